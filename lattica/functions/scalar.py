"""Scalar functions of the graph domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def _first_word(text: Column, words: dict[str, str]) -> Column:
    """The value of the first word that text contains, in the words' order; else null."""
    out = F.lit(None).cast("string")
    for word, value in reversed(words.items()):
        out = F.when(text.contains(word), F.lit(value)).otherwise(out)
    return out


def instruction(domain: Column, style: Column, cloud: Column, constraints: Column) -> Column:
    """PR1: one sentence part per metadata field that is there."""
    part = lambda head, value, tail="": F.when(F.length(value) > 0, F.concat(F.lit(head), value, F.lit(tail)))
    listed = F.when(F.size(constraints) > 0, F.concat(F.lit("satisfying: "), F.array_join(constraints, ", ")))
    return F.concat(F.concat_ws(". ", part("Design a ", domain, " architecture"), part("using a ", style, " style"), part("deployed on ", cloud), listed), F.lit("."))


def sample_id(n: Column) -> Column:
    """PR2: at least six digits; longer numbers stay whole."""
    return F.format_string("CSA-%06d", n)


def sample_number(sample: Column) -> Column:
    """PR2 back."""
    return F.split(sample, "-")[1].cast("int")


def clean_label(text: Column) -> Column:
    """PR7."""
    for a, b in (("#quot;", '"'), ("#amp;", "&"), ("#39;", "'")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(text)


def derive_type(node_id: Column, label: Column | None = None) -> Column:
    """PR8."""
    text = F.lower(F.concat_ws(" ", node_id, F.lit("") if label is None else label))
    return F.coalesce(_first_word(text, dims.TYPE_WORDS), F.lit(dims.DEFAULT_TYPE))


def normal_type(raw: Column, node_id: Column) -> Column:
    """PR9: a known type or alias, else derived from the id."""
    low = F.lower(F.trim(raw))
    aliased = F.coalesce(_first_equal(low, dims.TYPE_ALIASES), low)
    return F.when(aliased.isin(dims.NODE_TYPES), aliased).otherwise(derive_type(node_id))


def _first_equal(text: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(text == key, F.lit(value)).otherwise(out)
    return out


def normal_label(raw: Column) -> Column:
    """PR10: null if no word maps it."""
    return _first_word(F.lower(F.trim(raw)), dims.LABEL_WORDS)


def infer_label(source_type: Column, target_type: Column, current: Column | None = None) -> Column:
    """PR11: the label at hand, else by the types of the ends."""
    by_type = (
        F.when((source_type == "service") & (target_type == "database"), "DB Query")
        .when((source_type == "service") & (target_type == "queue"), "Async")
        .when((source_type == "service") & (target_type == "cache"), "Cache")
        .otherwise(dims.DEFAULT_LABEL)
    )
    return by_type if current is None else F.coalesce(normal_label(current), by_type)


def parse_failure(raw: Column) -> Column:
    """PR15."""
    count = lambda c: F.length(raw) - F.length(F.replace(raw, F.lit(c), F.lit("")))
    return (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "EMPTY_OUTPUT")
        .when(~raw.contains("{"), "NO_JSON")
        .when(count("{") > count("}"), "INCOMPLETE_JSON")
        .otherwise("OTHER_PARSE")
    )


def icon(node_id: Column) -> Column:
    """PR16."""
    return _first_word(F.lower(node_id), {w: w for w in dims.ICONS})


def layer(node_type: Column) -> Column:
    return F.coalesce(_first_equal(node_type, dims.TYPE_LAYER), F.lit("service"))


def dashed(label: Column) -> Column:
    return F.coalesce(label.isin(dims.DASHED_LABELS), F.lit(False))


def edge_key(source: Column, target: Column, label: Column) -> Column:
    """PR18."""
    return F.concat(source, F.lit("->"), target, F.lit("["), label, F.lit("]"))


def bucket(n: Column, buckets=tuple(dims.SIZE_BUCKETS)) -> Column:
    """PR19: closed ranges; null outside all."""
    out = F.lit(None).cast("string")
    for name, low, high in buckets:
        out = F.when(n.between(low, high), F.lit(name)).otherwise(out)
    return out


def token_length(text: Column) -> Column:
    """PR20: a stand-in where no tokenizer is given."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3.5).cast("int"))


def matches(node_id: Column, words: list[str]) -> Column:
    """PR21: how many of the words the id contains."""
    low = F.lower(node_id)
    total = F.lit(0)
    for w in words:
        total = total + low.contains(w).cast("int")
    return total


def ratio(a: Column, b: Column) -> Column:
    """PR27."""
    return F.round(a / F.greatest(F.lit(1), b), 4)


def english_list(items: Column) -> Column:
    """PR23, PR24: "a, b and c"."""
    n = F.size(items)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(items, F.lit(0)))
        .otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(items, -1)))
    )


def insert_after(text: Column, anchor: str, addition: str) -> Column:
    """PR5: behind the first occurrence; an error without one."""
    at = F.instr(text, anchor)
    done = F.concat(F.substring(text, F.lit(1), at + len(anchor) - 1), F.lit(addition), F.substring(text, at + len(anchor), F.length(text)))
    return F.when(at > 0, done).otherwise(F.raise_error(F.lit(f"anchor missing: {anchor}")))


def render(template: str, description: Column) -> Column:
    """PR4."""
    return F.replace(F.lit(template), F.lit("{description}"), F.trim(description))


def id_style(node_id: Column) -> Column:
    """DO2."""
    return (
        F.when(node_id.rlike("^[A-Z0-9_]+$") & node_id.rlike("[A-Z]"), "ALL_CAPS")
        .when(node_id.rlike("^[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$"), "camelCase")
        .when(node_id.rlike("^[a-z0-9_]+$"), "lower_underscore")
        .otherwise("other")
    )
