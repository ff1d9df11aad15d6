"""Spans of regular-expression matches as DataFrame expressions, in code points.

Splitting at a pattern gives the texts between its matches; their lengths and the matches' lengths
add up to every match's place.  No Python runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string>>"


#: Matches added up at once; longer lists are cut into blocks, so the work stays near-linear.
BLOCK = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(steps: Column, begin: Column) -> Column:
    """Spans of (gap, match) steps, the first gap starting at begin."""
    zero = F.struct(begin.alias("at"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.length(s["match"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), s["match"].alias("match")))).alias("found"))

    return F.aggregate(steps, zero, step, lambda acc: acc["found"])


def _placed_in_blocks(steps: Column) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))

    def each(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, s: acc + s["gap"] + F.length(s["match"])))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), F.slice(begins, 1, F.size(parts)).alias("b")), lambda x: _placed(x["p"], x["b"])))

    return _once(blocks, each)


def find_spans(text: Column, pattern: str, only_if: str | None = None) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches; end is exclusive.

    only_if: a cheaper pattern that every text with a wanted match contains.
    Null or empty text gives an empty array.  Matches must not be empty.
    """

    def steps(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        return F.zip_with(gaps, matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("match")))

    listed = _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), steps)
    placed = _once(listed, lambda s: F.when(F.size(s) <= BLOCK, _placed(s, F.lit(0))).otherwise(_placed_in_blocks(s)))
    return F.when(text.rlike(only_if or pattern), placed).otherwise(F.array().cast(SPAN))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """array<struct<start, rank, end, kind>>: sorts by start, then kind as listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def merged(parts: Sequence[Column]) -> Column:
    return F.array_sort(F.concat(*parts))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted tagged spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def outside(spans: Column, taken: Column) -> Column:
    """Those of spans that touch none of taken."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(match: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    reversed_digits = F.reverse(digits(match))
    n = F.length(reversed_digits)

    def worth(i: Column) -> Column:
        d = F.substring(reversed_digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i))
    return n.between(12, 19) & F.when(n.between(12, 19), total % 10 == 0).otherwise(False)

