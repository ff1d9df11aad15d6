"""Secret scans: fixed patterns, and random-looking strings found by character Markov models.

Two first-order models, of random strings and of ordinary identifiers, are trained from labelled
samples.  A candidate token whose log-likelihood ratio exceeds the prior odds is reported as kind
`random`, unless it touches a span of the fixed patterns; those always stay.

DataFrame functions only.  The models are one table of (alphabet + 1) squared numbers.  Null and
empty texts have no spans; repeated rows are scanned alike; an empty table gives no rows; extra columns
are ignored; whole texts are scanned, however long.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import read_table, staged, text_rows

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_KEYWORD = r"(?i)password|passwd|secret|token|api_?key"
# longer-than-required runs only: a maximal run is one match either way
_ACCESS = r"AKIA[A-Z0-9]{16,}+"
_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
_CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "random")

#: Every other character counts as position 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_K = len(ALPHABET) + 1
#: Labelled training rows: so many documents at most (by hash of their id) and generated strings.
SAMPLE_DOCS = 2000
SAMPLE_RANDOM = 3000
#: Pseudo-counts that back a transition by the second character's own frequency.
BACKING = 4.0
#: Log prior odds against a candidate being a secret, and the ratio a character must have on average.
LOG_ODDS = math.log(1e6)
MEAN_RATIO = 0.7


def base_spans(text: Column) -> dict[str, Column]:
    assign = S.find_spans(text, _ASSIGN, _KEYWORD)
    return {
        "assign": F.filter(assign, lambda s: F.length(F.regexp_extract(s["match"], _ASSIGN, 1)) >= 6),
        "access": S.find_spans(text, _ACCESS),
        "hex": S.find_spans(text, _HEX),
    }


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, is_random): values of found secrets and generated strings against ordinary words.

    docs: doc_id, text.  At most SAMPLE_DOCS documents give tokens.
    """
    spark = docs.sparkSession
    # a few more by hash than asked for, so that only those meet in the sorted limit
    share = min(1.0, 1.3 * SAMPLE_DOCS / max(1, docs.count()))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    some = staged(docs.where(picked).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS), "secret-sample")
    b = base_spans(F.col("text"))
    found = some.select(F.explode(F.concat(*(F.transform(x, lambda s: F.regexp_extract(s["match"], r"([A-Za-z0-9+/_=-]+)$", 1)) for x in b.values()))).alias("token"), F.lit(True).alias("is_random"))
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", _ASSIGN, " "), _ACCESS, " "), _HEX, " ")
    words = some.select(F.explode(F.regexp_extract_all(cleaned, F.lit(r"[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("token"), F.lit(False).alias("is_random"))
    # generated: digits of hash values in base 64 (letters, digits, two signs) and in base 16
    n = F.col("id")
    raw = F.unhex(F.concat(F.sha2(n.cast("string"), 256)))
    made = spark.range(SAMPLE_RANDOM).select(F.when(n % 3 == 0, F.sha1(n.cast("string").cast("binary"))).when(n % 3 == 1, F.base64(raw)).otherwise(F.regexp_replace(F.base64(raw), "[+/=]", "")).alias("token"), F.lit(True).alias("is_random"))
    return found.unionByName(words).unionByName(made).where(F.length("token") > 1)


def train(samples: DataFrame) -> list[float]:
    """Log ratio of every transition, at _K * from + to.  The driver gets at most 2 * _K squared counts."""
    pair = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))
    pairs = samples.select("is_random", F.explode(pair).alias("pair"))
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring("pair", i, 1))
    counts = pairs.groupBy("is_random", place(1).alias("a"), place(2).alias("b")).agg(F.count("*").alias("n")).collect()
    seen = {True: [0.0] * (_K * _K), False: [0.0] * (_K * _K)}
    for r in counts:
        seen[r["is_random"]][_K * r["a"] + r["b"]] += r["n"]

    def chances(n: list[float]) -> list[float]:
        """Transitions, drawn towards how often a character follows at all."""
        after = [0.5 + sum(n[b::_K]) for b in range(_K)]
        total = sum(after)
        rows = [sum(n[_K * a : _K * a + _K]) + BACKING for a in range(_K)]
        return [(n[_K * a + b] + BACKING * after[b] / total) / rows[a] for a in range(_K) for b in range(_K)]

    return [math.log(x / y) for x, y in zip(chances(seen[True]), chances(seen[False]))]


def log_ratio(token: Column, model: list[float]) -> Column:
    table = F.from_json(F.lit(json.dumps([round(x, 5) for x in model])), "array<double>")
    step = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) * _K + F.instr(F.lit(ALPHABET), F.substring(token, i + 1, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, step(i)))


def with_spans(rows: DataFrame, model: list[float]) -> DataFrame:
    """rows (a column `text` without nulls, others are kept) with n_assign, n_access, n_hex, base and all spans.

    Spans are arrays of (start, rank, end, kind), sorted.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns]
    found = rows.select(*kept, *(c.alias(f"_{k}") for k, c in base_spans(F.col("text")).items()), S.find_spans(F.col("text"), _CANDIDATE).alias("_candidate"))
    found = found.withColumn("base", S.merged([S.tagged(F.col(f"_{k}"), k, i) for i, k in enumerate(KINDS[:3])]))
    free = S.outside(F.col("_candidate"), F.col("base"))

    def is_secret(s: Column) -> Column:
        ratio = log_ratio(s["match"], model)
        return (ratio >= LOG_ODDS) & (ratio >= MEAN_RATIO * (F.length(s["match"]) - 1))

    random = F.when(F.size("_candidate") > 0, F.filter(free, is_secret)).otherwise(F.array().cast(S.SPAN))
    found = found.withColumn("_added", S.tagged(random, "random", 3))
    spans = F.when(F.size("_added") > 0, S.merged([F.col("base"), F.col("_added")])).otherwise(F.col("base"))
    return found.select(*kept, *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]), "base", spans.alias("spans"))


def scan(docs: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text, n_assign, n_access, n_hex, base, spans."""
    rows = text_rows(docs, id_col, text_col)
    return with_spans(rows, model or train(labelled_samples(rows)))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, all columns, with every span replaced in the text and the length counted anew."""
    model = train(labelled_samples(text_rows(docs, id_col, text_col)))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = with_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text")), model)
    done = found.select("row", F.size("spans").alias("n"), redacted(F.col("text"), F.col("spans")).alias("text"))

    def column(c: str) -> Column:
        old = F.col(f"row.`{c}`")
        if c == text_col:
            return F.when(F.col("n") > 0, F.col("text")).otherwise(old).alias(c)
        if c == length_col:
            return F.when(F.col("n") > 0, F.length("text").cast(dict(docs.dtypes)[c])).otherwise(old).alias(c)
        return old.alias(c)

    return done.select(*map(column, docs.columns))


def redacted(text: Column, spans: Column) -> Column:
    """text with every span, or run of touching spans, replaced by [SECRET]."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = (s["start"] > acc["at"]) | (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.when(fresh, "[SECRET]").otherwise("")).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(S.listed(F.col("base")), 256).alias("base_sha256"), S.listed(F.col("spans")).alias("spans"))
