"""Scores of predicted graphs against targets, by names and by structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _guarded(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Micro precision, recall and F1 of summed counts."""
    p, r = _guarded(tp, tp + fp), _guarded(tp, tp + fn)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_guarded(2 * p * r, p + r), 6).alias("f1")]


def set_match(predicted: DataFrame, target: DataFrame, id_col: str, key: list[str]) -> DataFrame:
    """JO12, AG20: per record tp, fp (fabricated) and fn (missing) of distinct keys."""
    p = predicted.select(id_col, *key).distinct().withColumn("in_p", F.lit(1))
    t = target.select(id_col, *key).distinct().withColumn("in_t", F.lit(1))
    both = p.join(t, [id_col, *key], "full")
    n = lambda c: F.count_if(c)
    return both.groupBy(id_col).agg(n(F.col("in_p").isNotNull() & F.col("in_t").isNotNull()).alias("tp"), n(F.col("in_t").isNull()).alias("fp"), n(F.col("in_p").isNull()).alias("fn"))


def multiset_match(predicted: DataFrame, target: DataFrame, id_col: str, key: list[str]) -> DataFrame:
    """AG16: per record the multiset counterparts, tp = sum of the lesser counts."""
    p = predicted.groupBy(id_col, *key).agg(F.count("*").alias("p"))
    t = target.groupBy(id_col, *key).agg(F.count("*").alias("t"))
    zero = F.lit(0).cast("long")
    both = p.join(t, [id_col, *key], "full").select(id_col, F.coalesce("p", zero).alias("p"), F.coalesce("t", zero).alias("t"))
    return both.groupBy(id_col).agg(F.sum(F.least("p", "t")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("t"), zero)).alias("fp"), F.sum(F.greatest(F.col("t") - F.col("p"), zero)).alias("fn"))


def micro(matches: DataFrame) -> DataFrame:
    """AG15: one row over all records."""
    s = matches.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return s.select("tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def exact(matches: DataFrame) -> DataFrame:
    """AG19: the share of records without any difference."""
    hit = F.count_if((F.col("fp") == 0) & (F.col("fn") == 0))
    return matches.agg(F.count("*").alias("records"), hit.alias("exact"), F.round(_guarded(hit, F.count("*")), 6).alias("rate"))


def rates(outputs: DataFrame, flags: list[str], parsed: str) -> DataFrame:
    """AG17: every flag's rate over all records and over the parsed ones."""
    n, ok = F.count("*"), F.count_if(F.col(parsed))
    cols = [F.count_if(F.col(f)).alias(f"n_{f}") for f in flags]
    one = outputs.agg(n.alias("records"), ok.alias("parsed"), *cols)
    return one.select("records", "parsed", *(F.round(_guarded(F.col(f"n_{f}"), F.col(d)), 6).alias(f"{f}_of_{d}") for f in flags for d in ("records", "parsed")))


def count_error(predicted: DataFrame, target: DataFrame, id_col: str, column: str) -> DataFrame:
    """AG18: mean absolute difference."""
    both = predicted.select(id_col, F.col(column).alias("p")).join(target.select(id_col, F.col(column).alias("t")), id_col)
    return both.agg(F.count("*").alias("records"), F.round(F.avg(F.abs(F.col("p") - F.col("t"))), 6).alias("mean_error"))
