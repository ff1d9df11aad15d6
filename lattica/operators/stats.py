"""Corpus statistics: frequencies, distributions, duplicates, sets, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.staging import staged


def frequency(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """AG1."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """AG1: ties by value, so the cut is the same everywhere."""
    return frequency(df, column).orderBy(F.desc("n"), "value").limit(n)


def summary(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """AG2, AG4: count, min, max, mean and interpolated percentiles, rounded; AG2' with one digit.

    Percentiles are found in a running count of the distinct values, so no task holds all of them.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("c"))
    upto = staged(numbered(counts, ["x"], "upto", weight="c"), "running")
    one = upto.agg(F.sum("c").alias("n"), F.sum(F.col("x") * F.col("c")).alias("total"))
    ranks = {f"p{p}": (F.col("n") - 1) * F.lit(p / 100) for p in (50, 75, 90, 95, 99)}
    sides = [F.min(F.when(F.col("upto") > f(rank), F.col("x"))).alias(f"{name}_{f.__name__}") for name, rank in ranks.items() for f in (F.floor, F.ceil)]
    found = upto.join(F.broadcast(one)).agg(F.any_value("n").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.any_value("total").alias("total"), *sides)
    between = lambda name, rank: F.col(f"{name}_floor") + (F.col(f"{name}_ceil") - F.col(f"{name}_floor")) * (rank - F.floor(rank))
    kind = dict(df.dtypes)[column]
    return found.select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("low").cast(kind).alias("low"), F.col("high").cast(kind).alias("high"), F.round(F.col("total") / F.col("n"), digits).alias("mean"), *(F.round(between(n, r), digits).alias(n) for n, r in ranks.items()))


def upper_median(df: DataFrame, column: str, *key: str) -> DataFrame:
    """AG3: the element at n div 2 of the sorted values, found from a running count of distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*key, column).agg(F.count("*").alias("c"))
    if not key:
        upto = staged(numbered(counts, [column], "upto", weight="c"), "running")
        return upto.join(F.broadcast(upto.agg(F.sum("c").alias("total")))).where("upto > total div 2").agg(F.min(column).alias("upper_median"))
    upto = F.sum("c").over(Window.partitionBy(*key).orderBy(column))
    total = F.sum("c").over(Window.partitionBy(*key))
    at = counts.select(*key, column, upto.alias("upto"), total.alias("total")).where("upto > total div 2")
    return at.groupBy(*key).agg(F.min(column).alias("upper_median"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """AG5: equal widths from least to largest, the last bin closed."""
    ends = F.broadcast(df.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")))
    x = F.col(column).cast("double")
    at = F.least(F.lit(bins - 1), F.floor((x - F.col("low")) * bins / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)))).cast("int")
    return df.where(F.col(column).isNotNull()).join(ends).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def extremes(df: DataFrame, key: str, column: str) -> DataFrame:
    """AG6: keys of the largest and least value, the first key of equals."""
    return df.agg(F.min_by(key, F.struct(-F.col(column), F.col(key))).alias("largest"), F.min_by(key, F.struct(F.col(column), F.col(key))).alias("least"))


def cumulative(df: DataFrame, column: str, limits: list[int]) -> DataFrame:
    """AG7: how many values, and which share, are at most each limit; one pass."""
    counts = df.agg(F.count(column).alias("total"), *(F.count_if(F.col(column) <= x).alias(f"c{x}") for x in limits))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("at_most"), F.col(f"c{x}").alias("n"), F.round(100 * F.col(f"c{x}") / F.greatest(F.lit(1), F.col("total")), 2).alias("pct")) for x in limits))).alias("r")
    return counts.select(rows).select("r.*")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """AG8."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def count_of_counts(df: DataFrame, key: str) -> DataFrame:
    """AG9."""
    return df.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, key: Column) -> DataFrame:
    """AG12, DD2 to DD5: groups of equal keys and the records in them."""
    groups = df.groupBy(key.alias("k")).agg(F.count("*").alias("size")).where("size > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("records"), F.coalesce(F.max("size"), F.lit(0).cast("long")).alias("largest"))


def singleton_rate(df: DataFrame, column: str) -> DataFrame:
    """AG13: values that occur once, over all slots."""
    counts = df.groupBy(column).agg(F.count("*").alias("c"))
    return counts.agg(F.count("*").alias("distinct_values"), F.count_if(F.col("c") == 1).alias("singletons"), F.round(F.count_if(F.col("c") == 1) / F.greatest(F.lit(1), F.sum("c")), 6).alias("rate"))


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """WI5, DD1, DO3: the first row of every key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("nth", nth).where("nth = 1").drop("nth")


def near_pairs(sets: DataFrame, key: str, id_col: str, items: str, threshold: float) -> DataFrame:
    """JO11, SE5: pairs of one key whose item sets reach the Jaccard threshold; two empty sets are alike.

    Two sets that reach it share one of their least `size - ceil(threshold * size) + 1` items, so records
    meet by key and such an item only; empty sets meet by key.
    """
    keep = F.size("s") - F.ceil(F.size("s") * threshold - 1e-9) + 1
    first = F.when(F.size("s") == 0, F.array(F.lit(None).cast(sets.schema[items].dataType.elementType))).otherwise(F.slice("s", F.lit(1), F.greatest(keep, F.lit(1)).cast("int")))
    rows = sets.select(F.col(key).alias("k"), F.col(id_col).alias("i"), F.array_sort(F.array_distinct(items)).alias("s"))
    met = rows.select("k", "i", F.explode(first).alias("item"))
    pairs = met.alias("a").join(met.alias("b"), (F.col("a.k") == F.col("b.k")) & F.col("a.item").eqNullSafe(F.col("b.item")) & (F.col("a.i") < F.col("b.i"))).select(F.col("a.k").alias("k"), F.col("a.i").alias("a"), F.col("b.i").alias("b")).distinct()
    side = lambda c: rows.select("k", F.col("i").alias(c), F.col("s").alias(f"s_{c}"))
    both = pairs.join(side("a"), ["k", "a"]).join(side("b"), ["k", "b"])
    union = F.size(F.array_union("s_a", "s_b"))
    j = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("s_a", "s_b")) / union)
    return both.select("a", "b", F.round(j, 6).alias("jaccard")).where(F.col("jaccard") >= threshold)


def containing(texts: DataFrame, id_col: str, text_col: str, passages: DataFrame, passage_id: str, passage_col: str) -> DataFrame:
    """FI8: (id, passage id) of texts that hold a whole passage.

    A text that holds a passage has the passage's inner words (between spaces) as words of its own, so
    the two meet by the first three of them and only then by the whole passage.  Passages of fewer words
    meet all texts; they are few.
    """
    words = lambda c: F.split(c, " ", -1)
    p = passages.select(F.col(passage_id), F.col(passage_col).alias("_passage"), words(F.col(passage_col)).alias("_w")).where("_passage IS NOT NULL")
    anchored = p.where(F.size("_w") >= 5).select(passage_id, "_passage", F.xxhash64(F.slice("_w", 2, 3)).alias("_at"))
    t = texts.select(F.col(id_col), F.col(text_col).alias("_text"), words(F.col(text_col)).alias("_w"))
    places = F.sequence(F.lit(1), F.greatest(F.size("_w") - 2, F.lit(1)))
    here = t.select(id_col, F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.slice("_w", i, F.lit(3)))))).alias("_at"))
    met = here.join(anchored.select("_at", passage_id), "_at").select(id_col, passage_id).distinct()
    long = met.join(anchored.select(passage_id, "_passage"), passage_id).join(t.select(id_col, "_text"), id_col).where(F.col("_text").contains(F.col("_passage"))).select(id_col, passage_id)
    short = p.where(F.size("_w") < 5).select(passage_id, "_passage")
    return long.unionByName(t.join(short, F.col("_text").contains(F.col("_passage"))).select(id_col, passage_id)).distinct()


def markers(df: DataFrame, id_col: str, fields: dict[str, str], words: list[str], examples: int = 3) -> DataFrame:
    """FI8, AG24: per field and marker, the records that contain it and the first ids.

    One pass: every row explodes only the markers it contains.
    """
    hits = F.array_compact(F.array(*(F.when(F.lower(F.col(c)).contains(w), F.struct(F.lit(f).alias("field"), F.lit(w).alias("marker"))) for f, c in fields.items() for w in words)))
    rows = df.select(F.col(id_col).alias("id"), F.explode(hits).alias("h")).select("id", "h.*")
    nth = F.row_number().over(Window.partitionBy("field", "marker").orderBy("id"))
    counts = rows.groupBy("field", "marker").agg(F.count("*").alias("records"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= examples).groupBy("field", "marker").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    return counts.join(first, ["field", "marker"])


def allocate(df: DataFrame, stratum: str, id_col: str, n: int) -> DataFrame:
    """SP1, WI7, WI8: at least one row of each stratum, the rest by largest remainder; least ids first."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    everywhere = Window.partitionBy(F.lit(0))  # one row per stratum
    strata, total = F.count("*").over(everywhere), F.sum("size").over(everywhere)
    base = sizes.select("*", strata.alias("strata"), total.alias("total"))
    budget = F.greatest(F.lit(n) - F.col("strata"), F.lit(0))
    quota = budget * (F.col("size") - 1) / F.greatest(F.col("total") - F.col("strata"), F.lit(1))
    base = base.select(stratum, "size", "total", budget.alias("budget"), quota.alias("quota"), F.floor(quota).alias("whole"))
    left = F.col("budget") - F.sum("whole").over(everywhere)
    nth = F.row_number().over(everywhere.orderBy(F.desc(F.col("quota") - F.col("whole")), stratum))
    take = base.select(stratum, "size", F.when(F.lit(n) >= F.col("total"), F.col("size")).otherwise(1 + F.col("whole") + F.when(nth <= left, 1).otherwise(0)).alias("take"))
    before = F.coalesce(F.sum("size").over(everywhere.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = take.select(F.col(stratum).alias("_stratum"), "take", before.alias("before"))
    # strata follow each other in one global numbering, so a large one is no single task
    placed = numbered(df, [stratum, id_col], "place").join(take, F.col(stratum).eqNullSafe(F.col("_stratum")))
    return placed.where("place - before <= take").drop("place", "take", "before", "_stratum")


def merged_ratios(df: DataFrame, key: str, pair: str) -> DataFrame:
    """AG22: [numerator, denominator] pairs added up by key, and their ratio."""
    one = df.groupBy(key).agg(F.sum(F.get(pair, F.lit(0))).alias("num"), F.sum(F.get(pair, F.lit(1))).alias("den"))
    return one.withColumn("ratio", F.round(F.col("num") / F.greatest(F.lit(1), F.col("den")), 4))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """SK8, QG4, DO4: rows_read and a digest of a table that does not depend on the order of its rows.

    It adds up two 60-bit parts of every row's SHA-256.
    """
    h = F.sha2(F.concat_ws("|", *columns), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows_read"), F.concat_ws(":", part(1), part(16)).alias("digest"))


def hash_split(df: DataFrame, id_col: str, share: float = 0.85) -> DataFrame:
    """SP6: train or holdout by the id's hash."""
    x = F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.select(id_col, F.when(x < share, "train").otherwise("holdout").alias("split"))


def seeded_sample(df: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """SP5: the n least hashes of seed and id."""
    return df.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256)).orderBy("h", id_col).limit(n).drop("h")


def numbered(df: DataFrame, order: list[str], name: str = "n", weight: str | None = None) -> DataFrame:
    """WI2, WI6, WI11: consecutive numbers from 1 in a global order, without one task for all rows.

    Ranges are numbered on their own and shifted by the rows before them.  weight: a running sum of that
    column instead, each row's own included.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parted = staged(ranged.withColumn("_part", F.spark_partition_id()), "numbered")  # bounds are sampled: fix them
    within = Window.partitionBy("_part").orderBy(*order)
    own = F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(within)
    local = parted.withColumn("_local", own)
    before = F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = local.groupBy("_part").agg(F.max("_local").cast("long").alias("c")).select("_part", F.coalesce(before, F.lit(0).cast("long")).alias("_before"))
    return local.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")
