"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Every rule scores a document between 0 and 1, higher is worse.  Per stratum the rules' cutoffs are lowered
together along one path from loose to strict, and the exact (Clopper-Pearson) upper bound of the share of
good documents that any rule rejects is taken at each step until it exceeds ALPHA.  The path is laid
out without the good documents that the bound counts, so this is a fixed sequence of tests: all bounds
up to the first failure hold together with probability 1 - DELTA, which is split over the strata only.
Of those steps the one is chosen that rejects most bad documents, where a share of good ones weighs
COST times as much.  A rule that gains nothing is off; where fewer than least_labels() good documents are
labelled no step passes and all rules are off.

DataFrame functions only; the driver gets counts per stratum, rule and score bin, and per stratum and step.  A null text has
no words and fails the base rule; a null stratum is a stratum of its own; repeated rows are judged
alike; labels of unknown documents and null labels are ignored, of several labels the best counts.
Empty tables give no rows; no labels switch the learnt rules off.  Very long texts are measured whole.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read_table, staged

_SYMBOLS = r"[#*$%&|<>]"
_MARKS = r"[!?=_~^/{}\[\]@\\]"
WINDOW = 8
#: False rejections allowed per stratum, by any rule, and the chance that any stratum's bound fails.
ALPHA, DELTA = 0.02, 0.05
#: What rejecting a share of the good documents weighs against the same share of the bad ones.
COST = 20.0
BINS = 64
#: One in so many good documents only lays out the path where the other strata have too few for that.
HOLD = 5
#: Labelled ids are broadcast up to so many (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals", "n_marks", "n_repeat_words")
RULES = ("symbols", "capitals", "marks", "dup_lines", "repeats", "odd_lengths")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES, which replace columns of the same names.

    Windows of eight words are compared by 64-bit hashes built by doubling.  Only texts that hold a
    window twice take the sorted path, which costs n log n.
    """
    names = [c for c in docs.columns if c.lower() not in MEASURES]
    words, listed, h, w, at = fresh(docs, "_words", "_lines", "_h", "_w", "_at")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        *(F.col(f"`{c}`") for c in names),
        F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda x: x != "").alias(words),
        lines.alias(listed),
        F.regexp_count(t, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.regexp_count(t, F.lit(_MARKS)).cast("long").alias("n_marks"),
    )
    df = df.select(
        *(F.col(f"`{c}`") for c in names),
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
        "n_symbols",
        (F.size(listed) - F.size(F.array_distinct(listed))).cast("long").alias("n_dup_lines"),
        F.size(listed).cast("long").alias("n_lines"),
        "n_capitals",
        "n_marks",
        F.transform(words, lambda x: F.xxhash64(x)).alias(h),
    )
    kept = [c for c in df.columns if c != h]

    def doubled(d: DataFrame, by: int) -> DataFrame:
        n = F.greatest(F.size(h) - by, F.lit(0))
        pairs = F.zip_with(F.slice(h, 1, n), F.slice(h, by + 1, n), lambda a, b: F.xxhash64(a, b))
        return d.select(*(F.col(f"`{c}`") for c in kept), pairs.alias(h))

    for by in (1, 2, 4):
        df = doubled(df, by)
    # a window's place beside its hash, for the few texts that repeat one
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    df = df.select(*(F.col(f"`{c}`") for c in kept), F.when(repeats, placed).alias(w))
    n = F.size(w) - 1
    twins = F.flatten(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>"))))
    df = df.select(*(F.col(f"`{c}`") for c in kept), F.when(F.col(w).isNotNull(), F.array_sort(F.array_distinct(twins))).alias(at))
    m = F.greatest(F.size(at) - 1, F.lit(0))
    steps = F.zip_with(F.slice(at, 1, m), F.slice(at, 2, m), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda acc, s: acc + s)
    return df.select(*(F.col(f"`{c}`") for c in kept), F.when(F.col(at).isNotNull(), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def scores() -> dict[str, Column]:
    """By rule, from the columns of measured()."""
    share = lambda a, b: F.when(F.col(b) > 0, F.least(F.col(a) / F.col(b), F.lit(1.0))).otherwise(F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(5.0))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "capitals": share("n_capitals", "word_chars"),
        "marks": share("n_marks", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "odd_lengths": F.least(F.abs(mean - 5.5) / 20, F.lit(1.0)),
    }


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a rate of which k in n were seen: the p with P(X <= k) = delta."""
    if n == 0 or k >= n:
        return 1.0

    def cdf(p: float) -> float:
        at = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
        total, term, i = 1.0, 1.0, k
        while i > 0 and term > 1e-17 * total:  # from X = k downwards
            term *= i / (n - i + 1) * (1 - p) / p
            total += term
            i -= 1
        return math.exp(min(0.0, at + math.log(total)))

    low, high = k / n, 1.0 - 1e-12
    low = max(low, 1e-12)
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) > delta else (low, mid)
    return high


def least_labels(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """So many good documents must be labelled in a stratum before a rule can be on there."""
    return math.ceil(math.log(strata / delta) / -math.log1p(-alpha))


def path(good: list[dict[int, int]], bad: list[dict[int, int]]) -> list[tuple[int, int]]:
    """(rule, cut) in the order in which cutoffs are lowered, from counts by score bin of each rule.

    Only cuts at which another bad document falls.  Those above all of the good documents come first, the
    farthest above first; then by the share of good ones rejected.
    """
    steps = []
    for r, (g, b) in enumerate(zip(good, bad)):
        top, all_bad = max(g, default=0), max(1, sum(b.values()))
        for cut in (x - 1 for x in b if x > 0):
            rejected = sum(n for x, n in g.items() if x > cut) / max(1, sum(g.values()))
            caught = sum(n for x, n in b.items() if x > cut) / all_bad
            steps.append((rejected, -(cut + 1) / (top + 1), -caught, -cut, r))
    return [(r, -cut) for *_, cut, r in sorted(steps)]


def fit(features: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff: a document whose score exceeds it is rejected.

    features: doc_id, the stratum and measured() columns; labels: doc_id, quality.
    """
    best = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = features.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{stratum}`").alias("stratum"), *MEASURES).join(best, "doc_id").where(~base_failed())
    bins = F.array(*(F.ceil(c * BINS).cast("int") for c in scores().values()))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HOLD)) == 0
    known = staged(known.select(F.coalesce(F.col("stratum").cast("string"), F.lit("")).alias("stratum"), (F.col("quality") == 1).alias("good"), held.alias("held"), bins.alias("bins")), "quality-bins")

    counts = known.select("stratum", "good", "held", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "good", "held", "rule", "bin").agg(F.count("*").alias("n")).collect()
    strata = sorted({r["stratum"] for r in counts})

    def by_bin(wanted) -> list[dict[int, int]]:
        out: list[dict[int, int]] = [{} for _ in RULES]
        for r in counts:
            if wanted(r):
                out[r["rule"]][r["bin"]] = out[r["rule"]].get(r["bin"], 0) + r["n"]
        return out

    paths: dict[str, tuple[list[tuple[int, int]], bool]] = {}
    for s in strata:
        elsewhere, own, rest = (by_bin(w) for w in (lambda r: r["good"] and r["stratum"] != s, lambda r: r["good"] and r["stratum"] == s and r["held"], lambda r: r["good"] and r["stratum"] == s and not r["held"]))
        size = lambda x: sum(x[0].values())
        apart = size(elsewhere) < size(own) and size(rest) >= least_labels(len(strata), alpha, delta)
        paths[s] = path(own if apart else elsewhere, by_bin(lambda r: not r["good"] and r["stratum"] == s)), apart

    # the step of its stratum's path at which a document is first rejected
    at = F.lit(None).cast("int")
    for s, (steps, _) in paths.items():
        first = [[min((i for i, (rule, cut) in enumerate(steps) if rule == r and cut < x), default=len(steps)) for x in range(BINS + 1)] for r in range(len(RULES))]
        at = F.when(F.col("stratum") == s, F.least(*(F.element_at(F.array(*map(F.lit, f)), F.col("bins")[r] + 1) for r, f in enumerate(first)))).otherwise(at)
    table: dict[str, Counter] = {s: Counter() for s in strata}
    for r in known.groupBy("stratum", "good", "held", at.alias("at")).agg(F.count("*").alias("n")).collect():
        if not (r["good"] and r["held"] and paths[r["stratum"]][1]):
            table[r["stratum"]][r["good"], r["at"]] += r["n"]

    out: dict[str, dict[str, float]] = {}
    for s, (steps, _) in paths.items():
        n, bad = (sum(x for (good, _), x in table[s].items() if good is kind) for kind in (True, False))
        k = caught = 0
        best_gain = 0.0
        cutoffs: dict[str, float] = {}
        for i, (rule, cut) in enumerate(steps):
            k += table[s][True, i]
            caught += table[s][False, i]
            if binomial_upper(k, n, delta / len(strata)) > alpha:
                break
            cutoffs[RULES[rule]] = min(cut / BINS, cutoffs.get(RULES[rule], 1.0))
            gain = caught / max(1, bad) - COST * k / max(1, n)
            if gain > best_gain:
                best_gain = gain
                out[s] = dict(cutoffs)
    return out


def verdict(stratum: str, cutoffs: dict[str, dict[str, float]]) -> Column:
    """True if no learnt rule rejects the document."""
    s = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit(""))
    ok = F.lit(True)
    for rule, score in scores().items():
        limit = None
        for name, cuts in sorted(cutoffs.items()):
            if rule in cuts:
                here = s == name, F.lit(cuts[rule])
                limit = F.when(*here) if limit is None else limit.when(*here)
        if limit is not None:
            ok = ok & (score <= limit.otherwise(F.lit(1.0)))
    return ok


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that pass the base rule and the rules learnt from labels.

    Only labelled documents are measured for the cutoffs; their ids are broadcast up to BROADCAST_IDS.
    """
    marked = staged(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id")).distinct(), "quality-marked")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{stratum}`").cast("string").alias("stratum"), F.col(f"`{text_col}`").alias("text"))
    known = rows.drop("row").join(F.broadcast(marked) if marked.count() <= BROADCAST_IDS else marked, F.col("doc_id") == F.col("_id"), "left_semi")
    cutoffs = fit(staged(measured(known).drop("text"), "quality-known"), labels, "stratum")
    # a row number in the condition keeps it above the measuring steps, which would else be repeated inside it
    numbered = measured(rows).withColumn("_nth", F.monotonically_increasing_id())
    return numbered.where(~base_failed() & verdict("stratum", cutoffs) & (F.col("_nth") >= 0)).select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    features = staged(measured(docs).drop("text"), "quality")
    cutoffs = fit(features, read_table(spark, sf_dir, "labels"), "lang")
    kept = ~base_failed() & verdict("lang", cutoffs)
    return features.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))
