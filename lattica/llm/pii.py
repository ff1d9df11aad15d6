"""Personal data: fixed patterns, and further spans by weak supervision.

Labelers (format checks as regular expressions, gazetteers of providers, area codes, bank countries, makers,
names and places, words of the context) vote on candidate spans.  Expectation-maximisation over the counts of vote patterns estimates every labeler's
reliability and each pattern's posterior; a naive-Bayes span classifier is then trained on the
posteriors with the span's shape as a further feature.  Candidates it accepts are added, and so is
every clear one (strict format, a word that names it, no vote against), whatever else the table
holds; the spans of the fixed patterns always stay.

DataFrame functions only; the driver gets one count per (kind, votes, shape), a bounded table.
Null and empty texts have no spans; repeated rows are scanned alike; extra columns are ignored;
whole texts are scanned, however long.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .common import read_table, staged, text_rows

# Possessive forms match the same spans as greedy ones here, without deep recursion or rescans of long runs.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")

#: Patterns of further candidates, by kind.
CANDIDATES = {
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{2,63}+(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z0-9-]{2,63}+)+",
    "local_phone": r"(?<![0-9A-Za-z+./-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z./-])",
    "national_id": r"(?<![0-9A-Za-z./-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z./-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "mac": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])",
}
EXTRA = tuple(CANDIDATES)
#: Stricter formats: the regular-expression labeler's approval.
STRICT = {
    "spelled_email": r"(?i)\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$",
    "local_phone": r"^(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)",
    "mac": r"^(?!(?:00:){5}00|(?i:ff:){5}(?i:ff)).",
}
#: Gazetteers.  Given names, cities, mail providers, area codes of large cities, makers' prefixes of network cards.
NAMES = "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna peter maria hans klaus petra monika jean marie pierre sophie luis carmen jose ana juan pablo lucia emma olivia".split()
PLACES = "london paris berlin madrid rome vienna munich hamburg barcelona lyon marseille valencia seville cologne frankfurt chicago boston houston dallas seattle denver miami atlanta phoenix detroit".split()
PROVIDERS = "gmail googlemail yahoo outlook hotmail icloud proton protonmail aol gmx web t-online orange laposte libero telefonica".split()
AREAS = "202 205 206 212 213 214 215 216 303 305 310 312 313 314 404 408 412 414 415 469 480 503 504 510 512 602 612 614 615 617 619 646 650 702 713 718 720 773 801 816 818 832 858 901 904 916 917 919 949 972".split()
MAKERS = "00:1a:2b 00:1b:63 00:1c:b3 00:50:56 00:0c:29 00:15:5d 08:00:27 3c:5a:b4 a4:83:e7 b8:27:eb dc:a6:32 f0:18:98 f4:f5:d8 fc:fb:fb".split()
_PERSON = rf"(?i)\b(?:{'|'.join(NAMES + PLACES)})\b"
#: What the gazetteer labeler looks for in a span, or around it.
LISTED = {
    "spelled_email": (True, rf"(?i)(?:{'|'.join(PROVIDERS)})"),
    "local_phone": (True, rf"^\(?(?:{'|'.join(AREAS)})"),
    "national_id": (False, _PERSON),
    "iban": (False, _PERSON),
    "mac": (True, rf"(?i)^(?:{'|'.join(MAKERS)})"),
}
#: Context: words that name the kind of data, looked for up to CONTEXT characters before a span.
CUES = {
    "spelled_email": r"(?i)\be?-?mail|contact|write|reach|correo|courriel|kontakt",
    "local_phone": r"(?i)\btel|phone|mobile|\bcell|\bcall|\bfax|telefon|teléfono|téléphone",
    "national_id": r"(?i)\bssn\b|social security|national id|tax id|identity",
    "iban": r"(?i)\biban\b|account|konto|cuenta|compte|\bbank",
    "mac": r"(?i)\bmac\b|hardware address|ethernet|device",
}
#: Context of other numbers, right before a span.
ANTI = r"(?i)\b(?:isbn|issn|doi|version|ver|rev|build|order|invoice|part|serial|sku|page|chapter|figure|table|section|vol|no)\b[^A-Za-z]*$"
CONTEXT = 40
LABELERS = 5
#: A span is added if the classifier is at least so sure.
SURE = 0.95
#: Before any vote: the share of candidates that is personal data, and how often a labeler that votes is right.
PRIOR, RELIABLE, ROUNDS = 0.2, 0.8, 30
#: Least probability of a clear span: strict format and context for, no labeler against.
CLEAR = 0.98
#: Most probability of a span that the context or its own form speaks against.
VETOED = 0.5


def base_spans(text: Column) -> dict[str, Column]:
    card = S.find_spans(text, _CARD, r"[0-9](?:[\x20-]?[0-9]){11}")
    phone = S.find_spans(text, _PHONE)
    return {
        "email": S.find_spans(text, _EMAIL, "@"),
        "ip": F.filter(S.find_spans(text, _IP, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda s: s["match"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter(card, lambda s: S.passes_luhn(s["match"])),
        "phone": F.filter(phone, lambda s: F.length(S.digits(s["match"])).between(9, 15)),
    }


def _votes(kind: str, text: Column, s: Column) -> Column:
    """One digit per labeler, 0 against, 1 abstains, 2 for: strict format, context, other context, placeholder, gazetteer."""
    lead = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
    vote = lambda yes, no=None: F.when(yes, "2").when(no if no is not None else F.lit(False), "0").otherwise("1")
    distinct = F.size(F.array_distinct(F.split(F.regexp_replace(F.lower(s["match"]), "[^0-9a-z]", ""), "")))
    return F.concat(
        vote(s["match"].rlike(STRICT[kind]), ~s["match"].rlike(STRICT[kind])),
        vote(lead.rlike(CUES[kind])),
        vote(F.lit(False), lead.rlike(ANTI)),
        vote(F.lit(False), distinct <= 3),  # one character repeated: a placeholder
        vote((s["match"] if LISTED[kind][0] else lead).rlike(LISTED[kind][1])),
    )


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start, rank, end, kind, votes, shape>> of candidates that touch no base span."""
    def judged(i: int, kind: str) -> Column:
        def one(s: Column) -> Column:
            shape = F.least(F.floor(F.length(s["match"]) / 8), F.lit(5)).cast("int")
            return F.struct(s["start"].alias("start"), F.lit(len(KINDS) + i).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), _votes(kind, text, s).alias("votes"), shape.alias("shape"))

        return F.transform(S.outside(S.find_spans(text, CANDIDATES[kind]), base), one)

    parts = [judged(i, kind) for i, kind in enumerate(EXTRA)]
    return F.concat(*parts)


def is_clear(votes: str) -> bool:
    return votes.startswith("22") and "0" not in votes


def is_vetoed(votes: str) -> bool:
    """The context says that it is another number, or it is a placeholder."""
    return "0" in votes[2:4]


def estimate(counts: dict[tuple[str, str, int], int]) -> dict[tuple[str, str, int], float]:
    """Probability of being personal data by (kind, votes, shape), from their counts alone.

    EM per kind over two classes; a labeler's reliabilities are its chances of each vote in each
    class, smoothed towards RELIABLE.  With few candidates the prior beliefs decide.  No vote
    for (against) makes a span less (more) likely, so the classes can't change places where one of
    them has few votes.  Clear spans have at least CLEAR, vetoed ones at most VETOED.
    """
    out = {}
    for kind in {k for k, _, _ in counts}:
        rows = [(v, s, n) for (k, v, s), n in counts.items() if k == kind]
        prior = PRIOR
        # strength of the belief that votes are right, in pseudo-counts
        belief = [{True: {"2": RELIABLE * 8, "1": 8.0, "0": (1 - RELIABLE) * 8}, False: {"2": (1 - RELIABLE) * 8, "1": 8.0, "0": RELIABLE * 8}} for _ in range(LABELERS)]
        chance = [{c: {v: x / sum(b[c].values()) for v, x in b[c].items()} for c in b} for b in belief]

        def weight(i: int, vote: str) -> float:
            w = math.log(chance[i][True][vote] / chance[i][False][vote])
            return max(0.0, w) if vote == "2" else min(0.0, w) if vote == "0" else w

        def posterior(votes: str) -> float:
            odds = math.log(prior / (1 - prior)) + sum(weight(i, v) for i, v in enumerate(votes))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

        for _ in range(ROUNDS):
            p = {v: posterior(v) for v, _, _ in rows}
            total = sum(n for _, _, n in rows)
            yes = sum(n * p[v] for v, _, n in rows)
            prior = min(0.95, max(0.01, (yes + 20 * PRIOR) / (total + 20)))
            for i in range(LABELERS):
                for c in (True, False):
                    mass = dict(belief[i][c])
                    for v, _, n in rows:
                        mass[v[i]] += n * (p[v] if c else 1 - p[v])
                    chance[i][c] = {v: x / sum(mass.values()) for v, x in mass.items()}
        # the span classifier: labelers and shape, trained on the posteriors
        p = {v: posterior(v) for v, _, _ in rows}
        shape: dict[bool, dict[int, float]] = {c: defaultdict(lambda: 5.0) for c in (True, False)}
        for v, s, n in rows:
            shape[True][s] += n * p[v]
            shape[False][s] += n * (1 - p[v])
        size = {c: sum(shape[c].values()) + 5.0 * (6 - len(shape[c])) for c in shape}
        for v, s, _ in rows:
            odds = math.log(max(p[v], 1e-12) / max(1 - p[v], 1e-12)) + math.log(shape[True][s] / size[True]) - math.log(shape[False][s] / size[False])
            found = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            out[kind, v, s] = max(found, CLEAR) if is_clear(v) else min(found, VETOED) if is_vetoed(v) else found
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts, base and all spans (array of start, rank, end, kind, sorted).  Texts are read once."""
    rows = text_rows(docs, id_col, text_col)
    found = rows.select("doc_id", "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    base = S.merged([S.tagged(F.col(k), k, i) for i, k in enumerate(KINDS)])
    found = found.select("doc_id", "text", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base"))
    found = staged(found.withColumn("candidates", candidates(F.col("text"), F.col("base"))).drop("text"), "pii-spans")

    votes = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count("*").alias("n")).collect()
    sure = sorted(f"{k}:{v}:{s}" for (k, v, s), p in estimate({(r["kind"], r["votes"], r["shape"]): r["n"] for r in votes}).items() if p >= SURE)
    accepted = F.filter("candidates", lambda c: F.array_contains(F.array(*map(F.lit, sure)) if sure else F.array().cast("array<string>"), F.concat_ws(":", c["kind"], c["votes"], c["shape"])))
    added = F.transform(accepted, lambda c: F.struct(c["start"], c["rank"], c["end"], c["kind"]))
    both = F.when(F.size("candidates") > 0, S.merged([F.col("base"), added])).otherwise(F.col("base"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base", both.alias("spans"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(S.listed(F.col("base")), 256).alias("base_sha256"), S.listed(F.col("spans")).alias("spans"))
