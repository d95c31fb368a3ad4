"""Personal data in texts: labelers vote, their reliabilities are estimated, a classifier decides.

Candidates are spans of patterns: the base kinds with their fixed checks, and further kinds that may
or may not be personal data.  Labelers vote yes, no or nothing on each: a strict pattern, gazetteers,
words nearby, and how the span stands in its text.  Expectation-maximisation over the counts of the
vote patterns estimates how often each labeler is right (per yes and no, as in Dawid and Skene),
which gives every pattern a probability.  A logistic regression fitted to those probabilities judges the
candidates of the further kinds; base spans that pass their checks always stay.  All work on texts is SQL
functions; the driver sees one row per vote pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import kept

# The base patterns.  Quantifiers are possessive and starts guarded where that changes no match,
# so that long runs cost one pass.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+.(-])(?<!\+[0-9]\x20)(?<!\+[0-9]{2}\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "social": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?![0-9A-Za-z])",
    "spelled_email": rf"(?<!{_LOCAL})[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?{_HOST}++(?:(?:\x20?[\[(]dot[\])]\x20?|\.){_HOST}++)++",
}
#: A text without this holds no match.
_HINTS = {"email": "@", "ip": ".", "phone": "+", "spelled_email": "at"}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)

# Words that speak for or against personal data near a span, and calling codes and domains known.
_FOR = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|login|adresse",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": r"phone|tel|call|fax|mobile|contact|number|telefon|llam",
    "local_phone": r"phone|tel|call|fax|mobile|contact|telefon|llam",
    "social": r"ssn|social|security|taxpayer",
    "account": r"iban|account|bank|konto|compte|cuenta",
    "spelled_email": "mail|contact|write|kontakt|correo|courriel",
}
_AGAINST = r"version|isbn|issn|order|price|total|serial|chapter|section|part no|model|rev\b|doi"
_KNOWN = {
    "email": r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl)$",
    "ip": r"^(?!0\.|255\.)",
    "card": r"^(3[47]|30|36|38|4|5[1-5]|2[2-7]|6)",
    "phone": r"^\+\x20?(1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]",
    "social": r"^(?!000|666|9)",
    "account": r"^(AT|BE|CH|DE|ES|FR|GB|IT|NL|PL|PT|SE)",
    "spelled_email": r"(?i)(com|org|net|edu|de|fr|es|uk|eu)$",
}
#: Letters looked at on either side of a span.
NEARBY = 32
ROUNDS = 50
LABELERS = ("strict", "known", "context", "stands")


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    turned = F.reverse(digits)
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(turned, i, F.lit(1)).cast("int").alias("d")))
    doubled = F.transform(places, lambda x: F.when(x["i"] % 2 == 1, x["d"]).when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: Column, span: Column) -> Column:
    """The fixed checks of the base kinds; for the others a check of their form."""
    digits = _digits(span)
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "ip", span.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(kind == "card", F.length(digits).between(12, 19) & _luhn(digits))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .when(kind == "social", ~span.rlike("-00-|-0000$"))
        .when(kind == "account", F.length(F.regexp_replace(span, " ", "")).between(15, 34))
        .otherwise(F.lit(True))
    )


def _found(kind: str) -> Column:
    """The matches of a pattern as structs: number, length of what stands before it, span, and text on both sides."""
    pieces, spans = F.col(f"_{kind}_pieces"), F.col(f"_{kind}_spans")
    return F.transform(
        spans,
        lambda span, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("turn"), F.length(pieces[i]).alias("gap"), span.alias("span"),
            F.substring(pieces[i], -NEARBY, NEARBY).alias("left"), F.substring(pieces[i + 1], 1, NEARBY).alias("right"),
        ),
    )


def candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, start, end, span, passes, votes) of every match of every pattern; offsets in code points."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    spans = {}
    for kind, pattern in PATTERNS.items():
        held = F.contains(F.col("text"), F.lit(_HINTS[kind])) if kind in _HINTS else F.lit(True)
        spans[f"_{kind}_spans"] = F.when(held, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    docs = docs.withColumns(spans)
    pieces = {f"_{k}_pieces": F.when(F.size(f"_{k}_spans") > 0, F.split("text", p, -1)) for k, p in PATTERNS.items()}
    docs = docs.filter(" or ".join(f"size(_{k}_spans) > 0" for k in KINDS)).withColumns(pieces)
    matches = F.concat(*[F.coalesce(_found(k), F.array().cast("array<struct<kind:string,turn:int,gap:int,span:string,left:string,right:string>>")) for k in KINDS])
    rows = docs.select("doc_id", "text_hash", F.explode(matches).alias("m")).select("doc_id", "text_hash", "m.*")
    rows = rows.dropDuplicates(["doc_id", "text_hash", "kind", "turn"])
    upto = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("span")).over(upto))
    kind, near = F.col("kind"), F.lower(F.concat_ws(" ", "left", "right"))

    def by_kind(patterns: dict[str, str], value: Column) -> Column:
        out = F.lit(False)
        for name, pattern in patterns.items():
            out = F.when(kind == name, value.rlike(pattern)).otherwise(out)
        return out

    passes = _passes(kind, F.col("span"))
    votes = {
        "strict": F.when(passes, 1).otherwise(0),
        "known": F.when(by_kind(_KNOWN, F.col("span")), 1).otherwise(0),
        "context": F.when(near.rlike(_AGAINST), 0).when(by_kind(_FOR, near), 1).otherwise(-1),
        "stands": F.when(F.col("left").rlike(r"(^|[\s\"'(<:,;=])$") & F.col("right").rlike(r"^($|[\s\"')>.,;:!?])"), 1).otherwise(0),
    }
    return rows.select("doc_id", "text_hash", "kind", (F.col("end") - F.length("span")).alias("start"), "end", "span", passes.alias("passes"), *[v.cast("int").alias(k) for k, v in votes.items()])


def reliabilities(patterns: list[dict]) -> tuple[float, dict[str, tuple[float, float]], list[float]]:
    """Share of personal data, and per labeler how often it votes yes on it and on the rest, by
    expectation-maximisation over vote patterns with their counts ``n``; then the probability of each pattern.

    Starts from the majority of votes; every count is smoothed, so a labeler that never votes stays neutral.
    """
    chance = []
    for p in patterns:
        cast = [p[k] for k in LABELERS if p[k] >= 0]
        chance.append((sum(cast) + 0.5) / (len(cast) + 1))
    share, rates = 0.5, {}
    for _ in range(ROUNDS):
        weight = sum(p["n"] for p in patterns)
        share = (sum(p["n"] * c for p, c in zip(patterns, chance, strict=True)) + 1) / (weight + 2)
        for k in LABELERS:
            voted = [(p, c) for p, c in zip(patterns, chance, strict=True) if p[k] >= 0]
            yes = (sum(p["n"] * c * p[k] for p, c in voted) + 2) / (sum(p["n"] * c for p, c in voted) + 3)
            no = (sum(p["n"] * (1 - c) * p[k] for p, c in voted) + 1) / (sum(p["n"] * (1 - c) for p, c in voted) + 3)
            rates[k] = (yes, no)
        for i, p in enumerate(patterns):
            odds = math.log(share / (1 - share))
            for k in LABELERS:
                if p[k] >= 0:
                    yes, no = rates[k]
                    odds += math.log(yes / no) if p[k] else math.log((1 - yes) / (1 - no))
            chance[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return share, rates, chance


def _inputs(p: dict) -> list[float]:
    cast = [float(p[k] == 1) for k in LABELERS] + [float(p["context"] == 0)]
    return [1.0, *cast, *[float(p["kind"] == k) for k in KINDS]]


def classifier(patterns: list[dict], chance: list[float], rounds: int = 2000) -> list[float]:
    """Weights of a logistic regression on votes and kind, fitted to the probabilities of the patterns."""
    inputs = [_inputs(p) for p in patterns]
    total = sum(p["n"] for p in patterns)
    weights = [0.0] * len(_inputs({k: 0 for k in LABELERS} | {"kind": ""}))
    for _ in range(rounds):
        slope = [1e-3 * w for w in weights]
        for p, x, c in zip(patterns, inputs, chance, strict=True):
            at = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x, strict=True))))
            pull = (at - c) * p["n"] / total
            slope = [s + pull * v for s, v in zip(slope, x, strict=True)]
        weights = [w - s for w, s in zip(weights, slope, strict=True)]
    return weights


def judged(documents: DataFrame) -> DataFrame:
    """The candidates with ``chance``, and those that stay: base spans that pass, others from one half up."""
    rows = kept(candidates(documents), "spans")
    patterns = [r.asDict() for r in rows.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).orderBy("kind", *LABELERS).collect()]
    weights = [0.0] * len(_inputs({k: 0 for k in LABELERS} | {"kind": ""}))
    if patterns:
        weights = classifier(patterns, reliabilities(patterns)[2])
    inputs = [F.lit(1.0), *[(F.col(k) == 1).cast("double") for k in LABELERS], (F.col("context") == 0).cast("double"), *[(F.col("kind") == k).cast("double") for k in KINDS]]
    score = sum((x * F.lit(w) for x, w in zip(inputs, weights, strict=True)), F.lit(0.0))
    rows = rows.withColumn("chance", 1 / (1 + F.exp(-score)))
    base = F.col("kind").isin(*BASE)
    return rows.filter(F.when(base, F.col("passes")).otherwise(F.col("passes") & (F.col("chance") >= 0.5)))


def findings(documents: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Added spans that overlap a base span are left out.  NULL texts are empty.  Rows that repeat an id with the same
    text have the same result; with another text they have their own.  Other columns are not read.
    """
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    span = F.struct("start", order.alias("order"), "end", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    listed = judged(documents).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("all"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    other = listed.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "all")
    rows = docs.join(other, docs.doc_id.eqNullSafe(other.id) & (docs.text_hash == other.hash), "left")
    rows = rows.withColumn("all", F.coalesce("all", F.array().cast(listed.schema["all"].dataType)))
    rows = rows.withColumn("_base", F.filter("all", lambda s: s["order"] < len(BASE)))

    def apart(s: Column) -> Column:
        return ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))

    rows = rows.withColumn("all", F.filter("all", lambda s: (s["order"] < len(BASE)) | apart(s)))

    def said(chosen: Column) -> Column:
        return F.concat_ws(",", F.transform(chosen, lambda s: s["said"]))

    def number(i: int) -> Column:  # a second parameter of the lambda would be the place in the array
        return F.size(F.filter("_base", lambda s: s["order"] == i)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(said(F.col("_base")), 256).alias("base_sha256"), said(F.col("all")).alias("spans"))
