"""Mixing sources by temperature: a share per source, realised as whole documents in permuted blocks.

A source holding the share p of all tokens gets the weight p^a / sum p^a.  Bisection finds the
exponent: the largest one, 1 at most, whose weights reach a target entropy, but not so small that a
source would have to be repeated more often than a limit.  A budget of tokens times the weight is a
source's quota.  Its documents are dealt to blocks by a hash, the blocks and the documents of a block are
permuted by it, and the quota is filled in that order: whole epochs first, then part of one.
Everything is a DataFrame plan; only sums over sources reach the driver, one row a step.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import kept

#: Target entropy as a share of the largest possible one (all sources equal).
ENTROPY = 0.998
#: A source is seen so many times at most.
EPOCHS = 4.0
#: Halvings of the exponent's interval.
STEPS = 30
#: Documents are dealt to so many blocks a source; a power of 16.
BLOCKS = 4096
SEED = "17"


def n_tokens(text: Column) -> Column:
    """Words between white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _at(shares: DataFrame, a: float) -> tuple[float, float]:
    """At the exponent ``a``: the entropy of the weights, and how often the most repeated source is seen."""
    powers = shares.select("p", F.pow("p", F.lit(a)).alias("q"))
    row = powers.agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("p")).alias("s"), F.max(F.col("q") / F.col("p")).alias("top")).first()
    return math.log(row.z) - a * row.s / row.z, row.top / row.z


def _bisected(holds: Callable[[float], bool], low: float, high: float, steps: int) -> tuple[float, float]:
    """The interval of length 2^-steps times the first one at whose lower end ``holds`` is true and at whose upper end it isn't."""
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low, high


def exponent(totals: DataFrame, entropy: float = ENTROPY, epochs: float = EPOCHS, steps: int = STEPS) -> float:
    """The temperature exponent for ``totals`` (source, tokens), the budget being all tokens.

    Entropy grows as the exponent falls, repetition too; the limit on repetition wins.
    """
    filled = totals.filter("tokens > 0")
    whole = filled.agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).first()
    if not whole.k or whole.k == 1:
        return 1.0
    shares = kept(filled.select((F.col("tokens") / F.lit(whole.n)).alias("p")).coalesce(1), "shares")
    goal = entropy * math.log(whole.k)
    if _at(shares, 1.0)[0] >= goal:
        return 1.0
    spread, _ = _bisected(lambda a: _at(shares, a)[0] >= goal, 0.0, 1.0, steps)
    if _at(shares, spread)[1] <= epochs:
        return spread
    return _bisected(lambda a: _at(shares, a)[1] > epochs, spread, 1.0, steps)[1]


def mixture(documents: DataFrame, entropy: float = ENTROPY, epochs: float = EPOCHS, blocks: int = BLOCKS, seed: str = SEED, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``documents`` that the mixture draws, each with n_tokens, weight, copies, block and place.

    ``copies`` is how often the row is seen, ``block`` the turn of its block and ``place`` its turn within the block
    of its source.  A row that is not drawn is left out.  The budget is the number of tokens of ``documents``.
    NULL is a source of its own.  Documents without tokens cost nothing: they are drawn as often as their source's
    whole epochs.  Rows that repeat an id are rows of their own, in the order of a hash of their text.  Columns of
    these names are replaced; of the others ``columns`` are returned (all, if not given).
    """
    own = [c for c in columns or documents.columns if c not in ("n_tokens", "weight", "copies", "block", "place")]
    rows = documents.withColumns({"n_tokens": n_tokens(F.col("text")), "_tie": F.xxhash64(F.col("text").cast("string"))})
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    digits = len(f"{blocks - 1:x}")
    dealt = rows.withColumns({"_source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "_key": key})
    dealt = dealt.withColumn("block", F.conv(F.substring("_key", 1, digits), 16, 10).cast("int"))
    dealt = kept(dealt.select(*dict.fromkeys([*own, "doc_id", "n_tokens", "block", "_source", "_key", "_tie"])), "dealt")

    sums = kept(dealt.groupBy("_source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    totals = sums.groupBy("_source").agg(F.sum("tokens").alias("tokens"))
    a = exponent(totals, entropy, epochs)
    whole = totals.filter("tokens > 0").agg(F.sum("tokens").cast("double").alias("n"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))).alias("z")).first()
    n, z = float(whole.n or 0), float(whole.z or 1)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(z)).otherwise(0.0)
    quotas = totals.withColumn("weight", weight).select("_source", "weight", F.col("tokens").alias("_tokens"), F.floor(F.round(F.col("weight") * F.lit(n), 3)).cast("long").alias("_quota"))

    before = Window.partitionBy("_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = sums.withColumn("_before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("_source", "block", "_before").join(quotas, "_source")
    within = Window.partitionBy("_source", "block").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = dealt.withColumns({"_upto": F.sum("n_tokens").over(within), "place": F.count("*").over(within)})
    drawn = (
        slots.join(turns, ["_source", "block"])
        .withColumn("_whole", F.when(F.col("_tokens") > 0, F.floor(F.col("_quota") / F.col("_tokens"))).otherwise(1))
        .withColumn("_part", F.col("_quota") - F.col("_whole") * F.col("_tokens"))
        .withColumn("copies", (F.col("_whole") + F.when((F.col("n_tokens") > 0) & (F.col("_before") + F.col("_upto") <= F.col("_part")), 1).otherwise(0)).cast("long"))
    )
    return drawn.filter("copies > 0").select(*own, "n_tokens", "weight", "copies", "block", "place")
