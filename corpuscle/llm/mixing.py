"""Temperature mixing of sources, with DataFrame functions only.

A source's weight is its share of the tokens to the power ``alpha``, normalised:
alpha 1 leaves the shares, alpha 0 makes all sources equal.  The budget is the least
at which every source is read once, so no document is left out; then a source is
read ``r = tokens ** (alpha - 1)`` times, relative to the least of these.  The
exponent is bisected on [0, 1] to the least one whose largest repetition is within
``max_repetition``, or whose entropy of the weights is within ``target_entropy``
(a share of the largest possible).  Four bisection steps share one aggregation
over the table of sources, whose predicates alone reach the driver.

Weights are realised as block permutations.  A source's documents fall into
``16 ** DIGITS`` blocks by a hash of doc_id.  An epoch reads the blocks in an order
of its own; the last, partial epoch takes the longest start of its order whose
tokens are within the source's budget.  ``schedule`` is where in the whole run (0 to
1) a block is read, so that every stretch of the run holds the sources at their
weights.  Only tables of sources by blocks are shuffled; the plan is broadcast where
it has ``FEW`` rows or fewer, else joined by (source, block), of which a hot source
has many.

Tokens are words ``[^\\x20\\x09-\\x0D]+``.  A null source is a source of its own, and
null texts have no tokens.  A source without tokens is read once.  Null doc_ids
share a block.  Repeated rows are read each.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DIGITS, SEED, STEPS, FEW = 2, "mix", 28, 200_000
NO_SOURCE, SOURCE = "\x00", ["__source", "__unnamed"]  # a source is its name, and whether that is null


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def blocked(docs: DataFrame) -> DataFrame:
    """doc (a struct of the row), SOURCE, __block and __tokens."""
    block = F.substring(F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, DIGITS)
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce("source", F.lit(NO_SOURCE)).alias("__source"), F.col("source").isNull().alias("__unnamed"), block.alias("__block"), n_words(F.col("text")).alias("__tokens"))


def bisect(sources: DataFrame, max_repetition: float | None, target_entropy: float | None) -> float:
    """The least exponent on the grid of 2 ** -STEPS that meets the limit (1 if only that does)."""
    lo, hi = 0.0, 1.0
    sources = sources.where("tokens > 0")
    total = sources.agg(F.sum("tokens").cast("double").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if total["n"] < 2:
        return 1.0
    for _ in range(STEPS // 4):
        points = [lo + (hi - lo) * i / 16 for i in range(17)]
        tests = []
        for i, a in enumerate(points[:-1]):
            if max_repetition is not None:
                x = F.pow(F.col("tokens").cast("double"), F.lit(a - 1.0))
                tests.append((F.max(x) <= F.min(x) * F.lit(max_repetition)).alias(f"p{i}"))
            else:
                p = F.col("tokens") / F.lit(total["t"])
                w = F.pow(p, F.lit(a))
                entropy = F.log(F.sum(w)) - F.lit(a) * F.sum(w * F.log(p)) / F.sum(w)
                tests.append((entropy <= F.lit(target_entropy) * F.log(F.lit(float(total["n"])))).alias(f"p{i}"))
        got = sources.agg(*tests).first()
        first = next((i for i in range(16) if got[f"p{i}"]), 16)
        if first == 0:
            return points[0]
        lo, hi = points[first - 1], points[first]
    return hi


def plan(stats: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None) -> DataFrame:
    """(SOURCE, __block, epoch, block_rank, schedule, repetition) from tokens by source and block."""
    sources = cut(stats.groupBy(*SOURCE).agg(F.sum("tokens").alias("tokens")), "sources")
    alpha = bisect(sources, max_repetition, target_entropy)
    x = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha - 1.0)))
    least = sources.agg(F.min(x).alias("least")).first()["least"] or 1.0
    ratio = sources.select(*SOURCE, F.col("tokens").alias("all"), F.round(F.coalesce(x / F.lit(least), F.lit(1.0)), 6).alias("repetition"))
    spread = stats.join(ratio, SOURCE).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor("repetition").cast("int"))))
    order = F.md5(F.concat_ws("|", F.lit(SEED), "__source", F.col("epoch").cast("string"), "__block").cast("binary"))
    w = Window.partitionBy(*SOURCE, "epoch").orderBy("order", "__block")
    rows = spread.withColumn("order", order).withColumns({"block_rank": F.row_number().over(w), "sum": F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    budget = F.floor((F.col("repetition") - F.floor("repetition")) * F.col("all"))
    rows = rows.where((F.col("epoch") < F.floor("repetition")) | ((F.col("sum") <= budget) & (budget > 0)))
    schedule = F.round((F.col("epoch") + (F.col("block_rank") - 1) / F.lit(16.0**DIGITS)) / F.col("repetition"), 6)
    return rows.select(*SOURCE, "__block", "epoch", "block_rank", schedule.alias("schedule"), "repetition")


def mixed(docs: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None) -> DataFrame:
    """doc and __ columns with epoch, block_rank, schedule and repetition: a row for each reading."""
    rows = blocked(docs)
    stats = cut(rows.groupBy(*SOURCE, "__block").agg(F.sum("__tokens").alias("tokens")), "stats")
    steps = cut(plan(stats, max_repetition, target_entropy), "plan")
    few = steps.count() <= FEW
    return rows.join(F.broadcast(steps) if few else steps, [*SOURCE, "__block"])


def mixture(docs: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, block_rank, schedule and repetition of every reading."""
    rows = mixed(docs.select("doc_id", "source", "text"), max_repetition, target_entropy)
    return rows.select("doc.doc_id", "doc.source", F.col("__tokens").alias("n_tokens"), "epoch", F.col("__block").alias("block"), "block_rank", "schedule", "repetition")


def mix(docs: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None) -> DataFrame:
    """``docs`` with each row as often as its source's weight asks for."""
    return mixed(docs, max_repetition, target_entropy).select("doc.*")
