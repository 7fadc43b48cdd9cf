"""Exact duplicates by a tree merge of sorted digest runs, with DataFrame functions only.

Every row belongs to a run, by a hash of its identifier (of its place in the table,
if that is null).  A run is sorted by digest and holds one entry for each: the
identifier that stays, and the number of rows.  Runs are merged ``FAN`` at a time in
binomial rounds (64, 8, 1): the entries of the runs of a round meet by range of their
keys, are merged in order and adjacent entries of one key become one, which keeps the
better identifier.  Identifiers are compared as structs, which Spark aggregates by
sorting and merging, before an exchange and after it; each round is stored in order.
There are 64 runs, and ``FAN`` times as many for as long as a run would hold more than
``RUN_ROWS`` rows, so a digest that a third of all rows share is reduced run by run
and spread over all of them on the way back: the decisions go down the same tree, in
which an entry meets at most ``FAN`` entries of the level below.

An entry's key is the digest, the byte length and a second, unrelated hash of the
text; rows are equal only if all three are (the check of the digest, made again at
every level).

Null texts count as empty.  Rows with a null identifier are kept in the result
with their group; a group of null identifiers alone has a null keep_id, and its
rows are not dropped.  Rows that repeat an identifier and a text share one
decision.  An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, without

FAN, LEVELS, MOST_LEVELS, RUN_ROWS = 8, 2, 6, 1 << 20
KEY = ["__digest", "__bytes", "__second"]


def digest_key(data: Column, digest: Column) -> list[Column]:
    return [digest.alias(KEY[0]), F.octet_length(data).cast("long").alias(KEY[1]), F.xxhash64(data).alias(KEY[2])]


def tree_keep(rows: DataFrame, id_col: str, largest: bool = True, run_rows: int = RUN_ROWS) -> DataFrame:
    """``rows`` (id_col, KEY and others) with keep_id and group_size of each row's key."""
    better, key = F.max if largest else F.min, F.col(id_col)
    spread = F.xxhash64(F.coalesce(key.cast("string"), F.monotonically_increasing_id().cast("string")))
    rows = cut(rows.withColumn("__spread", F.pmod(spread, F.lit(FAN**MOST_LEVELS)).cast("int")), "rows")
    n, depth = rows.count(), LEVELS
    while depth < MOST_LEVELS and n > run_rows * FAN**depth:
        depth += 1
    rows = rows.withColumn("__run", F.col("__spread") % FAN**depth).drop("__spread")
    entries = rows.select("__run", *KEY, F.when(key.isNotNull(), F.struct(key.alias("id"))).alias("kept"), F.lit(1).cast("long").alias("group_size"))
    levels = []
    for k in range(depth + 1):
        merged = entries.groupBy("__run", *KEY).agg(better("kept").alias("kept"), F.sum("group_size").alias("group_size"))
        levels.append(cut(merged.sortWithinPartitions("__run", *KEY), f"level{k}"))
        entries = levels[-1].withColumn("__run", F.floor(F.col("__run") / FAN).cast("int"))
    known = levels.pop()
    while levels:
        below = levels.pop().select("__run", *KEY, F.floor(F.col("__run") / FAN).cast("int").alias("__up"))
        known = below.join(known.withColumnRenamed("__run", "__up"), ["__up", *KEY]).drop("__up")
    return rows.join(known.select("__run", *KEY, F.col("kept.id").alias("keep_id"), "group_size"), ["__run", *KEY]).drop("__run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """One row per row: id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), *digest_key(text, F.unhex(F.sha2(text.cast("binary"), 256))))
    return tree_keep(rows, id_col, largest).select(
        id_col,
        "keep_id",
        "group_size",
        (F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex(KEY[0])).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, largest: bool = True) -> DataFrame:
    """``docs`` (doc_id, text and others) without the rows that another row with the same text replaces."""
    gone = exact_groups(docs, largest=largest).where(~F.col("kept"))
    return without(docs, gone, doc_id=docs["doc_id"], text_sha256=F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))
