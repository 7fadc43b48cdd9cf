"""Per-module digests, insight mining, reports and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import fixed, text


def modules(files: DataFrame) -> DataFrame:
    """A row for each module: sorted files, longest summary, size."""
    rows = files.withColumn("module", text.module_of(F.col("file_path")))
    return rows.groupBy("module").agg(
        F.array_sort(F.collect_set("file_path")).alias("files"),
        F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("description"),
        F.sum(F.floor(F.length("content") / 4)).cast("long").alias("tokens"),
        F.count(F.lit(1)).alias("chunks"),
    )


def first_n(rows: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


def keep_last(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """Of rows with one key, the last in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def stack(content: Column) -> Column:
    """Known technologies that occur in the text, in order, joined."""
    low = F.lower(content)
    return F.array_join(F.array_sort(F.filter(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in fixed.STACK]), lambda x: x.isNotNull())), ", ")


def first_paragraph(content: Column, least: int, gap: str = "\n\n", most: int = 200) -> Column:
    """The first paragraph of more than ``least`` characters, without number signs; its first ``most``."""
    parts = F.transform(F.split(content, gap), lambda p: F.trim(F.ltrim(F.regexp_replace(F.trim(p), "^#+", ""))))
    return F.coalesce(F.substring(F.try_element_at(F.filter(parts, lambda p: F.length(p) > least), F.lit(1)), 1, most), F.lit(""))


def tags(content: Column, table: dict[str, str] | None = None, most: int = 5) -> Column:
    """Names of the patterns that occur, in table order; the first ``most``."""
    found = F.array(*[F.when(F.regexp(content, F.lit(f"(?i){p}")), F.lit(t)) for t, p in (table or fixed.TAGS).items()])
    return F.slice(F.filter(found, lambda x: x.isNotNull()), 1, most)


def mine_insights(turns: DataFrame, pattern: str = fixed.INSIGHT, least: int = 200, gap: str = "\n\n") -> DataFrame:
    """Assistant turns that state something to keep: one for each text, its telling paragraph, and tags."""
    rows = turns.where((F.col("role") == "assistant") & (F.length("text") >= least) & F.col("text").rlike(pattern))
    rows = rows.where((F.length("text") - F.length(F.replace("text", F.lit("```"), F.lit("")))) / 3 <= 4)
    rows = rows.withColumn("key", F.md5(F.substring("text", 1, 500).cast("binary")))
    rows = keep_last(rows, ["key"], "conv_id", "turn")
    telling = F.try_element_at(F.filter(F.split("text", gap), lambda p: F.regexp(p, F.lit(pattern)) & (F.length(p) > 100)), F.lit(1))
    rows = rows.withColumn("best", F.coalesce(telling, F.substring("text", 1, 500)))
    return rows.select("conv_id", "turn", F.substring(F.trim("best"), 1, 1000).alias("content"), tags(F.col("best")).alias("tags"))


def bars(rows: DataFrame, value: str, width: int = 20) -> DataFrame:
    """Length of a bar for each value: at least 1 where the value is above 0; halves go to even."""
    top = rows.agg(F.max(value)).scalar()
    return rows.withColumn("bar", F.when(F.col(value) > 0, F.greatest(F.lit(1), F.bround(F.col(value) / top * width).cast("int"))).otherwise(0))


def short_path(path: Column, root: str = "") -> Column:
    """The path below the root, or its last three parts."""
    return F.when(F.startswith(path, F.lit(root + "/")) & F.lit(bool(root)), F.substring(path, len(root) + 2, 10_000)).otherwise(F.array_join(F.slice(F.split(path, "/"), -F.least(F.lit(3), F.size(F.split(path, "/"))), 3), "/"))


def ranks(found: DataFrame) -> DataFrame:
    """(query, first): the rank of the first relevant result of each query; null if none. found: query, rank, relevant."""
    return found.groupBy("query").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))


def metrics(first: DataFrame, *by: str) -> DataFrame:
    """Hit@1, Recall@3, Recall@5 and MRR of first ranks."""
    at = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return first.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.round(at(1), 6).alias("hit1"), F.round(at(3), 6).alias("recall3"), F.round(at(5), 6).alias("recall5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def best_source(scored: DataFrame) -> DataFrame:
    """For each query, the source of its least score."""
    return scored.groupBy("query").agg(F.min_by("source", F.struct("score", "source")).alias("routed"))


def accuracy(routed: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: the number of queries, and the share whose source is among those expected (query, source)."""
    right = expected.select("query", F.col("source").alias("routed")).distinct().withColumn("right", F.lit(1.0))
    rows = routed.join(right, ["query", "routed"], "left")
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce("right", F.lit(0.0))), 6).alias("accuracy"))
