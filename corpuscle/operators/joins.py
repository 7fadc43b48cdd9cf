"""Equal-key joins whose hot keys are dealt over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.scratch import cut

#: Rows of one side that a key may bring into one task before it is split.
CELL = 1 << 16


def key_counts(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, __l, __r): the rows of each side, of keys that both sides have."""
    count = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    return count(left, "__l").join(count(right, "__r"), key)


def dealt(left: DataFrame, right: DataFrame, key: list[str], most: int | None = None, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a cell (__i, __j) of their key: a row of left meets a row of right in just one cell.

    A key with n rows in left and m in right has ceil(n / most) times ceil(m / most)
    cells; each row is copied along its own row or column of them.  Only hot keys are
    copied.  A row's place is a hash of all its columns, so equal rows share a place:
    callers with very many equal rows count them first.  ``counts``: the ``key_counts``,
    where the caller knows them.
    """
    most = CELL if most is None else most
    counts = key_counts(left, right, key) if counts is None else counts
    parts = lambda n: F.ceil(F.col(n) / most).cast("int")
    hot = cut(counts.where((F.col("__l") > most) | (F.col("__r") > most)).select(*key, parts("__l").alias("__rows"), parts("__r").alias("__cols")), "hot")
    if hot.isEmpty():
        one = F.lit(0)
        return left.withColumns({"__i": one, "__j": one}), right.withColumns({"__i": one, "__j": one})

    def place(df: DataFrame, parts: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce(parts, F.lit(1))).cast("int")

    along = lambda parts: F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))
    a = left.join(hot, key, "left").withColumn("__i", place(left, "__rows")).withColumn("__j", along("__cols"))
    b = right.join(hot, key, "left").withColumn("__j", place(right, "__cols")).withColumn("__i", along("__rows"))
    return a.drop("__rows", "__cols"), b.drop("__rows", "__cols")


def salted_join(left: DataFrame, right: DataFrame, key: list[str], most: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """The inner join by ``key``, with hot keys split on both sides; null keys meet nothing.  Without ``counts``, both sides are read twice."""
    a, b = dealt(left, right, key, most, counts)
    return a.join(b, [*key, "__i", "__j"]).drop("__i", "__j")


#: Rows of a key that meet each other in one task, where a key's rows are paired among themselves.
PAIRED = 1 << 12


def paired(rows: DataFrame, key: str, by: str, most: int | None = None) -> DataFrame:
    """(x, y): any two rows of one key as structs, once; ``by`` is unique within a key, and neither it nor the key is null.

    A key with n rows has m = ceil(n / most) places and m (m + 1) / 2 cells: a row of one
    place meets those of its own and of the later ones.  Cells are spread over as many tasks.
    """
    most = PAIRED if most is None else most
    places = F.ceil(F.col("n") / most).cast("int").alias("m")
    hot = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key, places), "hot")
    cells = hot.agg(F.sum(F.expr("CAST(m AS LONG) * (m + 1) DIV 2"))).first()[0]
    placed = rows.withColumn("__row", F.struct(*rows.columns)).join(F.broadcast(hot), key, "left").withColumn("m", F.coalesce("m", F.lit(1)))
    placed = placed.withColumn("p", F.pmod(F.xxhash64(F.col(by)), F.col("m")).cast("int"))
    x = placed.select(key, F.col("p").alias("__i"), F.explode(F.sequence("p", F.col("m") - 1)).alias("__j"), F.col("__row").alias("x"))
    y = placed.select(key, F.explode(F.sequence(F.lit(0), "p")).alias("__i"), F.col("p").alias("__j"), F.col("__row").alias("y"))
    where = [key, "__i", "__j"]
    if cells is not None:  # the cells' rows are few and their pairs many: their tasks must not be merged
        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(cells, 10_000))
        x, y = x.repartition(tasks, *where), y.repartition(tasks, *where)
    return x.join(y, where).where((F.col("__i") < F.col("__j")) | (F.col(f"x.{by}") < F.col(f"y.{by}"))).select("x", "y")
