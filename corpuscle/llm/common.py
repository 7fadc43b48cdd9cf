"""What the operators of this subpackage share: tables, scratch tables, checks."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts go to Python in batches small enough for any mix of lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all machines share, as a whole URI.

    Where that setting is absent, a local folder is made on a local master (tests on
    one machine); on a cluster that is an error.  The folder is deleted when the JVM
    ends, if ``discard`` has not done so before.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="corpuscle-")
        spark.conf.set("spark.checkpoint.dir", base)
    hadoop, store = _hadoop(spark, f"{base.rstrip('/')}/corpuscle-{uuid.uuid4().hex}")
    store.deleteOnExit(hadoop)
    return store.makeQualified(hadoop).toUri().toString()


def _hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        hadoop, store = _hadoop(df.sparkSession, df._cut_path)
        store.delete(hadoop.getParent(), True)


FEW = 100_000  # ids up to this number are broadcast (under 2 MB), more are joined by shuffle


def without(docs: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` without the rows whose keys, expressions over ``docs``, are a row of ``gone``; null keys stay."""
    gone = cut(gone.select(*[F.col(n).alias(f"__gone_{n}") for n in keys]).distinct(), "gone")
    same = [expression == gone[f"__gone_{n}"] for n, expression in keys.items()]
    return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, same, "left_anti")


SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """A join on ``key`` in which the rows of one key of ``left`` go to ``salts`` tasks by ``spread``.

    ``right``, which has few rows a key, is repeated for each salt.
    """
    left = left.withColumn("__salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def give_back(collect: bool = True) -> None:
    """Memory that this process has freed goes back to the machine."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def kept_in_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept for the next task of the same Python worker; one thing at a time."""
    slot = sys.modules.setdefault("_corpuscle_worker", types.ModuleType("_corpuscle_worker"))
    if getattr(slot, "key", None) != key:
        if getattr(slot, "key", None) is not None:  # another operator's things go, and their memory goes back
            slot.key = slot.value = None
            give_back()
        slot.value = make()
        slot.key = key
    return slot.value
