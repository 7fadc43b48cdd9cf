"""Written tables in the shared folder: cuts of lineage, and indexes kept for a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A folder under spark.checkpoint.dir, deleted when the JVM ends; where that is unset, below a local one on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="corpuscle-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/corpuscle-{uuid.uuid4().hex}"
    folder, store = hadoop(spark, path)
    store.deleteOnExit(folder)
    return path


def hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """A path and its file system, as Spark sees them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str = "level") -> DataFrame:
    """``df`` written to a new folder and read back."""
    path = f"{new_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, Any] = {}


def built(spark: SparkSession, inputs: list[str], name: str, build: Callable[[str], None]) -> str:
    """The folder that ``build`` filled from these inputs, made once in a session and again when an input has changed."""
    seen = []
    for path in inputs:
        at, store = hadoop(spark, path)
        files = store.listStatus(at)  # a file, or the files of a folder
        seen += [(path, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files]
    key = (spark.sparkContext.applicationId, name, *seen)
    if key not in _KEPT:
        folder = new_folder(spark)
        build(folder)
        _KEPT[key] = folder
    return _KEPT[key]
