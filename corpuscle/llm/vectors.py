"""Integer vectors, which the vector operators share.

A component x becomes floor(scale * x).  Rows take part if their vector has the common
width and no component that is null, not finite, or so large that sums of ``bits``
bits could not hold a squared norm (for 64 components and 61 bits: from 2 ** 27.5 on,
as integers).  The common width is the length of the usable vector with the least
identifier, among lengths that are a positive multiple of ``parts``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_rows(rows: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int = 1, scale: int = 256, bits: int = 61) -> tuple[DataFrame, int]:
    """(id, label, q array<long>) of the rows that take part, and their width (0: there are none)."""
    v = F.col("v")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    most = F.sqrt(F.lit(2.0**bits) / F.greatest(F.size(v), F.lit(1))) / scale - 1
    fits = F.forall(v, lambda c: F.coalesce(F.abs(c) < most, F.lit(False)))
    good = rows.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & fits)
    width = good.agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", F.size(v).alias("width"))).alias("first")).first()["first"]
    width = width["width"] if width else 0
    return good.where(F.size(v) == width).select("id", "label", F.transform(v, lambda c: F.floor(c * scale)).alias("q")), width


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """The rows of a list column that holds no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)
