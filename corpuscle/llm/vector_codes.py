"""Vector code compression: product codebooks of integers, trained by exact rounds.

Vectors are integers (see ``vectors``), cut into ``parts`` equal consecutive parts.
Each part position has a codebook, which starts as that part of the rows with the
``entries`` least identifiers.  A round assigns every part to the nearest entry and
replaces each entry by floor(sum / count) of its parts; an entry without parts stays.

The codebooks (parts * entries * width / parts integers, whatever the table) are
broadcast.  Arrow batches compute all squared distances at once, as |x|^2 - 2 x.c +
|c|^2 by int64 matrix products, and take the first least one, so ties go to the lower
index and no result depends on the order of the rows.  A task adds up the sums and
counts of its entries; those of all tasks are merged by a shuffle grouped by entry.
The table is read once more in each round rather than stored: its filter and floor
are far cheaper than a copy.

Rows with a null label are a group of their own in ``label_error``.  Rows with a null
identifier are coded, and come last when the codebooks start; rows that repeat an
identifier are rows of their own, ordered by vector.  With fewer rows than entries
there are as many entries as rows.  A sum of errors beyond a long is null.  An empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, cut, salted_join
from .vectors import integer_rows, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry, by part and row; x: rows, parts, width; books: parts, entries, width."""
    x = x.transpose(1, 0, 2)
    d = (books * books).sum(2)[:, None, :] - 2 * (x @ books.transpose(0, 2, 1))
    code = d.argmin(2)
    return code, np.take_along_axis(d, code[:, :, None], 2)[:, :, 0] + (x * x).sum(2)


def first_codebooks(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """Parts of the rows with the least identifiers."""
    found = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    return np.array([r["q"] for r in found], np.int64).reshape(len(found), parts, width // parts).transpose(1, 0, 2)


def entry_sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sum0, ...): the parts that are nearest to each entry, added up within tasks, then by entry."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums, counts = np.zeros((parts * entries, w), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * w).reshape(-1, parts, w)
            place = (assigned(x, books)[0].T + entries * np.arange(parts)).reshape(-1)
            np.add.at(sums, place, x.reshape(-1, w))
            counts += np.bincount(place, minlength=len(counts))
        used = np.flatnonzero(counts)
        cols = [used // entries, used % entries, counts[used], *sums[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names)

    names = ["part", "entry", "n", *[f"sum{i}" for i in range(w)]]
    found = rows.select("q").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return found.groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names[2:]])


def train(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after all rounds: parts, entries, width / parts."""
    books = first_codebooks(rows, parts, entries, width)
    for _ in range(rounds):
        after = books.copy()
        for part, entry, n, *sums in entry_sums(rows, books).collect():  # a row for each entry at most
            after[part, entry] = np.array(sums, np.int64) // n
        books = after
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (a byte for each part) and error of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, _, w = books.shape
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = assigned(matrix(batch.column(2), parts * w).reshape(-1, parts, w), shared.value)
            codes = pa.array([c.tobytes() for c in np.ascontiguousarray(code.T.astype(np.uint8))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(error.sum(0))], ["id", "label", "code", "error"])

    return rows.mapInArrow(run, f"id long, label {kind}, code binary, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with q, the vector of entries that a code names."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    names = codes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(names.index("code")).to_pylist()), np.uint8).reshape(-1, len(shared.value))
            q = shared.value[np.arange(len(shared.value)), at].reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(q), pa.list_(pa.int64()))], [*names, "q"])

    return codes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema) + ", q array<long>")


def compressed(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (hex), error, label_error and the digest of the codebooks, for every row that takes part."""
    good, width = integer_rows(rows, id_col, vec_col, label_col, parts)
    books = train(good, width, parts, entries, rounds) if width else np.empty((parts, 0, 0), np.int64)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    # null labels together, apart from every other
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = cut((encode(good, books) if width else encode(good.where(F.lit(False)), books)).withColumn("group", key), "coded")
    sums = cut(coded.groupBy("group").agg(F.try_sum("error").alias("label_error")), "sums")
    both = coded.join(F.broadcast(sums), "group") if sums.count() <= FEW else salted_join(coded, sums, "group", "id")
    return both.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
