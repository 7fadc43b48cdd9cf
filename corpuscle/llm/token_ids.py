"""Token-id files: frequency-ranked ids in byte-aligned coding with control bytes.

A file holds consecutive documents in ascending order of their identifiers:

    b"CRPT1\\0\\0\\0" | u64 docs, ids, table length, control length, data length
    | u32 table[rank] = id | i64 doc_id[docs] | u8 null flag[docs] | u64 ids of each doc
    | control bytes | data bytes

Ids are replaced by their rank by frequency within the file, so that most take a
byte.  Each control byte holds four two-bit codes (value bytes - 1); values follow
in a separate section, low byte first.  A reader turns control bytes into lengths
with one table lookup per four values, and gathers the values with numpy.

A file ends after ``FILE_IDS`` ids, between documents.  Its name comes from the
partition number alone and it is moved into place when whole, so that a task that
runs again after the loss of an executor writes the same file again.

Null texts count as empty and give only the end id.  Rows with a null identifier
come first, flagged.  Ties and repeated rows are separate documents, ordered by
text.  An empty table writes no file.  Extra columns are left out.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, kept_in_worker, scratch_dir
from .words import WordPool, gathered, lead, regular

MAGIC = b"CRPT1\0\0\0"
FILE_IDS = 1 << 20
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    n = len(values)
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = codes
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    at = np.cumsum(codes, dtype=np.int64) + np.arange(n) - codes
    data = np.empty(n + int(codes.sum(dtype=np.int64)), np.uint8)
    data[at] = values.astype(np.uint8)
    for k in (1, 2, 3):
        more = np.flatnonzero(codes >= k)
        data[at[more] + k] = (values[more] >> np.uint32(8 * k)).astype(np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The values again: lengths by table lookup, then four gathers."""
    sizes = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def to_file(doc_ids: list[int | None], arrays: list[np.ndarray]) -> bytes:
    ids = np.concatenate(arrays) if arrays else np.empty(0, np.uint32)
    counts = np.bincount(ids.astype(np.int64)) if len(ids) else np.empty(0, np.int64)
    used = np.flatnonzero(counts)
    table = used[np.argsort(-counts[used], kind="stable")].astype("<u4")
    rank = np.zeros(len(counts), "<u4")
    rank[table] = np.arange(len(table), dtype="<u4")
    control, data = pack(rank[ids])
    head = struct.pack("<5Q", len(doc_ids), len(ids), len(table), len(control), len(data))
    return b"".join([MAGIC, head, table.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), np.array([len(a) for a in arrays], "<u8").tobytes(), control, data])


def from_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, number of ids of each, and all ids."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, size, c, d = struct.unpack_from("<5Q", raw, 8)
    at = 48
    parts = []
    for kind, count in (("<u4", size), ("<i8", docs), ("u1", docs), ("<u8", docs), ("u1", c), ("u1", d)):
        parts.append(np.frombuffer(raw, kind, count, at))
        at += parts[-1].nbytes
    if at != len(raw):
        raise ValueError("a token-id file of the wrong length")
    table, ids, null, sizes, control, data = parts
    values = table[unpack(control, data, n)] if n else np.empty(0, np.uint32)
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], sizes.astype(np.int64), values


class LibraryEncoder:
    """The tokenizers library behind a pool of words; texts that do not fall into words go to it whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(1 + max(vocab.values()), np.int64)
        for t, i in vocab.items():  # a byte-level file shows each byte by one character
            self.size[i] = len(added[i].encode()) if i in added else len(t)
        self.marks = list(added.values())
        self.words = WordPool(self._learn)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words go to the library as one text, whose ids are cut again at the words' ends."""
        shown = lead(words)
        ends = np.cumsum(pc.binary_length(shown).to_numpy(zero_copy_only=False), dtype=np.int64)
        ids = self.whole("".join(shown.to_pylist()))
        return ids, np.diff(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        plain = regular(texts, self.marks)
        ids, counts = self.words.encode(texts.filter(pa.array(plain)))
        if plain.all():
            return ids, counts
        ends = np.cumsum(counts)
        parts = iter(zip((ends - counts).tolist(), ends.tolist(), strict=True))
        each = [ids[slice(*next(parts))] if p else self.whole(t.as_py()) for p, t in zip(plain.tolist(), texts, strict=True)]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def write_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Writes the files; returns file, part, seq, docs and ids of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = kept_in_worker(("library", path), lambda: LibraryEncoder(path)), TaskContext.get().partitionId(), 0
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        names: list[int | None] = []
        arrays: list[np.ndarray] = []
        end, held = np.array([end_id], np.uint32), 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            name = f"{root}/ids-{part:06d}-{seq:05d}.crpt"
            trial = f"{root}/_trial-{part:06d}-{seq:05d}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(trial) as f:
                f.write(to_file(names, arrays))
            store.move(trial, name)
            row = pa.RecordBatch.from_pylist([{"file": name.rpartition("/")[2], "part": part, "seq": seq, "docs": len(names), "ids": held}], schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))
            seq, held = seq + 1, 0
            names.clear()
            arrays.clear()
            return row

        for keys, texts in gathered(batches):
            ids, counts = encoder.encode(pc.fill_null(texts, ""))
            stops = np.cumsum(counts)
            for key, a, b in zip(keys.to_pylist(), (stops - counts).tolist(), stops.tolist(), strict=True):
                names.append(key)
                arrays.append(np.concatenate([ids[a:b], end]))
                held += len(arrays[-1])
                if held >= FILE_IDS:
                    yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, "file string, part int, seq int, docs long, ids long")


def read_files(spark, folder: str, files: DataFrame) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, sizes, ids = from_file(memoryview(raw.as_buffer()).tobytes())
                ends = np.cumsum(sizes)
                data = np.ascontiguousarray(ids, "<u4").view(np.uint8)
                crc = [zlib.crc32(data[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(names), pa.string()), pa.array(names, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["file", "doc_id", "within", "n_tokens", "ids_crc32"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.crpt").load(folder)
    rows = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "file string, doc_id long, within long, n_tokens long, ids_crc32 long")
    # files are summed within their part first; the running sum over parts has a row for each task alone
    part = files.groupBy("part").agg(F.sum("ids").alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.join(part, "part").select("file", (F.col("earlier") + F.coalesce(F.sum("ids").over(within), F.lit(0))).alias("before"))
    return rows.join(starts, "file").select("doc_id", (F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_id_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Writes ``docs`` as token-id files in the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/ids"
    files = cut(write_files(docs, path, folder, id_col, text_col, end_id), "files")
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_files(spark, folder, files)
