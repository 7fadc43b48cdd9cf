r"""Substring dedup: repeated passages by suffix trees over words, partitioned by prefix.

A suffix is a place of a document with the words ``[^\x20\x09-\x0D]+`` that follow it.
In the tree of all suffixes of all documents, a node at depth ``words`` is a run of so
many words, and its leaves are the places where it starts; what hangs below adds
nothing that is not found from the next places too, so trees are cut there.  A leaf
counts as repeated if a document with a smaller doc_id has a leaf below the same node.
Repeated leaves that overlap or touch in a document make up its maximal repeats, which
are removed.

1. Leaves without company are left out early: of each run of ``words`` words, the
   ``GRAM``-word run of the least hash (one place in five is such an anchor) goes to a
   shuffle by its hash.  Where documents with two identifiers meet, the anchor is
   shared; only suffixes whose anchor is shared can lie below a node of two documents.
   Every document hears of its own shared anchors.
2. Their suffixes are split by prefix: the order of suffixes is that of their first
   ``PREFIX`` words, by hash; bounds between groups are drawn from a bounded sample of
   suffixes so that a group holds about ``GROUP`` of them, which cuts common prefixes
   deeper than rare ones.  Bounds only balance; no result depends on them.
3. A group sorts its suffixes, which lays its subtree out in order, and reads the nodes
   at depth ``words`` off neighbours that agree.  The least doc_id below each decides.
4. Every document hears of its repeated leaves and drops the words they cover.

Suffixes move as columns packed and compressed by group, not as rows.  Before they
move, a task settles what it can: of the leaves of one node it passes on those of its
least doc_id, so a passage that a third of all documents hold costs a group one entry
a task.  Texts are shuffled once, by (doc_id, hash), and read from that exchange twice.
Words are told apart by 64-bit hashes, runs by a 64-bit hash beside 16 bits of each
word of the prefix.

Null and empty texts have no words.  Documents with a null doc_id come after all
others: what they share with those is removed, what they share among themselves stays.
Rows that repeat a doc_id are documents of the same rank, so neither loses to the
other; equal rows give equal rows.  An empty table gives an empty result; extra columns
are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, GRAM, PREFIX, GROUP = 13, 5, 4, 2_000_000
SLICE_BYTES, HELD, SAMPLE_DOCS, SAMPLE_EACH = 1 << 20, 1_500_000, 2000, 32
LAST = (1 << 63) - 1  # stands for a null doc_id

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE = _random.integers(0, 1 << 64, 256, np.uint64)
MULT, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, one text after the other, and how many words each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < size]
    opens[edges] = inside[edges]  # a text ends a word
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(inside)
    first = np.flatnonzero(opens[at])
    sizes = np.diff(np.append(first, len(at)))
    place = at - np.repeat(starts, sizes)
    powers = np.empty(int(sizes.max()), np.uint64)
    powers[0] = 1
    powers[1:] = MULT
    np.multiply.accumulate(powers, out=powers)
    h = mixed(np.add.reduceat(BYTE[data[at]] * powers[place], first) + sizes.astype(np.uint64))
    upto = np.searchsorted(starts, offsets)
    return h, np.diff(upto)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    size = max(0, len(h) - n + 1)
    a = np.zeros(size, np.uint64)
    for i in range(n):
        a = (a ^ (a >> np.uint64(31))) * MULT + h[i : i + size]
    return mixed(a)


def prefixes(h: np.ndarray, size: int) -> np.ndarray:
    """Sixteen bits of each of the first words of the suffixes, in order."""
    key = np.zeros(size, np.uint64)
    for i in range(PREFIX):
        key = (key << np.uint64(16)) | (h[i : i + size] >> np.uint64(48))
    return key


def suffixes(h: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``words`` words of their text, and the place of the anchor of each."""
    size, gram = max(0, len(h) - words + 1), min(GRAM, words)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
    whole = np.flatnonzero(left[:size] >= words)
    g = run_hashes(h, gram)
    best, anchor = g[:size].copy(), np.arange(size)
    for i in range(1, words - gram + 1):
        other = g[i : i + size]
        less = other < best
        best[less] = other[less]
        anchor[less] = np.flatnonzero(less) + i
    return whole, anchor[whole]


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of 8, 8, 4, 4, 8 and 8 bytes a value, by planes of bytes, compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in map(np.ascontiguousarray, arrays) if len(a)]
    raw = b"".join(planes)
    head = np.array([len(raw), *map(len, arrays)], np.int64).tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


TYPES = [np.uint64, np.uint64, np.uint32, np.int32, np.int64, np.int64]


def unpack(blob: bytes) -> list[np.ndarray]:
    size, *lens = np.frombuffer(blob, np.int64, 1 + len(TYPES)).tolist()
    raw = np.frombuffer(pa.decompress(blob[8 * (1 + len(TYPES)) :], decompressed_size=size, codec="zstd"), np.uint8) if size else np.empty(0, np.uint8)
    out, at = [], 0
    for n, kind in zip(lens, TYPES, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(-1) if n else np.empty(0, kind))
        at += n * width
    return out


def nodes(key: np.ndarray, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves in order of the tree, by doc_id below a node; the node of each, and where nodes begin and end."""
    order = np.lexsort((ids, h, key) if len(h) else (ids, key))
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if len(h):
        s = h[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, first, np.append(first[1:], len(k))[: len(first)] - 1


class Settled:
    """What a task holds of leaves until they are packed: it answers for those that it can decide."""

    def __init__(self, rule: str, group_of: Callable[[np.ndarray], np.ndarray]):
        self.rule, self.group_of, self.turn = rule, group_of, 0
        self._clear()

    def _clear(self) -> None:
        self.parts: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.hs: list[np.ndarray] = []
        self.docs = self.n = 0

    def add(self, key: np.ndarray, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, hs: np.ndarray) -> Iterator[tuple[int, bytes]]:
        self.parts.append((key, h, (doc + self.docs).astype(np.uint32), pos.astype(np.int32)))
        self.ids.append(ids)
        self.hs.append(hs)
        self.docs += len(ids)
        self.n += len(key)
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.n:
            return self._clear()
        key, h, doc, pos = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        ids, hs = np.concatenate(self.ids), np.concatenate(self.hs)
        self._clear()
        order, node, first, last = nodes(key, h, ids[doc])
        key, h, doc, pos = key[order], h[order] if len(h) else h, doc[order], pos[order]
        own = ids[doc]
        if self.rule == "shared":
            answered = (own[first] < own[last])[node]
            ends = np.unique(np.concatenate([first, last]))
            send = np.zeros(len(key), bool)
            send[ends] = True
            send |= ~answered
            sent_pos = np.where(answered, -1, pos)  # the ends of a shared node bear witness for other tasks
        else:
            answered = own > own[first][node]
            send, sent_pos = ~answered, pos
        at = np.flatnonzero(send)
        group = self.group_of(key[at])
        by = np.argsort(group, kind="stable")
        at, group = at[by], group[by]
        cuts = np.flatnonzero(np.diff(group)) + 1
        for part in np.split(at, cuts) if len(at) else []:
            yield int(self.group_of(key[part[:1]])[0]), self._packed(key[part], h[part] if len(h) else h, doc[part], sent_pos[part], ids, hs)
        if answered.any():
            self.turn += 1
            yield self.turn, self._packed(key[:0], h[:0], doc[answered], pos[answered], ids, hs)

    @staticmethod
    def _packed(key: np.ndarray, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, hs: np.ndarray) -> bytes:
        used, doc = np.unique(doc, return_inverse=True)
        return pack(key, h, doc.astype(np.uint32), pos.astype(np.int32), ids[used], hs[used])


def by_document(doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, hs: np.ndarray) -> pa.Table:
    """id, h and the places of each document."""
    order = np.lexsort((pos, hs[doc], ids[doc]))
    a, b = ids[doc][order], hs[doc][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)).astype(np.int32)), pa.array(pos[order].astype(np.int32)))
    return pa.table({"id": a[first], "h": b[first], "pos": lists})


def unpacked(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Key, h, doc and pos of the leaves to decide on and then of those answered; doc counts in the ids and hs of both."""
    cols: list[list[np.ndarray]] = [[np.empty(0, kind)] for kind in [*TYPES, *TYPES]]
    docs = 0
    for blob in table.column("packed"):
        key, h, doc, pos, ids, hs = unpack(blob.as_buffer().to_pybytes())
        for k, new in enumerate((key, h, doc.astype(np.int64) + docs, pos, ids, hs), 0 if len(key) else len(TYPES)):
            cols[k % 6 if k % 6 > 3 else k].append(new)
        docs += len(ids)
    whole = [np.concatenate(c) for c in cols]
    return whole[:6], [*whole[6:10], *whole[4:6]]


def decided(packed: DataFrame, rule: str, groups: int) -> DataFrame:
    """(id, h, pos): of each document, the leaves that the rule holds for.

    Groups answer in columns packed by documents, so that there is no row for each
    document and group; a bucket of documents then puts each one's places together.
    """

    def decide(table: pa.Table) -> pa.Table:
        (key, h, doc, pos, ids, hs), (_, _, done_doc, done_pos, _, _) = unpacked(table)
        own = ids[doc.astype(np.int64)]
        order, node, first, last = nodes(key, h, own)
        own = own[order]
        holds = (own[first] < own[last])[node] if rule == "shared" else own > own[first][node]
        some = order[holds & (pos[order] >= 0)]
        doc, pos = np.concatenate([doc[some], done_doc]).astype(np.int64), np.concatenate([pos[some], done_pos])
        bucket = np.mod(hs[doc], groups)
        by = np.argsort(bucket, kind="stable")
        parts = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []
        none = np.empty(0, np.uint64)
        return pa.table({"bucket": pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), "packed": pa.array([Settled._packed(none, none, doc[p], pos[p], ids, hs) for p in parts], pa.binary())})

    def put_together(table: pa.Table) -> pa.Table:
        _, (_, _, doc, pos, ids, hs) = unpacked(table)
        return by_document(doc.astype(np.int64), pos, ids, hs)

    dealt = packed.withColumn("group", F.pmod("group", F.lit(groups)))
    told = dealt.groupBy("group").applyInArrow(decide, "bucket long, packed binary")
    return told.groupBy("bucket").applyInArrow(put_together, "id long, h long, pos array<int>")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch (text first) of about ``SLICE_BYTES``."""
    ends = np.frombuffer(batch.column(0).buffers()[1], np.int32)[batch.column(0).offset :][: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def blobs(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for group, blob in found:
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([blob], pa.binary())], ["group", "packed"])


def packed_leaves(texts: DataFrame, words: int, group_of: Callable[[np.ndarray], np.ndarray], flagged: bool) -> DataFrame:
    """The anchors of all texts; or, of texts with the places of shared anchors (pos), the suffixes that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Settled("smaller" if flagged else "shared", group_of)
        for batch in batches:
            for part in slices(batch):
                ids, hs = part.column(1).to_numpy(), part.column(2).to_numpy()
                h, counts = word_hashes(part.column(0))
                starts = np.cumsum(counts) - counts
                place, anchor = suffixes(h, counts, words)
                if flagged:
                    lists = part.column(3)
                    sizes = np.diff(lists.offsets.to_numpy())
                    known = np.zeros(len(h), bool)
                    known[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(starts, sizes)] = True
                    place = place[known[anchor]]
                    key, second = prefixes(h, max(0, len(h) - PREFIX + 1))[place], run_hashes(h, words)[place]
                else:
                    place = np.unique(anchor)
                    key, second = run_hashes(h, min(GRAM, words))[place], np.empty(0, np.uint64)
                doc = np.searchsorted(starts + counts, place, "right")
                yield from blobs(held.add(key, second, doc, place - starts[doc], ids, hs))
        yield from blobs(held.flush())

    return texts.select("text", "id", "h", *["pos"] * flagged).mapInArrow(run, "group long, packed binary")


def prefix_bounds(texts: DataFrame, n_docs: int, groups: int, words: int) -> np.ndarray:
    """The groups' first prefixes, from the suffixes of a bounded sample of documents; evenly, where the sample is too small."""
    if groups < 2:
        return np.empty(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, counts = word_hashes(part.column(0))
                place, _ = suffixes(h, counts, words)
                doc = np.searchsorted(np.cumsum(counts), place, "right")
                nth = np.arange(len(place)) - np.searchsorted(doc, doc)
                stride = np.maximum(1, -(-np.bincount(doc, minlength=part.num_rows) // SAMPLE_EACH))
                key = prefixes(h, max(0, len(h) - PREFIX + 1))[place[nth % stride[doc] == 0]]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    some = texts.where(F.pmod(F.xxhash64("h", "id"), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0).select("text")
    keys = np.sort(np.array([r["key"] for r in some.mapInArrow(run, "key long").collect()], np.int64).view(np.uint64))
    if len(keys) < groups:
        return (np.arange(1, groups, dtype=np.float64) * (2.0**64 / groups)).astype(np.uint64)
    return keys[np.arange(1, groups) * len(keys) // groups]


def repeated_leaves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, group: int = GROUP) -> DataFrame:
    """id, h, text and pos (word numbers where repeated runs start; null: none) of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("h"))
    n_docs, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2
    groups = max(1, least, n_bytes // (6 * group))
    many = np.uint64(groups)
    anchors = packed_leaves(texts, words, lambda key: (key % many).astype(np.int64), False)
    shared = decided(anchors, "shared", groups)
    bounds = prefix_bounds(texts, n_docs, groups, words)
    some = texts.join(shared.hint("shuffle_hash"), ["id", "h"])
    leaves = packed_leaves(some, words, lambda key: np.searchsorted(bounds, key, "right"), True)
    return texts.join(decided(leaves, "smaller", groups).hint("shuffle_hash"), ["id", "h"], "left")


def covered(pos: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of n words lie in one of the runs that start at pos."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, pos, 1)
    np.add.at(step, pos + words, -1)
    return np.cumsum(step[:-1]) > 0


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, start and n_words of every maximal run of words that repeated passages cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, pos in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pos = np.sort(pos.values.to_numpy())
                cuts = np.flatnonzero(np.diff(pos) > words) + 1
                out += [(i, int(p[0]), int(p[-1] - p[0] + words)) for p in np.split(pos, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["id", "start", "n_words"])

    found = repeated_leaves(docs, id_col, text_col, words).where("pos IS NOT NULL").select("id", "pos")
    return found.mapInArrow(run, "id long, start long, n_words long").select(F.when(F.col("id") < LAST, F.col("id")).alias("doc_id"), "start", "n_words")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and text (the words that stay, one space between them) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, pos in zip(batch.column(0), batch.column(2), strict=True):
                found = text.as_buffer().to_pybytes().split()  # bytes: ASCII white space alone
                n.append(len(found))
                if pos.is_valid:
                    stay = ~covered(pos.values.to_numpy(), len(found), words)
                    found = list(compress(found, stay.tolist()))
                gone.append(n[-1] - len(found))
                kept.append(b" ".join(found))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "text"])

    out = repeated_leaves(docs, id_col, text_col, words, group).select("text", "id", "pos").mapInArrow(run, "id long, n_words long, n_removed long, text string")
    return out.select(F.when(F.col("id") < LAST, F.col("id")).alias("doc_id"), "n_words", "n_removed", "text")
