r"""N-gram Jaccard join: documents by n-grams as a sparse matrix, multiplied by blocks.

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; a document's set holds its
distinct ``N``-word shingles (fewer words: the whole sequence), as 64-bit hashes.
Two documents link if ``100 * |x & y| >= PERCENT * |x | y|``.

1. Sets are counted into a sketch of 2 ** BITS counters over all documents (one
   size for any table); (counter, hash) is a total order of shingles with frequent
   ones last.  Sets whose 128-bit digests and sizes are equal are one node from here
   on.  A node is named by half of its digest, or by the other half where two nodes
   have the first in common.
2. The matrix keeps, of each row, the first |x| - ceil(t |x|) + 1 entries of that
   order: linked rows share one of these.  Its columns (blocks) with one row are
   dropped.
3. In each block every node meets two leaders: the one of which the largest part of
   the kept entries is shared (the copy with the fewest changes of its own), and the
   smallest by hash.  Overlap counts are summed over blocks; pairs whose count is
   below the bound that the two sizes imply wait.  The others are compared exactly
   and give the first components: a group of n near copies costs O(n) comparisons.
4. Blocks that still hold several components are multiplied out across components.
   With o = ceil(t / (1 + t) (|x| + |y|)), linked sets share c = o - ceil(t max(|x|,
   |y|)) + 1 kept entries or more.  The first of these in the order has the place |x| -
   o or less in x and |y| - o or less in y, and c - 1 shared entries or more after it
   in both.  Only such products are made: in a group of near copies most shared entries
   come too late for one of the two.  Overlaps of the pairs that they give are counted
   over all of their entries; those that reach c are compared exactly.  So no link
   between components is lost, and none inside them is needed.

Bounds hold for any order of the shingles, so the sketch never changes a result.
A block of up to ``HOT`` rows is one task's; the counters bound every block.  Larger
blocks, which the sketch shows, are aggregated before their rows meet the aggregate,
spread over tasks.

Null texts and texts without words have an empty set and link with nothing.  Equal
texts (ties, repeated rows) are one node.  A null doc_id keeps its row, with its own
set size; it takes the component of its text, of near copies too, and is no component's
name.  An empty table gives an empty result.  Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, cut, discard, kept_in_worker, salted_join, without
from .components import components
from .exact_dedup import KEY, tree_keep

N, PERCENT, BITS, CHUNKS = 5, 80, 20, 16
SEEN, WORDS, HOT = 200_000, 300_000, 1 << 20
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class Hashes(dict):
    """64-bit hashes of words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) < 200:
            self[word] = value
        return value


def shingles(text: str | None, hashes: Hashes, n: int = N) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b"\n".join(words), len(words))], np.uint64)
    h = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    size = len(h) - n + 1
    a = h[:size] * FACTORS[0]
    for i in range(1, n):
        a = (a ^ (a >> np.uint64(29))) * FACTORS[i % len(FACTORS)] + h[i : i + size]
    a ^= a >> np.uint64(32)
    a *= FACTORS[0]
    a ^= a >> np.uint64(29)
    return np.unique(a)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit digest of a set, as two signed integers."""
    whole = xxhash.xxh3_128_digest(s.tobytes(), len(s) & 0xFFFFFFFF)
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)


def node_of(s: np.ndarray, clash: frozenset[int]) -> int:
    """The name of a set's node; ``clash`` holds the first halves that several sets have."""
    first, second = fingerprint(s)
    return second if first in clash else first


def counter_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BITS)).astype(np.int64)


def read_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, key, key2 (digest) and text_key of every row; and the sketch's chunks (doc_id null, chunk not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch = kept_in_worker(("hashes",), Hashes), np.zeros(1 << BITS, np.int32)
        names = ["doc_id", "n_shingles", "key", "key2", "text_key", "chunk", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            sizes, keys = [], []
            for t in (v.as_py() for v in batch.column(1)):
                s = shingles(t, hashes, n)
                sizes.append(len(s))
                keys.append(fingerprint(s))
                np.add.at(sketch, counter_of(s), 1)
            cols = [batch.column(0), sizes, [k[0] for k in keys], [k[1] for k in keys], batch.column(2), [None] * len(keys), [None] * len(keys)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        for k, part in enumerate(sketch.reshape(CHUNKS, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([None, None, None, None, None, k, zlib.compress(part.tobytes(), 1)], kinds, strict=True)], names)

    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return docs.mapInArrow(run, "doc_id long, n_shingles long, key long, key2 long, text_key long, chunk int, counts binary")


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sum_sketches(parts: DataFrame) -> np.ndarray:
    """All sketches added up: within tasks, then chunk by chunk; 2 ** BITS counters reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.int32)
                total[k] = np.minimum(total[k].astype(np.int64) + part, 2**31 - 1).astype(np.int32) if k in total else part
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    added = parts.mapInArrow(run, "chunk int, counts binary").repartition(CHUNKS, "chunk").mapInArrow(run, "chunk int, counts binary")
    sketch = np.zeros((CHUNKS, (1 << BITS) // CHUNKS), np.int32)
    for r in added.collect():
        sketch[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int32)
    return sketch.reshape(-1)


def at_least(x: Column, percent: int) -> Column:
    """ceil(percent / 100 * x) in integers."""
    return ((x * percent + 99) / 100).cast("long")


def least_overlap(x: Column, y: Column, percent: int) -> Column:
    """The least overlap of linked sets of these sizes: ceil(t / (1 + t) * (x + y))."""
    return (((x + y) * percent + 99 + percent) / (100 + percent)).cast("long")


def least_count(x: Column, y: Column, percent: int) -> Column:
    """How many kept entries linked sets of these sizes share at least."""
    return least_overlap(x, y, percent) - at_least(F.greatest(x, y), percent) + 1


def sizes_fit(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def kept_entries(docs: DataFrame, sketch, n: int, percent: int, clash: frozenset[int], hot: int | None) -> DataFrame:
    """(s, k, n, place): the first entries of each set in the order of the shingles; with ``hot``, whether more rows may hold s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, seen = kept_in_worker(("hashes",), Hashes), sketch.value, set()
        for batch in batches:
            out, keys, sizes, many = [], [], [], []
            for t in (v.as_py() for v in batch.column(0)):
                s = shingles(t, hashes, n)
                if not len(s):
                    continue
                key = node_of(s, clash)
                if key in seen:  # the table drops what another task has as well
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                size = len(s)
                keep = size - -(-percent * size // 100) + 1
                c = counts[counter_of(s)].astype(np.int64)
                near = np.flatnonzero(c <= np.partition(c, keep - 1)[keep - 1])
                near = near[np.argsort(c[near], kind="stable")[:keep]]  # s is sorted: ties stay in order of hash
                out.append(s[near].view(np.int64))
                keys.append(key)
                sizes.append(size)
                if hot is not None:
                    many.append(c[near] > hot)
            if out:
                lens = [len(o) for o in out]
                each = [pa.array(np.repeat(np.array(v, np.int64), lens)) for v in (keys, sizes)]
                cols = [pa.array(np.concatenate(out)), *each, pa.array(np.concatenate([np.arange(x, dtype=np.int64) for x in lens]))]
                names = ["s", "k", "n", "place"]
                if hot is not None:
                    cols.append(pa.array(np.concatenate(many)))
                    names.append("hot")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("text").mapInArrow(run, "s long, k long, n long, place long" + ", hot boolean" * (hot is not None))


def over_blocks(rows: DataFrame, aggregates: dict[str, Column], salts: int) -> DataFrame:
    """``rows`` with aggregates of their block s; with salts, the rows of a hot block are spread over as many tasks."""
    whole = Window.partitionBy("s")
    if not salts:
        return rows.withColumns({name: a.over(whole) for name, a in aggregates.items()})
    calm = rows.where("NOT hot").withColumns({name: a.over(whole) for name, a in aggregates.items()})
    few = rows.where("hot").groupBy("s").agg(*[a.alias(name) for name, a in aggregates.items()])
    return calm.unionByName(salted_join(rows.where("hot"), few, "s", "k", salts=salts))


def sets_of(docs: DataFrame, nodes: DataFrame, n: int, clash: frozenset[int]) -> DataFrame:
    """(k, size, members) of the nodes (doc_id, k), read again from the texts."""
    nodes = cut(nodes, "nodes")
    few = nodes.count() <= FEW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept_in_worker(("hashes",), Hashes)
        for batch in batches:
            keys, raws, sizes = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(t, hashes, n)
                node = node_of(s, clash)
                if k is None or node == k:
                    keys.append(node)
                    raws.append(s.tobytes())
                    sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(raws, pa.binary())], ["k", "size", "members"])

    kinds = "k long, size long, members binary"
    known = nodes.where("doc_id IS NOT NULL")
    rows = docs.join(F.broadcast(known) if few else known, "doc_id").select("k", "text").mapInArrow(run, kinds)
    unnamed = nodes.where("doc_id IS NULL").select("k")
    if not unnamed.isEmpty():  # no doc_id leads to these texts: all without one are read
        read = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("k"), "text").mapInArrow(run, kinds)
        rows = rows.unionByName(read.join(unnamed, "k", "left_semi"))
    return cut(rows.dropDuplicates(["k"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, compared in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            keep = []
            for x, y in zip(xs, ys, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # merges two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("k").alias("a"), F.col("members").alias("x")), "a")
    rows = left.join(sets.select(F.col("k").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return rows.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, hot: int = HOT, with_key: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; ``with_key``: and text_key."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read = cut(read_sets(docs, n), "read")
    sketch = sum_sketches(read.where("chunk IS NOT NULL").select("chunk", "counts"))
    meta = read.where("chunk IS NULL").select("doc_id", "n_shingles", "key", "key2", "text_key")
    # equal sets: the least doc_id stands for them; empty sets stand alone
    second = F.when(F.col("n_shingles") == 0, F.coalesce("doc_id", F.lit(0))).otherwise(F.col("key2"))
    groups = tree_keep(meta.withColumns({KEY[0]: F.col("key"), KEY[1]: F.col("n_shingles"), KEY[2]: second}), "doc_id", largest=False)
    groups = cut(groups.select("doc_id", "n_shingles", "key", "key2", "text_key", F.col("keep_id").alias("rep")), "groups")
    reps = cut(groups.where("doc_id <=> rep AND n_shingles > 0").select("doc_id", "key", "key2").distinct(), "reps")
    # of the 2 ** 64 first halves, n nodes have about n * n / 2 ** 65 in common
    clash = frozenset(r["key"] for r in reps.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key").collect())
    if clash:
        named = F.when(F.col("key").isin(list(clash)), F.col("key2")).otherwise(F.col("key"))
        groups, reps = groups.withColumn("key", named), reps.withColumn("key", named)
    reps = reps.select("doc_id", F.col("key").alias("k"))

    salts = -(-int(sketch.max(initial=0)) // hot) if sketch.max(initial=0) > hot else 0
    whole, own = Window.partitionBy("s"), Window.partitionBy("k")
    entries = kept_entries(docs, spark.sparkContext.broadcast(sketch), n, percent, clash, hot if salts else None)
    ends = {"lo": F.min("k"), "hi": F.max("k")}
    if salts:
        entries = cut(entries, "entries")
        once = entries.where("NOT hot").withColumn("before", F.lag("k").over(whole.orderBy("k"))).where("NOT (before <=> k)").drop("before")
        blocks = over_blocks(once.unionByName(entries.where("hot").dropDuplicates(["s", "k"])), ends, salts).where("lo <> hi")
    else:
        blocks = over_blocks(entries.withColumn("before", F.lag("k").over(whole.orderBy("k"))), ends, 0).where("lo <> hi AND NOT (before <=> k)").drop("before")
    # rank: how many shared entries come no later; shared: all of them
    blocks = cut(blocks.drop("lo", "hi").withColumns({"rank": F.row_number().over(own.orderBy("place")), "shared": F.count(F.lit(1)).over(own)}), "blocks")

    part = F.col("shared") / (F.col("n") - at_least(F.col("n"), percent) + 1)
    heads = {"first": F.min(F.struct(-part, "k", "n")), "second": F.min(F.struct(F.xxhash64("k"), "k", "n"))}
    leader = over_blocks(blocks, heads, salts).select("k", "n", F.posexplode(F.array(F.struct("first.k", "first.n"), F.struct("second.k", "second.n"))).alias("role", "l"))
    leader = leader.where("l.k <> k").select("k", "n", "role", F.col("l.k").alias("lk"), F.col("l.n").alias("ln"))
    met = leader.where(sizes_fit(F.col("n"), F.col("ln"), percent)).groupBy("k", "n", "role", "lk", "ln").agg(F.count(F.lit(1)).alias("c"))
    met = met.where(F.col("c") >= least_count(F.col("n"), F.col("ln"), percent))
    best = met.groupBy("k", "role").agg(F.max(F.struct("c", "lk")).alias("top")).select("k", F.col("top.lk").alias("l"))
    first = cut(best.select(F.col("k").alias("a"), F.col("l").alias("b")).distinct(), "first")
    links = cut(_linked(docs, reps, first, n, percent, clash), "links")
    found = cut(components(links), "components1")

    labelled = blocks.join(found.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component")
    mixed = cut(over_blocks(labelled, {"least": F.min("c"), "most": F.max("c")}, salts).where("least <> most").drop("least", "most"), "mixed")
    second = cut(across_components(mixed, percent), "second")
    if not second.isEmpty():
        links = cut(links.unionByName(_linked(docs, reps, second, n, percent, clash)), "links2")
        found = cut(components(links), "components2")
    discard(read, blocks, mixed)

    # components of keys become components of documents
    least = reps.groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    named = found.withColumnRenamed("node", "key").join(least.withColumnRenamed("k", "key"), "key")
    first_of = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_key = salted_join(named, first_of, "component", "key").select("key", "component_id")
    rows = salted_join(groups, by_key, "key", "doc_id", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"), *["text_key"] * with_key).withColumnRenamed("doc_id", id_col)


def first_in_common(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b, bound, s): the shared entries of two components' nodes that can be the first of ``bound`` shared ones, of nodes that may link."""
    x, y = mixed.alias("x"), mixed.alias("y")
    overlap, bound = (least(F.col("x.n"), F.col("y.n"), percent) for least in (least_overlap, least_count))
    first = lambda r: (F.col(f"{r}.place") <= F.col(f"{r}.n") - overlap) & (F.col(f"{r}.rank") <= F.col(f"{r}.shared") - bound + 1)
    most = F.least("x.rank", "y.rank") + F.least(F.col("x.shared") - F.col("x.rank"), F.col("y.shared") - F.col("y.rank"))
    fit = sizes_fit(F.col("x.n"), F.col("y.n"), percent) & (most >= bound) & first("x") & first("y")
    products = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.k") < F.col("y.k")) & (F.col("x.c") != F.col("y.c")) & fit)
    return products.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), bound.alias("bound"), F.col("x.s").alias("s"))


def across_components(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes of two components whose overlap count reaches the bound of their sizes."""
    met = first_in_common(mixed, percent).select("a", "b", "bound").distinct()
    entries = mixed.groupBy("k").agg(F.collect_list("s").alias("kept"))
    pairs = met.join(entries.select(F.col("k").alias("a"), F.col("kept").alias("x")), "a")
    pairs = pairs.join(entries.select(F.col("k").alias("b"), F.col("kept").alias("y")), "b")
    return pairs.where(F.size(F.array_intersect("x", "y")) >= F.col("bound")).select("a", "b")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document (the least doc_id) of each component; rows that repeat a doc_id go or stay by their own text."""
    gone = near_groups(docs, with_key=True).where("doc_id <> component_id").select("doc_id", "text_key")
    return without(docs, gone, doc_id=docs["doc_id"], text_key=text_key(docs["text"]))


def _linked(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, percent: int, clash: frozenset[int]) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct().join(reps, "k").select("doc_id", "k")
    return verified(pairs, sets_of(docs, nodes, n, clash), percent)
