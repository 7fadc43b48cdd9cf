"""Approximate nearest neighbours: a small-world graph per shard, results merged.

Rows fall into shards by a hash of their identifier, ``SHARD`` rows in each or
fewer, so a shard has one size whatever the table.  A shard's graph is
hierarchical: a node's top level is geometric by a hash of its identifier, and each
level holds a flat array of neighbour numbers, ``WIDTH`` to a node (twice that on
level 0), padded with -1.  Neighbours come from exact scans of the level in blocks
of a matrix product, thinned by the rule that a neighbour must be nearer to the
node than to the neighbours already chosen, then linked back where room is left;
components that remain apart on a level are tied by a bridge.  A search descends
greedily and widens to ``BREADTH`` candidates on level 0.

Equal vectors of a shard are one node with a list of identifiers, so a vector that
a third of all rows share takes one place in each graph; its list is read in order
and cut at k, which loses nothing from a merged list of k.

Queries go to the shards in blocks of about ``BLOCK_BYTES``, the size of a graph, so
a graph is loaded once for each block and the queries, not the graphs, are what is
copied; each shard gives k for each query and the lists are merged by (score, id).
Scores are cosines in double precision; vectors are scaled by powers of two first,
which changes no digit, so that squares neither overflow nor vanish.

Vectors that are null, empty, of zero length, or hold a null or a non-finite
component take no part, neither as queries nor as candidates; nor do null
identifiers.  Vectors of another length than a query's are not its candidates.
Rows that repeat an identifier are candidates each, but none of a query with that
identifier, however many there are; a query identifier with several vectors is
searched with one of them.  An empty table gives an empty
result.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD, WIDTH, BREADTH, BLOCK_BYTES, POOL = 8192, 16, 192, 8 << 20, 64


def mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of identifiers."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to [0.5, 1)."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(-1, keepdims=True))[1])


def thin(row: np.ndarray, near: np.ndarray, among: np.ndarray, width: int) -> list[int]:
    """Of candidates in order of nearness, those nearer to the node than to those chosen."""
    chosen: list[int] = []
    for c in range(len(row)):
        if not chosen or near[c] > among[c, chosen].max():
            chosen.append(c)
            if len(chosen) == width:
                break
    if len(chosen) < width // 2:  # too few directions: the nearest others fill up
        taken = set(chosen)
        chosen += [c for c in range(len(row)) if c not in taken][: width // 2 - len(chosen)]
    return chosen


def level_graph(x: np.ndarray, members: np.ndarray, width: int) -> np.ndarray:
    """Flat neighbour numbers of the members (rows of x), ``width`` to each."""
    n = len(members)
    flat = np.full((n, width), -1, np.int32)
    if n < 2:
        return flat
    v = x[members]
    fill = np.zeros(n, np.int32)
    pool = min(POOL, n - 1)
    picks: list[list[int]] = []
    for a in range(0, n, 512):
        sims = v[a : a + 512] @ v.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
        best = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        order = np.argsort(-np.take_along_axis(sims, best, 1), axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        for k, row in enumerate(best):
            w = v[row]
            picks.append([int(row[c]) for c in thin(row, sims[k, row], w @ w.T, width // 2)])
    for i, row in enumerate(picks):
        flat[i, : len(row)] = row
        fill[i] = len(row)
    for i, row in enumerate(picks):
        for j in row:
            if fill[j] < width and i not in flat[j, : fill[j]]:
                flat[j, fill[j]] = i
                fill[j] += 1
    bridge(flat, fill)
    return flat


def bridge(flat: np.ndarray, fill: np.ndarray) -> None:
    """Ties the parts that cannot be reached from the first node to it."""
    n, width = flat.shape
    seen = np.zeros(n, bool)
    start = last = 0
    while True:
        todo = [start]
        seen[start] = True
        while todo:
            for j in flat[todo.pop()].tolist():
                if j >= 0 and not seen[j]:
                    seen[j] = True
                    todo.append(j)
        rest = np.flatnonzero(~seen)
        if not len(rest):
            return
        start = int(rest[0])
        # a slot of the last node tied, or of any node reached that has room
        room = np.flatnonzero(seen & (fill < width))
        at = int(room[0]) if len(room) else last
        slot = int(fill[at]) if fill[at] < width else width - 1
        flat[at, slot] = start
        fill[at] = max(fill[at], slot + 1)
        last = start


class Graph:
    """A shard's vectors and its neighbour arrays, level by level."""

    def __init__(self, dim: int, ids: np.ndarray, starts: np.ndarray, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.dim, self.ids, self.starts, self.vectors, self.levels = dim, ids, starts, vectors, levels
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.unit = (vectors / self.norms[:, None]).astype(np.float32)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order], np.float64)
        keys = [r.tobytes() for r in vectors + 0.0]
        first: dict[bytes, int] = {}
        node = np.array([first.setdefault(k, len(first)) for k in keys])
        by_node = np.argsort(node, kind="stable")
        starts = np.searchsorted(node[by_node], np.arange(len(first) + 1))
        ids = ids[by_node]
        vectors = scaled(vectors[by_node][starts[:-1]])
        graph = cls(vectors.shape[1], ids, starts, vectors, [])
        level = np.floor(-np.log((mixed(ids[starts[:-1]]) >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-18) / np.log(WIDTH)).astype(int)
        for k in range(int(level.max()) + 1):
            members = np.flatnonzero(level >= k).astype(np.int32)
            graph.levels.append((members, level_graph(graph.unit, members, WIDTH * (1 if k else 2))))
        return graph

    def search(self, query: np.ndarray, k: int, breadth: int, own: int | None = None) -> list[tuple[int, float]]:
        """Up to k (id, cosine), nearest first, ties to the smaller id; rows of the identifier ``own`` are no candidates."""
        query = scaled(query)
        q = (query / np.sqrt((query**2).sum())).astype(np.float32)
        unit = self.unit
        at = int(self.levels[-1][0][0])
        best = float(unit[at] @ q)
        for members, flat in reversed(self.levels[1:]):
            here = int(np.searchsorted(members, at))
            while True:
                row = flat[here]
                row = row[row >= 0]
                if not len(row):
                    break
                sims = unit[members[row]] @ q
                j = int(sims.argmax())
                if not sims[j] > best:
                    break
                best, here = float(sims[j]), int(row[j])
            at = int(members[here])
        flat = self.levels[0][1]
        seen = np.zeros(len(unit), bool)
        seen[at] = True
        todo, found = [(-best, at)], [(best, at)]
        while todo:
            d, a = heappop(todo)
            if len(found) >= breadth and -d < found[0][0]:
                break
            row = flat[a]
            row = row[row >= 0]
            row = row[~seen[row]]
            if not len(row):
                continue
            seen[row] = True
            for s, j in zip((unit[row] @ q).tolist(), row.tolist(), strict=True):
                if len(found) < breadth:
                    heappush(found, (s, j))
                    heappush(todo, (-s, j))
                elif s > found[0][0]:
                    heapreplace(found, (s, j))
                    heappush(todo, (-s, j))
        nodes = np.array([j for _, j in found])
        exact = (self.vectors[nodes] * query).sum(1) / (self.norms[nodes] * np.sqrt((query**2).sum()))
        out = []
        for j, c in zip(nodes.tolist(), exact.tolist(), strict=True):
            ids = self.ids[self.starts[j] : self.starts[j + 1]]
            out += [(-c, i) for i in (ids if own is None else ids[ids != own])[:k].tolist()]
        return [(i, -c) for c, i in sorted(out)[:k]]

    def pack(self) -> dict[str, bytes | int | list[bytes]]:
        return {"dim": self.dim, "ids": self.ids.astype("<i8").tobytes(), "starts": self.starts.astype("<i4").tobytes(), "vectors": self.vectors.astype("<f8").tobytes(), "members": [m.astype("<i4").tobytes() for m, _ in self.levels], "flat": [f.astype("<i4").tobytes() for _, f in self.levels]}

    @classmethod
    def unpack(cls, r: dict) -> Graph:
        i4 = lambda b: np.frombuffer(b, "<i4")
        members = [i4(m) for m in r["members"]]
        flats = [i4(f).reshape(len(m), -1) for m, f in zip(members, r["flat"], strict=True)]
        return cls(r["dim"], np.frombuffer(r["ids"], "<i8"), i4(r["starts"]), np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dim"]), list(zip(members, flats, strict=True)))


GRAPH = "shard int, dim int, ids binary, starts binary, vectors binary, members array<binary>, flat array<binary>"


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda c: c != 0))


def build_index(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """A row per shard and vector length: the graph as flat arrays."""
    good = usable(rows, id_col, vec_col)
    shards = max(1, -(-good.count() // shard))
    keyed = good.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        v = group.column("v").combine_chunks()
        dim = key[1].as_py()
        graph = Graph.build(group.column("id").to_numpy().astype(np.int64), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
        kinds = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("starts", pa.binary()), ("vectors", pa.binary()), ("members", pa.list_(pa.binary())), ("flat", pa.list_(pa.binary()))])
        return pa.Table.from_pylist([{"shard": key[0].as_py()} | graph.pack()], kinds)

    return keyed.repartition(shards, "shard", "dim").groupBy("shard", "dim").applyInArrow(run, GRAPH)


def search_index(index: DataFrame, queries: DataFrame, k: int = 5, breadth: int = BREADTH, skip_self: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score; queries: id and v.  With skip_self, a query's own id is no candidate."""
    index = cut(index, "index")
    queries = queries.withColumn("dim", F.size("v"))
    blocks = queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / F.lit(BLOCK_BYTES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    grouped = queries.join(blocks, "dim").groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    tasks = grouped.join(index.select("shard", "dim"), "dim").join(index, ["shard", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                graph, out = Graph.unpack(r), []
                for q in r["queries"]:
                    out += [(q["id"], j, c) for j, c in graph.search(np.array(q["v"]), k, breadth, q["id"] if skip_self else None)]
                cols = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = tasks.repartition("shard", "block").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(rows: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k nearest others of each row whose vec_id is divisible by ``every``."""
    queries = usable(rows, "vec_id", "embedding").where(F.col("id") % every == 0).dropDuplicates(["id"])
    return search_index(build_index(rows), queries, k)
