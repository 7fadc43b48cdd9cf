"""Hard-negative mining by a distributed nearest-neighbour join over Voronoi cells.

Scores are inner products of integer vectors (see ``vectors``), exact in double
precision or int64.  Rows x are augmented to x' = (x, sqrt(M - |x|^2)), M the largest
squared norm, and anchors a to (a, 0): then |a' - x'|^2 = |a|^2 + M - 2 a.x, so order
by score is order by distance, and the triangle inequality holds.

1. Pivots are rows drawn by hash, one for ``ANCHORS`` anchors, ``PIVOTS`` at most.
   Anchors go to the cell of their nearest pivot; a cell knows its anchors' largest
   distance U.  Rows of each (cell, label) give the distances of the k + 1 nearest to
   the pivot, which bound from above how far the k-th positive of an anchor can be.
2. Positives: a row at distance D from the pivot of a cell is sent there if D - U is
   not above that bound, by class of label (``CLASSES`` at most, so that bounds have
   one size whatever the labels).
3. An anchor's positives give the scores, hence distances, between which its negatives
   lie.  A row is sent to a cell if [D - U, D + U] meets the cell's interval.
4. In a cell, blocks of ``BLOCK`` anchors meet chunks of the rows sent there, dealt by
   hash of the identifier and bounded by ``CHUNK_BYTES``: each pair is one task's exact
   join by matrix products, which gives the first k of each anchor; those of all chunks
   are merged.  So a hot label, vector or cell is spread over chunks, and no row is
   left out unless the bounds prove that it serves no anchor of the cell.

Bounds are widened by what rounding may cost.  Where vectors are spread evenly over
many dimensions, bounds exclude little and the work is that of all anchors times all rows.

Rows with a null identifier or label take no part.  Other rows of an anchor are those
with another identifier.  Rows that repeat an identifier are rows of their own, as
candidates and as positives; equal anchors count once, and an anchor identifier with
several vectors or labels is an anchor for each.  Without positives an anchor has no
rows, nor has a positive of a negative score, whose interval is empty.  Labels are
integers.  An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import integer_rows, matrix

ANCHORS, PIVOTS, CLASSES, BLOCK, CHUNK_BYTES = 64, 256, 64, 4096, 16 << 20
AKEY = ["anchor_id", "copy"]
CELL = ["cell", "block", "chunk"]


class Cells:
    """Pivots in augmented space, and distances to them."""

    def __init__(self, pivots: np.ndarray, largest: int):
        self.largest = float(largest)
        self.pivots = pivots.astype(np.float64)
        self.last = np.sqrt(np.maximum(0.0, self.largest - (self.pivots**2).sum(1)))
        self.slack = 1e-6 * (1.0 + np.sqrt(self.largest))
        self.apart = self.distances(self.pivots)

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Of rows, or of anchors, to all pivots."""
        x = x.astype(np.float64)
        own = (x**2).sum(1)
        inner = x @ self.pivots.T
        if anchors:
            return np.sqrt(np.maximum(0.0, own[:, None] + self.largest - 2 * inner))
        return np.sqrt(np.maximum(0.0, 2 * self.largest - 2 * (inner + np.sqrt(np.maximum(0.0, self.largest - own))[:, None] * self.last)))


def scores_of(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return a @ x.T


def first_k(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, largest first, ties in order of place."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.argsort(-score[some], kind="stable")[:k]]


def nearest_of(cell: np.ndarray, label: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances of distinct identifiers for each (cell, label)."""
    by = np.lexsort((dist, ids, label, cell))
    same = (cell[by][1:] == cell[by][:-1]) & (label[by][1:] == label[by][:-1]) & (ids[by][1:] == ids[by][:-1])
    by = by[np.concatenate([[True], ~same])] if len(by) else by
    by = by[np.lexsort((dist[by], label[by], cell[by]))]
    new = np.concatenate([[True], (cell[by][1:] != cell[by][:-1]) | (label[by][1:] != label[by][:-1])]) if len(by) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) if len(by) else by
    return by[np.arange(len(by)) - start < k]


def near_pivots(rows: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(cell, label, id, dist): of each cell and label, the rows nearest to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.float64)]
        for batch in batches:
            d = cells.distances(matrix(batch.column(2), cells.pivots.shape[1]))
            cell = d.argmin(1)
            new = [cell, batch.column(1).to_numpy(), batch.column(0).to_numpy(), d[np.arange(len(d)), cell]]
            both = [np.concatenate(c) for c in zip(held, new, strict=True)]
            keep = nearest_of(*both, k)
            held = [c[keep] for c in both]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["cell", "label", "id", "dist"])

    return rows.select("id", "label", "q").mapInArrow(run, "cell long, label long, id long, dist double")


def reach(anchors: DataFrame, near: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(cell, label, far): a distance within which every anchor of the cell and label has k other rows of its label."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cell, most = left.column("cell").to_numpy(), left.column("most").to_numpy()
        home, ids, dist = (right.column(c).to_numpy() for c in ("cell", "id", "dist"))
        far = []
        for c, u in zip(cell.tolist(), most.tolist(), strict=True):
            upper = u + cells.apart[c][home] + dist
            order = np.argsort(upper, kind="stable")
            first = np.sort(np.unique(ids[order], return_index=True)[1])  # an identifier counts once
            far.append(upper[order][first[k - 1]] if len(first) >= k else np.inf)
        return pa.table({"cell": cell, "label": left.column("label").to_numpy(), "far": np.array(far, np.float64)})

    wide = anchors.groupBy("cell", "label").agg(F.max("dist").alias("most"))
    return wide.groupBy("label").cogroup(near.groupBy("label")).applyInArrow(run, "cell long, label long, far double")


def served(rows: DataFrame, cells: Cells, radius: np.ndarray, low: np.ndarray, high: np.ndarray, blocks: np.ndarray, chunks: int) -> DataFrame:
    """The rows, once for each block of a cell that they may serve: low and high are distances by cell and class of label."""
    shared = rows.sparkSession.sparkContext.broadcast((cells, radius, low, high, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, radius, low, high, blocks = shared.value
        for batch in batches:
            d = cells.distances(matrix(batch.column(2), cells.pivots.shape[1]))
            label = np.mod(batch.column(1).to_numpy(), CLASSES)
            fit = (d - radius - cells.slack <= high[:, label].T) & (d + radius + cells.slack >= low[:, label].T)
            row, cell = np.nonzero(fit)
            times = blocks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for a in range(0, len(row), 4096):
                part = batch.take(pa.array(row[a : a + 4096]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[a : a + 4096]), pa.array(block[a : a + 4096])], ["id", "label", "q", "chunk", "cell", "block"])

    kinds = "id long, label long, q array<long>, chunk long, cell long, block long"
    return rows.select("id", "label", "q", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk")).mapInArrow(run, kinds)


def local_join(anchors: DataFrame, sent: DataFrame, chunks: int, width: int, pick: Callable, kinds: str) -> DataFrame:
    """``pick`` for each block of anchors and chunk of rows; it gets an anchor's row, and identifiers, labels and scores in order of identifier."""
    names = [c.split()[0] for c in kinds.split(", ")]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            ids, labels = right.column("id").to_numpy(), right.column("label").to_numpy()
            x, a = matrix(right.column("q").combine_chunks(), width), matrix(left.column("q").combine_chunks(), width)
            whole = left.drop_columns(["q"]).to_pylist()
            for i in range(0, len(a), 64):
                for row, score in zip(whole[i : i + 64], scores_of(a[i : i + 64], x), strict=True):
                    for found in pick(row, ids, labels, score):
                        for column, value in zip(out, found, strict=True):
                            column.append(np.full(len(found[-1]), value) if np.ndim(value) == 0 else value)
        return pa.table({n: np.concatenate(c) if c else np.empty(0, np.int64) for n, c in zip(names, out, strict=True)})

    spread = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    return spread.groupBy(*CELL).cogroup(sent.groupBy(*CELL)).applyInArrow(run, kinds)


def ranked(found: DataFrame, keys: list[str], k: int, id_col: str, score_col: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score_col), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, pivots: int = PIVOTS, chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK,
) -> DataFrame:
    """Of each anchor (``is_anchor`` over id) and positive, the first rows of other labels with least to most per cent of the positive's score."""
    spark = rows.sparkSession
    good, width = integer_rows(rows, id_col, vec_col, label_col, bits=55)  # 100 times a score fits a long
    good = good.where("id IS NOT NULL AND label IS NOT NULL").withColumn("label", F.col("label").cast("long"))
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda s, c: s + c * c)
    n, n_anchors, largest = good.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max(norm)).first()
    final = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], final)
    drawn = good.orderBy(F.xxhash64("id"), "id", "q").limit(min(pivots, -(-n_anchors // ANCHORS))).collect()
    cells = Cells(np.array([r["q"] for r in drawn], np.int64), largest)
    chunks = -(-n // max(64, chunk_bytes // (8 * width)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = cells.distances(matrix(batch.column(2), width), anchors=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1)), pa.array(d.min(1, initial=np.inf))], [*batch.schema.names, "cell", "dist"])

    whole = good.where(is_anchor).distinct()
    whole = whole.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("label", "q")).cast("long"))
    placed = whole.select("id", "label", "q", "copy", norm.alias("norm")).mapInArrow(place, "id long, label long, q array<long>, copy long, norm long, cell long, dist double")
    anchors = cut(placed.withColumnRenamed("id", "anchor_id"), "anchors")
    in_cell = {r["cell"]: (r["n"], r["most"]) for r in anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("most")).collect()}
    p = len(cells.pivots)
    blocks = np.array([-(-in_cell.get(c, (0, 0))[0] // block) for c in range(p)])
    radius = np.array([in_cell.get(c, (0, 0.0))[1] for c in range(p)])
    size = F.element_at(F.lit([max(1, int(b)) for b in blocks]), (F.col("cell") + 1).cast("int"))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64(*AKEY), size).cast("long"))

    # positives
    far = reach(anchors, near_pivots(good, cells, positives + 1), cells, positives + 1)
    high = np.full((p, CLASSES), -np.inf)
    for r in far.groupBy("cell", F.pmod("label", F.lit(CLASSES)).alias("class")).agg(F.max("far").alias("far")).collect():
        high[r["cell"], r["class"]] = r["far"]
    sent = served(good, cells, radius, np.full((p, CLASSES), -np.inf), high, blocks, chunks)

    def alike(row: dict, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> Iterator[tuple]:
        some = np.flatnonzero((labels == row["label"]) & (ids != row["anchor_id"]))
        some = some[first_k(score[some], positives)]
        yield row["anchor_id"], row["copy"], ids[some], score[some]

    found = local_join(anchors.select(*AKEY, *CELL[:2], "label", "q"), sent, chunks, width, alike, "anchor_id long, copy long, id long, score long")
    found = ranked(found, AKEY, positives, "id", "score").groupBy(*AKEY).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    anchors = cut(anchors.join(found, AKEY).where(F.exists("positives", lambda x: x["score"] >= 0)), "positives")

    # negatives
    bound = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(float(largest)) - 2 * c))
    some = F.transform(F.filter("positives", lambda x: x["score"] >= 0), lambda x: x["score"])
    ends = anchors.groupBy("cell").agg(F.min(bound(F.array_max(some) * most / 100)).alias("low"), F.max(bound(F.array_min(some) * least / 100)).alias("high"))
    low, high = np.full((p, CLASSES), np.inf), np.full((p, CLASSES), -np.inf)
    for r in ends.collect():
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    sent = served(good, cells, radius, low, high, blocks, chunks)

    def unlike(row: dict, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> Iterator[tuple]:
        wins = [(x["rank"], x["id"], x["score"], -(-least * x["score"] // 100), most * x["score"] // 100) for x in row["positives"] if x["score"] >= 0]
        some = np.flatnonzero((labels != row["label"]) & (ids != row["anchor_id"]) & (score >= min(w[3] for w in wins)) & (score <= max(w[4] for w in wins)))
        some = some[np.argsort(-score[some], kind="stable")]
        falling = -score[some]
        for slot, positive, value, lo, hi in wins:
            got = some[np.searchsorted(falling, -hi, "left") : np.searchsorted(falling, -lo, "right")][:negatives]
            yield row["anchor_id"], row["copy"], slot, positive, value, ids[got], score[got]

    kinds = "anchor_id long, copy long, slot long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = local_join(anchors.select(*AKEY, *CELL[:2], "label", "q", "positives"), sent, chunks, width, unlike, kinds)
    best = ranked(found, [*AKEY, "slot"], negatives, "negative_id", "negative_score")
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
