"""Toxicity by multiple-instance learning: sentences are scored, documents labelled.

A sentence's probability is a logistic function of the sum of its words' weights;
a document's is the noisy-or of its sentences: 1 - prod(1 - p).  Only documents
carry labels in training, and the gradient passes through the noisy-or to the
sentences, so the trained model also says which sentences offend.

A word has the weights of three hashed features: the word in lower case and its
first four and five characters.  Features are hashed into ``2 ** BITS`` buckets, so
the model has one size.

The model is fitted on a bounded sample of the rows whose crc32(doc_id as text) mod 5
is not 0: of each class those with the smallest hashes of doc_id, ``SAMPLE`` rows and
``SAMPLE_WORDS`` words at most.  Executors turn their whole texts into words' buckets,
and only these reach the driver; weights restore the share of the classes among all
such rows.  Labels, lang, source and doc_id are no inputs of a score.  Every whole text
is scored.  ``RATE`` and ``SHRINK`` were chosen by ``cross_validate`` inside the rows
that may be learnt from.

Null and empty texts have no sentence and get the score of an empty product, 0.
Without labels of both classes every score is 0.  Labels that are null are left
out; of repeated labels of a document the largest holds.  Rows with a null doc_id
are scored and count as not held out.  Extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, kept_in_worker

BITS, SAMPLE, SAMPLE_WORDS, LEAST_DOCS = 18, 3000, 4_000_000, 3
STEPS, RATE, DECAY, SHRINK = 120, 0.3, 1e-6, 0.15
SENTENCE = re.compile(r"[^.!?\n]+")
EDGE = ".,;:!?\"'()[]{}<>*%&$#@-_=+~`|/\\"
CACHE = 200_000


def features(piece: str) -> list[int]:
    """The three buckets of a white-space separated piece of text; none if it has no word."""
    word = piece.strip(EDGE).lower()
    if not word:
        return []
    mask = (1 << BITS) - 1
    return [zlib.crc32(x.encode()) * 0x9E3779B1 >> 7 & mask for x in (f"w {word}", f"4 {word[:4]}", f"5 {word[:5]}")]


class Packed(dict):
    """The buckets of pieces seen lately, in one integer; -1 for none."""

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = sum(f << BITS * i for i, f in enumerate(features(piece))) if piece.strip(EDGE) else -1
        if len(piece) < 200:
            self[piece] = value
        return value


def sentences(text: str | None, packed: Packed) -> tuple[list[int], list[int]]:
    """The packed words of a text, and how many each sentence has."""
    words, sizes = [], []
    for m in SENTENCE.finditer(text or ""):
        pieces = m.group().split()
        if pieces:
            got = [x for x in map(packed.__getitem__, pieces) if x >= 0]
            words += got
            sizes.append(len(got))
    return words, sizes


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def key(self) -> tuple:
        return "toxicity", zlib.crc32(self.weights.tobytes()), self.bias

    def word(self, piece: str) -> float:
        return sum(float(self.weights[f]) for f in features(piece))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class Bags:
    """Labelled documents as flat arrays: sentences of documents, words of sentences, buckets of words."""

    toxic: np.ndarray  # a label for each document
    doc: np.ndarray  # the document of each sentence
    sentence: np.ndarray  # the sentence of each word
    word: np.ndarray  # which distinct word it is
    buckets: np.ndarray  # the buckets of each distinct word, three in a row

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Bags:
        """From (packed words, sizes of sentences, label) of each document."""
        words = np.concatenate([np.empty(0, np.int64), *[r[0] for r in rows]]).astype(np.int64, copy=False)
        sizes = np.concatenate([np.empty(0, np.int32), *[r[1] for r in rows]]).astype(np.int32, copy=False)
        distinct, word = np.unique(words, return_inverse=True)
        mask = (1 << BITS) - 1
        buckets = np.stack([(distinct >> BITS * i & mask).astype(np.int32) for i in range(3)], 1)
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows])
        return cls(np.array([r[2] for r in rows], bool), doc, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), word.astype(np.int32), buckets)

    def support(self) -> np.ndarray:
        """For each bucket, the documents of its words; repeats of a word in a document count once."""
        pairs = self.doc[self.sentence].astype(np.int64) * len(self.buckets) + self.word
        pairs.sort()
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]
        each = np.bincount(pairs % max(1, len(self.buckets)), minlength=len(self.buckets))
        return np.bincount(self.buckets.reshape(-1), np.repeat(each, 3), 1 << BITS)


def gradient(bags: Bags, w: np.ndarray, b: float, weight: np.ndarray, learnt: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The weighted log loss of the noisy-or, and its gradient by weights and bias; only ``learnt`` buckets count."""
    value = (w * learnt)[bags.buckets].sum(1)
    z = np.bincount(bags.sentence, value[bags.word], len(bags.doc)) + b
    total = np.bincount(bags.doc, softplus(z), len(bags.toxic))  # -log of the product of 1 - p
    clipped = np.clip(total, 1e-9, 50)
    loss = float((np.where(bags.toxic, -np.log(-np.expm1(-clipped)), total) * weight).sum())
    slope = np.where(bags.toxic, -1 / np.expm1(clipped), 1.0) * weight
    gz = slope[bags.doc] / (1 + np.exp(-np.clip(z, -50, 50)))
    gword = np.bincount(bags.word, gz[bags.sentence], len(bags.buckets))
    return loss, np.bincount(bags.buckets.reshape(-1), np.repeat(gword, 3), len(w)) * learnt, float(gz.sum())


def class_weights(toxic: np.ndarray, share: float) -> np.ndarray:
    """Weights of documents that restore the share of toxic ones."""
    return np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean())) / len(toxic)


def fit(bags: Bags, share: float, rate: float = RATE, shrink: float = SHRINK, steps: int = STEPS) -> Model:
    """A model of labelled documents; ``share``: toxic rows among all that may be learnt from."""
    if not len(bags.word) or not bags.toxic.any() or bags.toxic.all():
        return Model(np.zeros(1 << BITS, np.float32), -np.inf)
    learnt = bags.support() >= LEAST_DOCS  # features of fewer documents are not learnt
    weight = class_weights(bags.toxic, share)
    w, b = np.zeros(1 << BITS), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        _, g, gb = gradient(bags, w, b, weight, learnt)
        g += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        now = rate * (1 - (step - 1) / steps)  # falls to 0, so that the last steps settle
        w -= now * (m / fix) / (np.sqrt(v / fix2) + 1e-7)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink * now, 0)
        b -= now * (mb / fix) / (np.sqrt(vb / fix2) + 1e-7)
    return Model((w * learnt).astype(np.float32), float(b))


def cross_validate(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float, settings: Iterable[dict], folds: int = 4) -> list[tuple[float, float, dict]]:
    """(log loss, accuracy, setting) over the folds of rows that may be learnt from, best first."""
    out = []
    for setting in settings:
        loss = right = 0.0
        for k in range(folds):
            model = fit(Bags.of([r for i, r in enumerate(rows) if i % folds != k]), share, **setting)
            test = Bags.of(rows[k::folds])
            weight, every = class_weights(test.toxic, share), np.ones(1 << BITS)
            loss += gradient(test, model.weights.astype(float), model.bias, weight, every)[0] / folds
            value = model.weights[test.buckets].sum(1)
            z = np.bincount(test.sentence, value[test.word], len(test.doc)) + model.bias
            p = -np.expm1(-np.bincount(test.doc, softplus(z), len(test.toxic)))
            right += float((((p >= 0.5) == test.toxic) * weight).sum()) / folds
        out.append((loss, right, setting))
    return sorted(out, key=lambda x: x[:2])


class Words(dict):
    """Weights of pieces seen lately."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self.model.word(piece)
        if len(piece) < 200:
            self[piece] = value
        return value


def score(text: str | None, words: Words, bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score and its sentences as (start, end, probability)."""
    if not text or not np.isfinite(bias):
        return 0.0, []
    spans, z = [], []
    get = words.__getitem__
    for m in SENTENCE.finditer(text):
        pieces = m.group().split()
        if pieces:
            spans.append(m.span())
            z.append(sum(map(get, pieces)) + bias)
    if not z:
        return 0.0, []
    z = np.array(z)
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return float(-np.expm1(-softplus(z).sum())), [(s, e, q) for (s, e), q in zip(spans, p.tolist(), strict=True)]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], float]:
    """A bounded sample of the rows that may be learnt from, as (words, sizes, label), and the share of toxic ones."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {bool(r["toxic"]): r["n"] for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return [], 0.0
    order = F.xxhash64("doc_id")
    picked = [known.where(c).orderBy(order, "doc_id").limit(sample) for c in ("toxic > 0", "toxic <= 0")]
    few = picked[0].unionByName(picked[1]).select("doc_id", (F.col("toxic") > 0).alias("toxic"))  # 2 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = kept_in_worker(("packed",), Packed)
        for batch in batches:
            got = [sentences(t.as_py(), packed) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([len(g[0]) for g in got], pa.int64())], ["h", "tie", "toxic", "words", "sizes", "n"])

    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(order.alias("h"), F.xxhash64("text").alias("tie"), "toxic", "text")
    rows = cut(rows.mapInArrow(run, "h long, tie long, toxic boolean, words array<long>, sizes array<int>, n long"), "examples")
    # a document that repeats cannot fill the sample's room either: rows and words are counted again
    taken: dict[tuple[bool, int, int], int] = {}
    for c in (True, False):
        room = sample_words
        for r in rows.where(F.col("toxic") == F.lit(c)).select("h", "tie", "n").orderBy("h", "tie").limit(sample).collect():
            room -= r["n"]
            if room < 0:
                break
            taken[c, r["h"], r["tie"]] = taken.get((c, r["h"], r["tie"]), 0) + 1
    if not taken:
        return [], 0.0
    chosen = docs.sparkSession.createDataFrame(list(taken), "toxic boolean, h long, tie long")
    got = rows.join(F.broadcast(chosen), ["toxic", "h", "tie"]).dropDuplicates(["toxic", "h", "tie"]).toArrow().sort_by([("h", "ascending"), ("tie", "ascending")])
    out = []
    for h, tie, toxic, words, sizes in zip(*[got.column(c) for c in ("h", "tie", "toxic", "words", "sizes")], strict=True):
        row = words.values.to_numpy(), sizes.values.to_numpy(), int(toxic.as_py())
        out += [row] * taken[toxic.as_py(), h.as_py(), tie.as_py()]
    return out, counts[True] / (counts[True] + counts[False])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out."""
    rows, share = examples(docs, labels, sample, sample_words)
    bags = Bags.of(rows)
    del rows
    model = fit(bags, share)
    del bags
    give_back()
    return model


def score_table(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, and the likeliest offending sentence of every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_in_worker(model.key(), lambda: Words(model))
        for batch in batches:
            scores, starts, ends, counts = [], [], [], []
            for text in (t.as_py() for t in batch.column(2)):
                s, parts = score(text, words, model.bias)
                worst = max(parts, key=lambda x: (x[2], -x[0]), default=(None, None, 0.0))
                scores.append(s)
                starts.append(worst[0])
                ends.append(worst[1])
                counts.append(sum(x[2] >= 0.5 for x in parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(counts, pa.int32())],
                ["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end", "n_offending"],
            )

    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, worst_start int, worst_end int, n_offending int").withColumnRenamed("doc_id", id_col)


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic; all columns stay."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_in_worker(model.key(), lambda: Words(model))
        for batch in batches:
            keep = [score(t, words, model.bias)[0] < 0.5 for t in (v.as_py() for v in batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, kinds)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_table(docs, train(docs, labels))
