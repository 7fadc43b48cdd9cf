"""Vector codes and hard negatives against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import hard_negatives, vector_codes

KIND = "vec_id long, embedding array<float>, label int, id long, label_ int, q string, cell int, copy int, chunk int, part int, code string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5, 6, "y") for r in rows], KIND).repartition(parts)


def sample(n, width, seed, labels=4, spread=1.0):
    """Rows with ties, repeated vectors, a hot vector and rows that take no part."""
    r = random.Random(seed)
    hot = [r.gauss(0, spread) for _ in range(width)]
    rows = []
    for i in range(n):
        v = hot if r.random() < 0.3 else [round(r.gauss(0, spread), 1) for _ in range(width)]
        rows.append((i, v, 0 if r.random() < 0.35 else r.choice([None, *range(labels)])))
    rows += [(n, None, 1), (n + 1, [NAN] * width, 1), (n + 2, [INF] + [0.0] * (width - 1), 1), (n + 3, [None] + [0.0] * (width - 1), 1), (n + 4, [], 1), (n + 5, [1.0] * (width + 1), 1), (n + 6, [1e30] * width, 1)]
    return rows


def good(rows, width):
    return [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist(), lab) for i, v, lab in rows if v and len(v) == width and all(x is not None and abs(x) < 1e6 for x in v)]


def codes_by_hand(rows, parts, entries, rounds):
    w = len(rows[0][1]) // parts
    cut = lambda q: [q[p * w : p * w + w] for p in range(parts)]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(q)[p] for _, q, _ in first] for p in range(parts)]

    def assign(q):
        near = []
        for p, x in enumerate(cut(q)):
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in books[p]]
            near.append((d.index(min(d)), min(d)))
        return near

    for _ in range(rounds):
        met = {}
        for _, q, _ in rows:
            for p, ((e, _), x) in enumerate(zip(assign(q), cut(q))):
                met.setdefault((p, e), []).append(x)
        for (p, e), xs in met.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, "".join(f"{e:02x}" for e, _ in assign(q)), sum(d for _, d in assign(q)), lab) for i, q, lab in rows]
    total = {}
    for _, _, d, lab in out:
        total[lab] = total.get(lab, 0) + d
    return sorted(((i, c, d, total[lab], digest) for i, c, d, lab in out), key=str)


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 200.0)])
def test_vector_codes_equal_brute_force(spark, seed, spread):
    rows = sample(150, 32, seed, spread=spread)
    rows += [rows[0], rows[0], (3, rows[5][1], 2), (None, rows[7][1], None), (None, rows[8][1], 1)]
    got = vector_codes.compressed(frame(spark, rows), parts=16, entries=8)
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes_by_hand(good(rows, 32), 16, 8, 2)


def test_vector_codes_of_few_and_no_rows(spark):
    rows = [(5, [0.5] * 16, None), (9, [-0.25] * 16, 1)]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vector_codes.compressed(frame(spark, rows)).collect()}
    assert got == {5: ("00" * 16, 0, 0), 9: ("01" * 16, 0, 0)}
    none = vector_codes.compressed(frame(spark, [(1, None, 1), (2, [1.0] * 7, 1)]))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0
    assert vector_codes.compressed(frame(spark, [])).count() == 0


def test_decoded_vectors_have_the_error_of_their_codes(spark):
    from corpuscle.llm.vectors import integer_rows

    rows, width = integer_rows(frame(spark, sample(80, 16, 3)), "vec_id", "embedding", "label", 16)
    books = vector_codes.train(rows, width, entries=8)
    back = vector_codes.decode(vector_codes.encode(rows, books), books).withColumnRenamed("q", "near").join(rows.select("id", "q"), "id")
    for r in back.collect():
        assert r["error"] == sum((a - b) ** 2 for a, b in zip(r["q"], r["near"]))


def mined_by_hand(rows, every, positives=5, negatives=10):
    rows = [r for r in rows if r[0] is not None and r[2] is not None]
    out = []
    anchors = sorted({(i, lab, tuple(q)) for i, q, lab in rows if i % every == 0})
    for i, lab, a in anchors:
        s = sorted((-int(np.dot(a, q)), j, other) for j, q, other in rows if j != i)
        for minus, p, _ in [x for x in s if x[2] == lab][:positives]:
            ps = -minus
            fit = [x for x in s if x[2] != lab and 30 * ps <= -100 * x[0] <= 90 * ps][:negatives]
            out += [(i, p, k + 1, j, ps, -m) for k, (m, j, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("seed,width,spread", [(1, 8, 1.0), (2, 3, 1.0), (3, 2, 5.0), (4, 4, 30000.0)])
def test_hard_negatives_equal_brute_force(spark, seed, width, spread):
    rows = sample(300, width, seed, spread=spread)
    rows += [rows[3], rows[3], (10, rows[11][1], 2), rows[10], (None, rows[7][1], 1), (-20, rows[12][1], 0)]
    got = hard_negatives.mined(frame(spark, rows), F.col("id") % 10 == 0, pivots=7, chunk_bytes=1, block=3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == mined_by_hand(good(rows, width), 10)


def test_cells_far_apart_get_their_own_rows_alone(spark, monkeypatch):
    """Eight clusters: bounds keep most rows from most cells, and nothing is lost."""
    r = random.Random(9)
    rows = []
    for i in range(1600):
        c = i % 8
        rows.append((i, [(20.0 if j == c else 0.0) + r.gauss(0, 0.3) for j in range(8)], r.randrange(3)))
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    sent = []
    real = hard_negatives.served
    monkeypatch.setattr(hard_negatives, "served", lambda *a: sent.append((real(*a), len(a[1].pivots))) or sent[-1][0])
    got = hard_negatives.mined(frame(spark, rows), F.col("id") % 10 == 0, pivots=40)
    assert sorted(tuple(x) for x in got.collect()) == mined_by_hand(good(rows, 8), 10)
    first, pivots = sent[0]
    assert first.count() < 1600 * pivots / 3


def test_hard_negatives_of_few_and_no_rows(spark):
    for rows in ([], [(0, [1.0, 1.0], 1)], [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1)], [(1, [1.0, 1.0], 1)], [(0, None, 1), (0, [1.0], None)], [(0, [0.0], 1), (1, [0.0], 1)]):
        assert hard_negatives.mined(frame(spark, rows), F.col("id") % 10 == 0).count() == 0
    zero = hard_negatives.mined(frame(spark, [(0, [0.0], 1), (1, [5.0], 1), (2, [7.0], 2)]), F.col("id") % 10 == 0)
    assert [tuple(r) for r in zero.collect()] == [(0, 1, 1, 2, 0, 0)]
