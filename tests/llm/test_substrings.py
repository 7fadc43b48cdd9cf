"""Substring dedup against brute force, and its edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.llm import substring_dedup as S

KIND = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, pos int, key int, packed string, group int"


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(i, t, "en", "a", 1, 5, 6, 7, 8, "x", 9) for i, t in rows], KIND).repartition(parts)


def by_hand(rows, n):
    """Windows are judged on the input; a null doc_id comes after all others."""
    place = lambda i: (i is None, i or 0)
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            least[k] = min(least.get(k, place(i)), place(i))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - n + 1):
            if least[tuple(w[p : p + n])] < place(i):
                gone |= set(range(p, p + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = ["a", "b", "the", "é", "中文", "x y", "\x1c", "Ab", "word", "q" * 300, "ſ", "😀"]
    passages = [[r.choice(vocab) for _ in range(r.randint(3, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(passages)[r.randint(0, 2) :] if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randint(0, 20))]
        rows.append((r.randint(-20, 200) if r.random() < 0.9 else None, r.choice(["", " ", "\n"]) + "".join(x + r.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n", "\x0c"]) for x in w)))
    hot = "this very passage stands in a third of all of the documents that there are here and it is long enough"
    rows += [(300 + i, hot) for i in range(40)] + [(500 + i, f"{i} {hot} {i}") for i in range(20)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1]), (None, hot), (None, hot), (7, None), (8, ""), (None, None), (9, " \n "), (10, "one two"), (11, "b " * 3000), (-5, "b " * 50)]
    return rows


@pytest.mark.parametrize("seed,words,held", [(1, 13, 1_500_000), (2, 13, 40), (3, 4, 100)])
def test_equal_to_brute_force(spark, monkeypatch, seed, words, held):
    monkeypatch.setattr(S, "HELD", held)
    monkeypatch.setattr(S, "SLICE_BYTES", 2000)
    rows = corpus(seed)
    got = S.drop_repeats(frame(spark, rows), words=words, group=50)
    assert got.columns == ["doc_id", "n_words", "n_removed", "text"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows, words)


def test_maximal_repeats_are_whole_runs(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (2, "x y " + a + " z"), (3, " ".join(a.split()[10:30]) + " mid " + " ".join(a.split()[40:60])), (4, " ".join(a.split()[:12]))]
    got = sorted(tuple(r) for r in S.maximal_repeats(frame(spark, rows)).collect())
    assert got == [(2, 2, 60), (3, 0, 20), (3, 21, 20)]


def test_empty_tables_and_no_words(spark):
    assert S.drop_repeats(frame(spark, [])).count() == 0
    assert S.maximal_repeats(frame(spark, [])).count() == 0
    assert sorted(tuple(r) for r in S.drop_repeats(frame(spark, [(1, None), (2, ""), (3, " ")])).collect()) == [(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, "")]


def test_words_are_told_apart():
    texts = ["", "a", " a", "a b", "ab", "b a", "é e", "a" * 1000, "a" * 1001, "\n\n", "x\x0by\x0cz"]
    h, counts = S.word_hashes(pa.array(["skip this", *texts]).slice(1))
    words = [w for t in texts for w in t.encode().split()]
    assert counts.tolist() == [len(t.encode().split()) for t in texts]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))


def test_packing_is_a_round_trip():
    r = np.random.default_rng(1)
    cols = [r.integers(0, 1 << 63, 50).astype(t) if t != np.int32 else np.arange(-1, 49, dtype=t) for t in S.TYPES]
    assert all((a == b).all() for a, b in zip(S.unpack(S.pack(*cols)), cols, strict=True))
    assert [len(c) for c in S.unpack(S.pack(*(c[:0] for c in cols)))] == [0] * 6


def test_a_hot_passage_is_one_entry_a_task(spark):
    """Of the leaves below one node, a task passes on those of its least document."""
    rows = [(i, "a passage that every document of the table holds and that is longer than thirteen words") for i in range(500)]
    packed = S.packed_leaves(frame(spark, rows, 4).selectExpr("text", "doc_id AS id", "xxhash64(text) AS h"), 13, lambda key: (key % np.uint64(3)).astype(np.int64), False)
    sent = sum(len(S.unpack(r["packed"])[0]) for r in packed.collect())
    assert sent <= 2 * 4 * 16
    plan = S.drop_repeats(frame(spark, rows, 4))
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()
