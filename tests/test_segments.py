"""The index that changes against a rebuild; positions against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_core import CHUNKS

from corpuscle.operators import search
from corpuscle.operators.index import Index, build_texts
from corpuscle.operators.segments import SegmentIndex

CHANGE = CHUNKS + ", change string, seq int"
WORDS = "alpha beta gamma delta of the été naïve x9 _ __ -".split()


def text_of(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(0, 12)))


def chunk(r, key):
    """A chunk in the columns of CHUNKS."""
    by_name = {"repo_id": f"r{key % 3}", "chunk_id": f"c{key}", "file_path": f"a/{key}.py", "chunk_type": "code", "symbol_name": text_of(r), "content": text_of(r), "summary": None, "last_modified": 1.0}
    return tuple(by_name[c.split()[0]] for c in CHUNKS.split(", "))


def shown(df):
    return sorted((r.repo_id, r.chunk_id, round(r.bm25_score, 9)) for r in df.collect())


def places(index):
    return sorted((r.repo_id, r.chunk_id, r.term, r.n, r.f, tuple(r.positions)) for r in index.table("postings").collect())


@pytest.mark.parametrize("seed", [1])
def test_any_sequence_equals_a_rebuild(spark, tmp_path, seed):
    r = random.Random(seed)
    index, now = SegmentIndex(spark, str(tmp_path / "s")), {}
    for batch in range(5):
        rows = []
        for seq in range(r.randint(1, 12)):
            key = r.randrange(15)
            if r.random() < 0.3:
                rows.append((*chunk(r, key), "delete", seq))
                now.pop(key, None)
            else:
                rows.append((*(now[key] if key in now and r.random() < 0.3 else chunk(r, key)), "put", seq))
                now[key] = rows[-1][:-2]
        assert index.apply(spark.createDataFrame(rows, CHANGE), batch)
        assert not index.apply(spark.createDataFrame(rows, CHANGE), batch)  # a replay
        if batch in (2, 4):
            index.compact(2)
            index.vacuum()
    whole = spark.createDataFrame(list(now.values()), CHUNKS)
    build_texts(whole, str(tmp_path / "w"))
    rebuilt = Index(spark, str(tmp_path / "w"))
    assert places(index) == places(rebuilt)
    for q in ("alpha", '"of the" été', "alpha AND beta", "__"):
        assert shown(index.bm25(q, None)) == shown(rebuilt.bm25(q, None)) == shown(search.bm25(whole, q, None))


def test_a_write_is_as_large_as_the_change(spark, tmp_path):
    r = random.Random(5)
    index, rows = SegmentIndex(spark, str(tmp_path / "s")), [chunk(r, i) for i in range(60)]
    count = lambda name, s: spark.read.parquet(f"{index.folder}/{name}/segment={s}").count()
    index.apply(spark.createDataFrame([(*x, "put", 0) for x in rows], CHANGE), 0)
    again = [(*x, "put", 0) for x in rows[5:]] + [(*chunk(r, i), "put", 1) for i in (0, 1, 70)] + [(*rows[9], "delete", 2), (*chunk(r, 99), "delete", 0)]
    index.apply(spark.createDataFrame(again, CHANGE), 1)
    assert (count("meta", 0), count("marks", 0)) == (60, 0)
    assert (count("meta", 1), count("texts", 1), count("marks", 1)) == (3, 3, 3)
    assert {x["chunk_id"] for x in spark.read.parquet(f"{index.folder}/postings/segment=1").collect()} <= {"c0", "c1", "c70"}
    index.apply(spark.createDataFrame(again, CHANGE), 2)  # nothing is new: no segment
    assert len(index.state()["segments"]) == 2


def test_sizes_of_segments_stay_tiered(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path / "s"))
    r = random.Random(6)
    for b in range(6):
        index.apply(spark.createDataFrame([(*chunk(r, b), "put", 0)], CHANGE), b)
        index.compact(2)
    state = index.state()
    assert len(state["segments"]) <= 3 and sum(s["rows"] for s in state["segments"]) == 6


def test_a_stream_that_dies_before_its_version(spark, tmp_path):
    """Killed between write and commit, started again: the same index as one batch."""
    r = random.Random(7)
    rows = [(*chunk(r, i % 20), r.choice(["put", "put", "delete"]), i) for i in range(60)]
    (tmp_path / "in").mkdir()
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes = lambda: spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index = SegmentIndex(spark, str(tmp_path / "s"))
    real, seen = index.commit, []

    def dies(state, version):
        seen.append(version)
        if len(seen) == 2:
            raise RuntimeError("killed")
        real(state, version)

    index.commit = dies
    with pytest.raises(Exception, match="killed"):
        index.feed(changes(), str(tmp_path / "c")).awaitTermination()
    index.commit = real
    query = index.feed(changes(), str(tmp_path / "c"), once=False, every="1 second")  # processingTime
    query.processAllAvailable()
    query.stop()
    whole = SegmentIndex(spark, str(tmp_path / "one"))
    whole.apply(spark.createDataFrame(rows, CHANGE), 0)
    assert places(index) == places(whole) and index.state()["batches"] == {"stream": 2}


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    a, b = SegmentIndex(spark, str(tmp_path / "s")), SegmentIndex(spark, str(tmp_path / "s"))
    state = a.state()
    a.commit(state, 1)
    with pytest.raises(Exception, match="exists"):
        b.commit(state, 1)


def by_hand(texts, phrases, most):
    out = {}
    for key, fields in texts.items():
        n = 0
        for words in fields:
            at = [[i for i in range(len(words)) if words[i : i + len(p)] == p] for p in phrases]
            n += sum(all(any(x <= y <= x + len(p) + most for y in other) for other in at) for p, own in zip(phrases, at) for x in own)
        if n and all(any(words[i : i + len(p)] == p for words in fields for i in range(len(words))) for p in phrases):
            out[key] = n
    return out


@pytest.mark.parametrize("phrases,most", [([["alpha"], ["beta"]], 0), ([["alpha"], ["beta"], ["gamma"]], 2), ([["of", "the"], ["delta"]], 1), ([["of", "the"], ["alpha"], ["beta", "beta"]], 4), ([["zeta"], ["beta"]], 3)])
def test_near_equals_brute_force(spark, tmp_path, phrases, most):
    r = random.Random(8)
    rows = [chunk(r, i) for i in range(120)]
    build_texts(spark.createDataFrame(rows, CHUNKS), str(tmp_path / "i"))
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    fold = lambda t: re.findall(r"[^\W_]+", (t or "").lower().replace("é", "e").replace("ï", "i"))
    texts = {(x[0], x[1]): [fold(x[names.index(c)]) for c in ("content", "summary", "symbol_name", "file_path")] for x in rows}
    index = Index(spark, str(tmp_path / "i"))
    assert {(x.repo_id, x.chunk_id): x.clumps for x in index.near(phrases, most).collect()} == by_hand(texts, phrases, most)
    long = [p for p in phrases if len(p) > 1]
    if long:  # phrases are counted from positions alone
        found = index.frequencies(long)
        assert "texts" not in found._jdf.queryExecution().executedPlan().toString()
        weigh = (1.0, 2.0, 3.0, 1.5)
        want = {k: sum(w * sum(ws[i : i + len(long[0])] == long[0] for i in range(len(ws))) for w, ws in zip(weigh, fields)) for k, fields in texts.items()}
        assert {(x.repo_id, x.chunk_id): x.f0 for x in found.where("f0 > 0").collect()} == {k: v for k, v in want.items() if v}


def test_the_same_again_writes_nothing_whatever_the_columns_order(spark, tmp_path):
    """A batch that comes after others, with columns in another order than the index keeps: unchanged chunks stay out."""
    r = random.Random(9)
    index, rows = SegmentIndex(spark, str(tmp_path / "s")), [chunk(r, i) for i in range(30)]
    order = ["symbol_name", "content", "chunk_id", "summary", "file_path", "repo_id", "chunk_type", "last_modified", "seq", "change"]
    batch = lambda some: spark.createDataFrame([(*x, "put", 0) for x in some], CHANGE).select(*order)
    index.apply(batch([chunk(r, i) for i in range(10)]), 0)
    index.apply(batch(rows), 1)
    assert [(s["rows"], s["marks"], s["live"]) for s in index.state()["segments"]] == [(10, 0, 0), (40, 10, 30)]
    index.apply(batch(rows), 2)
    index.apply(batch([*rows[:29], chunk(r, 29)]), 3)
    assert [(s["rows"], s["live"]) for s in index.state()["segments"]] == [(10, 0), (40, 29), (2, 1)]
    assert "segment=0" not in " ".join(index.table("postings").inputFiles())  # nothing of it lives
    build_texts(index.table("texts").join(index.table("meta"), ["repo_id", "chunk_id"]).select(*rows_of(CHUNKS)), str(tmp_path / "w"))
    assert places(index) == places(Index(spark, str(tmp_path / "w")))


def rows_of(schema):
    return [c.split()[0] for c in schema.split(", ")]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_lists_of_terms_by_hand(spark, monkeypatch, at_once):
    from corpuscle.operators import index

    r = random.Random(10)
    monkeypatch.setattr(index, "AT_ONCE", at_once)
    rows = [chunk(r, i) for i in range(20)] + [("r0", "none", *[None] * (len(CHUNKS.split(", ")) - 2))]
    want, names = {}, rows_of(CHUNKS)
    for x in rows:
        for i, c in enumerate(("content", "summary", "symbol_name", "file_path")):
            for p, t in enumerate(re.findall(r"[^\W_]+", (x[names.index(c)] or "").lower().replace("é", "e").replace("ï", "i"))):
                want.setdefault((x[0], x[1], t), []).append(i * index.FIELD + p)
    lists = index.posting_lists(spark.createDataFrame(rows, CHUNKS), 3)
    assert lists.groupBy("repo_id", "chunk_id", "bucket").count().where("count > 1").isEmpty()
    got = index.posting_rows(lists.select("repo_id", "chunk_id", "bucket", F.explode(F.split("lists", " ")).alias("list")))
    weigh = (1.0, 2.0, 3.0, 1.5)
    assert {(x.repo_id, x.chunk_id, x.term): (x.n, x.f, x.positions) for x in got.collect()} == {k: (len(v), sum(weigh[p // index.FIELD] for p in v), v) for k, v in want.items()}
    assert got.where(F.col("bucket") != index.bucket_of(F.col("term"), 3)).isEmpty()
