"""The pipeline against its stages done by hand on the small tables."""

import collections
import hashlib

import numpy as np
import pytest
from test_ops import PATH, ROWS, brute_groups
from tokenizers import Tokenizer

import corpus_pipeline
from corpuscle.llm import mixing, toxicity
from corpuscle.llm.common import cut, table


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = table(spark, small, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, small), "test")
        out.append(docs)
    return out


def test_stages(spark, small, stages):
    docs = table(spark, small, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    clean, exact, near, mixed, encoded = stages
    assert all(s.columns == docs.columns for s in stages[:4])
    model = toxicity.train(docs, table(spark, small, "labels"))
    words = toxicity.Words(model)
    kept = {i for i, r in rows.items() if toxicity.score(r.text, words, model.bias)[0] < 0.5}
    assert {r.doc_id for r in clean.collect()} == kept
    last = {}
    for i in kept:
        last[rows[i].text] = max(last.get(rows[i].text, i), i)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(last.values())
    groups = brute_groups([(i, rows[i].text) for i in last.values()])
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, _, c in groups})
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert times == collections.Counter(r.doc_id for r in mixing.mixture(near).collect())
    assert set(times) == {r.doc_id for r in near.collect()} and max(times.values()) <= 2
    library = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, n in times.items():
        ids = library.encode(rows[i].text, add_special_tokens=False).ids
        want[i, rows[i].source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(rows[i].text.encode()).hexdigest()] = n
    assert collections.Counter(map(tuple, encoded.collect())) == want


def test_run_equals_the_stages(spark, small, stages):
    assert collections.Counter(corpus_pipeline.run(spark, small).collect()) == collections.Counter(stages[-1].collect())


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, ties, repeated rows, very long and empty texts, clashing columns; and empty tables."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, key string, k long, epoch int, doc string, rank int"
    rows = [(*r, "y", 1, 2, "z", 3) for r in ROWS]
    labels = spark.createDataFrame([(1, 1, "q"), (6, 0, "q"), (None, 1, "q"), (7, None, "q")], "doc_id long, toxic int, text string")
    for name, docs, marks in (("odd", rows, labels), ("empty", [], labels.limit(0))):
        spark.createDataFrame(docs, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        at, held = table(spark, f"{tmp_path}/{name}", "documents"), []
        for _, stage in corpus_pipeline.STAGES:
            at = cut(stage(spark, at, f"{tmp_path}/{name}"), "odd")
            held.append(at)
        assert all(s.columns == [c.split()[0] for c in kinds.split(", ")] for s in held[:4])
        if not docs:
            assert [s.count() for s in held] == [0] * 5
            continue
        assert held[0].count() == len(rows)  # one label of each class in the training fold at most: nothing is rejected
        # of equal texts the largest doc_id stays (twice: a repeated row), of null and empty ones the largest
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in held[1].collect()) == [(False, i) for i in (2, 2, 4, 5, 6, 7, 8)] + [(True, 0)]
        ids = {r.doc_id for r in held[4].collect()}
        assert ids == {2, 4, 5, 6, 7, 8, None}
        want = {i: len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) for i, t, *_ in ROWS}
        assert all(r.n_tokens == want[r.doc_id] for r in held[4].collect())


def test_queries_have_the_contracts_columns(spark, small):
    from corpuscle.llm.queries import QUERIES

    want = {
        "op1": "query_id rank vec_id score", "op2": "doc_id n_shingles component_id", "op3": "page_id url text n_chars", "op5": "doc_id start n_tokens ids_crc32",
        "op6": "doc_id held_out score predicted", "op7": "doc_id keep_id group_size kept text_sha256", "op8": "page_id payload_bytes payload_digest record_type refers_to",
        "op9": "doc_id n_assign n_access n_hex base_sha256 spans", "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    for name, f in QUERIES.items():
        if (op := name.split("_")[0]) in want:
            assert f(spark, small).columns[: len(want[op].split())] == want[op].split()
