"""Queries against their SQL with its cuts lifted, and what cuts had hidden."""

import duckdb
import pytest
from test_core import TABLES, shown

from corpuscle.operators import contracts
from corpuscle.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def check_whole(spark, small, duck, name, *cuts):
    """The query equals its SQL, in which the cuts (old, new) are lifted here."""
    sql = SQL[name]
    for old, new in cuts:
        sql = sql.replace(old, new)
    df, rel = QUERIES[name](spark, small), duck.sql(sql)
    got = shown([tuple(r) for r in df.collect()], df.columns, df.columns)
    assert got and got == shown(rel.fetchall(), rel.columns, df.columns)


def test_contracts_of_all_repos_and_files(spark, small, duck):
    check_whole(spark, small, duck, "contract_match", (" WHERE repo_id IN ('Brand#1', 'Brand#2')", ""), (" WHERE file_path LIKE 'web/%' AND repo_id IN ('Brand#3', 'Brand#4')", ""))
    check_whole(spark, small, duck, "cross_project_impact", (" FROM us WHERE file_path LIKE 'web/%'", " FROM us"))


def test_contract_counts_by_brute_force(spark):
    ends = [("a", "f", "GET", "/x/y"), ("a", "f", "GET", "/x/y"), ("b", "g", "POST", "/v1/y_z/{id}"), ("c", "h", "GET", "/api")]
    uses = [("a", "s", "/y", None), ("d", "t", "/y", None), ("d", "t", "/y-z/x?q=1", "GET"), ("e", "u", "/none", None), ("e", "u", "/y-z", "POST")]
    keys = {"/x/y": {"x", "y"}, "/v1/y_z/{id}": {"y-z"}, "/api": set(), "/y": {"y"}, "/y-z/x?q=1": {"y-z", "x"}, "/none": {"none"}, "/y-z": {"y-z"}}
    want = {}
    for _, _, method, path in ends:
        for _, _, url, verb in uses:
            if keys[path] & keys[url] and verb in (None, method):
                want[path, url] = want.get((path, url), 0) + 1
    e = spark.createDataFrame(ends, "repo_id string, file_path string, method string, path string")
    u = spark.createDataFrame(uses, "repo_id string, file_path string, url string, method string")
    assert {(r.path, r.url): r.n for r in contracts.contract_counts(e, u).collect()} == want


def test_references_of_all_names(spark, small, duck):
    check_whole(spark, small, duck, "reverse_substring_join", (" WHERE name LIKE 'Widget1%'", ""))


def test_words_of_two_sources(spark, small, duck):
    check_whole(spark, small, duck, "shared_keys", ("HAVING count(*) >= 15", "HAVING count(*) >= 2"))


def test_postings_of_rare_terms(spark, small, duck):
    check_whole(spark, small, duck, "postings_build", (" HAVING count(DISTINCT chunk_id) > 5", ""))


def test_hits_of_whole_passages(spark, tmp_path):
    same = "the very same opening of forty characters and "
    spark.createDataFrame([(1, same + "one end"), (2, same + "another end"), (3, "short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, f"x {same}one end y"), (2, f"{same}one ending"), (3, f"{same}another end"), (4, same), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.item_id: r.documents for r in QUERIES["expected_hits"](spark, str(tmp_path)).collect()} == {1: 2, 2: 1}


def test_insights_of_all_turns(spark, small, duck):
    check_whole(spark, small, duck, "insight_chunks", (" WHERE turn = 1", ""))
