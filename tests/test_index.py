"""The stored index against searches over all chunks; boolean queries; registry and history; the impact report by brute force."""

import collections
import json

import pytest
from test_core import CHUNKS, CODE

from corpuscle.operators import extract, graph, maintenance, search
from corpuscle.operators.index import Index, build_texts
from corpuscle.plans import stored

NOW = 1700003600.0 + 168 * 3600


@pytest.mark.parametrize("query", ["token des", '"of the" doc', "token AND doc", "the NOT token", "a OR (b", "AND the", "", "!!", "doc_11", "çà Été"])
def test_index_equals_search(spark, small, query):
    index, chunks = stored.texts(spark, small), stored.chunks(spark, small)
    for k in (5, 30):
        want = search.search(chunks, query, k, 2500, NOW, expand=False)
        got = index.search(query, k, 2500, NOW, expand=False)
        shown = lambda df: [(r["rank"], r.chunk_id, round(r.final_score, 8), r.more_in_file, r.content) for r in df.orderBy("rank").collect()]
        assert shown(got) == shown(want)


def test_index_of_odd_chunks(spark, tmp_path):
    rows = [("r", "1", "a", "code", None, None, None, None), ("r", "2", "b", "code", "x", "", "same same", 0.0), ("s", "2", "b", "code", "x", "same", None, 0.0), ("s", "3", "c", "doc", None, "été same", None, 1.0)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    build_texts(chunks, str(tmp_path / "i"))
    index = Index(spark, str(tmp_path / "i"))
    for q in ("same", '"same same"', "ete", "b AND same"):
        shown = lambda df: sorted((r.repo_id, r.chunk_id, round(r.bm25_score, 9)) for r in df.collect())
        assert shown(index.bm25(q, None)) == shown(search.bm25(chunks, q, None))
    build_texts(chunks.limit(0), str(tmp_path / "e"))
    assert Index(spark, str(tmp_path / "e")).search("same").count() == 0


def test_boolean_queries():
    assert search.parse_match("one two") == ([["one"], ["two"]], None)
    assert search.parse_match("a AND b OR c NOT d") == ([["a"], ["b"], ["c"], ["d"]], ("or", ("and", 0, 1), ("not", 2, 3)))
    assert search.parse_match('x "AND y" OR z') == ([["x"], ["and", "y"], ["z"]], ("or", ("and", 0, 1), 2))
    assert search.parse_match("AND a")[1] is None and search.parse_match("a NOT")[1] is None


def test_targets(spark):
    repos = spark.createDataFrame([("r1", "/p/one", "One"), ("r2", "/p/two", "Two"), ("r3", "/q", "Three")], "repo_id string, local_path string, name string")
    spaces = spark.createDataFrame([("w", ["r1", "r2", "gone"]), ("none", [])], "name string, repo_ids array<string>")
    seen = lambda **by: sorted((r.repo_id or "", r.status) for r in maintenance.search_targets(repos, spaces, **by).collect())
    assert seen(workspace="w", repo="r3") == [("r1", "found"), ("r2", "found")]
    assert seen(workspace="x") == [("", "unknown workspace")] and seen(workspace="none") == [("", "empty workspace")]
    assert seen(repo="r3", cwd="/p/one") == [("r3", "found")] and seen(repo="x") == [("", "unknown repository")]
    assert seen(cwd="/q/deep/er") == [("r3", "found")] and seen(cwd="/z") == [("", "unindexed folder")] and seen() == [("", "no target")]
    spaces = maintenance.save_workspace(maintenance.save_workspace(spaces, "w", ["r3", "r1"]), "new", ["r2"])
    assert {r["name"]: r["repo_ids"] for r in spaces.collect()} == {"w": ["r1", "r2", "gone", "r3"], "none": [], "new": ["r2"]}


def test_forget_repo(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "repo_id string, v int")
    maintenance.write_partitioned(rows, str(tmp_path / "t"))
    spaces = spark.createDataFrame([("w", ["a", "b"])], "name string, repo_ids array<string>")
    repos, paths, spaces = maintenance.forget_repo(spark, "a", rows, rows, spaces, str(tmp_path / "t"))
    assert [r.repo_id for r in repos.collect()] == [r.repo_id for r in paths.collect()] == ["b"] and spaces.first().repo_ids == ["b"]
    assert [r.repo_id for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["b"]


def test_history(spark, tmp_path):
    for i in range(7):
        lines = [json.dumps({"role": "user", "text": f"t{i}"}), "{broken", "[1, 2]", "", json.dumps({"message": {"role": "assistant", "content": f"m{i}"}})]
        (tmp_path / f"{i}.jsonl").write_text("\n".join(lines))
    (tmp_path / "x.txt").write_text("no")
    got = sorted((r.file, r.role, r.text) for r in maintenance.history(spark, str(tmp_path)).collect())
    assert got == sorted(x for i in range(2, 7) for x in ((f"{i}.jsonl", "user", f"t{i}"), (f"{i}.jsonl", "assistant", f"m{i}")))
    assert maintenance.history(spark, str(tmp_path / "0.jsonl")).count() == 2


def test_impact_report_by_brute_force(spark):
    user = "from app.core.token import Token\n\ndef use_{0}():\n    return Token()\n"
    rows = [("r", "app/core/token.py", "python", "class Token:\n    pass\n"), ("r", "app/auth/user.py", "python", CODE)]
    rows += [("r", f"app/web/page{i}.py", "python", user.format(i)) for i in range(5)]
    rows += [("r", f"app/web/run{i}.py", "python", "from app.web.page0 import Page0Helper\n\ndef go():\n    Page0Helper()\n") for i in range(2)]
    rows += [("r", "tests/test_token.py", "python", "from app.web.page1 import use_1\n\ndef test_it():\n    use_1()\n")]
    files = spark.createDataFrame(rows, "repo_id string, file_path string, language string, content string")
    e, n = extract.edges(files), extract.nodes(files)
    every = e.collect()
    tested = {part for x in every if x.kind == "TESTED_BY" for part in x.target_symbol.replace("/", ".").split(".")}
    callers = collections.defaultdict(set)
    for x in every:
        if x.kind == "CALLS":
            for f in {r[1] for r in rows}:
                if f.rsplit("/", 1)[-1].removesuffix(".py").lower() in x.target_symbol.lower():
                    callers[f].add(x.source_file)
    want = []
    for h in graph.impact(e, n, "app/core/token.py").collect():
        stem = h.file_path.rsplit("/", 1)[-1].removesuffix(".py")
        many = len(callers[h.file_path])
        risk = max(0.0, 0.3 - 0.1 * (h.distance - 1)) + (0 if stem in tested else 0.25) + (0.2 if any(w in h.file_path.lower() for w in ("auth", "token", "login")) else 0) + (0.15 if many > 3 else 0.05 if many > 1 else 0)
        want.append((-round(min(risk, 1.0), 2), h.distance, h.qualified_name, stem in tested, many))
    got = [(-r.risk, r.distance, r.qualified_name, r.tested, r.callers) for r in graph.impact_report(e, n, "app/core/token.py").collect()]
    assert got == sorted(want)[:25] and len(got) >= 4 and any(r[3] for r in got) and max(r[4] for r in got) == 2
    level = lambda risk: "critical" if risk > 0.7 else "high" if risk > 0.5 else "medium" if risk > 0.3 else "low"
    assert all(r.level == level(r.risk) for r in graph.impact_report(e, n, "app/core/token.py").collect())


def test_postings_of_a_chunk_are_few_rows(spark, tmp_path):
    from corpuscle.operators.index import KEY, posting_lists, write_postings

    rows = [("r", "1", "a", "code", "s1", "été a b a " * 50 + " ".join(f"w{i}" for i in range(500)), "a", 0.0), ("r", "2", None, "code", None, None, None, 0.0), ("r", "3", "x", "code", None, "", None, 0.0)]
    lists = posting_lists(spark.createDataFrame(rows, CHUNKS), 4)
    assert lists.groupBy(*KEY).count().where("count > 4").isEmpty()
    write_postings(lists, str(tmp_path / "p"))
    got = {(r.chunk_id, r.term): (r.n, r.f, list(r.positions)) for r in spark.read.parquet(str(tmp_path / "p")).collect()}
    a = sorted([i * 4 + j for i in range(50) for j in (1, 3)])
    assert got["1", "a"] == (102, 103.5, [*a, 1 << 32, 3 << 32])
    assert got["1", "w499"] == (1, 1.0, [699]) and got["3", "x"][0] == 1 and len(got) == 505
