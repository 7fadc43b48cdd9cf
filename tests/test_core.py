"""Queries against DuckDB on the small tables, and operators on small inputs."""

import math
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import chunking, contracts, digest, extract, graph, maintenance, search
from corpuscle.plans.catalog import QUERIES, SQL
from corpuscle.sources import views
from corpuscle.streaming import changes

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def shown(rows, names, wanted):
    order = [names.index(n) for n in sorted(wanted)]
    clean = lambda v: None if v is None or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert shown([tuple(r) for r in df.collect()], df.columns, df.columns) == shown(rel.fetchall(), rel.columns, df.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


CHUNKS = "repo_id string, chunk_id string, file_path string, chunk_type string, symbol_name string, content string, summary string, last_modified double"


def test_bm25_equals_the_formula(spark):
    rows = [("r", str(i), f"src/f{i}.py", "code", None, t, None, 0.0) for i, t in enumerate(["the quick Café", "the the lazy dog", "quick quick fox jumps", "nothing here at all"])]
    df = spark.createDataFrame(rows, CHUNKS)
    got = {r.chunk_id: r.bm25_score for r in search.bm25(df, 'cafe quick "lazy dog"', None).collect()}

    def tokens(s):
        import re

        return re.findall(r"[^\W_]+", (s or "").lower().replace("é", "e"))

    docs = {r[1]: {"content": (tokens(r[5]), 1), "file_path": (tokens(r[2]), 1.5)} for r in rows}
    size = {i: sum(len(t) for t, _ in d.values()) for i, d in docs.items()}
    average, want = sum(size.values()) / len(size), {}
    for p in (["cafe"], ["quick"], ["lazy", "dog"]):
        count = {i: sum(w * sum(t[k : k + len(p)] == p for k in range(len(t))) for t, w in d.values()) for i, d in docs.items()}
        n = sum(c > 0 for c in count.values())
        idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
        for i, f in count.items():
            if f:
                want[i] = want.get(i, 0) - (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / average))
    assert got == pytest.approx(want)


def test_query_expansion():
    assert text.expand_query("Auth rbac") == "auth authentication authorize authorization rbac permission"
    assert text.expand_query("One two THREE four five six") == "One two THREE four five six"


def test_budget_admits_the_first_row(spark):
    rows = [("r", str(i), f"f{i % 3}", "code", None, "x" * 400, None, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, CHUNKS).withColumn("final_score", F.col("chunk_id").cast("double"))
    best = search.best_per_file(df)
    assert {r.chunk_id: r.more_in_file for r in best.collect()} == {"0": 1, "1": 1, "2": 1}
    assert [r.rank for r in search.within_budget(best, 3, 10).collect()] == [1]
    assert [r.rank for r in search.within_budget(best, 3, 200).collect()] == [1, 2]


CODE = '''"""Doc."""
from app.core.db import (
    Base,
)
from app.core.base import Model, Helper as Aid


class User(Model, abc.ABC):
    name: str = "x"

    async def save(self, a, *rest, b: int = 2) -> bool:
        return Aid(a)

# comment
def make(x=1):
    return Aid(x)
'''


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("r", "app/auth/user.py", "python", CODE), ("r", "tests/test_user.py", "python", "from app.auth.user import User\n\ndef test_it():\n    User()\n"), ("r", "web/a.ts", "typescript", "class A extends B implements C, D {}\nfetch('/api/v1/users')\n")]
    return spark.createDataFrame(rows, "repo_id string, file_path string, language string, content string")


def test_extraction(sources):
    e = {(r.kind, r.source_symbol, r.target_symbol, r.line) for r in extract.edges(sources).collect()}
    assert {("INHERITS", "User", "Model", 8), ("CALLS", None, "Aid", 12), ("CALLS", None, "Aid", 16), ("TESTED_BY", "test_user", "app.auth.user", None), ("IMPLEMENTS", "A", "D", 1), ("INHERITS", "A", "B", 1)} <= e
    assert ("INHERITS", "User", "ABC", 8) not in e
    n = {r.qualified_name: r for r in extract.nodes(sources).collect()}
    save = n["app/auth/user.py::User.save"]
    assert (save.kind, save.line_start, save.line_end, save.params, save.return_type) == ("method", 11, 14, "a, b: int", "bool")
    assert n["app/auth/user.py::make"].kind == "function" and n["tests/test_user.py::test_it"].is_test


def test_chunks_of_definitions(sources):
    rows = {r.name: r for r in chunking.code_symbols(sources).collect()}
    assert rows["User"].kind == "class" and rows["save"].line_start == 11
    assert chunking.python_definitions("def (") == []


def test_graph(spark, sources):
    e, n = extract.edges(sources), extract.nodes(sources)
    hit = {r.qualified_name: r for r in graph.impact(e, n, "app/auth/user.py").collect()}
    assert hit["tests/test_user.py::test_it"].distance == 1 and hit["tests/test_user.py::test_it"].direction == "reverse"
    assert graph.impact(e, n, "app/auth/user.py", changed=(900, 901)).count() == 0
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "src int, dst int")
    assert {r.node: r.depth for r in graph.reachable(links, spark.createDataFrame([(0,)], "node int"), 3).collect()} == {i: i for i in range(4)}


def test_substring_join_beyond_broadcast(spark, monkeypatch):
    left = spark.createDataFrame([("ab",), ("needle/in",), ("Q",)], "needle string")
    right = spark.createDataFrame([("a needle/in hay",), ("xABy",), ("zq",), (None,)], "hay string")
    want = {("ab", "xABy"), ("needle/in", "a needle/in hay"), ("Q", "zq")}
    assert {(r.needle, r.hay) for r in graph.substring_join(left, right, "needle", "hay").collect()} == want
    monkeypatch.setattr(graph, "FEW", 1)
    assert {(r.needle, r.hay) for r in graph.substring_join(left, right, "needle", "hay").collect()} == want


def test_contracts(spark, sources):
    seg = spark.range(1).select(contracts.segments(F.lit("https://x.y/api/v1/study_Sets/{id}/Cards?z=1")).alias("s")).first().s
    assert seg == ["study-sets", "cards"]
    assert [(r.url, r.line) for r in contracts.consumers(sources).collect()] == [("/api/v1/users", 2)]


def test_walk(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1\n", "node_modules/b.js": "no", "c.png": "no", "README.md": "# Hi", ".git/d": "no", "e.txt": ""}.items():
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    rows = maintenance.walk(spark, str(tmp_path / "root")).collect()
    assert sorted(os.path.basename(r.file_path) for r in rows) == ["README.md", "a.py"]


def test_partition_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "repo_id string, v int")
    maintenance.write_partitioned(rows, str(tmp_path / "t"))
    maintenance.write_partitioned(rows.where("repo_id = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"))
    assert {(r.repo_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}


def test_change_stream(spark, tmp_path):
    rows = "SELECT path, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, s) AS ts, change FROM VALUES ('a.py', 0, 'modified'), ('a.py', 1, 'deleted'), ('.git/x', 1, 'modified'), ('a.py', 60, 'modified'), ('z.py', 5000, 'modified') AS t(path, s, change)"
    spark.sql(rows).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("path string, ts timestamp, change string").parquet(str(tmp_path / "in"))
    q = changes.run(stream, lambda df, i: seen.extend((r.path, r.change, r.events) for r in df.collect()), str(tmp_path / "cp"))
    end = time.time() + 60
    while q.isActive and time.time() < end:
        time.sleep(0.2)
    assert q.exception() is None and sorted(seen) == [("a.py", "deleted", 2), ("a.py", "modified", 1)]


def test_insights(spark):
    turn = "We decided to use Redis because of the cache. " * 6
    rows = [(1, 0, "assistant", turn), (2, 0, "assistant", turn), (3, 0, "user", turn), (4, 0, "assistant", "short")]
    got = digest.mine_insights(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.tags) for r in got] == [(1, ["performance", "deployment"])]  # "decided" holds "ci"


def test_empty_inputs(spark, small):
    none = views.code(spark, small).where("false")
    assert extract.edges(none).count() == extract.nodes(none).count() == chunking.sections(none).count() == 0
