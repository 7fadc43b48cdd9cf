"""Tables of several repositories with equal paths; scripts and Dart to their braces; modules that imports mean."""

import time

import pytest

from corpuscle.operators import chunking, contracts, extract, graph, lexer, maintenance, modules, outline

FILES = "repo_id string, file_path string, language string, content string"
EDGES = "repo_id string, kind string, source_file string, source_symbol string, target_file string, target_symbol string, line int"


def test_chunks_of_equal_paths(spark):
    docs = {r: "# Alpha\n" + f"{r} " * 8000 + f"\n## Beta\n{r} end\n" for r in ("r1", "r2")}
    code = {r: f"{r} = 1\n" * 1200 + f"\n{r} = 2\n" for r in ("r1", "r2")}
    rows = [(r, "README.md", "markdown", t) for r, t in docs.items()] + [(r, "a.go", "go", t) for r, t in code.items()]
    both = chunking.chunk_files(spark.createDataFrame(rows, FILES)).collect()
    for r, other in (("r1", "r2"), ("r2", "r1")):
        own = [x for x in both if x.repo_id == r]
        alone = chunking.chunk_files(spark.createDataFrame([x for x in rows if x[0] == r], FILES)).collect()
        assert sorted(map(tuple, own)) == sorted(map(tuple, alone)) and len(own) == 4
        assert not any(other in x.content for x in own)
        parts = [x.content for x in sorted(own, key=lambda x: x.line_start) if x.strategy == "doc_sections"]
        assert "\n".join(parts) == docs[r]


def test_replacing_a_file_leaves_its_namesake(spark):
    old = spark.createDataFrame([("r1", "README.md", "old1"), ("r2", "README.md", "old2")], "repo_id string, file_path string, qualified_name string")
    new = spark.createDataFrame([("r1", "README.md", "new1")], old.schema)
    assert sorted(r.qualified_name for r in maintenance.replace_files(old, new).collect()) == ["new1", "old2"]
    same = old.withColumnRenamed("qualified_name", "t").selectExpr("repo_id", "file_path", "'x' AS qualified_name", "t")
    got = maintenance.replace_nodes(same, same.where("repo_id = 'r1'").selectExpr("repo_id", "file_path", "qualified_name", "'new1' AS t"), "t")
    assert sorted(r.t for r in got.collect()) == ["new1", "old2"]
    edges = spark.createDataFrame([("r1", "CALLS", "a", "s", None, "t", 1), ("r2", "CALLS", "a", "s", None, "t", 2), ("r2", "CALLS", "a", "s", None, "t", 3)], EDGES)
    assert sorted(r.line for r in maintenance.keep_first_edges(edges, "line").collect()) == [1, 2]


CODE = [
    ("r1", "a.py", "python", "class A:\n    def f(self):\n        return 1\n\n\ndef g():\n    return Store()\n"),
    ("r2", "a.py", "python", "from s import Store\n\n\ndef h():\n    return Store()\n"),
    ("r2", "s.py", "python", "class Store:\n    def own(self, a):\n        pass\n"),
    ("r3", "s.py", "python", "class Store:\n    def other(self, b):\n        pass\n"),
]


def test_edges_meet_nodes_of_their_repository(spark):
    files = spark.createDataFrame(CODE, FILES)
    edges, nodes = extract.edges(files), extract.nodes(files)
    calls = graph.enclosing_nodes(edges.where("kind = 'CALLS'"), nodes).collect()
    assert [(r.repo_id, r.qualified_name) for r in calls] == [("r2", "a.py::h")]
    found = graph.resolve_targets(edges.where("kind = 'CALLS'").selectExpr("repo_id", "1 AS edge_id", "target_symbol", "target_file"), nodes).collect()
    assert [(r.repo_id, r.qualified_name, r.stage) for r in found] == [("r2", "s.py::Store", 2)]
    hit = graph.impact(edges, nodes, "s.py", repo="r2").collect()
    assert {r.qualified_name for r in hit} == {"a.py::h"}
    assert graph.impact(edges, nodes, "s.py", repo="r3").count() == 0
    assert sorted((r.repo_id, r.outline) for r in outline.class_outline(nodes).collect() if r.name == "Store") == [("r2", "Store: own(a)"), ("r3", "Store: other(b)")]
    assert {r.file_path for r in modules.resolve_imports(edges, files).collect()} == {"s.py"}
    assert [r.name for r in outline.file_view(edges, nodes, "a.py", repo="r1").collect()] == ["A", "f", "g"]


def test_code_is_shipped_to_workers():
    """Functions that run in workers carry the operators with them, for machines without the package."""
    from pyspark import cloudpickle

    assert len(cloudpickle.dumps(lexer.definitions)) > 1000


TRICKY = """const t = '}'
function one(a) {
  const s = "}" + `}${ { k: '}' }.k }` + /[}/]}/.source // }
  /* } */
  return s
}
function two() { return 4 / 2 }
class A {
  run(x) {
    if (x) { return /}/ }
  }
}
"""


def test_braces_that_are_no_code():
    got = {d["name"]: (d["kind"], d["line_start"], d["line_end"], d["parent"]) for d in lexer.definitions(TRICKY, "typescript")}
    assert got == {"one": ("function", 2, 6, None), "two": ("function", 7, 7, None), "A": ("class", 8, 12, None), "run": ("method", 9, 11, "A")}


def test_long_functions_and_linear_time():
    long = "function big(a) {\n" + "  x()\n" * 3000 + "}\n"
    assert [(d["name"], d["line_end"]) for d in lexer.definitions(long, "javascript")] == [("big", 3002)]
    text = "function f(a) { if (a) { g('}') } }\n" * 30_000
    start = time.monotonic()
    assert len(lexer.definitions(text, "javascript")) == 30_000
    assert time.monotonic() - start < 20
    assert lexer.definitions("{" * 200_000, "javascript") == [] and lexer.definitions("", "dart") == []


@pytest.mark.parametrize("text", ["'", "`${", "/* a", "}", "class A {", "r'''", "`${`${`"])
@pytest.mark.parametrize("language", ["javascript", "dart"])
def test_broken_texts(text, language):
    code, _ = lexer.scan(text, language)
    assert len(code) == len(text)


PATHS = ["app/core/m1.py", "app/core/__init__.py", "lib/util.py", "svc/app/core/m1.py", "web/src/view.ts", "web/src/parts/index.ts", "json.py"]
ASKED = [
    ("app/x/a.py", "app.core.m1", "app/core/m1.py"),
    ("app/x/a.py", "app.core.m1.Widget", "app/core/m1.py"),
    ("app/x/a.py", "app.core.none", "app/core/__init__.py"),
    ("app/x/a.py", "core.m1", "app/core/m1.py"),
    ("app/x/a.py", "util", "lib/util.py"),
    ("app/x/a.py", "nowhere.at.all", None),
    ("json.py", "json", None),
    ("app/core/m2.py", ".m1", "app/core/m1.py"),
    ("app/x/a.py", "..core.m1", "app/core/m1.py"),
    ("web/src/main.ts", "./view", "web/src/view.ts"),
    ("web/src/main.ts", "./view.js", "web/src/view.ts"),
    ("web/src/deep/main.ts", "../parts", "web/src/parts/index.ts"),
    ("web/src/main.ts", "./util", None),
]


def test_imports_find_their_files(spark):
    files = spark.createDataFrame([("r", p) for p in PATHS], "repo_id string, file_path string")
    edges = spark.createDataFrame([("r", "IMPORTS", s, None, None, t, None) for s, t, _ in ASKED] + [("q", "IMPORTS", "b.py", None, None, "app.core.m1", None)], EDGES)
    got = {(r.source_file, r.target_symbol): r.file_path for r in modules.resolve_imports(edges, files).collect()}
    assert got == {(s, t): f for s, t, f in ASKED if f}
    graph_rows = {(r.src, r.dst): (r.imports, r.files) for r in modules.module_graph(edges, files).collect()}
    assert graph_rows[("x", "core")] == (5, 1) and all(a != b for a, b in graph_rows)
    counts = {r.file_path: r.importers for r in modules.module_importers(edges, files).collect()}
    assert counts == {"app/core/m1.py": 2, "svc/app/core/m1.py": 1, "lib/util.py": 1, "json.py": 1}
    assert modules.module_graph(edges.limit(0), files).count() == 0


def test_context_of_calls(spark):
    body = "é" * 80 + "\nconst a = fetch('/orders/list')\n" + "z" * 80 + "\nfetch('/orders/two')"
    got = {r.url: r.context for r in contracts.consumers(spark.createDataFrame([("r", "a.ts", "typescript", body)], FILES)).collect()}
    for url in ("/orders/list", "/orders/two"):
        at = body.index("fetch('" + url)
        assert got[url].startswith(body[max(0, at - 50) : at]) and len(got[url]) <= 100 and body.find(got[url]) == at - 50
