"""What reviews found: each fault with the input that showed it."""

import unicodedata

import pytest
from pyspark.sql import functions as F
from test_core import CHUNKS

from corpuscle.functions import text
from corpuscle.operators import chunking, extract, graph, maintenance, outline, search


@pytest.mark.parametrize("word", ["tiếng", "йод", "ÅNGSTRÖM", "Ǆ", "कि", "naïve"])
@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_query_and_text_fold_alike(spark, word, form):
    row = ("r", "1", "a.txt", "doc", None, f"one {unicodedata.normalize(form, word)} two", None, 0.0)
    chunks = spark.createDataFrame([row], CHUNKS)
    for asked in (word, unicodedata.normalize("NFD", word)):
        assert search.bm25(chunks, asked).count() == 1
    assert search.doc_stats(chunks).first().dl == 5  # three words and the two of the path
    assert spark.range(1).select(text.fold(F.lit(word)).alias("f")).first().f == text.fold_str(word)


SIGNED = '''class A:
    def long(
        self,
        a: int,  # one
        b: str = "x",
    ) -> dict:
        return {}

def outer(x,
          y):
    def inner():
        pass
    return inner

@wrapped
def last(): pass
'''


def test_signatures_over_lines(spark):
    """A block ends before the next line that is indented no more; a closing bracket is such a line."""
    files = spark.createDataFrame([("r", "a.py", "python", SIGNED)], "repo_id string, file_path string, language string, content string")
    got = {r.name: (r.kind, r.line_start, r.line_end, r.params, r.return_type) for r in extract.python_nodes(files).collect()}
    assert got["A"] == ("class", 1, 8, None, None)
    assert got["long"][:3] == ("method", 2, 5) and got["long"][4] == "dict" and got["long"][3].startswith("a: int")
    assert got["outer"] == ("function", 9, 14, "x, y", None)
    assert got["last"] == ("function", 16, 17, "", None) and "inner" not in got


def test_lines_of_very_many_matches(spark):
    body = "".join(f"class C{i} extends B{i} {{}}\n" + "\n" * (i % 3) for i in range(1500))
    files = spark.createDataFrame([("r", "a.ts", "typescript", body)], "repo_id string, file_path string, language string, content string")
    want = {f"C{i}": body[: body.index(f"class C{i} ")].count("\n") + 1 for i in range(1500)}
    assert {r.source_symbol: r.line for r in extract.inherits(files).collect()} == want


def test_walk_replaces_what_is_no_utf8(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = '\xff'\n")
    assert [r.content for r in maintenance.walk(spark, str(tmp_path)).collect()] == ["x = '�'\n"]


def test_overlap_of_repeated_rows(spark):
    left = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"])], "id int, l_k array<string>")
    right = spark.createDataFrame([("x", ["b", "c", "a"]), ("y", ["z"])], "u string, r_k array<string>")
    assert [(r.id, r.u, r.common) for r in graph.overlap_join(left, right, "k").collect()] == [(1, "x", 2)] * 2


def test_environments_by_all_markers(spark):
    paths = ["e1/pyvenv.cfg", "e1/a.py", "p/e2/bin/python", "p/e2/b.py", "q/e3/lib/python3.12/site-packages/c.py", "q/e3/d.py", "q/lib/e.py", "bin.py"]
    left = maintenance.outside_environments(spark.createDataFrame([(p,) for p in paths], "file_path string"))
    assert sorted(r.file_path for r in left.collect()) == ["bin.py", "q/lib/e.py"]


def test_sketch_of_json(spark):
    rows = [('{"b": "' + "x" * 40 + '", "a": [1.5, 2], "c": {"z": 1, "y": null}, "d": null, "e": true, "f": []}',), ("[1]",), ("no json",), (None,), ("{}",)]
    got = [r.sketch for r in outline.json_sketch(spark.createDataFrame(rows, "j string"), "j").collect()]
    assert got == ['{b: "' + "x" * 30 + '...", a: [float x 2], c: {y, z}, d: null, e: true, f: [any x 0]}', "", "", "", "{}"]


def test_status_line(spark):
    rows = lambda n: spark.createDataFrame([(f"f{i}",) for i in range(n)], "file_path string")
    assert outline.status_line(rows(3), rows(2), rows(0)).first().status == "3 files, 2 symbols, 0 edges"


SCRIPT = """export class A<T> extends B implements C {
  run() { if (x) { y() } }
}

const add = (a, b) => a + b
export const go = async (x: number): Promise<void> => {
  await z()
}
function open(a) {
  never
"""


def test_scripts_to_their_closing_braces(spark):
    files = spark.createDataFrame([("r", "a.ts", "typescript", SCRIPT), ("r", "b.go", "go", "func F(a int) {\n}\n")], "repo_id string, file_path string, language string, content string")
    got = {r.name: (r.kind, r.line_start, r.line_end, r.params) for r in extract.nodes(files).collect()}
    assert got == {"A": ("class", 1, 3, None), "add": ("function", 5, 5, "a, b"), "go": ("function", 6, 8, "x: number"), "open": ("function", 9, 59, "a"), "F": ("function", 1, 16, "a int")}


def test_files_reach_their_chunkers(spark):
    long = "import os\n\n\ndef one():\n    return 1\n\n\nclass Two:\n    def run(self):\n        pass\n" + "# filler of a long file\n" * 500
    rows = [("d/a.md", "# Hi\n\ntext", "markdown"), ("d/b.md", "# One\n" + "word " * 4000 + "\n## Two\nx\n", "markdown"), ("s/c.py", '"""About."""\ndef f(): pass\n', "python"), ("s/long.py", long, "python"), ("s/bad.py", "def (\n\n\nx = 1\n" + "y = 2\n" * 2000, "python"), ("s/long.go", "a\n\n\n" + "b = 1\n" * 2000, "go")]
    got = {}
    for r in chunking.chunk_files(spark.createDataFrame(rows, "file_path string, content string, language string")).collect():
        got.setdefault((r.file_path, r.strategy), []).append((r.symbol_name, r.summary))
    assert got["d/a.md", "doc_whole"] == [("a.md", "Hi")] and sorted(x for x, _ in got["d/b.md", "doc_sections"]) == ["One", "Two"]
    assert got["s/c.py", "code_whole"] == [("c.py", "s/c.py | About. | Defines: f")]
    assert sorted(x for x, _ in got["s/long.py", "code_symbols"]) == ["Two", "imports", "one", "run"]
    assert len(got["s/bad.py", "code_blocks"]) == 2 and len(got["s/long.go", "code_blocks"]) == 2 and len(got) == 6


def test_first_lines_keep_their_digits_and_lose_all_spaces(spark):
    lines = ["0 items of 40", "\n  \n  ##  Part 10  \nx", "　", None]
    rows = [(f"d/{i}.txt", x, "text") for i, x in enumerate(lines)]
    files = spark.createDataFrame(rows, "file_path string, content string, language string")
    want = {"d/0.txt": "0 items of 40", "d/1.txt": "Part 10", "d/2.txt": ""}
    assert {r.file_path: r.summary for r in chunking.whole(files).collect()} == want
    assert {r.file_path: r.summary for r in chunking.chunk_files(files).where("strategy = 'doc_whole'").collect()} == want


def test_signatures_keep_their_digits(spark):
    files = spark.createDataFrame([("r", "a.py", "python", "def f(\n    b,\n    c=10\n) -> A0:\n    pass\n1")], "repo_id string, file_path string, language string, content string")
    assert [(r.params, r.return_type) for r in extract.python_nodes(files).collect()] == [("b, c", "A0")]
    files = spark.createDataFrame([("r", "a.py", "python", "def f(a0,\n1b1,\n  c): pass")], "repo_id string, file_path string, language string, content string")
    assert [r.params for r in extract.python_nodes(files).collect()] == ["a0, 1b1, c"]


def test_segments_keep_their_digits(spark):
    from corpuscle.operators import contracts

    assert spark.createDataFrame([("/0items0/1a1",)], "u string").select(contracts.segments(F.col("u")).alias("s")).first().s == ["0items0", "1a1"]


def test_of_equal_lines_the_first_in_the_table_stays(spark, tmp_path):
    from corpuscle.plans.catalog import QUERIES

    rows = spark.range(0, 40000, 1, 1).selectExpr("id % 100 AS l_orderkey", "cast(least(id DIV 100, 7) AS int) AS l_linenumber", "id AS l_partkey")
    for part in range(2):
        rows.where(f"l_partkey DIV 20000 = {part}").sort(F.expr(f"xxhash64(l_partkey + {part})")).coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
    (tmp_path / "lineitem.parquet").mkdir()
    want = {}
    for part in range(2):
        file = next((tmp_path / f"p{part}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{'ba'[part]}.parquet")
        for r in spark.read.parquet(str(file)).collect():
            if r.l_linenumber == 7 and (r.l_orderkey not in want or want[r.l_orderkey][0] > file.name):
                want[r.l_orderkey] = (file.name, r.l_partkey)
    got = {r.l_orderkey: r.l_partkey for r in QUERIES["keep_last"](spark, str(tmp_path)).collect()}
    assert got == {k: v for k, (_, v) in want.items()}


def test_source_files_are_spread_over_tasks(spark, tmp_path):
    from corpuscle.sources import views

    rows = spark.range(0, 10000, 1, 1).selectExpr("id AS p_partkey", "'a b' AS p_name", "'Brand#1' AS p_brand", "'LARGE' AS p_type", "cast(id % 50 AS int) AS p_size", "1.0D AS p_retailprice")
    rows.write.parquet(str(tmp_path / "part.parquet"))
    spread = views.spread_code(spark, str(tmp_path))
    assert spread.rdd.getNumPartitions() == 3
    assert spread.exceptAll(views.code(spark, str(tmp_path))).isEmpty() and spread.count() == 10000
