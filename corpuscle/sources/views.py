"""Views of tables in the roles of files, chunks and code.

Each view is one list of SQL expressions that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the place of each row in it: its file (__file) and its number in that (__at)."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))


def _module(k: str) -> str:
    names = "auth core brands content billing search api".split()
    return f"CASE ({k}) % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _text(*parts: str) -> str:
    """Parts joined; a part in single quotes is text, | ends a line."""
    return "concat(" + ", ".join(parts) + ")"


K, N = "p_partkey", "(p_partkey + 1)"
PYTHON = _text(
    "'\"\"\"Module ', p_name, '.\"\"\"'", NL, "'from app.'", _module(N), "'.m'", N, "' import Widget'", N, NL, "'import json'", NL, NL,
    "'MAX_ITEMS = '", "p_size", NL, NL, "'class Widget'", K, "'(Base'", "p_size", "', core.Mixin):'", NL,
    "'    title: str = 1'", NL, "'    def run(self, a: int, b: str = 1) -> int:'", NL, "'        return Widget'", N, "'(a)'", NL, NL,
    "'    async def load_all(self):'", NL, "'        pass'", NL, NL, "'def make_'", K, "'(x, y=1):'", NL, "'    return Widget'", N, "'(x)'", NL,
)
SCRIPT = _text(
    "'import \"./m'", N, "'\"'", NL, "'const x = require(\"lib/m'", K, "'\")'", NL, "'class View'", K, "' extends Panel'", "p_size", "' implements Shown, Sized {'", NL,
    "'  load() { return fetch(\"/api/v1/part_sets/'", "p_size", "'\") }'", NL, "'}'", NL, "'function draw'", K, "'(a, b) { client.post(\"/orders/list\") }'", NL,
)
ROUTER = _text(
    "'from app.core.m'", "p_size", "' import Store, Helper as Aid'", NL, NL, "'@router.get(\"/part-sets/{id}/items'", "p_size", "'\")'", NL,
    "'async def get_items_'", K, "'(id: int) -> Item'", "p_size", "'Response:'", NL, "'    return Store(id)'", NL, NL, "'@router.post(\"/v1/orders\")'", NL, "'def add_'", K, "'(body: OrderCreate):'", NL, "'    Aid(body)'", NL,
)
DART = _text(
    "'import \"package:app/card'", N, "'.dart\";'", NL, "'/* class Hidden { /* one more } */ */'", NL, "'class Card'", K, "' extends Base'", "p_size", "' {'", NL, "'  final String name = \"a } brace {\";'", NL,
    "'  String title(int a, {int b = 1}) {'", NL, "'    if (a > 0) { return \"x$'", "'{ { 1: \"}\" }[a] }\"; }'", NL, "'    return r\"\";'", NL, "'  }'", NL, "'  int size'", "p_size", "'() => { 1: 2 }.length;'", NL, "'}'", NL,
    "'mixin Shown'", K, "' {'", NL, "'}'", NL, "'Future<void> load'", K, "'(String url) async {'", NL, "'  // } not here'", NL, "'  await fetch(url);'", NL, "'}'", NL,
)
DART_FILES = {"repo_id": "p_brand", "file_path": f"concat('lib/', {_module(K)}, '/card', {K}, '.dart')", "language": "'dart'", "content": DART}
CODE = {
    "repo_id": "p_brand",
    "file_path": f"CASE WHEN {K} % 10 = 0 THEN concat('tests/test_m', {K}, '.py') WHEN {K} % 4 = 2 THEN concat('web/src/view', {K}, '.ts') "
    f"WHEN {K} % 4 = 3 THEN concat('app/', {_module(K)}, '/router_m', {K}, '.py') ELSE concat('app/', {_module(K)}, '/m', {K}, '.py') END",
    "language": f"CASE WHEN {K} % 10 <> 0 AND {K} % 4 = 2 THEN 'typescript' ELSE 'python' END",
    "content": f"CASE WHEN {K} % 10 = 0 THEN {PYTHON} WHEN {K} % 4 = 2 THEN {SCRIPT} WHEN {K} % 4 = 3 THEN {ROUTER} ELSE {PYTHON} END",
}
FILES = {
    "repo_id": "source",
    "file_path": "concat(source, '/', lang, '/', doc_id, '.txt')",
    "symbol_name": "concat('doc_', doc_id)",
    "content": "text",
    "summary": "substr(text, 1, 60)",
    "last_modified": "1700000000.0 + doc_id * 60",
    "doc_id": "doc_id",
}
#: Text with headings and blank lines, for chunkers.
SECTIONS = {
    "file_path": "concat(source, '/', lang, '/', doc_id, '.md')",
    "content": f"concat('Intro of ', doc_id, {NL}, replace(text, {NL}, concat({NL}, {NL}, '## Part ', doc_id % 7, {NL})))",
}


def view(spark: SparkSession, sf_dir: str, source: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def view_sql(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source})"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part", CODE)


#: Rows of ``part``, short ones, that become the source files of one task.
FILES_A_TASK = 4096


def spread_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``code``, over tasks in proportion to the rows: the source files are far longer than the rows they are made of."""
    rows = table(spark, sf_dir, "part")
    tasks = rows.count() // FILES_A_TASK + 1
    return rows.repartition(tasks, "p_partkey").selectExpr(*[f"{e} AS {c}" for c, e in CODE.items()])


def dart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part", DART_FILES)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents", FILES)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents", SECTIONS)


CODE_SQL = view_sql("code", "part", CODE)
DART_SQL = view_sql("code", "part", DART_FILES)
FILES_SQL = view_sql("files", "documents", FILES)
SECTIONS_SQL = view_sql("sections", "documents", SECTIONS)
