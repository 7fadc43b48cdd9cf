"""Queries of outlines, views and digests of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import digest as D
from corpuscle.operators import extract as X
from corpuscle.operators import graph as G
from corpuscle.operators import outline as O
from corpuscle.sources import views

from . import code_queries as Q
from . import corpus_queries as CQ
from . import graph_queries as GQ
from .registry import query

PARAMS = "array_to_string(list_filter(list_transform(string_split(regexp_extract(s, '\\(([^)]*)\\)', 1), ','), lambda p: trim(string_split(p, '=')[1])), lambda p: p <> '' AND p NOT IN ('self', 'cls') AND p[1] <> '*')[1:6], ', ')"
SIGN = f"CASE WHEN kind = 'class' THEN name ELSE name || '(' || {PARAMS} || ')' || coalesce(' -> ' || nullif(trim(regexp_extract(s, '\\)\\s*->\\s*([^:]+)', 1)), ''), '') END"
NODES = f"{Q.LINES}, {Q.NODES}"


def py_nodes(spark, d):
    return GQ.nodes(spark, d).where("file_path LIKE '%.py'")


@query(f"{NODES} SELECT qualified_name, {SIGN} AS signature FROM pyn")
def signatures(spark, d):
    return py_nodes(spark, d).select("qualified_name", O.signature().alias("signature"))


PRECISE = f"""ps AS (SELECT *, {CQ.module_sql('file_path')} AS module, string_split(file_path, '/')[-1] || ':' || line_start || '-' || line_end || ' ' || CASE WHEN parent_name IS NOT NULL THEN parent_name || '.' || name ELSE {SIGN} END AS d FROM pyn),
    pr AS (SELECT module, row_number() OVER (PARTITION BY module ORDER BY file_path, line_start, qualified_name) AS rank, CASE WHEN length(d) > 120 THEN d[1:117] || '...' ELSE d END AS symbol FROM ps)"""


@query(f"{NODES}, {PRECISE} SELECT module, rank, symbol FROM pr WHERE rank <= 25")
def precise_symbols(spark, d):
    return O.precise_symbols(py_nodes(spark, d))


@query(
    f"{NODES}, sg AS (SELECT *, {SIGN} AS sig FROM pyn WHERE name[1] <> '_'), mt AS (SELECT *, row_number() OVER (PARTITION BY file_path, parent_name ORDER BY line_start) AS r FROM sg WHERE kind = 'method'), "
    "ls2 AS (SELECT file_path, parent_name AS name, string_agg(sig, ', ' ORDER BY r) AS methods FROM mt WHERE r <= 8 GROUP BY ALL) "
    "SELECT file_path, name, CASE WHEN kind = 'class' AND methods IS NOT NULL THEN name || ': ' || methods ELSE sig END AS outline FROM sg LEFT JOIN ls2 USING (file_path, name) WHERE kind <> 'method'"
)
def class_outline(spark, d):
    return O.class_outline(py_nodes(spark, d)).drop("repo_id")


MODELS = f"""c AS (SELECT file_path, regexp_extract(s, '^class\\s+(\\w+)', 1) AS model, line FROM ls WHERE {Q.PY} AND regexp_matches(s, '^class\\s')), mf AS (SELECT c.file_path, model, regexp_extract(ls.s, '^\\s+(\\w+):', 1) || '(' || trim(regexp_extract(ls.s, ':\\s*([\\w\\[\\], |]+?)(?:\\s*=|\\s*$)', 1)) || ')' AS fields FROM c JOIN ls ON ls.file_path = c.file_path AND ls.line = c.line + 1 WHERE regexp_matches(ls.s, '^\\s+\\w+:\\s*[\\w\\[\\], |]+?(?:\\s*=|\\s*$)'))"""


@query(f"{Q.LINES}, {MODELS} SELECT * FROM mf")
def model_fields(spark, d):
    return O.model_fields(views.code(spark, d)).drop("repo_id")


SETTINGS = f"""cv AS (SELECT file_path, line, regexp_extract(s, '^([A-Z][A-Z_0-9]+)', 1) || '=' || trim(regexp_extract(s, '[:=]\\s*(.+)$', 1)) AS setting FROM ls WHERE {Q.PY} AND regexp_matches(s, '^[A-Z][A-Z_0-9]+\\s*[:=]\\s*.+'))"""


@query(f"{Q.LINES}, {SETTINGS} SELECT file_path, setting FROM cv")
def config_values(spark, d):
    return O.config_values(views.code(spark, d)).select("file_path", "setting")


@query("SELECT p_partkey, '{name: \"' || p_name || '\", size: ' || p_size || ', tags: [str x 2], more: {x, y}}' AS sketch FROM part")
def json_sketch(spark, d):
    rows = views.table(spark, d, "part").selectExpr("p_partkey", """concat('{"name":"', p_name, '","size":', p_size, ',"tags":["a","b"],"more":{"x":1,"y":2}}') AS j""")
    return O.json_sketch(rows, "j").select("p_partkey", "sketch")


VIEW = """v AS (SELECT 'defined' AS section, 5 AS most, file_path || ':' || line_start AS entry FROM nodes WHERE name = 'Widget13'
    UNION SELECT 'callers', 15, source_file || ':' || coalesce(line, 0) FROM edges WHERE kind = 'CALLS' AND target_symbol ILIKE '%Widget13%'
    UNION SELECT 'inheritors', 10, source_symbol FROM edges WHERE kind = 'INHERITS' AND target_symbol = 'Widget13'
    UNION SELECT 'importers', 12, source_file FROM edges WHERE kind = 'IMPORTS' AND target_symbol ILIKE '%Widget13%'
    UNION SELECT 'uses', 20, kind || ' ' || target_symbol FROM edges WHERE source_symbol = 'Widget13')"""


@query(f"{GQ.EDGES}, {VIEW}, r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY entry) AS rank FROM v) SELECT section, rank, entry FROM r WHERE rank <= most")
def symbol_view(spark, d):
    return O.symbol_view(GQ.edges(spark, d), GQ.nodes(spark, d), "Widget13")


@query(f"{GQ.EDGES}, x AS (SELECT target_symbol AS name, count(DISTINCT source_file) AS external FROM edges WHERE kind = 'CALLS' AND source_file <> 'app/core/m29.py' GROUP BY 1) SELECT coalesce(parent_name, '') AS parent, name, kind, line_start, coalesce(external, 0) AS external FROM pyn LEFT JOIN x USING (name) WHERE file_path = 'app/core/m29.py'")
def file_view(spark, d):
    rows = O.file_view(GQ.edges(spark, d), GQ.nodes(spark, d), "app/core/m29.py")
    return rows.withColumn("line_start", F.col("line_start").cast("long"))


@query(f"{GQ.EDGES} SELECT (SELECT count(DISTINCT file_path) FROM code) || ' files, ' || (SELECT count(*) FROM nodes) || ' symbols, ' || (SELECT count(*) FROM edges) || ' edges' AS status")
def status_line(spark, d):
    return O.status_line(views.code(spark, d), GQ.nodes(spark, d), GQ.edges(spark, d))


@query(
    f"{NODES}, {PRECISE}, fm AS (SELECT DISTINCT {CQ.module_sql('file_path')} AS module, file_path FROM code), n AS (SELECT module, count(*) AS files FROM fm GROUP BY module), l AS (SELECT module, string_agg(symbol, chr(10) ORDER BY rank) AS listed FROM pr WHERE rank <= 25 GROUP BY module) "
    "SELECT module, md5('## ' || module || ' (' || files || ' files)' || chr(10) || coalesce(listed, '')) AS hash, length('## ' || module || ' (' || files || ' files)' || chr(10) || coalesce(listed, '')) // 4 AS tokens FROM n LEFT JOIN l USING (module)"
)
def render_digest(spark, d):
    rows = O.render(D.modules(CQ.code_modules(spark, d)), O.precise_symbols(py_nodes(spark, d)))
    return rows.select("module", F.md5(F.col("digest").cast("binary")).alias("hash"), "tokens")


def top_sql(title: str, rows: str, order: str, most: int) -> str:
    """A section of the first entries (module, file_path, e) of each module."""
    return f"{title} AS (SELECT module, chr(10) || '{title}: ' || string_agg(e, '; ' ORDER BY r) AS {title} FROM (SELECT module, e, row_number() OVER (PARTITION BY module ORDER BY {order}) AS r FROM (SELECT {CQ.module_sql('file_path')} AS module, * FROM ({rows}))) WHERE r <= {most} GROUP BY module)"


FULL = f"""fm AS (SELECT DISTINCT {CQ.module_sql('file_path')} AS module, file_path FROM code), mc AS (SELECT module, count(*) AS files FROM fm GROUP BY module), li AS (SELECT module, chr(10) || string_agg(symbol, chr(10) ORDER BY rank) AS listed FROM pr WHERE rank <= 25 GROUP BY module),
    {top_sql('fields', "SELECT file_path, model || ': ' || fields AS e FROM mf", 'file_path, e', 8)}, {top_sql('settings', 'SELECT file_path, line, setting AS e FROM cv', 'file_path, line', 6)},
    af AS (SELECT DISTINCT file_path, upper(verb) || ' ' || path AS flow FROM (SELECT file_path, unnest(regexp_extract_all(content, '@router\\.(get|post|put|patch|delete)\\("([^"]+)"', 1)) AS verb, unnest(regexp_extract_all(content, '@router\\.(get|post|put|patch|delete)\\("([^"]+)"', 2)) AS path FROM code WHERE {Q.PY})),
    tg AS (SELECT source_file AS file_path, array_to_string(list_sort(list(DISTINCT dst))[1:3], ', ') AS targets FROM mg WHERE src <> dst GROUP BY source_file),
    fw AS (SELECT flow, file_path, 'API ' || flow || ' (' || file_path || ')' || coalesce(' -> ' || targets, '') AS e FROM af LEFT JOIN tg USING (file_path) ORDER BY flow, file_path LIMIT 15), cs AS (SELECT * FROM al ORDER BY part, fan DESC, chain LIMIT 15),
    dg AS (SELECT 'module' AS part, module, '## ' || module || ' (' || files || ' files)' || coalesce(listed, '') || coalesce(fields, '') || coalesce(settings, '') AS digest FROM mc LEFT JOIN li USING (module) LEFT JOIN fields USING (module) LEFT JOIN settings USING (module)
    UNION ALL SELECT 'chains', '', '## chains' || chr(10) || string_agg(chain, chr(10) ORDER BY part, fan DESC, chain) FROM cs HAVING count(*) > 0 UNION ALL SELECT 'flows', '', '## flows' || chr(10) || string_agg(e, chr(10) ORDER BY flow, file_path) FROM fw HAVING count(*) > 0)"""


@query(f"{GQ.EDGES}{GQ.MODULES}{GQ.DEPS}{GQ.CHAINS}, {PRECISE}, {MODELS}, {SETTINGS}, {FULL} SELECT part, module, md5(digest) AS hash, length(digest) // 4 AS tokens FROM dg")
def full_digest(spark, d):
    code, edges = views.code(spark, d), GQ.edges(spark, d)
    flows = O.flow_targets(X.key_flows(code), edges, code.select("file_path"))
    rows = O.full_digest(D.modules(CQ.code_modules(spark, d)), O.precise_symbols(py_nodes(spark, d)), O.model_fields(code), O.config_values(code), G.two_hop(GQ.deps(spark, d)), flows)
    return rows.select("part", "module", F.md5(F.col("digest").cast("binary")).alias("hash"), "tokens")


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def tool_json(spark, d):
    return O.as_json(views.table(spark, d, "nation").select("n_nationkey", "n_name"))


@query(f"{NODES} SELECT qualified_name, starts_with(name, 'test') OR contains(name, 'test_') AS is_test FROM pyn WHERE kind <> 'class'")
def test_functions(spark, d):
    rows = py_nodes(spark, d).where("kind <> 'class'")
    return rows.select("qualified_name", (F.startswith("name", F.lit("test")) | F.contains("name", F.lit("test_"))).alias("is_test"))
