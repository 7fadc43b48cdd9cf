"""Queries of chunkers, symbols and relationships, over a view of parts as code."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import chunking as C
from corpuscle.operators import extract as X
from corpuscle.sources import views

from .registry import query

CODE = "WITH " + views.CODE_SQL
LINES = CODE + ", ls AS (SELECT repo_id, file_path, language, unnest(string_split(content, chr(10))) AS s, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM code)"
PY, TS = "language = 'python'", "language = 'typescript'"
TEST = "(language = 'python' AND (contains(string_split(file_path, '/')[-1], 'test_') OR contains(lower(file_path), 'test_') OR contains(file_path, '_test.py') OR contains(file_path, 'conftest.py')))"

IMPORTS = f"""SELECT file_path AS source_file, target AS target_symbol FROM (
    SELECT file_path, unnest(regexp_extract_all(content, '(?m)^from\\s+([\\p{{L}}\\p{{N}}_.]+)\\s+import', 1) || regexp_extract_all(content, '(?m)^import\\s+([\\p{{L}}\\p{{N}}_.]+)', 1)) AS target FROM code WHERE {PY}
    UNION ALL SELECT file_path, unnest(regexp_extract_all(content, '(?:import|require)\\s*\\(?\\s*[''"]([^''"]+)[''"]', 1)) FROM code WHERE {TS})"""
INHERITS = f"""SELECT file_path AS source_file, child AS source_symbol, base AS target_symbol, line FROM (
    SELECT file_path, line, regexp_extract(s, '^class\\s+(\\w+)\\(', 1) AS child, trim(string_split(trim(unnest(string_split(regexp_extract(s, '^class\\s+\\w+\\(([^)]+)\\)', 1), ','))), '.')[-1]) AS base FROM ls WHERE {PY} AND regexp_matches(s, '^class\\s+\\w+\\([^)]+\\)')
    UNION ALL SELECT file_path, line, regexp_extract(s, 'class\\s+(\\w+)\\s+extends', 1), regexp_extract(s, 'extends\\s+(\\w+)', 1) FROM ls WHERE {TS} AND regexp_matches(s, 'class\\s+\\w+\\s+extends\\s+\\w+'))
    WHERE base NOT IN ('', 'object', 'ABC', 'Exception', 'BaseException')"""
IMPLEMENTS = f"SELECT file_path AS source_file, regexp_extract(s, 'class\\s+(\\w+)', 1) AS source_symbol, trim(unnest(string_split(regexp_extract(s, 'implements\\s+([\\w, ]+)', 1), ','))) AS target_symbol, line FROM ls WHERE {TS} AND contains(s, 'implements')"
CALLS = f"""SELECT c.file_path AS source_file, c.name AS target_symbol, c.line FROM
    (SELECT file_path, line, unnest(regexp_extract_all(s, '(\\w+)\\s*\\(', 1)) AS name FROM ls WHERE {PY}) c
    SEMI JOIN (SELECT file_path, trim(string_split(trim(unnest(string_split(regexp_extract(s, '^from\\s+[\\w.]+\\s+import\\s+([^(]+)', 1), ','))), ' as ')[-1]) AS name FROM ls WHERE {PY} AND s LIKE 'from %') n
    ON c.file_path = n.file_path AND c.name = n.name WHERE c.name[1] = upper(c.name[1])"""
TESTED = f"SELECT source_file, string_split(string_split(source_file, '/')[-1], '.')[1] AS source_symbol, source_file AS target_file, target_symbol FROM ({IMPORTS}) i SEMI JOIN code c ON c.file_path = i.source_file AND {TEST} WHERE NOT regexp_matches(lower(target_symbol), 'test|mock|fixture|conftest|pytest')"


def code(spark, d):
    return views.code(spark, d)


@query(f"{CODE} {IMPORTS}")
def imports_edges(spark, d):
    return X.imports(code(spark, d)).select("source_file", "target_symbol")


@query(f"{LINES} {INHERITS}")
def inherits_edges(spark, d):
    return X.inherits(code(spark, d)).select("source_file", "source_symbol", "target_symbol", F.col("line").cast("long").alias("line"))


@query(f"{LINES} {IMPLEMENTS}")
def implements_edges(spark, d):
    return X.implements(code(spark, d)).select("source_file", "source_symbol", "target_symbol", F.col("line").cast("long").alias("line"))


@query(f"{LINES} {CALLS}")
def calls_edges(spark, d):
    return X.calls(code(spark, d)).select("source_file", "target_symbol", F.col("line").cast("long").alias("line"))


@query(f"{CODE} {TESTED}")
def tested_by_edges(spark, d):
    return X.tested_by(code(spark, d)).select("source_file", "source_symbol", "target_file", "target_symbol")


NODES = f"""df AS (SELECT *, length(s) - length(ltrim(s)) AS ind, regexp_matches(s, '^class\\s+\\w+') AS is_class FROM ls WHERE {PY} AND regexp_matches(s, '^\\s*(async\\s+)?def\\s+\\w+\\s*\\(|^class\\s+\\w+')),
    rl AS (SELECT file_path, line, s, length(s) - length(ltrim(s)) AS ind FROM ls WHERE {PY} AND trim(s) <> '' AND ltrim(s)[1] <> '#'),
    ln AS (SELECT file_path, max(line) AS last FROM ls GROUP BY file_path),
    nx AS (SELECT df.file_path, df.line, min(rl.line) AS nxt FROM df JOIN rl ON rl.file_path = df.file_path AND rl.line > df.line AND rl.ind <= df.ind GROUP BY ALL),
    pv AS (SELECT df.file_path, df.line, max_by(rl.s, rl.line) AS opener FROM df JOIN rl ON rl.file_path = df.file_path AND rl.line < df.line AND rl.ind = 0 GROUP BY ALL),
    nd AS (SELECT df.file_path, df.line AS line_start, coalesce(nxt - 1, last) AS line_end, is_class, s,
        CASE WHEN is_class THEN regexp_extract(s, '^class\\s+(\\w+)', 1) ELSE regexp_extract(s, 'def\\s+(\\w+)', 1) END AS name,
        CASE WHEN NOT is_class AND ind > 0 THEN nullif(regexp_extract(coalesce(opener, ''), '^class\\s+(\\w+)', 1), '') END AS parent_name
        FROM df JOIN ln USING (file_path) LEFT JOIN nx USING (file_path, line) LEFT JOIN pv USING (file_path, line)),
    pyn AS (SELECT file_path || '::' || coalesce(parent_name || '.', '') || name AS qualified_name, CASE WHEN is_class THEN 'class' WHEN parent_name IS NOT NULL THEN 'method' ELSE 'function' END AS kind, file_path, name, parent_name, line_start, line_end, s FROM nd WHERE ltrim(s) = s OR parent_name IS NOT NULL)"""
GENERIC = f"""WITH ch AS (SELECT file_path, unnest(string_split(content, '')) AS c, generate_subscripts(string_split(content, ''), 1) AS pos FROM code WHERE {TS}),
    br AS (SELECT file_path, pos, c, sum(CASE c WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS depth, 1 + sum((c = chr(10))::INT) OVER w AS line FROM ch WINDOW w AS (PARTITION BY file_path ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    op AS (SELECT file_path, line, min(pos) AS pos, min_by(depth, pos) AS depth FROM br WHERE c = '{{' GROUP BY ALL),
    cl AS (SELECT op.file_path, op.line, min_by(br.line, br.pos) AS line_end FROM op JOIN br ON br.file_path = op.file_path AND br.pos > op.pos AND br.c = '}}' AND br.depth = op.depth - 1 GROUP BY ALL),
    tn AS (SELECT file_path, line, unnest(regexp_extract_all(s, 'class\\s+(\\w+)', 1)) AS name, 'class' AS kind, NULL AS params FROM ls WHERE {TS}
        UNION ALL SELECT file_path, line, unnest(regexp_extract_all(s, 'function\\s+(\\w+)\\s*\\([^)]*\\)', 1)), 'function', regexp_extract(s, 'function\\s+\\w+\\s*\\(([^)]*)\\)', 1)[1:60] FROM ls WHERE {TS})
    SELECT file_path || '::' || name AS qualified_name, kind, file_path, name, line AS line_start, line_end::BIGINT AS line_end, params FROM tn JOIN cl USING (file_path, line)"""


@query(f"{LINES}, {NODES} SELECT qualified_name, kind, name, parent_name, line_start, line_end FROM pyn")
def python_nodes(spark, d):
    n = X.python_nodes(code(spark, d))
    return n.select("qualified_name", "kind", "name", "parent_name", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@query(f"{LINES} SELECT * FROM ({GENERIC})")
def js_nodes(spark, d):
    return X.script_nodes(code(spark, d)).select("qualified_name", "kind", "file_path", "name", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "params")


@query(
    f"{LINES}, {NODES} SELECT qualified_name, array_to_string(list_filter(list_transform(string_split(regexp_extract(s, '\\(([^)]*)\\)', 1), ','), lambda p: trim(string_split(p, '=')[1])), "
    "lambda p: p <> '' AND p NOT IN ('self', 'cls') AND p[1] <> '*')[1:6], ', ') AS params, nullif(trim(regexp_extract(s, '\\)\\s*->\\s*([^:]+)', 1)), '') AS return_type FROM pyn WHERE kind <> 'class'"
)
def params(spark, d):
    return X.python_nodes(code(spark, d)).where("kind <> 'class'").select("qualified_name", "params", "return_type")


@query(f"{LINES}, {NODES} SELECT qualified_name, parent_name AS enclosing_class FROM pyn WHERE kind = 'method'")
def enclosing_class(spark, d):
    return X.python_nodes(code(spark, d)).where("kind = 'method'").select("qualified_name", F.col("parent_name").alias("enclosing_class"))


@query(f"{LINES}, {NODES} SELECT qualified_name, line_end - line_start + 1 AS block_lines FROM pyn")
def block_end(spark, d):
    return X.python_nodes(code(spark, d)).select("qualified_name", (F.col("line_end") - F.col("line_start") + 1).cast("long").alias("block_lines"))


@query(f"{CODE} SELECT file_path, language, {TEST} AS is_test FROM code")
def test_files(spark, d):
    return code(spark, d).select("file_path", "language", text.is_test_file(F.col("file_path"), F.col("language")).alias("is_test"))


@query(f"{CODE} SELECT file_path, coalesce(nullif(trim(regexp_extract(content, '(?s)^\\s*\"\"\"(.*?)\"\"\"', 1)), ''), '') AS docstring FROM code WHERE {PY}")
def module_docstring(spark, d):
    return code(spark, d).where(PY).select("file_path", C.module_docstring(F.col("content"), F.col("language")).alias("docstring"))


@query(f"{CODE} SELECT file_path, array_to_string(list_filter(string_split(content, chr(10)), lambda x: CASE WHEN {PY} THEN regexp_matches(x, '^(import|from)\\s') ELSE contains(x, 'require') END), chr(10)) AS imports FROM code")
def import_block(spark, d):
    return code(spark, d).select("file_path", C.import_block(F.col("content"), F.col("language")).alias("imports"))


@query(
    "WITH t(node_type, symbol_type) AS (VALUES ('class_definition', 'class'), ('method_declaration', 'method'), ('function_item', 'function'), ('arrow_function', 'function'), ('interface_declaration', 'interface'), "
    "('enum_item', 'enum'), ('type_alias', 'type'), ('struct_item', 'type'), ('trait_item', 'trait'), ('impl_item', 'trait'), ('lexical_declaration', 'definition')) SELECT * FROM t"
)
def symbol_type_map(spark, d):
    kinds = "class_definition method_declaration function_item arrow_function interface_declaration enum_item type_alias struct_item trait_item impl_item lexical_declaration".split()
    return spark.createDataFrame([(k,) for k in kinds], "node_type string").withColumn("symbol_type", C.symbol_type(F.col("node_type")))


@query(
    f"WITH {views.FILES_SQL} SELECT file_path, CASE WHEN length(content) // 4 <= 4000 THEN 'doc_whole' ELSE 'doc_sections' END AS strategy FROM files"
    f" UNION ALL SELECT file_path, CASE WHEN length(content) // 4 <= 2000 THEN 'code_whole' WHEN {PY} THEN 'code_symbols' ELSE 'code_blocks' END FROM ({CODE} SELECT * FROM code)"
)
def chunk_dispatch(spark, d):
    both = views.files(spark, d).select("file_path", "content").withColumn("language", text.language(F.col("file_path"))).unionByName(code(spark, d).select("file_path", "content", "language"))
    return both.select("file_path", C.strategy(F.col("language"), F.col("content")).alias("strategy"))


FIRST = "coalesce(ltrim(regexp_replace(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '^#+', ''))[1:120], '')"


@query(f"WITH {views.FILES_SQL} SELECT file_path, string_split(file_path, '/')[-1] AS symbol_name, {FIRST.format(c='content')} AS summary FROM files WHERE length(content) // 4 <= 4000")
def chunk_whole_vs_split(spark, d):
    return C.whole(views.files(spark, d)).select("file_path", "symbol_name", "summary")


SPLIT = f"WITH {views.SECTIONS_SQL}, ls AS (SELECT file_path, unnest(string_split(content, chr(10))) AS s, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM sections)"


@query(
    f"{SPLIT}, m AS (SELECT *, (sum(CASE WHEN regexp_matches(s, '^#{{1,4}}\\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line))::BIGINT AS section FROM ls) "
    "SELECT file_path, section, coalesce(max(CASE WHEN regexp_matches(s, '^#{1,4}\\s+') THEN trim(regexp_extract(s, '^#{1,4}\\s+(.*)$', 1)) END), 'Top') AS symbol_name, min(line) AS line_start, max(line) AS line_end, md5(string_agg(s, chr(10) ORDER BY line)) AS hash "
    "FROM m GROUP BY file_path, section HAVING trim(string_agg(s, '')) <> ''"
)
def chunk_sections(spark, d):
    rows = C.sections(views.sections(spark, d))
    return rows.select("file_path", "section", "symbol_name", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), F.md5(F.col("content").cast("binary")).alias("hash"))


@query(
    f"{SPLIT}, g AS (SELECT *, trim(s) <> '' AND coalesce(lag(trim(s) = '') OVER (PARTITION BY file_path ORDER BY line), true) AS st FROM ls), "
    "m AS (SELECT *, (sum(st::INT) OVER (PARTITION BY file_path ORDER BY line))::BIGINT AS block FROM g) "
    "SELECT file_path, block, min(line) AS line_start, max(line) AS line_end, md5(trim(string_agg(s, chr(10) ORDER BY line))) AS hash FROM m WHERE trim(s) <> '' GROUP BY file_path, block"
)
def chunk_blocks(spark, d):
    rows = C.blocks(views.sections(spark, d), None)
    return rows.select("file_path", "block", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), F.md5(F.col("content").cast("binary")).alias("hash"))


AST = f"""df AS (SELECT *, length(s) - length(ltrim(s)) AS ind, regexp_matches(s, '^\\s*class\\s') AS is_class FROM ls WHERE {PY} AND regexp_matches(s, '^\\s*(async\\s+)?def\\s+\\w+\\s*\\(|^\\s*class\\s+\\w+')),
    rl AS (SELECT file_path, line, s, length(s) - length(ltrim(s)) AS ind FROM ls WHERE {PY} AND trim(s) <> '' AND ltrim(s)[1] <> '#'),
    nx AS (SELECT df.file_path, df.line, min(rl.line) AS nxt FROM df JOIN rl ON rl.file_path = df.file_path AND rl.line > df.line AND rl.ind <= df.ind GROUP BY ALL),
    pa AS (SELECT df.file_path, regexp_extract(df.s, '(?:class|def)\\s+(\\w+)', 1) AS name, CASE WHEN is_class THEN 'class' ELSE 'function' END AS kind, df.line AS line_start, max(rl.line) AS line_end
        FROM df LEFT JOIN nx USING (file_path, line) JOIN rl ON rl.file_path = df.file_path AND rl.line >= df.line AND (nxt IS NULL OR rl.line < nxt) GROUP BY ALL),
    ta AS (SELECT file_path, name, kind, line_start, line_end FROM ({GENERIC}) UNION ALL SELECT file_path, regexp_extract(s, '^  (\\w+)\\(\\) \\{{', 1), 'method', line, line FROM ls WHERE {TS} AND regexp_matches(s, '^  \\w+\\(\\) \\{{')),
    al AS (SELECT * FROM pa UNION ALL SELECT * FROM ta)"""


@query(f"{LINES}, {AST} SELECT al.*, array_to_string(string_split(content, chr(10))[line_start:line_end], chr(10)) AS content FROM al JOIN code USING (file_path)")
def ast_chunks(spark, d):
    return C.code_symbols(code(spark, d)).select("file_path", "name", "kind", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "content")


DART = LINES.replace(views.CODE_SQL, views.DART_SQL) + """, dn AS (
    SELECT file_path, line, regexp_extract(s, '^\\w+ (\\w+)', 1) AS name, 'class' AS kind, NULL AS params, '}' AS closer FROM ls WHERE regexp_matches(s, '^(class|mixin) ')
    UNION ALL SELECT file_path, line, regexp_extract(s, '^  \\w+ (\\w+)\\(', 1), 'method', regexp_extract(s, '\\((.*)\\) \\{$', 1), '  }' FROM ls WHERE regexp_matches(s, '^  \\w+ \\w+\\(.*\\) \\{$')
    UNION ALL SELECT file_path, line, regexp_extract(s, '^  \\w+ (\\w+)\\(', 1), 'method', '', NULL FROM ls WHERE regexp_matches(s, '^  \\w+ \\w+\\(\\) => ')
    UNION ALL SELECT file_path, line, regexp_extract(s, ' (\\w+)\\(', 1), 'function', regexp_extract(s, '\\((.*)\\) async', 1), '}' FROM ls WHERE regexp_matches(s, '^\\S+ \\w+\\(.*\\) async \\{$'))"""


@query(f"{DART} SELECT dn.file_path, name, kind, params, dn.line AS line_start, CASE WHEN closer IS NULL THEN dn.line ELSE min(ls.line) END AS line_end FROM dn LEFT JOIN ls ON ls.file_path = dn.file_path AND ls.line > dn.line AND ls.s = closer GROUP BY dn.file_path, name, kind, params, dn.line, closer")
def dart_nodes(spark, d):
    return X.dart_nodes(views.dart(spark, d)).select("file_path", "name", "kind", "params", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@query(
    "SELECT sha256('__commits__:0:' || lpad(o_orderkey::VARCHAR, 8, '0'))[1:16] AS chunk_id, lpad(o_orderkey::VARCHAR, 8, '0') AS symbol_name, o_orderpriority AS summary, o_orderstatus AS author "
    "FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20)"
)
def commit_chunks(spark, d):
    last = views.table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    lines = last.select(F.concat_ws("|", F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), "o_orderpriority", "o_orderstatus", F.col("o_orderdate").cast("string")).alias("line"))
    return C.commit_chunks(lines).select("chunk_id", "symbol_name", "summary", "author")


@query(f"{CODE} SELECT file_path, 'API' AS type, upper(verb) || ' ' || path AS flow FROM (SELECT file_path, unnest(regexp_extract_all(content, '@router\\.(get|post|put|patch|delete)\\(\"([^\"]+)\"', 1)) AS verb, unnest(regexp_extract_all(content, '@router\\.(get|post|put|patch|delete)\\(\"([^\"]+)\"', 2)) AS path FROM code WHERE {PY})")
def key_flows(spark, d):
    return X.key_flows(code(spark, d))


@query(f"{CODE}, f AS (SELECT file_path, unnest(regexp_extract_all(content, '@router\\.(get|post|put|patch|delete)\\(\"([^\"]+)\"', 1)) AS verb, unnest(regexp_extract_all(content, '@router\\.(get|post|put|patch|delete)\\(\"([^\"]+)\"', 2)) AS path FROM code WHERE {PY}) SELECT 'API' AS type, upper(verb) || ' ' || path AS flow, file_path FROM f ORDER BY flow, file_path LIMIT 15")
def flow_order(spark, d):
    return X.key_flows(code(spark, d)).select("type", "flow", "file_path").orderBy(F.when(F.col("type") == "API", 0).when(F.col("type") == "TASK", 1).otherwise(2), "flow", "file_path").limit(15)



DEFINED = "regexp_extract_all(content, '(?m)^(?:class|(?:async\\s+)?def|function)\\s+(\\w+)', 1)[1:5]"
OPENING = "nullif(trim(regexp_extract(content, '^\"\"\"([^\"]*)\"\"\"', 1))[1:200], '')"


@query(
    f"{CODE}, {views.FILES_SQL} SELECT file_path, 'doc_whole' AS strategy, string_split(file_path, '/')[-1] AS symbol_name, {FIRST.format(c='content')} AS summary, 1 AS line_start FROM files WHERE length(content) // 4 <= 4000 "
    "UNION ALL SELECT file_path, 'doc_sections', 'Top', NULL, 1 FROM files WHERE length(content) // 4 > 4000 "
    f"UNION ALL SELECT file_path, 'code_whole', string_split(file_path, '/')[-1], concat_ws(' | ', array_to_string(string_split(file_path, '/')[-2:], '/'), {OPENING}, 'Defines: ' || nullif(array_to_string({DEFINED}, ', '), '')), 1 FROM code"
)
def chunk_files(spark, d):
    both = views.files(spark, d).select("file_path", "content").withColumn("language", text.language(F.col("file_path"))).unionByName(code(spark, d).select("file_path", "content", "language"))
    return C.chunk_files(both).select("file_path", "strategy", "symbol_name", "summary", "line_start")
