"""Queries of digests, reports, maintenance, registry, evaluation and change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import fixed, text
from corpuscle.operators import digest as D
from corpuscle.operators import maintenance as M
from corpuscle.sources import views
from corpuscle.streaming import changes

from . import search_queries as SQ
from .registry import query

FILES = "WITH " + views.FILES_SQL
T = views.table


def files(spark, d):
    return views.files(spark, d)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


PATH = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"
NAME = "string_split({p}, '/')[-1]"
SUFFIX = f"lower(regexp_extract({NAME}, '.(\\.[^.]*)$', 1))"


def page_paths(spark, d):
    return T(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))


LANGS = "CASE " + " ".join(f"WHEN x = '{s}' THEN '{lang}'" for s, lang in fixed.LANGUAGES.items()) + " END"


@query(f"SELECT page_id, {LANGS} AS language FROM (SELECT page_id, {SUFFIX.format(p=PATH)} AS x FROM pages)")
def language_by_suffix(spark, d):
    return page_paths(spark, d).select("page_id", text.language(F.col("path")).alias("language"))


MIXED = "CASE p_partkey % 7 WHEN 0 THEN concat('src/m', p_partkey, '.py') WHEN 1 THEN concat('node_modules/x', p_partkey, '.js') WHEN 2 THEN concat('docs/pic', p_partkey, '.png') WHEN 3 THEN concat('a/.hidden/f', p_partkey, '.py') WHEN 4 THEN concat('b/.env', p_partkey) WHEN 5 THEN 'README.md' ELSE concat('misc/f', p_partkey, '.txt') END"
WANTED = f"NOT list_has_any(string_split(regexp_replace(p, '/?[^/]*$', ''), '/'), {sql_list(fixed.SKIP_DIRS)}) AND NOT regexp_matches('/' || p, '/\\.[^/]+') AND NOT list_contains({sql_list(fixed.SKIP_SUFFIXES)}, {SUFFIX.format(p='p')})"


def mixed(spark, d):
    return T(spark, d, "part").selectExpr("p_partkey", f"{MIXED} AS p", "p_size % 9 = 0 AS recent")


@query(f"SELECT p_partkey, p FROM (SELECT p_partkey, {MIXED} AS p FROM part) WHERE {WANTED}")
def skip_filter(spark, d):
    return mixed(spark, d).where(M.is_wanted(F.col("p"))).select("p_partkey", "p")


@query(f"SELECT p_partkey, CASE WHEN {NAME.format(p='p')} IN ('CLAUDE.md', 'AGENTS.md', 'README.md', 'readme.md', 'CONTRIBUTING.md', 'ARCHITECTURE.md') THEN 0 WHEN recent THEN 1 WHEN list_has_any(string_split(p, '/'), ['src', 'app', 'lib']) THEN 2 ELSE 3 END AS priority FROM (SELECT p_partkey, {MIXED} AS p, p_size % 9 = 0 AS recent FROM part)")
def priority_order(spark, d):
    return mixed(spark, d).select("p_partkey", M.priority(F.col("p"), F.col("recent")).alias("priority")).orderBy("priority", "p_partkey")


@query("SELECT doc_id, sha256(text)[1:16] AS file_hash FROM documents WHERE strlen(text) BETWEEN 1 AND 100000 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def scan_clean_hash(spark, d):
    from corpuscle.operators.chunking import clean

    rows = clean(T(spark, d, "documents").select("doc_id", F.col("text").alias("content")))
    return rows.select("doc_id", M.short_hash_of_bytes(F.col("content").cast("binary")).alias("file_hash"))


ENV = "CASE WHEN p_partkey % 50 = 0 THEN concat('proj', p_partkey % 6, '/env/pyvenv.cfg') WHEN p_partkey % 3 = 0 THEN concat('proj', p_partkey % 12, '/env/lib/m', p_partkey, '.py') ELSE concat('proj', p_partkey % 12, '/src/m', p_partkey, '.py') END"


@query(f"WITH f AS (SELECT {ENV} AS file_path FROM part), e AS (SELECT DISTINCT regexp_replace(file_path, '/[^/]*$', '') AS env FROM f WHERE file_path LIKE '%/pyvenv.cfg') SELECT file_path FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE starts_with(f.file_path, e.env || '/'))")
def venv_marker_antijoin(spark, d):
    return M.outside_environments(T(spark, d, "part").selectExpr(f"{ENV} AS file_path"))


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 49) ON o_orderkey = l_orderkey")
def recent_file_semijoin(spark, d):
    recent = T(spark, d, "lineitem").where("l_quantity >= 49").select("l_orderkey").distinct()
    return T(spark, d, "orders").join(recent, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT conv_id, turn, md5(text) AS hash FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC LIMIT 5))")
def history_scan(spark, d):
    c = T(spark, d, "conversations")
    last = c.select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(5)
    return c.where("role = 'assistant'").join(F.broadcast(last), "conv_id", "left_semi").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("hash"))


INS = "(?i)(" + "|".join(["tion", "the"]) + ")"


@query(
    f"WITH e AS (SELECT * FROM conversations WHERE role = 'assistant' AND length(text) >= 200 AND regexp_matches(text, '{INS}')), k AS (SELECT *, row_number() OVER (PARTITION BY md5(text[1:500]) ORDER BY conv_id, turn) AS r FROM e) "
    f"SELECT conv_id, turn, trim(coalesce(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '{INS}') AND length(p) > 100)[1], text[1:500]))[1:1000] AS content FROM k WHERE r = 1"
)
def insight_mining(spark, d):
    return D.mine_insights(T(spark, d, "conversations"), INS, 200, "\n").select("conv_id", "turn", "content")


TAG_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{t}' END" for t, p in fixed.TAGS.items()) + "], lambda x: x IS NOT NULL)[1:5], ',')"


@query(f"SELECT conv_id, turn, {TAG_SQL} AS tags FROM conversations")
def insight_tags(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", F.array_join(D.tags(F.col("text")), ",").alias("tags"))


@query("SELECT sha256('insight:' || role || ':0:' || md5(text)[1:8])[1:16] AS chunk_id, text[1:120] AS summary, role || ', turn' AS symbol_name FROM conversations")
def insight_chunks(spark, d):
    from corpuscle.operators.chunking import insight_chunk

    rows = T(spark, d, "conversations").select(F.col("role").alias("repo_id"), F.col("text").alias("content"), F.array("role", F.lit("turn")).alias("tags"))
    return insight_chunk(rows).select("chunk_id", "summary", "symbol_name")


@query("SELECT substr(sha256(regexp_replace(lower('HTTPS://' || split_part(url, '/', 3) || '/org/repo.git'), '(\\.git)?/?$', '')), 1, 12) AS repo_id, count(*) AS pages FROM pages GROUP BY 1")
def repo_identity(spark, d):
    remote = F.concat(F.lit("HTTPS://"), F.split("url", "/")[2], F.lit("/org/repo.git"))
    return T(spark, d, "pages").groupBy(M.repo_id(remote).alias("repo_id")).agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'files', count(DISTINCT source || lang) FROM documents UNION ALL SELECT 'tokens', sum(length(text) // 4)::BIGINT FROM documents")
def counts(spark, d):
    docs = T(spark, d, "documents")
    one = lambda df, name, c: df.agg(F.lit(name).alias("name"), c.cast("long").alias("n"))
    n = F.count(F.lit(1))
    return one(docs, "documents", n).union(one(T(spark, d, "pages"), "pages", n)).union(one(docs, "files", F.count_distinct("source", "lang"))).union(one(docs, "tokens", F.sum(F.floor(F.length("text") / 4))))


@query("SELECT max(CASE WHEN doc_id = 17 THEN sha256(text)[1:16] END) AS file_hash FROM documents WHERE doc_id = 17")
def lookup_hash(spark, d):
    return T(spark, d, "documents").where("doc_id = 17").agg(F.any_value(M.short_hash_of_bytes(F.col("text").cast("binary"))).alias("file_hash"))


@query("SELECT DISTINCT source || '/' || lang AS folder FROM documents")
def distinct_paths(spark, d):
    return T(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("folder")).distinct()


KEYS = "|".join(fixed.SECURITY)


@query(f"SELECT page_id, regexp_matches(lower(url), '{KEYS}') AS sensitive FROM pages")
def keyword_flags(spark, d):
    return T(spark, d, "pages").select("page_id", text.is_sensitive(F.col("url")).alias("sensitive"))


@query("WITH h AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) || [url]) AS u FROM pages) SELECT u FROM h WHERE u <> '' AND (NOT starts_with(u, 'http') OR contains(lower(u), 'api')) AND NOT regexp_matches(u, '\\.js|\\.css|\\.png|\\.svg|localhost')")
def url_noise(spark, d):
    from corpuscle.operators.contracts import is_url_of_interest

    u = T(spark, d, "pages").select(F.explode(F.concat(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), F.array("url"))).alias("u")).distinct()
    return u.where(is_url_of_interest(F.col("u")))


TYPES = "CASE p_partkey % 5 WHEN 0 THEN concat('Test', p_brand) WHEN 1 THEN '_Private' WHEN 2 THEN 'BaseModel' ELSE concat('Part', p_type) END"


@query(f"SELECT n, count(*) AS c FROM (SELECT {TYPES} AS n FROM part) WHERE n NOT LIKE 'Test%' AND n[1] <> '_' AND n NOT IN ('BaseModel', 'Base', 'Meta', 'Config') GROUP BY n")
def type_name_filter(spark, d):
    from corpuscle.operators.contracts import is_type_name

    return T(spark, d, "part").selectExpr(f"{TYPES} AS n").where(is_type_name(F.col("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("c"))


@query("SELECT p, count(*) AS n FROM (SELECT CASE WHEN turn = 0 THEN '__commits__' ELSE role || '/x' END AS p FROM conversations) WHERE NOT starts_with(p, '__') GROUP BY p")
def pseudo_path_filter(spark, d):
    p = T(spark, d, "conversations").selectExpr("CASE WHEN turn = 0 THEN '__commits__' ELSE concat(role, '/x') END AS p")
    return p.where(~F.startswith("p", F.lit("__"))).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ') || ['a1', '9x', p_brand]) AS w FROM part), k AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS w FROM part) SELECT w FROM w SEMI JOIN k USING (w) WHERE regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]{2,}$')")
def identifier_gate(spark, d):
    p = T(spark, d, "part")
    w = p.select(F.explode(F.concat(F.split("p_name", " "), F.array(F.lit("a1"), F.lit("9x"), F.col("p_brand")))).alias("w")).distinct()
    return w.where(F.col("w").rlike("^[A-Za-z_][A-Za-z0-9_]{2,}$")).join(p.select(F.split("p_name", " ")[0].alias("w")).distinct(), "w", "left_semi")


OLD = "SELECT source || '/' || doc_id AS file_path, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(text)[1:16] END AS file_hash FROM documents WHERE doc_id % 7 <> 0"
NEW = "SELECT source || '/' || doc_id AS file_path, sha256(text)[1:16] AS file_hash FROM documents WHERE doc_id % 13 <> 0"


def versions(spark, d):
    docs = T(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("file_path"), M.short_hash_of_bytes(F.col("text").cast("binary")).alias("file_hash"))
    old = docs.where("doc_id % 7 <> 0").withColumn("file_hash", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("file_hash")))
    return old.drop("doc_id"), docs.where("doc_id % 13 <> 0").drop("doc_id")


@query(f"SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'removed' WHEN o.file_hash <> n.file_hash THEN 'updated' ELSE 'unchanged' END AS status FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.file_path = n.file_path")
def snapshot_diff(spark, d):
    return M.snapshot_diff(*versions(spark, d))


COUNTED = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in {"added": "o.file_path IS NULL", "updated": "o.file_hash <> n.file_hash", "removed": "n.file_path IS NULL", "unchanged": "o.file_hash = n.file_hash"}.items())


@query(f"SELECT {COUNTED} FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.file_path = n.file_path")
def reconcile_counts(spark, d):
    return M.reconcile_counts(M.snapshot_diff(*versions(spark, d)))


@query(f"SELECT file_path FROM ({OLD}) EXCEPT SELECT file_path FROM ({NEW})")
def path_set_diff(spark, d):
    old, new = versions(spark, d)
    return old.select("file_path").join(new.select("file_path"), "file_path", "left_anti")


@query(f"SELECT file_path, file_hash FROM ({NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({OLD}) o WHERE o.file_path = n.file_path AND o.file_hash = n.file_hash)")
def hash_skip(spark, d):
    old, new = versions(spark, d)
    return M.changed_files(new, old)


@query("SELECT file_path, file_hash FROM (" + OLD + ") WHERE file_path NOT IN (SELECT file_path FROM (" + NEW + ")) UNION ALL " + NEW)
def replace_per_file(spark, d):
    return M.replace_files(*versions(spark, d)).select("file_path", "file_hash")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS r FROM lineitem) WHERE r = 1")
def keep_last(spark, d):
    rows = views.placed(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "__file", "__at")
    rows = D.keep_last(rows, ["l_orderkey"], F.desc("l_linenumber"), "__file", "__at")  # of equal lines, the first in the table
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, v FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, v DESC) AS r FROM (SELECT c_custkey, c_acctbal AS v, 0 AS n FROM customer UNION ALL SELECT c_custkey, c_acctbal + 1, 1 FROM customer WHERE c_custkey % 3 = 0)) WHERE r = 1")
def upsert_keep_last(spark, d):
    c = T(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    return M.upsert(c, c.where("c_custkey % 3 = 0").withColumn("v", F.col("v") + 1), ["c_custkey"], "v")


EDGE = "SELECT CASE l_linenumber % 2 WHEN 0 THEN 'CALLS' ELSE 'INHERITS' END AS kind, 'f' || l_suppkey AS source_file, CASE WHEN l_linenumber % 2 = 1 THEN 's' || (l_partkey % 10) END AS source_symbol, 't' || (l_partkey % 5) AS target_symbol, l_orderkey * 10 + l_linenumber AS id FROM lineitem"


@query(f"SELECT kind, source_file, target_symbol, id FROM (SELECT *, row_number() OVER (PARTITION BY kind, source_file, source_symbol, target_symbol ORDER BY id) AS r FROM ({EDGE})) WHERE r = 1 OR source_symbol IS NULL")
def edge_keep_first(spark, d):
    e = T(spark, d, "lineitem").selectExpr("CASE l_linenumber % 2 WHEN 0 THEN 'CALLS' ELSE 'INHERITS' END AS kind", "concat('f', l_suppkey) AS source_file", "CASE WHEN l_linenumber % 2 = 1 THEN concat('s', l_partkey % 10) END AS source_symbol", "concat('t', l_partkey % 5) AS target_symbol", "l_orderkey * 10 + l_linenumber AS id")
    return M.keep_first_edges(e, "id").select("kind", "source_file", "target_symbol", "id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_id(spark, d):
    gone = T(spark, d, "labels").where("toxic = 1").select("doc_id")
    return T(spark, d, "documents").select("doc_id", "source").join(gone, "doc_id", "left_anti")


@query("SELECT r_name AS key, CASE WHEN r_regionkey < 2 THEN 'new' ELSE 'old' END AS value FROM region")
def meta_upsert(spark, d):
    r = T(spark, d, "region").select(F.col("r_name").alias("key"), "r_regionkey")
    return M.upsert(r.withColumn("value", F.lit("old")), r.where("r_regionkey < 2").withColumn("value", F.lit("new")), ["key"], "r_regionkey").select("key", "value")


@query("SELECT source AS repo_id, count(*) AS chunk_count, count(DISTINCT lang) AS file_count, max(1700000000 + doc_id * 60) AS last_indexed FROM documents GROUP BY source")
def repo_stats(spark, d):
    return T(spark, d, "documents").groupBy(F.col("source").alias("repo_id")).agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("lang").alias("file_count"), F.max(1700000000 + F.col("doc_id") * 60).alias("last_indexed"))


@query("SELECT r_name AS name, array_to_string(list_sort(list(n_name) FILTER (n_name <> 'NATION_3')), ',') AS repos FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def repo_cascade(spark, d):
    return M.drop_repo(workspaces(spark, d), "NATION_3").select("name", F.array_join(F.array_sort("repo_ids"), ",").alias("repos"))


def workspaces(spark, d):
    n = T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("name")).agg(F.array_sort(F.collect_list("n_name")).alias("repo_ids"))


@query("SELECT r_name AS name, n_name AS repo FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY 1, 2")
def workspace_explode(spark, d):
    return workspaces(spark, d).select("name", F.explode("repo_ids").alias("repo")).orderBy("name", "repo")


@query("SELECT n_name AS repo_id, array_to_string(list_sort(list_distinct(['/a/' || n_name, '/b/' || n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN '/c/x' ELSE '/a/' || n_name END])), ',') AS paths FROM nation")
def register_paths(spark, d):
    n = T(spark, d, "nation")
    old = n.select(F.col("n_name").alias("repo_id"), F.array(F.concat(F.lit("/a/"), "n_name"), F.concat(F.lit("/b/"), "n_regionkey")).alias("local_paths"))
    new = n.select(F.col("n_name").alias("repo_id"), F.array(F.when(F.col("n_nationkey") % 2 == 0, "/c/x").otherwise(F.concat(F.lit("/a/"), "n_name"))).alias("local_paths"))
    return M.register(old, new).select("repo_id", F.array_join("local_paths", ",").alias("paths"))


def places(spark, d):
    n = T(spark, d, "nation").select(F.col("n_name").alias("repo_id"), F.concat(F.lit("/home/r"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name").alias("local_path"))
    asked = T(spark, d, "customer").selectExpr("CASE c_custkey % 3 WHEN 0 THEN concat('/home/r', c_nationkey % 5, '/NATION_', c_nationkey) WHEN 1 THEN concat('/home/r', c_nationkey % 5, '/NATION_', c_nationkey, '/src/c', c_custkey) ELSE concat('/tmp/c', c_custkey) END AS path")
    return n, asked.distinct()


PLACES = "WITH r AS (SELECT n_name AS repo_id, '/home/r' || n_regionkey || '/' || n_name AS root FROM nation), a AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN concat('/home/r', c_nationkey % 5, '/NATION_', c_nationkey) WHEN 1 THEN concat('/home/r', c_nationkey % 5, '/NATION_', c_nationkey, '/src/c', c_custkey) ELSE concat('/tmp/c', c_custkey) END AS path FROM customer)"


@query(f"{PLACES} SELECT path, root FROM a JOIN r ON path = root OR starts_with(path, root || '/')")
def prefix_match(spark, d):
    n, asked = places(spark, d)
    return M.prefix_match(asked, n.select(F.col("local_path").alias("root"))).select("path", "root")


@query(f"{PLACES}, ws AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT path, repo_id, r_name AS workspace, CASE WHEN repo_id IS NULL THEN 'unindexed' WHEN path = root AND r_name IS NOT NULL THEN 'workspace' ELSE 'repo' END AS status FROM a LEFT JOIN r ON path = root OR starts_with(path, root || '/') LEFT JOIN ws ON n_name = repo_id")
def context_resolution(spark, d):
    n, asked = places(spark, d)
    return M.resolve_context(asked, n, workspaces(spark, d))


ORGS = "SELECT s_suppkey AS repo_id, CASE WHEN s_suppkey % 2 = 0 THEN 'git@host:org' || (s_nationkey % 5) || '/r.git' ELSE 'https://host/org' || (s_nationkey % 5) || '/r' || s_suppkey END AS remote, '/p' || (s_suppkey % 40) || '/r' || s_suppkey AS path FROM supplier"


@query(f"WITH o AS (SELECT repo_id, 'org' || regexp_extract(remote, 'org(\\d+)/', 1) AS org, regexp_replace(path, '/[^/]*$', '') AS par FROM ({ORGS})) SELECT DISTINCT x.repo_id AS a, y.repo_id AS b FROM o x JOIN o y ON x.repo_id < y.repo_id AND (x.org = y.org OR x.par = y.par)")
def org_pairs(spark, d):
    s = T(spark, d, "supplier").selectExpr("s_suppkey AS repo_id", "CASE WHEN s_suppkey % 2 = 0 THEN concat('git@host:org', s_nationkey % 5, '/r.git') ELSE concat('https://host/org', s_nationkey % 5, '/r', s_suppkey) END AS remote", "concat('/p', s_suppkey % 40, '/r', s_suppkey) AS local_path")
    return M.related_repos(s)


def module_sql(p: str) -> str:
    parts = f"string_split({p}, '/')"
    out = f"CASE WHEN len({parts}) > 1 THEN {parts}[-2] ELSE '_root' END"
    for root in ("packages", "lib", "src", "app"):
        at = f"list_position({parts}, '{root}')"
        out = f"CASE WHEN {at} > 0 THEN CASE WHEN len({parts}) - {at} <= 1 THEN '{root}' ELSE array_to_string({parts}[{at} + 1 : len({parts}) - 1], '/') END ELSE {out} END"
    return out


def code_modules(spark, d):
    return views.code(spark, d).withColumn("summary", F.substring("content", 1, 40))


@query(f"WITH {views.CODE_SQL}, m AS (SELECT *, {module_sql('file_path')} AS module, content[1:40] AS summary FROM code) SELECT module, count(DISTINCT file_path) AS files, max_by(summary, (length(summary), summary)) AS description, sum(length(content) // 4)::BIGINT AS tokens, count(*) AS chunks FROM m GROUP BY module")
def module_digest(spark, d):
    return D.modules(code_modules(spark, d)).withColumn("files", F.size("files").cast("long"))


@query(f"WITH {views.CODE_SQL}, m AS (SELECT DISTINCT file_path, {module_sql('file_path')} AS module FROM code) SELECT module, array_to_string(list_sort(list(file_path)), ',') AS files FROM m GROUP BY module")
def module_collect(spark, d):
    return D.modules(code_modules(spark, d)).select("module", F.array_join("files", ",").alias("files"))


@query(f"WITH {views.CODE_SQL}, m AS (SELECT *, {module_sql('file_path')} AS module FROM code) SELECT module, count(*) AS members FROM m GROUP BY module")
def module_membership(spark, d):
    rows = views.code(spark, d).withColumn("module", text.module_of(F.col("file_path")))
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("members"))


STACKED = "'We use ' || CASE doc_id % 4 WHEN 0 THEN 'redis and FASTAPI' WHEN 1 THEN 'Next.js, react' WHEN 2 THEN 'kafka' ELSE 'nothing' END"
STACK_SQL = "array_to_string(list_sort(list_filter(" + sql_list(fixed.STACK) + ", lambda k: contains(lower(s), lower(k)))), ', ')"


@query(f"SELECT doc_id, {STACK_SQL} AS stack FROM (SELECT doc_id, {STACKED} || text AS s FROM documents)")
def stack_keywords(spark, d):
    s = T(spark, d, "documents").select("doc_id", F.concat(F.lit("We use "), F.expr("CASE doc_id % 4 WHEN 0 THEN 'redis and FASTAPI' WHEN 1 THEN 'Next.js, react' WHEN 2 THEN 'kafka' ELSE 'nothing' END"), "text").alias("s"))
    return s.select("doc_id", D.stack(F.col("s")).alias("stack"))


@query(f"SELECT k AS tech, count(*) AS docs FROM (SELECT unnest({sql_list(fixed.STACK)}) AS k) JOIN (SELECT lower({STACKED} || text) AS s FROM documents) ON contains(s, lower(k)) GROUP BY k")
def stack_scan(spark, d):
    s = T(spark, d, "documents").select(F.concat(F.lit("We use "), F.expr("CASE doc_id % 4 WHEN 0 THEN 'redis and FASTAPI' WHEN 1 THEN 'Next.js, react' WHEN 2 THEN 'kafka' ELSE 'nothing' END"), "text").alias("s"))
    return s.select(F.explode(F.split(D.stack(F.col("s")), ", ")).alias("tech")).where("tech <> ''").groupBy("tech").agg(F.count(F.lit(1)).alias("docs"))


PARA = "coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(ltrim(regexp_replace(trim(p), '^#+', '')))), lambda p: length(p) > {n})[1][1:200], '')"


@query(f"SELECT doc_id, {PARA.format(n=50)} AS description FROM documents")
def description(spark, d):
    return T(spark, d, "documents").select("doc_id", D.first_paragraph(F.col("text"), 50, "\n").alias("description"))


@query(f"SELECT doc_id, length({PARA.format(n=30)}) AS n FROM documents")
def first_paragraph(spark, d):
    return T(spark, d, "documents").select("doc_id", F.length(D.first_paragraph(F.col("text"), 30, "\n")).cast("long").alias("n"))


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def first_n_per_group(spark, d):
    return D.first_n(T(spark, d, "documents"), "source", 5, F.desc("n_chars"), "doc_id").select("source", "doc_id")


@query(SQ.bm25_sql(["the", "la"], "SELECT repo_id, lang, count(*) - 1 AS more FROM (SELECT repo_id, string_split(file_path, '/')[2] AS lang FROM rk) GROUP BY ALL"))
def more_in_file(spark, d):
    from corpuscle.operators import search as S

    hits = S.bm25(SQ.chunks(spark, d), "the la", None).withColumn("file_path", F.split("file_path", "/")[1]).withColumn("final_score", F.col("bm25_score"))
    return S.best_per_file(hits).select("repo_id", F.col("file_path").alias("lang"), F.col("more_in_file").alias("more"))


@query("WITH h AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, n, greatest(1, round_even(n / max(n) OVER () * 20, 0)::INT) AS bar FROM h")
def overview(spark, d):
    h = T(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return D.bars(h, "n")


@query("SELECT page_id, array_to_string(string_split(" + PATH + ", '/')[-3:], '/') AS short FROM pages")
def short_paths(spark, d):
    return page_paths(spark, d).select("page_id", D.short_path(F.col("path")).alias("short"))


@query("SELECT conv_id, turn FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 20")
def newest_n(spark, d):
    return T(spark, d, "conversations").orderBy(F.desc("conv_id"), F.desc("turn")).limit(20).select("conv_id", "turn")


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) SELECT w, count(*) AS n FROM w GROUP BY w ORDER BY n DESC, w LIMIT 10")
def most_common(spark, d):
    w = T(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(10)


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation ORDER BY name")
def name_order(spark, d):
    return T(spark, d, "region").select(F.col("r_name").alias("name")).unionByName(T(spark, d, "nation").select(F.col("n_name").alias("name"))).orderBy("name")


@query("SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars, source, doc_id) AS rank FROM documents ORDER BY n_chars, source, doc_id LIMIT 100")
def sort_stable(spark, d):
    from pyspark.sql import Window

    top = T(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy("n_chars", "source", "doc_id").limit(100)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("n_chars", "source", "doc_id")))


@query("SELECT source AS repo_id, doc_id AS id FROM documents UNION ALL SELECT 'pages', page_id FROM pages")
def cross_repo_union(spark, d):
    return T(spark, d, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").alias("id")).unionByName(T(spark, d, "pages").select(F.lit("pages").alias("repo_id"), F.col("page_id").alias("id")))


@query("SELECT item_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_position(w, z[1]) = z[2]), lambda z: z[1]), ' ') AS words FROM (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark)")
def ordered_dedupe(spark, d):
    return T(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


FOUND = "SELECT s_suppkey % 20 AS query, 1 + s_suppkey // 20 % 6 AS rank, (s_suppkey * 7 + s_nationkey) % 5 = 0 AS relevant, CASE WHEN s_suppkey % 20 < 8 THEN 'docs' ELSE 'infra' END AS category FROM supplier"


def found(spark, d):
    return T(spark, d, "supplier").selectExpr("s_suppkey % 20 AS query", "1 + (s_suppkey DIV 20) % 6 AS rank", "(s_suppkey * 7 + s_nationkey) % 5 = 0 AS relevant", "CASE WHEN s_suppkey % 20 < 8 THEN 'docs' ELSE 'infra' END AS category")


METRIC = "count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr"


@query(f"WITH f AS (SELECT query, any_value(category) AS category, min(CASE WHEN relevant THEN rank END) AS first FROM ({FOUND}) GROUP BY query) SELECT category, {METRIC} FROM f GROUP BY category")
def eval_metrics(spark, d):
    rows = found(spark, d)
    return D.metrics(D.ranks(rows).join(rows.select("query", "category").distinct(), "query"), "category")


@query("WITH q AS (SELECT c_custkey % 40 AS query, c_mktsegment AS source, min(c_acctbal) AS score FROM customer GROUP BY ALL) SELECT query, min_by(source, (score, source)) AS routed FROM q GROUP BY query")
def routing_accuracy(spark, d):
    q = T(spark, d, "customer").groupBy((F.col("c_custkey") % 40).alias("query"), F.col("c_mktsegment").alias("source")).agg(F.min("c_acctbal").alias("score"))
    return D.best_source(q)


@query("WITH b AS (SELECT item_id, text AS p FROM benchmark) SELECT item_id, count(*) AS documents FROM b JOIN documents d ON contains(d.text, b.p) GROUP BY item_id")
def expected_hits(spark, d):
    b = T(spark, d, "benchmark").select("item_id", F.col("text").alias("p"))
    blocks = max(1, -(-b.count() // 1000))  # so many items are broadcast at a time
    docs, out = T(spark, d, "documents").select("text"), None
    for i in range(blocks):
        some = F.broadcast(b.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i))
        rows = docs.join(some, F.contains("text", F.col("p"))).select("item_id")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def change_events(spark, d):
    return T(spark, d, "events").selectExpr("concat('src/u', user_id, '.py') AS path", "ts", "CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'modified' END AS change")


GAP = "WITH e AS (SELECT 'src/u' || user_id || '.py' AS path, ts, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'modified' END AS change FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS st FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)), s AS (SELECT *, sum(st) OVER (PARTITION BY path ORDER BY ts) AS sid FROM g)"


@query(f"{GAP} SELECT path, max_by(change, (ts, change)) AS change, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY path, sid")
def debounce_sessions(spark, d):
    return changes.debounced(change_events(spark, d), "2 hours")


@query("SELECT 'src/u' || user_id || '.py' AS path, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY 1")
def watch_filter(spark, d):
    e = T(spark, d, "events").selectExpr("CASE WHEN user_id % 2 = 1 THEN concat('src/u', user_id, '.py') ELSE concat('.git/u', user_id) END AS path")
    return changes.watched(e).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


WORK = "w AS (SELECT r_name AS name, n_name AS repo_id FROM region JOIN nation ON n_regionkey = r_regionkey)"


@query(f"WITH {WORK}, m AS (SELECT repo_id, min(name) AS workspace FROM w GROUP BY repo_id) SELECT 's' || s_suppkey AS path, n_name AS repo_id, workspace FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN m ON m.repo_id = n_name")
def workspace_mappings(spark, d):
    paths = T(spark, d, "supplier").join(T(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.col("n_name").alias("repo_id"))
    return M.map_workspaces(paths, workspaces_of(spark, d)).select("path", "repo_id", "workspace")


def workspaces_of(spark, d):
    rows = T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("name")).agg(F.array_sort(F.collect_set("n_name")).alias("repo_ids"))


@query(f"WITH {WORK} SELECT repo_id, 'found' AS status FROM w WHERE name = 'ASIA' UNION ALL SELECT NULL, 'unknown workspace' WHERE NOT EXISTS (SELECT 1 FROM w WHERE name = 'ASIA')")
def search_targets(spark, d):
    repos = T(spark, d, "nation").select(F.col("n_name").alias("repo_id"), F.concat(F.lit("/x/"), "n_name").alias("local_path"))
    return M.search_targets(repos, workspaces_of(spark, d), workspace="ASIA")


@query("WITH c AS (SELECT source AS repo_id, count(DISTINCT lang) AS files, count(*) AS chunks FROM documents GROUP BY 1) SELECT repo_id, upper(repo_id) AS name, files, chunks FROM c")
def repo_list(spark, d):
    docs = T(spark, d, "documents")
    repos = docs.select(F.col("source").alias("repo_id")).distinct().withColumn("name", F.upper("repo_id"))
    return M.repo_list(repos, docs.select(F.col("source").alias("repo_id"), F.col("lang").alias("file_path")))


NAMED = "SELECT concat('f', p_partkey % 40) AS file_path, p_name AS qualified_name, p_partkey AS seq, p_size AS v FROM part"


@query(f"WITH o AS (SELECT * FROM ({NAMED}) WHERE seq % 2 = 0), n AS (SELECT * FROM ({NAMED}) WHERE seq % 2 = 1 AND file_path < 'f2'), b AS (SELECT *, 0 AS new FROM o WHERE file_path NOT IN (SELECT file_path FROM n) UNION ALL SELECT *, 1 FROM n) SELECT file_path, qualified_name, seq, v FROM b QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY new DESC, seq DESC) = 1")
def replace_nodes(spark, d):
    rows = T(spark, d, "part").selectExpr("concat('f', p_partkey % 40) AS file_path", "p_name AS qualified_name", "p_partkey AS seq", "p_size AS v")
    return M.replace_nodes(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1 AND file_path < 'f2'"), "seq")
