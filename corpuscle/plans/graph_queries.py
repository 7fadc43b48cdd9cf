"""Queries of look-ups, traversals, risk and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import fixed, text
from corpuscle.operators import contracts as K
from corpuscle.operators import graph as G
from corpuscle.operators import modules as M
from corpuscle.operators import search as S
from corpuscle.sources import views
from corpuscle.sources.scratch import cut

from . import code_queries as Q
from . import stored
from .corpus_queries import module_sql
from .registry import query

EDGES = (
    Q.LINES
    + f""", {Q.NODES}, edges AS (
    SELECT 'IMPORTS' AS kind, source_file, NULL::VARCHAR AS source_symbol, NULL::VARCHAR AS target_file, target_symbol, NULL::BIGINT AS line FROM ({Q.IMPORTS})
    UNION ALL SELECT 'INHERITS', source_file, source_symbol, NULL, target_symbol, line FROM ({Q.INHERITS})
    UNION ALL SELECT 'IMPLEMENTS', source_file, source_symbol, NULL, target_symbol, line FROM ({Q.IMPLEMENTS})
    UNION ALL SELECT 'CALLS', source_file, NULL, NULL, target_symbol, line FROM ({Q.CALLS})
    UNION ALL SELECT 'TESTED_BY', source_file, source_symbol, target_file, target_symbol, NULL FROM ({Q.TESTED})),
    nodes AS (SELECT qualified_name, kind, file_path, name, line_start, line_end FROM pyn UNION ALL SELECT qualified_name, kind, file_path, name, line_start, line_end FROM ({Q.GENERIC}))"""
)


def line():
    return F.coalesce("line", F.lit(0)).cast("long").alias("line")


def edges(spark, d):
    return stored.code(spark, d).table("edges")


def nodes(spark, d):
    return stored.code(spark, d).table("nodes")


def lookup(sql):
    return query(f"{EDGES} {sql}")


@lookup("SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edge_histogram(spark, d):
    return edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@lookup("SELECT kind, count(*) AS n, count(DISTINCT file_path) AS files FROM nodes GROUP BY kind")
def node_histogram(spark, d):
    return nodes(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("files"))


@lookup("SELECT file_path, count(*) AS n FROM nodes GROUP BY file_path ORDER BY n DESC, file_path LIMIT 10")
def top_files(spark, d):
    return nodes(spark, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").limit(10)


@lookup("SELECT target_symbol AS module, count(*) AS n FROM edges WHERE kind = 'IMPORTS' AND string_split(target_symbol, '.')[1] IN (SELECT DISTINCT string_split(file_path, '/')[1] FROM nodes) GROUP BY 1 ORDER BY n DESC, module LIMIT 8")
def hub_modules(spark, d):
    tops = nodes(spark, d).select(F.split("file_path", "/")[0].alias("top")).distinct()
    imp = edges(spark, d).where("kind = 'IMPORTS'").select(F.col("target_symbol").alias("module"), F.split("target_symbol", r"\.")[0].alias("top"))
    return imp.join(tops, "top", "left_semi").groupBy("module").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "module").limit(8)


DEPS = ", deps AS (SELECT DISTINCT string_split(source_file, '/')[2] AS src, string_split(target_symbol, '.')[2] AS dst FROM edges WHERE kind = 'IMPORTS' AND source_file LIKE 'app/%' AND target_symbol LIKE 'app.%')"


def deps(spark, d):
    imp = edges(spark, d).where("kind = 'IMPORTS' AND source_file LIKE 'app/%' AND target_symbol LIKE 'app.%'")
    return imp.select(F.split("source_file", "/")[1].alias("src"), F.split("target_symbol", r"\.")[1].alias("dst")).distinct()


def with_deps(sql):
    return query(f"{EDGES}{DEPS} {sql}")


@with_deps("SELECT src AS module, array_to_string(list_sort(list(dst)), ',') AS targets FROM deps GROUP BY src")
def module_arrows(spark, d):
    return deps(spark, d).groupBy(F.col("src").alias("module")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("targets"))


@with_deps("SELECT m.module, coalesce(a.n, 0) AS depends_on, coalesce(b.n, 0) AS imported_by FROM (SELECT src AS module FROM deps UNION SELECT dst FROM deps) m LEFT JOIN (SELECT src, count(*) AS n FROM deps GROUP BY src) a ON a.src = m.module LEFT JOIN (SELECT dst, count(*) AS n FROM deps GROUP BY dst) b ON b.dst = m.module")
def dep_sets(spark, d):
    x = deps(spark, d)
    both = x.select(F.col("src").alias("module"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(x.select(F.col("dst").alias("module"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("module").agg(F.sum("a").alias("depends_on"), F.sum("b").alias("imported_by")).select("module", F.col("depends_on").cast("long"), F.col("imported_by").cast("long"))


CHAINS = """, ch AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM deps x JOIN deps y ON x.dst = y.src WHERE x.src <> y.dst AND x.src <> x.dst AND y.src <> y.dst),
    al AS (SELECT 0 AS part, (SELECT count(*) FROM deps z WHERE z.src = ch.a) AS fan, a || ' -> ' || b || ' -> ' || c AS chain FROM ch
    UNION ALL SELECT 1, 0, src || ' -> ' || dst FROM deps WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM ch WHERE (ch.a = src AND ch.b = dst) OR (ch.b = src AND ch.c = dst)))"""


@query(f"{EDGES}{DEPS}{CHAINS} SELECT part, fan, chain FROM al ORDER BY part, fan DESC, chain LIMIT 25")
def dependency_chains(spark, d):
    return G.two_hop(deps(spark, d))


@query("WITH dp AS (SELECT DISTINCT c_nationkey % 5 AS src, c_nationkey % 7 + 5 AS dst FROM customer UNION SELECT DISTINCT s_nationkey % 7 + 5, s_nationkey % 5 + 20 FROM supplier), h AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM dp x JOIN dp y ON x.dst = y.src) SELECT a, c, count(*) AS via FROM h GROUP BY a, c")
def two_hop(spark, d):
    c, s = views.table(spark, d, "customer"), views.table(spark, d, "supplier")
    dp = c.selectExpr("c_nationkey % 5 AS src", "c_nationkey % 7 + 5 AS dst").union(s.selectExpr("s_nationkey % 7 + 5", "s_nationkey % 5 + 20")).distinct()
    x, y = dp.selectExpr("src AS a", "dst AS b"), dp.selectExpr("src AS b", "dst AS c")
    return x.join(y, "b").groupBy("a", "c").agg(F.count(F.lit(1)).alias("via"))


@lookup("SELECT qualified_name, line_start FROM nodes WHERE file_path = 'app/core/m8.py'")
def nodes_by_file(spark, d):
    return nodes(spark, d).where("file_path = 'app/core/m8.py'").select("qualified_name", F.col("line_start").cast("long").alias("line_start")).orderBy("line_start")


@lookup("SELECT * FROM nodes WHERE qualified_name = 'app/core/m8.py::Widget8.run' OR qualified_name LIKE 'app/auth/m49.py::%'")
def node_get(spark, d):
    n = nodes(spark, d).where("qualified_name = 'app/core/m8.py::Widget8.run' OR qualified_name LIKE 'app/auth/m49.py::%'")
    return n.select("qualified_name", "kind", "file_path", "name", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@lookup("SELECT qualified_name FROM nodes WHERE file_path LIKE 'app/core/%' AND line_start <= 12 AND line_end >= 10")
def lines_overlap(spark, d):
    return G.nodes_at_lines(nodes(spark, d).where("file_path LIKE 'app/core/%'"), 10, 12).select("qualified_name")


@lookup("SELECT kind, target_symbol, coalesce(line, 0) AS line FROM edges WHERE source_file = 'app/core/m8.py'")
def edges_from(spark, d):
    return edges(spark, d).where("source_file = 'app/core/m8.py'").select("kind", "target_symbol", line())


@lookup("SELECT kind, source_file, target_symbol FROM edges WHERE target_symbol ILIKE '%m1_7%' OR target_file ILIKE '%m1_7%'")
def edges_to(spark, d):
    return G.edges_to(edges(spark, d), "m1_7").select("kind", "source_file", "target_symbol")


@lookup("SELECT target_symbol FROM edges WHERE kind = 'IMPORTS' AND source_file = 'web/src/view2.ts'")
def file_imports(spark, d):
    return edges(spark, d).where("kind = 'IMPORTS' AND source_file = 'web/src/view2.ts'").select("target_symbol")


@lookup("SELECT source_file, target_symbol FROM edges WHERE kind = 'IMPORTS' AND target_symbol ILIKE '%core.m1%'")
def importers(spark, d):
    return G.importers(edges(spark, d), "core.m1").select("source_file", "target_symbol")


@lookup("SELECT source_file, target_symbol, line FROM edges WHERE kind = 'CALLS' AND target_symbol ILIKE '%widget12%'")
def callers(spark, d):
    return G.callers(edges(spark, d), "widget12").select("source_file", "target_symbol", line())


@lookup("SELECT source_symbol, target_symbol FROM edges WHERE kind = 'TESTED_BY' AND (source_file = 'tests/test_m10.py' OR target_file = 'tests/test_m10.py')")
def test_edges(spark, d):
    return G.test_edges(edges(spark, d), "tests/test_m10.py").select("source_symbol", "target_symbol")


@lookup("SELECT target_symbol AS module, count(*) AS call_files FROM (SELECT DISTINCT e.target_symbol, e.source_file FROM edges e JOIN nodes n ON e.target_symbol = n.name AND e.source_file <> n.file_path WHERE e.kind = 'CALLS') GROUP BY 1")
def external_callers(spark, d):
    e, n = edges(spark, d).where("kind = 'CALLS'"), nodes(spark, d).select(F.col("name").alias("target_symbol"), "file_path").distinct()
    return e.join(n, "target_symbol").where("source_file <> file_path").groupBy(F.col("target_symbol").alias("module")).agg(F.count_distinct("source_file").alias("call_files"))


@lookup(
    "SELECT n.file_path, count(*) AS importers FROM (SELECT DISTINCT file_path, unnest([dotted, regexp_replace(dotted, '^[^.]*\\.', '')]) AS name FROM (SELECT DISTINCT file_path, replace(regexp_replace(file_path, '\\.[^.]*$', ''), '/', '.') AS dotted FROM nodes)) n "
    "JOIN edges e ON e.kind = 'IMPORTS' AND e.target_symbol = n.name GROUP BY 1"
)
def module_importers(spark, d):
    return M.module_importers(edges(spark, d), nodes(spark, d).select("file_path"))


MODULES = f""", im AS (SELECT row_number() OVER () AS id, source_file, target_symbol LIKE './%' AS rel, CASE WHEN target_symbol LIKE './%' THEN string_split(source_file, '/')[:-2] || string_split(target_symbol[3:], '/') WHEN contains(target_symbol, '/') THEN string_split(target_symbol, '/') ELSE string_split(target_symbol, '.') END AS p FROM edges WHERE kind = 'IMPORTS'),
    ak AS (SELECT id, source_file, rel, n, array_to_string(p[1:n], '.') AS name FROM (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM im)),
    fp AS (SELECT file_path, string_split(regexp_replace(file_path, '\\.[^./]*$', ''), '/') AS p FROM (SELECT DISTINCT file_path FROM code)),
    fn AS (SELECT name, min_by(file_path, (k, file_path)) AS file_path, min(k) AS k FROM (SELECT file_path, k, array_to_string(p[k + 1:], '.') AS name FROM (SELECT *, unnest(range(0, len(p))) AS k FROM fp) WHERE k <= 1 OR len(p) - k >= 2) GROUP BY name),
    rs AS (SELECT id, source_file, max_by(file_path, n) AS file_path FROM ak JOIN fn USING (name) WHERE (k = 0 OR NOT rel) AND file_path <> source_file GROUP BY id, source_file),
    mg AS (SELECT {module_sql('source_file')} AS src, {module_sql('file_path')} AS dst, source_file FROM rs)"""


@query(f"{EDGES}{MODULES} SELECT src, dst, count(*) AS imports, count(DISTINCT source_file) AS files FROM mg WHERE src <> dst GROUP BY src, dst")
def module_graph(spark, d):
    return M.module_graph(edges(spark, d), views.code(spark, d).select("file_path"))


@lookup(
    f"SELECT module, array_to_string(list(name ORDER BY r), ',') AS symbols FROM (SELECT module, name, row_number() OVER (PARTITION BY module ORDER BY place, name) AS r FROM (SELECT {module_sql('file_path')} AS module, name, min((file_path, line_start)) AS place FROM nodes GROUP BY ALL)) WHERE r <= 20 GROUP BY module"
)
def module_symbols(spark, d):
    return M.module_symbols(nodes(spark, d).drop("repo_id")).select("module", F.array_join("symbols", ",").alias("symbols"))


@query(f"{EDGES} SELECT kind, source_file, target_symbol, coalesce(line, 0) AS line, qualified_name FROM (SELECT e.*, n.qualified_name, e.line BETWEEN n.line_start AND n.line_end AS inside, bool_or(coalesce(e.line BETWEEN n.line_start AND n.line_end, false)) OVER (PARTITION BY e.source_file, e.kind, e.target_symbol, e.line) AS anyin FROM edges e JOIN nodes n ON e.source_file = n.file_path WHERE e.kind <> 'TESTED_BY') WHERE coalesce(inside, false) OR NOT anyin")
def point_in_interval(spark, d):
    return G.enclosing_nodes(edges(spark, d).where("kind <> 'TESTED_BY'"), nodes(spark, d)).select("kind", "source_file", "target_symbol", line(), "qualified_name")


RESOLVED = """, e AS (SELECT DISTINCT target_symbol, target_file FROM edges), f AS (SELECT *, string_split(target_symbol, '.')[-1] AS nm, lower(replace(target_symbol, '.', '/')) AS mp FROM e),
    s1 AS (SELECT target_symbol, target_file, qualified_name, 1 AS stage FROM f JOIN nodes n ON f.target_file = n.file_path AND f.nm = n.name),
    nr AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY qualified_name) AS r FROM nodes), s2 AS (SELECT target_symbol, target_file, qualified_name, 2 FROM f JOIN nr ON nr.name = f.nm AND r <= 3),
    lf AS (SELECT * FROM f WHERE (target_symbol, coalesce(target_file, '')) NOT IN (SELECT target_symbol, coalesce(target_file, '') FROM s1 UNION SELECT target_symbol, coalesce(target_file, '') FROM s2)),
    s3 AS (SELECT target_symbol, target_file, qualified_name, 3 FROM (SELECT lf.target_symbol, lf.target_file, n.qualified_name, row_number() OVER (PARTITION BY lf.target_symbol, lf.target_file ORDER BY n.qualified_name) AS r FROM lf JOIN nodes n ON contains(lower(n.file_path), lf.mp)) WHERE r <= 3),
    al AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), mn AS (SELECT *, min(stage) OVER (PARTITION BY target_symbol, target_file) AS lo FROM al)"""


@query(f"{EDGES}{RESOLVED} SELECT target_symbol, target_file, qualified_name, stage FROM mn WHERE stage = lo")
def resolve_targets(spark, d):
    e = cut(edges(spark, d).select("target_symbol", "target_file").distinct().withColumn("edge_id", F.xxhash64("target_symbol", "target_file")))
    return G.resolve_targets(e, nodes(spark, d)).join(e, "edge_id").select("target_symbol", "target_file", "qualified_name", "stage")


@query(f"{EDGES} SELECT DISTINCT e.target_symbol, n.file_path FROM edges e JOIN nodes n ON contains(lower(n.file_path), lower(replace(e.target_symbol, '.', '/'))) WHERE e.kind = 'IMPORTS'")
def import_path_join(spark, d):
    imp = edges(spark, d).where("kind = 'IMPORTS'").select("target_symbol", F.replace("target_symbol", F.lit("."), F.lit("/")).alias("p")).distinct()
    return G.substring_join(imp, nodes(spark, d).select("file_path").distinct(), "p", "file_path").select("target_symbol", "file_path").distinct()


@query(f"{EDGES} SELECT n.name, count(*) AS refs FROM (SELECT DISTINCT name FROM nodes) n JOIN edges e ON contains(lower(e.target_symbol), lower(n.name)) GROUP BY n.name")
def reverse_substring_join(spark, d):
    names = cut(nodes(spark, d).select("name").distinct(), "names")
    targets = cut(edges(spark, d).groupBy("target_symbol").agg(F.count(F.lit(1)).alias("n")), "targets")
    return G.substring_join(names, targets, "name", "target_symbol").groupBy("name").agg(F.sum("n").alias("refs"))


@query("WITH u AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS p FROM pages), h AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS h FROM pages) SELECT h FROM h WHERE length(h) > 1 AND NOT EXISTS (SELECT 1 FROM u WHERE contains(lower(u.p), lower(h.h)))")
def contains_antijoin(spark, d):
    p = views.table(spark, d, "pages")
    u = p.select(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("p")).distinct()
    h = p.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("h")).where("length(h) > 1").distinct()
    return h.join(G.substring_join(h, u, "h", "p").select("h").distinct(), "h", "left_anti")


REFS = f"""SELECT 'defined_in' AS category, file_path AS file, qualified_name AS symbol, line_start AS line FROM nodes WHERE name = 'Widget13'
    UNION ALL SELECT DISTINCT 'imported_by', source_file, NULL, 0::BIGINT FROM edges WHERE kind = 'IMPORTS' AND target_symbol ILIKE '%Widget13%'
    UNION ALL SELECT 'called_by', source_file, target_symbol, line FROM edges WHERE kind = 'CALLS' AND target_symbol ILIKE '%Widget13%'
    UNION ALL SELECT 'inherited_by', source_file, source_symbol, line FROM edges WHERE kind = 'INHERITS' AND target_symbol = 'Widget13'"""


@query(f"{EDGES}, kn AS ({REFS}) SELECT * FROM kn UNION ALL SELECT 'referenced_in', file_path, NULL, 0 FROM (SELECT DISTINCT file_path FROM code WHERE regexp_matches(lower(content), '(^|[^\\p{{L}}\\p{{N}}])widget13([^\\p{{L}}\\p{{N}}]|$)')) WHERE file_path NOT IN (SELECT file FROM kn)")
def references_cascade(spark, d):
    from corpuscle.operators.search import folded, phrase_count

    hits = views.code(spark, d).where(phrase_count(folded("content"), ["widget13"]) > 0)
    return G.references(edges(spark, d), nodes(spark, d), hits, "Widget13").select("category", "file", "symbol", line())


FK = "SELECT 'supplier:' || s_suppkey AS src, 'nation:' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders"


def fk_links(spark, d):
    t = lambda n, a, b, c, e: views.table(spark, d, n).select(F.concat(F.lit(a), b).alias("src"), F.concat(F.lit(c), e).alias("dst"))
    return t("supplier", "supplier:", "s_suppkey", "nation:", "s_nationkey").union(t("customer", "customer:", "c_custkey", "nation:", "c_nationkey")).union(t("nation", "nation:", "n_nationkey", "region:", "n_regionkey")).union(t("orders", "orders:", "o_orderkey", "customer:", "o_custkey"))


def walk_sql(links: str, seed: str, depth: int) -> str:
    return f"WITH RECURSIVE l AS ({links}), w(node, depth) AS (SELECT '{seed}', 0 UNION SELECT l.dst, w.depth + 1 FROM w JOIN l ON l.src = w.node WHERE w.depth < {depth}) SELECT node, min(depth) AS depth FROM w GROUP BY node"


@query(walk_sql(f"SELECT * FROM ({FK}) UNION ALL SELECT dst, src FROM ({FK})", "nation:3", 3))
def bfs_reachability(spark, d):
    links = fk_links(spark, d)
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return G.reachable(both, spark.createDataFrame([("nation:3",)], "node string"), 3)


PAGE_LINKS = "SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^/?#]*)', 1) AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages"


@query(walk_sql(f"SELECT * FROM ({PAGE_LINKS}) UNION ALL SELECT dst, src FROM ({PAGE_LINKS})", "/en", 2))
def bfs_file_level(spark, d):
    e = views.table(spark, d, "pages").select(F.regexp_extract("url", "^https?://[^/]+(/[^/?#]*)", 1).alias("source_file"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target_file"))
    links = e.select(F.col("source_file").alias("src"), F.col("target_file").alias("dst")).distinct()
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return G.reachable(both, spark.createDataFrame([("/en",)], "node string"), 2)


@query(
    f"{EDGES}, im AS (SELECT DISTINCT source_file, target_symbol, lower(replace(target_symbol, '.', '/')) AS mp FROM edges WHERE kind = 'IMPORTS'), fl AS (SELECT DISTINCT file_path FROM nodes), "
    "l1 AS (SELECT 1 AS depth, source_file AS parent, file_path AS child, target_symbol AS target FROM im LEFT JOIN fl ON contains(lower(file_path), mp) WHERE source_file = 'app/core/m1.py'), "
    "l2 AS (SELECT 2, source_file, file_path, target_symbol FROM im LEFT JOIN fl ON contains(lower(file_path), mp) WHERE source_file IN (SELECT child FROM l1 WHERE child <> 'app/core/m1.py')) SELECT * FROM l1 UNION ALL SELECT * FROM l2"
)
def trace_depth2(spark, d):
    return G.trace(edges(spark, d), nodes(spark, d), "app/core/m1.py", 2)


@query(f"{EDGES} SELECT 'imports' AS direction, target_symbol AS other FROM edges WHERE kind = 'IMPORTS' AND source_file = 'app/brands/m9.py' UNION ALL SELECT 'importers', source_file FROM edges WHERE kind = 'IMPORTS' AND target_symbol ILIKE '%brands.m9%'")
def trace_both(spark, d):
    e = edges(spark, d)
    out = e.where("kind = 'IMPORTS' AND source_file = 'app/brands/m9.py'").select(F.lit("imports").alias("direction"), F.col("target_symbol").alias("other"))
    return out.unionByName(G.importers(e, "brands.m9").select(F.lit("importers").alias("direction"), F.col("source_file").alias("other")))


def steps_sql(depth: int) -> str:
    """Levels z1 to z<depth> from z0: each symbol at its least distance, with the first direction and kind that reach it."""
    seen, out = "SELECT q FROM z0", ""
    for i in range(1, depth + 1):
        out += f", z{i} AS (SELECT dst AS q, {i} AS distance, min({{'d': direction, 'k': kind}}) AS m FROM cp JOIN z{i - 1} z ON cp.src = z.q WHERE dst NOT IN ({seen}) GROUP BY dst)"
        seen += f" UNION ALL SELECT q FROM z{i}"
    return out


WITHIN = "coalesce(e.line BETWEEN n.line_start AND n.line_end, false)"
IMPACT = f"""{RESOLVED}, sr AS (SELECT e.kind, e.target_symbol, e.target_file, n.qualified_name AS a, {WITHIN} AS inside, bool_or({WITHIN}) OVER (PARTITION BY e.source_file, e.kind, e.target_symbol, e.line) AS anyin FROM edges e JOIN nodes n ON e.source_file = n.file_path),
    pr AS (SELECT DISTINCT a, mn.qualified_name AS b, kind FROM sr JOIN mn ON sr.target_symbol = mn.target_symbol AND sr.target_file IS NOT DISTINCT FROM mn.target_file WHERE stage = lo AND (inside OR NOT anyin) AND a <> mn.qualified_name),
    lk AS (SELECT a AS src, b AS dst, kind, 'forward' AS direction FROM pr UNION SELECT b, a, kind, 'reverse' FROM pr), cp AS (SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY src, direction ORDER BY dst, kind) <= 5),
    z0 AS (SELECT DISTINCT qualified_name AS q FROM nodes WHERE file_path = 'app/core/m1.py'){steps_sql(3)},
    hit AS (SELECT qualified_name, file_path, distance, m.k AS via, m.d AS direction, file_path <> 'app/core/m1.py' AS is_new_file FROM (SELECT * FROM z1 UNION ALL SELECT * FROM z2 UNION ALL SELECT * FROM z3) JOIN nodes ON q = qualified_name ORDER BY distance, qualified_name LIMIT 50)"""


@query(f"{EDGES}{IMPACT} SELECT qualified_name, distance, via, direction, is_new_file FROM hit")
def impact_capped(spark, d):
    return G.impact(edges(spark, d), nodes(spark, d), "app/core/m1.py").select("qualified_name", "distance", "via", "direction", "is_new_file")


SENSITIVE = "regexp_matches(lower({c}), '" + "|".join(fixed.SECURITY) + "')"
RISKY = f"""SELECT s_suppkey, 1 + s_suppkey % 3 AS distance, s_suppkey % 2 = 0 AS tested, s_name || CASE WHEN s_suppkey % 5 = 0 THEN '/auth' ELSE '' END AS file_path, s_nationkey % 6 AS caller_files FROM supplier"""
RISK = f"SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.3::DOUBLE - (distance - 1) * 0.1::DOUBLE) + CASE WHEN tested THEN 0 ELSE 0.25 END::DOUBLE + CASE WHEN {SENSITIVE.format(c='file_path')} THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN caller_files > 3 THEN 0.15 WHEN caller_files > 1 THEN 0.05 ELSE 0 END::DOUBLE) AS risk FROM ({RISKY})"


def risky(spark, d):
    s = views.table(spark, d, "supplier").selectExpr("s_suppkey", "1 + s_suppkey % 3 AS distance", "s_suppkey % 2 = 0 AS tested", "concat(s_name, CASE WHEN s_suppkey % 5 = 0 THEN '/auth' ELSE '' END) AS file_path", "s_nationkey % 6 AS caller_files")
    return s.withColumn("risk", G.item_risk(F.col("distance"), F.col("tested"), text.is_sensitive(F.col("file_path")), F.col("caller_files")))


@query(f"SELECT s_suppkey, file_path, round(risk, 2) AS risk FROM ({RISK})")
def impact_risk(spark, d):
    return risky(spark, d).select("s_suppkey", "file_path", F.round("risk", 2).alias("risk"))


@query(f"SELECT s_suppkey, distance, round(risk, 2) AS risk FROM ({RISK}) ORDER BY round(risk, 2) DESC, distance, s_suppkey LIMIT 25")
def impact_sort(spark, d):
    return risky(spark, d).select("s_suppkey", "distance", F.round("risk", 2).alias("risk")).orderBy(F.desc("risk"), "distance", "s_suppkey").limit(25)


ROLL = f"SELECT count(*) AS affected, count(DISTINCT file_path) AS files, count(*) FILTER (NOT tested) AS untested, round(least(1.0, CASE WHEN count(*) >= 10 THEN 0.3 WHEN count(*) >= 5 THEN 0.2 WHEN count(*) >= 2 THEN 0.1 ELSE 0 END::DOUBLE + 0.25::DOUBLE + 0.25::DOUBLE * count(*) FILTER (NOT tested) / count(*) + 0.2::DOUBLE * max(risk)), 4) AS risk FROM ({RISK})"


@query(f"SELECT *, CASE WHEN risk > 0.7 THEN 'critical' WHEN risk > 0.5 THEN 'high' WHEN risk > 0.3 THEN 'medium' ELSE 'low' END AS level FROM ({ROLL})")
def overall_risk(spark, d):
    return G.overall_risk(risky(spark, d), text.is_sensitive(F.lit("app/auth/service.py"))).withColumn("risk", F.round("risk", 4))


@query(f"SELECT distance, count(*) AS affected, count(DISTINCT file_path) AS files, count(*) FILTER (NOT tested) AS untested, round(max(risk), 4) AS max_risk FROM ({RISK}) GROUP BY distance")
def impact_rollup(spark, d):
    return risky(spark, d).groupBy("distance").agg(F.count(F.lit(1)).alias("affected"), F.count_distinct("file_path").alias("files"), F.count_if(~F.col("tested")).alias("untested"), F.round(F.max("risk"), 4).alias("max_risk"))


@query("SELECT l_partkey, CASE WHEN count(DISTINCT l_suppkey) > 3 THEN 0.15 WHEN count(DISTINCT l_suppkey) > 1 THEN 0.05 ELSE 0 END::DOUBLE AS bonus FROM lineitem GROUP BY l_partkey")
def caller_bonus(spark, d):
    n = F.count_distinct("l_suppkey")
    return views.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.when(n > 3, 0.15).when(n > 1, 0.05).otherwise(0.0).alias("bonus"))


ENDS = f"{Q.LINES}, en AS (SELECT repo_id, file_path, line, upper(regexp_extract(s, '@router\\.(get|post)\\(\"([^\"]+)', 1)) AS method, regexp_extract(s, '@router\\.(get|post)\\(\"([^\"]+)', 2) AS path, regexp_extract(lead(s) OVER (PARTITION BY file_path ORDER BY line), 'def\\s+(\\w+)', 1) AS handler, lead(s) OVER (PARTITION BY file_path ORDER BY line) AS sig FROM ls WHERE contains(lower(file_path), 'route') QUALIFY contains(s, '@router'))"


@query(f"{ENDS} SELECT file_path, method, path, line, handler, nullif(regexp_extract(sig, ':\\s*([A-Z]\\w+(?:Response|Request|Create|Update|Schema))', 1), '') AS request_schema FROM en")
def endpoints(spark, d):
    return K.endpoints(views.code(spark, d)).select("file_path", "method", "path", line(), "handler", "request_schema")


USES = f"us AS (SELECT repo_id, file_path, line, regexp_extract(s, 'fetch\\(\"([^\"]+)\"', 1) AS url, NULL::VARCHAR AS method FROM ls WHERE contains(s, 'fetch(') UNION ALL SELECT repo_id, file_path, line, regexp_extract(s, '\\.(post)\\(\"([^\"]+)\"', 2), 'POST' FROM ls WHERE contains(s, 'client.post(') UNION ALL SELECT repo_id, file_path, line, regexp_extract(s, '@router\\.(get|post)\\(\"([^\"]+)', 2), upper(regexp_extract(s, '@router\\.(get|post)', 1)) FROM ls WHERE contains(s, '@router.'))"


@query(f"{ENDS}, {USES} SELECT file_path, line, url, method FROM us")
def consumers(spark, d):
    return K.consumers(views.code(spark, d)).select("file_path", line(), "url", "method")


SEG = "list_filter(list_transform(string_split(string_split(regexp_replace({c}, 'https?://[^/]+', ''), '?')[1], '/'), lambda x: lower(replace(trim(x), '_', '-'))), lambda x: x NOT IN ('', 'api', 'v1', 'v2', 'v3') AND x[1] NOT IN ('{{', '$', ':'))"


@query(
    f"{ENDS}, {USES}, a AS (SELECT repo_id, method, path, {SEG.format(c='path')} AS sg FROM en), b AS (SELECT repo_id, url, method, {SEG.format(c='url')} AS sg FROM us) "
    "SELECT a.path, b.url, count(*) AS n FROM a JOIN b ON list_has_any(a.sg, b.sg) AND (b.method IS NULL OR b.method = a.method) GROUP BY a.path, b.url"
)
def contract_match(spark, d):
    c = views.code(spark, d)
    return K.contract_counts(K.endpoints(c), K.consumers(c))


@query("WITH u AS (SELECT page_id, " + SEG.format(c="string_split(url, '#')[1]") + " AS s FROM pages), h AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages), g AS (SELECT href, " + SEG.format(c="href") + " AS s FROM h) SELECT u.page_id, g.href, len(list_intersect(list_distinct(u.s), list_distinct(g.s))) AS common FROM u JOIN g ON list_has_any(u.s, g.s)")
def segment_overlap_join(spark, d):
    p = views.table(spark, d, "pages")
    u = p.select("page_id", K.segments(F.split("url", "#")[0]).alias("l_seg"))
    g = p.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href")).distinct().select("href", K.segments(F.col("href")).alias("r_seg"))
    return G.overlap_join(u, g, "seg").select("page_id", "href", "common")


@query(f"{EDGES}, n AS (SELECT DISTINCT name, repo_id FROM pyn JOIN code USING (file_path) WHERE pyn.kind = 'class' AND name NOT LIKE 'Test%' AND name NOT LIKE '\\_%' ESCAPE '\\' AND name NOT IN ('BaseModel', 'Base', 'Meta', 'Config')), e AS (SELECT DISTINCT target_symbol AS name, repo_id FROM edges JOIN code ON source_file = file_path WHERE edges.kind = 'INHERITS') SELECT name, array_to_string(list_sort(list(DISTINCT repo_id)), ',') AS sources FROM (SELECT * FROM n UNION SELECT * FROM e) GROUP BY name HAVING count(DISTINCT repo_id) >= 2")
def shared_types(spark, d):
    n = nodes(spark, d).where("kind = 'class' AND file_path LIKE '%.py'").where(K.is_type_name(F.col("name"))).select("name", "repo_id")
    e = edges(spark, d).where("kind = 'INHERITS'").select(F.col("target_symbol").alias("name"), "repo_id")
    return K.shared_keys(n.unionByName(e), "name", "repo_id").select("name", F.array_join("sources", ",").alias("sources"))


@query("WITH t AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS k FROM documents) SELECT k, count(*) AS sources FROM t GROUP BY k HAVING count(*) >= 2")
def shared_keys(spark, d):
    words = views.table(spark, d, "documents").select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("k"))
    return K.shared_keys(words, "k", "source").select("k", F.size("sources").cast("long").alias("sources"))


@query(f"{ENDS} SELECT method, path, count(*) AS n FROM en WHERE file_path LIKE '%router_m3.py' OR NOT EXISTS (SELECT 1 FROM en WHERE file_path LIKE '%router_m3.py') GROUP BY ALL UNION ALL SELECT method, path, count(*) FROM en WHERE file_path LIKE '%nowhere.py' OR NOT EXISTS (SELECT 1 FROM en WHERE file_path LIKE '%nowhere.py') GROUP BY ALL")
def changed_file_fallback(spark, d):
    ends = K.endpoints(views.code(spark, d))
    count = lambda x: x.groupBy("method", "path").agg(F.count(F.lit(1)).alias("n"))
    return count(K.affected_endpoints(ends, "app/x/router_m3.py")).unionByName(count(K.affected_endpoints(ends, "nowhere.py")))


@query(f"{ENDS}, {USES}, a AS (SELECT DISTINCT repo_id, path, method, {SEG.format(c='path')} AS sg FROM en WHERE file_path LIKE '%router_m3.py'), b AS (SELECT repo_id, file_path, url, method, {SEG.format(c='url')} AS sg FROM us) SELECT b.repo_id, count(*) AS consumers FROM a JOIN b ON b.repo_id <> a.repo_id AND list_has_any(a.sg, b.sg) AND (b.method IS NULL OR b.method = a.method) GROUP BY b.repo_id")
def cross_project_impact(spark, d):
    c = views.code(spark, d)
    pairs = K.cross_project(K.endpoints(c), K.consumers(c), "router_m3.py")
    return pairs.groupBy(F.col("use_repo").alias("repo_id")).agg(F.count(F.lit(1)).alias("consumers"))


@lookup("SELECT file_path FROM (SELECT DISTINCT file_path FROM nodes WHERE contains(lower(file_path), 'core/m1') UNION SELECT DISTINCT file_path FROM code WHERE contains(lower(file_path), 'core/m1') AND NOT EXISTS (SELECT 1 FROM nodes WHERE contains(lower(file_path), 'core/m1'))) ORDER BY length(file_path), file_path LIMIT 5")
def file_match(spark, d):
    return S.file_match(nodes(spark, d), views.code(spark, d), "Core/M1")


REPORT = f""", fl AS (SELECT DISTINCT file_path, regexp_replace(string_split(file_path, '/')[-1], '(.)\\.[^.]*$', '\\1') AS st FROM hit), tp AS (SELECT DISTINCT unnest(regexp_split_to_array(target_symbol, '[./]')) AS part FROM edges WHERE kind = 'TESTED_BY'),
    cn AS (SELECT file_path, count(DISTINCT source_file) AS callers FROM fl JOIN edges ON edges.kind = 'CALLS' AND contains(lower(target_symbol), lower(st)) GROUP BY file_path),
    rp AS (SELECT qualified_name, hit.file_path, distance, direction, st IN (SELECT part FROM tp) AS tested, coalesce(callers, 0) AS callers FROM hit JOIN fl USING (file_path) LEFT JOIN cn USING (file_path)),
    rk AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.3::DOUBLE - (distance - 1) * 0.1::DOUBLE) + CASE WHEN tested THEN 0 ELSE 0.25 END::DOUBLE + CASE WHEN {SENSITIVE.format(c='file_path')} THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN callers > 3 THEN 0.15 WHEN callers > 1 THEN 0.05 ELSE 0 END::DOUBLE), 2) AS risk FROM rp)"""


@query(f"{EDGES}{IMPACT}{REPORT} SELECT *, CASE WHEN risk > 0.7 THEN 'critical' WHEN risk > 0.5 THEN 'high' WHEN risk > 0.3 THEN 'medium' ELSE 'low' END AS level FROM rk ORDER BY risk DESC, distance, qualified_name LIMIT 25")
def impact_report(spark, d):
    return G.impact_report(edges(spark, d), nodes(spark, d), "app/core/m1.py")
