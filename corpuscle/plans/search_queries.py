"""Queries of ranked and plain text search, over documents as chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import digest as D
from corpuscle.operators import search as S
from corpuscle.operators.index import buckets_for
from corpuscle.operators.segments import SegmentIndex
from corpuscle.sources import views
from corpuscle.sources.scratch import cut, new_folder

from . import stored
from .registry import query
from .stored import chunks

NOW = 1700003600.0 + 168 * 3600
SCORED = ["repo_id", "chunk_id", "file_path"]


CHUNKS = (
    views.FILES_SQL
    + """, chunks AS (SELECT *, sha256(file_path || ':0:' || symbol_name)[1:16] AS chunk_id,
    CASE WHEN doc_id % 10 = 0 THEN 'doc' WHEN doc_id % 15 = 1 THEN 'insight' ELSE 'code' END AS chunk_type FROM files)"""
)
TOK = r"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(terms: list[str], tail: str, some: str = "") -> str:
    fields = {"content": 1.0, "summary": 2.0, "symbol_name": 3.0, "file_path": 1.5}
    toks = ", ".join(f"{TOK.format(c=c)} AS t_{c}" for c in fields)
    freq = ", ".join("(" + " + ".join(f"len(list_filter(t_{c}, lambda z: z = '{t}')) * {w}" for c, w in fields.items()) + f")::DOUBLE AS f{i}" for i, t in enumerate(terms))
    dl = " + ".join(f"len(t_{c})" for c in fields)
    ns = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END"
    part = " + ".join(f"({idf(i)}) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(terms)))
    some = some or " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""WITH {CHUNKS}, tk AS (SELECT *, {toks} FROM chunks), fr AS (SELECT *, ({dl}) AS dl, {freq} FROM tk),
        st AS (SELECT repo_id, count(*) AS n, avg(dl) AS avgdl, {ns} FROM fr GROUP BY repo_id),
        sc AS (SELECT fr.*, -({part}) AS bm25_score FROM fr JOIN st USING (repo_id) WHERE {some}),
        rk AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY bm25_score, chunk_id) AS repo_rank FROM sc) {tail}"""


RANK = """, rr AS (SELECT *, bm25_score
        * CASE WHEN string_split(file_path, '/')[-1] IN ('CLAUDE.md', 'AGENTS.md', 'README.md', 'ARCHITECTURE.md') THEN 3.0 WHEN chunk_type = 'doc' THEN 1.5 WHEN chunk_type = 'insight' THEN 2.0 ELSE 1.0 END::DOUBLE
        * (1.0::DOUBLE + len(list_intersect(list_distinct(string_split(translate(lower(symbol_name), '_/.', '   '), ' ')), {q})) / {n}::DOUBLE)
        * CASE WHEN list_has_any(string_split(translate(lower(file_path), '/_.', '   '), ' '), {q}) THEN 1.5 ELSE 1.0 END::DOUBLE
        * CASE WHEN last_modified <> 0 AND ({now}::DOUBLE - last_modified::DOUBLE) / 3600 < 168 THEN 1.15 ELSE 1.0 END::DOUBLE AS final_score
        FROM rk WHERE repo_rank <= {per}),
        dd AS (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY final_score, chunk_id) AS fr_, count(*) OVER (PARTITION BY repo_id, file_path) - 1 AS more_in_file FROM rr),
        bb AS (SELECT *, row_number() OVER w AS rank, (sum(length(content) // 4) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS tokens_so_far FROM dd WHERE fr_ = 1 WINDOW w AS (ORDER BY final_score, chunk_id))"""


@query(bm25_sql(["token", "thing", "des"], "SELECT repo_id, chunk_id, file_path, round(bm25_score, 5) AS bm25_score FROM rk WHERE repo_rank <= 20 ORDER BY rk.bm25_score, chunk_id LIMIT 10"))
def text_bm25_topk(spark, d):
    rows = stored.texts(spark, d).bm25("token thing des", 20).orderBy("bm25_score", "chunk_id").limit(10)
    return rows.select(*SCORED, F.round("bm25_score", 5).alias("bm25_score"))


@query(
    bm25_sql(["token", "doc", "src3"], RANK.format(q="['token', 'doc', 'src3']", n=3, now=NOW, per=20))
    + " SELECT repo_id, chunk_id, file_path, round(final_score, 5) AS final_score, rank, tokens_so_far, more_in_file FROM bb WHERE rank <= 10 AND (rank = 1 OR tokens_so_far <= 6000)"
)
def text_rerank_dedupe_budget(spark, d):
    rows = stored.texts(spark, d).search("token doc src3", 10, 6000, NOW, expand=False, per_repo=20)
    return rows.select(*SCORED, F.round("final_score", 5).alias("final_score"), "rank", "tokens_so_far", "more_in_file")


@query(
    bm25_sql(["token", "auth", "des"], RANK.format(q="['token', 'des']", n=2, now=NOW, per=20))
    + " SELECT repo_id, chunk_id, round(final_score, 5) AS final_score, rank FROM bb WHERE rank <= 10 AND (rank = 1 OR tokens_so_far <= 999999)"
)
def text_synonym_search(spark, d):
    return stored.texts(spark, d).search("token des", 10, 999_999, NOW).select("repo_id", "chunk_id", F.round("final_score", 5).alias("final_score"), "rank")


@query(
    bm25_sql(["thation", "doc"], RANK.format(q="['thation', 'doc']", n=2, now=NOW, per=20))
    + " SELECT repo_id, chunk_id, file_path, summary, rank FROM bb WHERE rank <= 10 AND (rank = 1 OR tokens_so_far <= 999999)"
)
def compact_search(spark, d):
    return stored.texts(spark, d).search("thation doc", 10, 999_999, NOW).select(*SCORED, "summary", "rank")


@query(
    f"WITH {CHUNKS} SELECT chunk_id, file_path, 0.0::DOUBLE AS bm25_score FROM chunks WHERE (content ILIKE '%t_e%' OR summary ILIKE '%t_e%' OR symbol_name ILIKE '%t_e%') "
    "AND (content ILIKE '%doc%' OR summary ILIKE '%doc%' OR symbol_name ILIKE '%doc%') ORDER BY last_modified DESC, chunk_id LIMIT 10"
)
def text_like_fallback(spark, d):
    return S.like_search(chunks(spark, d), "t_e doc", 10).select("chunk_id", "file_path", "bm25_score")


@query(
    f"WITH {CHUNKS} SELECT chunk_id, bm25_score FROM (SELECT chunk_id, 0.0::DOUBLE AS bm25_score, last_modified FROM chunks WHERE content ILIKE '%token%' OR summary ILIKE '%token%' OR symbol_name ILIKE '%token%' ORDER BY last_modified DESC, chunk_id LIMIT 10)"
)
def query_error_fallback(spark, d):
    return S.search_or_like(chunks(spark, d), '"token', 10).select("chunk_id", "bm25_score")


@query(
    f"WITH {CHUNKS}, r AS (SELECT repo_id, symbol_name, chunk_id, row_number() OVER (PARTITION BY repo_id ORDER BY symbol_name, chunk_id) AS r FROM chunks WHERE symbol_name ILIKE '%doc_1%') "
    "SELECT repo_id, symbol_name, chunk_id FROM r WHERE r <= 50 ORDER BY repo_id, symbol_name, chunk_id LIMIT 50"
)
def symbol_search(spark, d):
    return S.symbols(chunks(spark, d), "doc_1").select("repo_id", "symbol_name", "chunk_id")


PHRASE = " OR ".join(f"contains(' ' || array_to_string({TOK.format(c=c)}, ' ') || ' ', ' of the ')" for c in ("content", "summary", "symbol_name", "file_path"))


@query(f"WITH {CHUNKS} SELECT repo_id, chunk_id FROM chunks WHERE {PHRASE} ORDER BY repo_id, chunk_id LIMIT 50")
def text_phrase_refs(spark, d):
    return stored.texts(spark, d).frequencies([["of", "the"]]).where("f0 > 0").orderBy("repo_id", "chunk_id").limit(50).select("repo_id", "chunk_id")


@query(
    f"WITH {CHUNKS}, p AS (SELECT repo_id, chunk_id, unnest({TOK.format(c='content')} || {TOK.format(c='summary')} || {TOK.format(c='symbol_name')} || {TOK.format(c='file_path')}) AS term FROM chunks) "
    "SELECT repo_id, term, count(*) AS occurrences, count(DISTINCT chunk_id) AS df FROM p GROUP BY ALL"
)
def postings_build(spark, d):
    rows = stored.texts(spark, d).table("postings")
    return rows.groupBy("repo_id", "term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("df"))


@query(
    f"WITH {CHUNKS}, s AS (SELECT repo_id, " + " + ".join(f"len({TOK.format(c=c)})" for c in ("content", "summary", "symbol_name", "file_path")) + " AS dl FROM chunks) "
    "SELECT repo_id, count(*) AS n, round(avg(dl), 6) AS avgdl FROM s GROUP BY repo_id"
)
def corpus_stats(spark, d):
    return stored.texts(spark, d).table("stats").select("repo_id", "n", F.round("avgdl", 6).alias("avgdl"))


@query(
    "WITH e AS (SELECT p_name FROM part WHERE p_name = 'red widget'), s AS (SELECT p_name FROM part WHERE contains(lower(p_name), 'red widget') ORDER BY p_name LIMIT 20) "
    "SELECT p_name, count(*) AS n FROM (SELECT p_name FROM e UNION ALL SELECT p_name FROM s WHERE NOT EXISTS (SELECT 1 FROM e)) GROUP BY p_name"
)
def exact_then_substring(spark, d):
    return S.exact_or_substring(views.table(spark, d, "part").select("p_name"), "p_name", "red widget").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT url, length(url) AS n FROM pages WHERE contains(lower(url), 'example.com/en') ORDER BY length(url), url LIMIT 5")
def shortest_path_match(spark, d):
    rows = views.table(spark, d, "pages").where(text.holds(F.col("url"), "example.com/en"))
    return rows.select("url", F.length("url").alias("n")).orderBy("n", "url").limit(5)


@query(
    "WITH t AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE 'get' || upper(p_name[1]) || replace(p_name[2:], ' ', 'HTTP') || 'X2Y' END AS name FROM part), "
    "s AS (SELECT p_partkey, name, CASE WHEN contains(name, '_') THEN string_split(name, '_') ELSE string_split(regexp_replace(regexp_replace(name, '([^A-Z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ') END AS p FROM t) "
    "SELECT p_partkey, name, array_to_string(list_filter(list_transform(p, lambda x: lower(x)), lambda x: x <> ''), ' ') AS parts FROM s"
)
def identifier_split(spark, d):
    rows = names(spark, d)
    return rows.select("p_partkey", "name", F.array_join(text.split_identifier(F.col("name")), " ").alias("parts"))


def names(spark, d):
    return views.table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE concat('get', upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', 'HTTP'), 'X2Y') END AS name")


@query(
    "WITH t AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part), w AS (SELECT name, unnest(string_split(name, '_')) AS word FROM t) "
    "SELECT word, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM w WHERE word <> '' GROUP BY word"
)
def vocabulary(spark, d):
    rows = views.table(spark, d, "part").selectExpr("replace(p_name, ' ', '_') AS name").distinct()
    words = rows.select("name", F.explode(text.split_identifier(F.col("name"))).alias("word"))
    return words.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query(f"WITH {CHUNKS}, t AS (SELECT repo_id, chunk_id, " + " + ".join(f"len({TOK.format(c=c)})" for c in ("content", "summary", "symbol_name", "file_path")) + " AS dl FROM chunks), "
    f"p AS (SELECT unnest({TOK.format(c='content')} || {TOK.format(c='summary')} || {TOK.format(c='symbol_name')} || {TOK.format(c='file_path')}) AS term FROM chunks) "
    "SELECT 'chunks' AS what, count(*) AS n FROM chunks UNION ALL SELECT 'tokens', sum(dl)::BIGINT FROM t UNION ALL SELECT 'occurrences', count(*) FROM p UNION ALL SELECT 'terms', count(DISTINCT term) FROM p UNION ALL SELECT 'repositories', count(DISTINCT repo_id) FROM chunks")
def index_build(spark, d):
    """Builds the text index, if the session has none of these documents, and counts what it holds."""
    i, n = stored.texts(spark, d), F.count(F.lit(1))
    one = lambda table, what, c: i.table(table).agg(F.lit(what).alias("what"), c.cast("long").alias("n"))
    return one("texts", "chunks", n).union(one("meta", "tokens", F.sum("dl"))).union(one("postings", "occurrences", F.sum("n"))).union(one("postings", "terms", F.count_distinct("term"))).union(one("stats", "repositories", n))


PLACED = ", ".join(f"SELECT repo_id, chunk_id, {i} AS field, unnest({TOK.format(c=c)}) AS term, generate_subscripts({TOK.format(c=c)}, 1) - 1 AS pos FROM chunks" for i, c in enumerate(("content", "summary", "symbol_name", "file_path"))).replace(", SELECT repo_id", " UNION ALL SELECT repo_id")


@query(
    f"WITH {CHUNKS}, p AS MATERIALIZED (SELECT *, CASE term WHEN 'that' THEN 0 WHEN 'with' THEN 1 ELSE 2 END AS i FROM ({PLACED}) WHERE term IN ('that', 'with', 'this')), "
    "o AS (SELECT repo_id, chunk_id, pos, (SELECT count(DISTINCT q.i) FROM p q WHERE q.repo_id = p.repo_id AND q.chunk_id = p.chunk_id AND q.field = p.field AND q.pos BETWEEN p.pos AND p.pos + 13) AS kinds FROM p) "
    "SELECT repo_id, chunk_id, count(*) AS clumps FROM o WHERE kinds = 3 GROUP BY repo_id, chunk_id"
)
def text_near_search(spark, d):
    """Chunks in which three words stand together, with twelve others between them or fewer."""
    return stored.texts(spark, d).near([["that"], ["with"], ["this"]], 12)


@query(
    f"WITH {CHUNKS}, p AS MATERIALIZED ({PLACED.replace('FROM chunks', 'FROM (SELECT * FROM chunks WHERE doc_id % 5 <> 2)')}) "
    "SELECT repo_id, term, count(*) AS occurrences, count(DISTINCT chunk_id) AS df, sum(field * 4294967296 + pos)::BIGINT AS places FROM p GROUP BY repo_id, term"
)
def index_incremental(spark, d):
    """Postings after four batches: stale texts of every fourth document, all documents, deletions, and the same again."""
    rows = chunks(spark, d)
    index = SegmentIndex(spark, new_folder(spark), buckets_for(rows))
    put = rows.withColumns({"change": F.lit("put"), "seq": F.lit(1)})
    stale = put.where("doc_id % 4 = 1").withColumn("content", F.concat(F.lit("stale words "), F.reverse("content")))
    gone = put.where("doc_id % 5 = 2").withColumn("change", F.lit("delete"))
    for batch, changes in enumerate([stale, put, gone, put.where("doc_id % 5 <> 2")]):
        index.apply(changes, batch)
    index.compact(3)
    return index.table("postings").groupBy("repo_id", "term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("df"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)).alias("places"))


ASKED = "SELECT item_id, text FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))"
FIELDS = {"content": 1.0, "summary": 2.0, "symbol_name": 3.0, "file_path": 1.5}
MANY = (
    f"WITH {CHUNKS}, asked AS MATERIALIZED ({ASKED}), q AS (SELECT item_id, unnest(list_distinct({TOK.format(c='text')})) AS term FROM asked), "
    + "tk AS (" + " UNION ALL ".join(f"SELECT repo_id, chunk_id, {w}::DOUBLE AS w, unnest({TOK.format(c=c)}) AS term FROM chunks" for c, w in FIELDS.items()) + "), "
    + "dl AS (SELECT repo_id, chunk_id, " + " + ".join(f"len({TOK.format(c=c)})" for c in FIELDS) + " AS dl FROM chunks), st AS (SELECT repo_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY repo_id), "
    "h AS (SELECT repo_id, chunk_id, term, sum(w) AS f FROM tk WHERE term IN (SELECT term FROM q) GROUP BY ALL), hn AS (SELECT *, count(*) OVER (PARTITION BY repo_id, term) AS nt FROM h), "
    "pt AS (SELECT hn.*, CASE WHEN ln((n - nt + 0.5) / (nt + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - nt + 0.5) / (nt + 0.5)) END * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part FROM hn JOIN st USING (repo_id) JOIN dl USING (repo_id, chunk_id)), "
    "sc AS (SELECT item_id, repo_id, chunk_id, round(-sum(part), 9) AS score FROM q JOIN pt USING (term) GROUP BY ALL), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, chunk_id) AS rank FROM sc), "
    "rl AS (SELECT item_id, repo_id, chunk_id FROM asked JOIN chunks ON contains(content, asked.text)) "
)


def asked(spark, d):
    """(query, text) of benchmark passages that documents hold, and (query, repo_id, chunk_id) of these documents."""
    items = F.broadcast(views.table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"))
    held = chunks(spark, d).select("repo_id", "chunk_id", "content").join(items, F.contains("content", F.col("text"))).select("query", "text", "repo_id", "chunk_id")
    held = cut(held, "relevant")
    return held.select("query", "text").distinct(), held.drop("text")


@query(MANY + "SELECT round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, count(*) AS queries FROM (SELECT item_id, min(rank) FILTER (rl.chunk_id IS NOT NULL) AS first FROM rk LEFT JOIN rl USING (item_id, repo_id, chunk_id) WHERE rank <= 5 GROUP BY item_id)")
def search_evaluation(spark, d):
    """Our own search, asked for passages: how often documents that hold them come first."""
    queries, relevant = asked(spark, d)
    found = stored.texts(spark, d).search_many(queries, 5)
    marked = found.join(relevant.withColumn("relevant", F.lit(True)), ["query", "repo_id", "chunk_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    return D.metrics(D.ranks(marked))


@query(MANY + "SELECT count(*) AS queries, round(avg(CASE WHEN EXISTS (SELECT 1 FROM rl WHERE rl.item_id = rk.item_id AND rl.repo_id = rk.repo_id) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM rk WHERE rank = 1")
def search_routing(spark, d):
    """How often the repository of the best answer holds the passage."""
    queries, relevant = asked(spark, d)
    best = D.best_source(stored.texts(spark, d).search_many(queries, 5).select("query", F.col("repo_id").alias("source"), "score"))
    return D.accuracy(best, relevant.select("query", F.col("repo_id").alias("source")))


@query(bm25_sql(["token", "doc", "the"], "SELECT repo_id, chunk_id, round(bm25_score, 5) AS bm25_score FROM rk WHERE repo_rank <= 20", some="f0 > 0 AND f1 > 0 AND NOT f2 > 0"))
def text_boolean_search(spark, d):
    rows = stored.texts(spark, d).bm25("token AND doc NOT the", 20)
    return rows.select("repo_id", "chunk_id", F.round("bm25_score", 5).alias("bm25_score"))
