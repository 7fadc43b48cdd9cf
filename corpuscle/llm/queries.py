"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .bpe import encode_table
from .common import table
from .exact_dedup import exact_groups
from .hard_negatives import mined
from .html_text import extract
from .mixing import mixture
from .ngram_join import near_groups
from .secrets import scan
from .substring_dedup import drop_repeats
from .token_ids import token_id_table
from .toxicity import toxicity
from .vector_codes import compressed
from .warc import archived_pages


def tokenizer_path(spark: SparkSession) -> str:
    """``corpuscle.tokenizer`` if set, else the installed byte-level file."""
    import public_tokenizers

    return spark.conf.get("corpuscle.tokenizer", None) or public_tokenizers.path("byte_bpe_50k.json")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_table(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", label), F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_ann, op2_ngram_join, op3_html_text, op4_mixing, op5_token_ids, op6_toxicity, op7_exact_dedup, op8_warc, op9_secrets, op10_bpe_codec, op11_vector_codes, op12_substring_dedup, op13_hard_negatives)}

USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codebook_rounds(rounds: int) -> str:
    """The steps of vector codes as SQL: entries of round k (b) from the parts nearest to those before (a)."""
    near = """
        a{k} AS MATERIALIZED (
            SELECT vec_id, label, p.part, first(x) AS x, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d
            FROM (SELECT p.*, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM p JOIN b{k} USING (part)) p
            GROUP BY vec_id, label, p.part)"""
    move = """
        m{k} AS (SELECT part, entry, list(v ORDER BY i) AS c FROM (
            SELECT part, entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM a{k}, generate_series(1, (SELECT max(len(x)) FROM p)) t(i) GROUP BY part, entry, i) GROUP BY part, entry),
        b{next} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
    steps = [step.format(k=k, next=k + 1) for k in range(rounds) for step in (near, move)]
    return ",".join([*steps, near.format(k=rounds)])


SQL = {
    "op11_vector_codes": f"""
        WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {USABLE}),
        p AS MATERIALIZED (SELECT vec_id, label, part, q[part * w + 1 : part * w + w] AS x FROM (SELECT *, len(q) // 16 AS w FROM v), range(16) t(part)),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 64),
        {_codebook_rounds(2)},
        r AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY ALL)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY part, entry) FROM b2)) AS codebooks_sha256 FROM r""",
    "op12_substring_dedup": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT doc_id, p, sha256(array_to_string(w[p : p + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
        r AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM s) WHERE least < doc_id),
        c AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(p, p + 13)) AS i FROM r)),
        l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i))), ' ')) AS kept_sha256
        FROM d LEFT JOIN l USING (doc_id)""",
    "op13_hard_negatives": f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE label IS NOT NULL AND {USABLE}),
        s AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id))::INT AS rank,
               s.vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op2_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS MATERIALIZED (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n_shingles FROM l),
        e AS (SELECT doc_id, unnest(s) AS s FROM l),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        k AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n_shingles + b.n_shingles - c)),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, k.y FROM r JOIN k ON k.x = r.other)
        SELECT n.doc_id, n_shingles, min(other) AS component_id FROM r JOIN n USING (doc_id) GROUP BY n.doc_id, n_shingles""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform([1, 11, 21, 31], lambda i: translate(to_base(('0x' || x[i : i + 9])::BIGINT, 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM d""",
    "op4_mixing": r"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT doc_id, source, coalesce(source, chr(0)) AS s, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS n,
                   md5('mix|' || coalesce(doc_id::VARCHAR, ''))[1:2] AS b FROM documents),
        st AS MATERIALIZED (SELECT s, b, sum(n)::BIGINT AS t FROM d GROUP BY ALL),
        so AS MATERIALIZED (SELECT s, sum(t)::BIGINT AS t FROM st GROUP BY s),
        cut(i, lo, hi) AS (
            SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
            UNION ALL
            SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
            FROM (SELECT i, lo, hi, (SELECT max(pow(t::DOUBLE, (lo + hi) / 2 - 1.0)) <= min(pow(t::DOUBLE, (lo + hi) / 2 - 1.0)) * 2.0 FROM so WHERE t > 0) AS ok
                  FROM cut WHERE i < 28)),
        al AS (SELECT CASE WHEN (SELECT count(*) FROM so WHERE t > 0) < 2 THEN 1.0
                           WHEN (SELECT max(pow(t::DOUBLE, -1.0)) <= min(pow(t::DOUBLE, -1.0)) * 2.0 FROM so WHERE t > 0) THEN 0.0
                           ELSE hi END AS a FROM cut WHERE i = 28),
        x AS (SELECT s, t, CASE WHEN t > 0 THEN pow(t::DOUBLE, a - 1.0) END AS x FROM so, al),
        r AS (SELECT s, t AS al, round(coalesce(x / (SELECT min(x) FROM x), 1.0), 6) AS rep FROM x),
        e AS (SELECT st.s, st.b, st.t, al, rep, unnest(range(0, floor(rep)::INT + 1))::INT AS epoch FROM st JOIN r USING (s)),
        p AS (SELECT *, row_number() OVER w AS block_rank, sum(t) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
              FROM (SELECT *, md5('mix|' || s || '|' || epoch || '|' || b) AS o FROM e) WINDOW w AS (PARTITION BY s, epoch ORDER BY o, b))
        SELECT doc_id, source, n AS n_tokens, epoch, d.b AS block, block_rank::INT AS block_rank,
               round((epoch + (block_rank - 1) / 256.0::DOUBLE) / rep, 6) AS schedule, rep AS repetition
        FROM d JOIN p ON d.s = p.s AND d.b = p.b
        WHERE epoch < floor(rep) OR (upto <= floor((rep - floor(rep)) * al) AND floor((rep - floor(rep)) * al) > 0)""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
