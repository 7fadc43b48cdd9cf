"""Ranked text search over chunks: inverted index, weighted BM25, re-ranking, cuts.

Chunks have repo_id, chunk_id, file_path, chunk_type, symbol_name, content, summary
and last_modified.  Statistics are per repository; scores are negative, the least
is the best.  Every order ends in chunk_id, so results do not depend on partitions.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import fixed, text


def postings(chunks: DataFrame) -> DataFrame:
    """(repo_id, chunk_id, field, pos, term): the inverted index of the four fields."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), text.tokens(F.col(f)).alias("terms")) for f in fixed.COLUMN_WEIGHTS])
    rows = chunks.select("repo_id", "chunk_id", F.explode(fields).alias("x"))
    return rows.select("repo_id", "chunk_id", "x.field", F.posexplode("x.terms").alias("pos", "term"))


def doc_stats(chunks: DataFrame) -> DataFrame:
    """(repo_id, chunk_id, dl): unweighted number of tokens of all fields."""
    dl = reduce(Column.__add__, [text.n_tokens(folded(f)) for f in fixed.COLUMN_WEIGHTS])
    return chunks.select("repo_id", "chunk_id", dl.cast("long").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """(repo_id, n, avgdl)."""
    return stats.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def parse_query(query: str) -> list[list[str]]:
    """Phrases of a query as lists of terms; double quotes hold several words together."""
    found = [re.findall(r"[^\W_]+", text.fold_str(q or w)) for q, w in re.findall(r'"([^"]*)"|([^\s"]+)', query)]
    return [list(p) for p in dict.fromkeys(tuple(p) for p in found if p)]


Condition = int | tuple  # a phrase's number, or ("and" | "or" | "not", left, right)


def parse_match(query: str) -> tuple[list[list[str]], Condition | None]:
    """Phrases of a query and how they combine.

    AND, OR and NOT in capitals, outside quotes, are operators; NOT binds closest, then
    AND, which is also meant where phrases follow each other in such a query, then OR.
    A query without operators, or with one that lacks a side, asks for any of its
    phrases (None).
    """
    parts = [(False, q) if q or not w else (w in ("AND", "OR", "NOT"), w) for q, w in re.findall(r'"([^"]*)"|([^\s"]+)', query)]
    plain = parse_query(" ".join(f'"{p}"' for is_operator, p in parts if not is_operator))
    if not any(is_operator for is_operator, _ in parts):
        return parse_query(query), None
    tree = _any(parts, {tuple(p): i for i, p in enumerate(plain)})
    return (plain, tree) if tree is not None else (parse_query(query), None)


def _any(parts: list[tuple[bool, str]], number: dict[tuple, int]) -> Condition | None:
    """The condition of parts (is an operator, word or phrase); None if an operator lacks a side."""
    for name in ("OR", "AND"):  # what binds least splits first
        at = next((i for i, p in enumerate(parts) if p == (True, name)), None)
        if at is not None:
            left, right = _any(parts[:at], number), _any(parts[at + 1 :], number)
            return None if left is None or right is None else (name.lower(), left, right)
    out: Condition | None = None
    while parts:
        (is_operator, word), *parts = parts
        if is_operator:  # NOT, of what stands before it
            if out is None or not parts or parts[0][0]:
                return None
            (_, word), *parts = parts
        (phrase,) = parse_query(f'"{word}"') or [None]
        if phrase is None:
            return None
        one = number[tuple(phrase)]
        out = one if out is None else ("not" if is_operator else "and", out, one)
    return out


def meets(condition: Condition | None, phrases: int) -> Column:
    """The condition over f0, f1, ...; None: any phrase."""
    if condition is None:
        return reduce(Column.__or__, [F.col(f"f{i}") > 0 for i in range(phrases)])
    if isinstance(condition, int):
        return F.col(f"f{condition}") > 0
    name, left, right = condition
    left, right = meets(left, phrases), meets(right, phrases)
    return left & right if name == "and" else left | right if name == "or" else left & ~right


EDGE = r"[\p{L}\p{N}]"


def phrase_count(folded: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens follow each other in a folded text, overlaps included."""
    rest = "".join(rf"[^\p{{L}}\p{{N}}]+{t}" for t in phrase[1:])
    return F.regexp_count(folded, F.lit(rf"(?<!{EDGE}){phrase[0]}(?={rest}(?!{EDGE}))"))


def folded(field: str) -> Column:
    return text.fold(F.coalesce(F.col(field), F.lit("")))


def frequencies(chunks: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """The chunks with dl and, for each phrase, its weighted frequency f0, f1, ...: one pass, no shuffle."""
    rows = chunks.withColumns({f"t_{f}": folded(f) for f in fixed.COLUMN_WEIGHTS})
    dl = reduce(Column.__add__, [text.n_tokens(F.col(f"t_{f}")) for f in fixed.COLUMN_WEIGHTS])
    freq = {f"f{i}": reduce(Column.__add__, [phrase_count(F.col(f"t_{f}"), p) * w for f, w in fixed.COLUMN_WEIGHTS.items()]) for i, p in enumerate(phrases)}
    return rows.withColumns({"dl": dl.cast("long")} | freq).drop(*[f"t_{f}" for f in fixed.COLUMN_WEIGHTS])


def bm25(chunks: DataFrame, query: str, per_repo: int | None = 20) -> DataFrame:
    """Chunks that hold a phrase of the query, with bm25_score; the per_repo best of each repository."""
    phrases, condition = parse_match(query)
    if not phrases:
        return chunks.where("false").withColumn("bm25_score", F.lit(0.0))
    rows = frequencies(chunks, phrases)
    stats = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    hits = rows.where(meets(condition, len(phrases))).join(stats, "repo_id")
    return scored(hits, len(phrases), per_repo)


def term_score(f: Column, held: Column) -> Column:
    """A phrase's part of the score: its weighted frequency f, in ``held`` of n chunks; dl and avgdl are columns."""
    k1, b = fixed.K1, fixed.B
    idf = F.log((F.col("n") - held + 0.5) / (held + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def scored(hits: DataFrame, phrases: int, per_repo: int | None) -> DataFrame:
    """Hits with bm25_score from f0, n0, f1, ..., n, dl and avgdl, which go; the per_repo best of each repository."""
    names = [f"{x}{i}" for x in "fn" for i in range(phrases)]
    total = reduce(Column.__add__, [term_score(F.col(f"f{i}"), F.col(f"n{i}")) for i in range(phrases)])
    rows = hits.withColumn("bm25_score", -total).drop(*names, "n", "avgdl", "dl")
    if per_repo is None:
        return rows
    w = Window.partitionBy("repo_id").orderBy("bm25_score", "chunk_id")
    return rows.withColumn("repo_rank", F.row_number().over(w)).where(F.col("repo_rank") <= per_repo)


def words(c: Column, marks: str) -> Column:
    return F.filter(F.split(F.translate(F.lower(c), marks, " " * len(marks)), r"\s+"), lambda w: w != "")


def rerank(hits: DataFrame, query: str, now: float) -> DataFrame:
    """Adds final_score: the score times boosts for kind, symbol, path and age."""
    asked = sorted(set(query.lower().split()))
    array = F.array(*[F.lit(w) for w in asked])
    name = text.basename(F.col("file_path"))
    kind = F.when(name.isin(fixed.PRIORITY_DOCS), fixed.BOOST_PRIORITY).when(F.col("chunk_type") == "doc", fixed.BOOST_DOC).when(F.col("chunk_type") == "insight", fixed.BOOST_INSIGHT).otherwise(1.0)
    common = F.size(F.array_intersect(words(F.coalesce("symbol_name", F.lit("")), "_/."), array))
    symbol = 1.0 + common / F.lit(float(max(len(asked), 1)))
    path = F.when(F.arrays_overlap(words(F.col("file_path"), "/_."), array), fixed.BOOST_PATH).otherwise(1.0)
    age = (F.lit(float(now)) - F.col("last_modified").cast("double")) / 3600
    recent = F.when((F.coalesce("last_modified", F.lit(0.0)) != 0) & (age < fixed.RECENT_HOURS), 1 + fixed.RECENT).otherwise(1.0)
    return hits.withColumn("final_score", F.col("bm25_score") * kind * symbol * path * recent)


def best_per_file(ranked: DataFrame) -> DataFrame:
    """The best chunk of each file, and how many more of its chunks were found."""
    w = Window.partitionBy("repo_id", "file_path")
    rows = ranked.withColumns({"__r": F.row_number().over(w.orderBy("final_score", "chunk_id")), "more_in_file": F.count(F.lit(1)).over(w) - 1})
    return rows.where("__r = 1").drop("__r")


def within_budget(ranked: DataFrame, k: int, max_tokens: int, first: int = 1000) -> DataFrame:
    """The first k rows by score whose contents fit the budget; the first row always does.

    Only ``first`` rows (k or more) can be in the answer, so the running sum is over few rows.
    """
    top = ranked.orderBy("final_score", "chunk_id").limit(max(first, k))
    w = Window.orderBy("final_score", "chunk_id")
    size = F.floor((F.col("chars") if "chars" in ranked.columns else F.length(F.coalesce("content", F.lit("")))) / 4)
    rows = top.withColumns({"rank": F.row_number().over(w), "tokens_so_far": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where((F.col("rank") <= k) & ((F.col("rank") == 1) | (F.col("tokens_so_far") <= max_tokens)))


def search(chunks: DataFrame, query: str, k: int = 5, max_tokens: int = 3000, now: float = 0.0, expand: bool = True) -> DataFrame:
    """The whole read path: expansion, scoring, re-ranking, one row a file, budget."""
    asked = text.expand_query(query) if expand else query
    return within_budget(best_per_file(rerank(bm25(chunks, asked, 2 * k), query, now)), k, max_tokens)


def search_compact(chunks: DataFrame, query: str, k: int = 10, now: float = 0.0) -> DataFrame:
    """As search, without contents and with no budget to speak of."""
    return search(chunks, query, k, 999_999, now).drop("content")


def like_search(chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Every word in content, summary or symbol name, in any letter case; newest first, score 0."""
    hit = [F.coalesce(reduce(Column.__or__, [F.coalesce(text.like_any_case(F.col(c), w), F.lit(False)) for c in ("content", "summary", "symbol_name")]), F.lit(False)) for w in query.split()]
    if not hit:
        return chunks.where("false").withColumn("bm25_score", F.lit(0.0))
    return chunks.where(reduce(Column.__and__, hit)).withColumn("bm25_score", F.lit(0.0)).orderBy(F.desc("last_modified"), "chunk_id").limit(limit)


def search_or_like(chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """BM25; a query that is no valid expression (an odd number of quotes) goes to like_search."""
    if query.count('"') % 2:
        return like_search(chunks, query.replace('"', ""), limit)
    return bm25(chunks, query, None).orderBy("bm25_score", "chunk_id").limit(limit)


def symbols(chunks: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Chunks whose symbol name holds the pattern, by name; at most ``limit`` a repository and in all."""
    w = Window.partitionBy("repo_id").orderBy("symbol_name", "chunk_id")
    rows = chunks.where(F.col("symbol_name").isNotNull() & text.like_any_case(F.col("symbol_name"), pattern))
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r").orderBy("repo_id", "symbol_name", "chunk_id").limit(limit)


def exact_or_substring(rows: DataFrame, column: str, name: str, most: int = 20) -> DataFrame:
    """Rows equal to the name; only if there are none, up to ``most`` that hold it."""
    exact = rows.where(F.col(column) == name)
    none = exact.agg(F.count(F.lit(1)) == 0).scalar()
    return exact.unionByName(rows.where(F.contains(F.lower(column), F.lit(name.lower())) & none).orderBy(column).limit(most))


def file_match(nodes: DataFrame, chunks: DataFrame, part: str, most: int = 5) -> DataFrame:
    """Paths that hold the part in any letter case, shortest first: of files with symbols, else of files with chunks."""
    named = nodes.select("file_path").where(text.holds(F.col("file_path"), part)).distinct()
    none = named.agg(F.count(F.lit(1)) == 0).scalar()
    other = chunks.select("file_path").where(text.holds(F.col("file_path"), part) & none).distinct()
    return named.unionByName(other).orderBy(F.length("file_path"), "file_path").limit(most)


def phrase_refs(chunks: DataFrame, symbol: str, limit: int = 50) -> DataFrame:
    """Chunks whose fields hold the symbol's tokens as a phrase."""
    (phrase,) = parse_query(f'"{symbol}"')
    hit = reduce(Column.__or__, [phrase_count(folded(f), phrase) > 0 for f in fixed.COLUMN_WEIGHTS])
    return chunks.where(hit).orderBy("repo_id", "chunk_id").limit(limit)
