r"""Secrets in texts, with SQL functions only.

Base kinds, leftmost and non-overlapping each: ``assign`` (a key word, ``:`` or
``=``, a value of 12 characters or more), ``access`` (``AKIA`` and 14 or more),
``hex`` (16 or more).  Added kind ``entropy``: candidate strings of ``WINDOW`` or
more characters over ``[A-Za-z0-9+/_=-]`` with a letter and a digit, of which some
window of ``WINDOW`` characters has a Shannon entropy at or above the threshold of
the string's character class (hexadecimal, or all).  The windows slide by
incremental counts: a step takes one count down and one up and corrects the sum of
c * log2(c).  Candidates that match the allow-list, or that overlap a base span,
are suppressed.

Positions are code points.  They come from the gaps between matches: the lengths
of gaps and matches are summed within blocks of ``BLOCK`` and over the blocks, so
that a text with very many matches takes near-linear time; a long candidate takes
time in proportion to its characters.

Null and empty texts have no spans.  Rows with a null identifier, ties and repeated
rows are scanned each for itself.  Extra columns are left out of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, BLOCK = 20, 256
THRESHOLDS = {"hex": 3.0, "any": 3.7}
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|sample|redacted",
    r"^(.)\1*$",
    r"(?i)^(sha1|sha256|sha384|sha512|md5)[-=]",
)
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [  # name, pattern, group that holds the value, least characters of it
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"


def quoted(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def with_matches(rows: DataFrame, pattern: str, group: int, name: str) -> DataFrame:
    """Adds {name}: array of (start, end, value) of every match of the pattern in ``text``."""
    p = quoted(pattern)
    steps = "transform(found, (m, i) -> length(gaps[i]) + IF(i = 0, 0, length(found[i - 1])))"
    blocks = f"transform(sequence(0, (size(found) - 1) DIV {BLOCK}), b -> slice(steps, b * {BLOCK} + 1, {BLOCK}))"
    running = "aggregate({x}, cast(array() as array<int>), (a, v) -> concat(a, array(coalesce(try_element_at(a, -1), 0) + v)))"
    inner = running.format(x="blk")
    totals = "transform(blocks, blk -> aggregate(blk, 0, (a, v) -> a + v))"
    offsets = f"slice(concat(array(0), {running.format(x='totals')}), 1, size(totals))"
    some = "size(found) > 0"
    return (
        rows.selectExpr("*", f"regexp_extract_all(text, {p}, 0) AS found")
        .selectExpr("*", f"IF({some}, split(text, {p}, -1), array()) AS gaps", f"IF({some}, regexp_extract_all(text, {p}, {group}), array()) AS vals" if group else "found AS vals")
        .selectExpr("*", f"IF({some}, {steps}, cast(array() as array<int>)) AS steps")
        .selectExpr("*", f"IF({some}, {blocks}, cast(array() as array<array<int>>)) AS blocks")
        .selectExpr("*", f"{totals} AS totals")
        .selectExpr("*", f"IF({some}, flatten(zip_with(blocks, {offsets}, (blk, o) -> transform({inner}, v -> v + o))), cast(array() as array<int>)) AS begins")
        .selectExpr(*[f"`{c}`" for c in rows.columns], f"transform(begins, (s, i) -> named_struct('s', s, 'e', s + length(found[i]), 'v', vals[i])) AS {name}")
    )


def entropy_of(value: Column) -> Column:
    """The largest entropy of a window of the string ``value``.

    The state holds the count of each character in the window and the sum of
    c * log2(c) over these counts; a character that leaves takes one count down, one
    that comes takes one up, and both correct the sum.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    let = lambda x, body: F.element_at(F.transform(F.array(x), body), 1)  # noqa: E731  evaluated once, then read by place
    codes = F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), F.ascii)
    moves = let(codes, lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("comes"), F.get(cs, i - WINDOW).alias("goes"), (i >= WINDOW - 1).alias("full"))))

    def step(acc: Column, m: Column) -> Column:
        comes, goes, counts = m["comes"], m["goes"], acc["counts"]
        gone = F.coalesce(F.get(table, F.get(counts, goes) - 1) - F.get(table, F.get(counts, goes)), F.lit(0.0))
        left = F.get(counts, comes) - F.coalesce((comes == goes).cast("int"), F.lit(0))
        total = acc["total"] + gone + F.get(table, left + 1) - F.get(table, left)
        moved = F.transform(counts, lambda n, k: n + F.when(k == comes, 1).otherwise(0) - F.when(k == goes, 1).otherwise(0))
        return let(total, lambda t: F.struct(moved.alias("counts"), t.alias("total"), F.when(m["full"], F.least(acc["least"], t)).otherwise(acc["least"]).alias("least")))

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
    return F.lit(math.log2(WINDOW)) - F.aggregate(moves, start, step, lambda acc: acc["least"]) / WINDOW


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row."""
    th = THRESHOLDS | (thresholds or {})
    rows = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    for name, pattern, group, least in KINDS:
        rows = with_matches(rows, pattern, group, name).selectExpr("*", f"filter({name}, m -> length(m.v) >= {least}) AS kept_{name}").drop(name).withColumnRenamed(f"kept_{name}", name)
    rows = with_matches(rows, CANDIDATE, 0, "cand").drop("text")
    allowed = " OR ".join(f"m.v RLIKE {quoted(p)}" for p in allow) or "false"
    overlap = " OR ".join(f"exists({name}, b -> b.s < m.e AND m.s < b.e)" for name, *_ in KINDS)
    rows = rows.selectExpr("*", f"filter(cand, m -> m.v RLIKE '[0-9]' AND m.v RLIKE '[A-Za-z]' AND NOT ({allowed}) AND NOT ({overlap})) AS open").drop("cand")
    limit = lambda v: F.when(v.rlike("^[0-9a-fA-F]+$"), th["hex"]).otherwise(th["any"])
    rows = rows.withColumn("entropy", F.filter("open", lambda m: entropy_of(m["v"]) >= limit(m["v"]) - 1e-9)).drop("open")
    tagged = lambda name, k: f"transform({name}, m -> named_struct('s', m.s, 'k', {k}, 'e', m.e))"
    names = [name for name, *_ in KINDS]
    base = "array_sort(concat(" + ", ".join(tagged(n, k) for k, n in enumerate(names)) + "))"
    every = "array_sort(concat(" + ", ".join(tagged(n, k) for k, n in enumerate([*names, "entropy"])) + "))"
    label = "element_at(array(" + ", ".join(f"'{n}'" for n in [*names, "entropy"]) + "), m.k + 1)"
    shown = lambda a: f"array_join(transform({a}, m -> concat({label}, ':', m.s, ':', m.e)), ',')"
    return rows.selectExpr(
        f"id AS `{id_col}`",
        *[f"cast(size({n}) AS bigint) AS n_{n}" for n in names],
        f"sha2({shown(base)}, 256) AS base_sha256",
        f"{shown(every)} AS spans",
        "cast(size(entropy) AS bigint) AS n_entropy",
    )
