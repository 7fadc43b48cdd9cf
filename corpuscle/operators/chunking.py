"""Chunkers: whole files, heading sections, blank-line blocks, code, insights, commits."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text

from . import lexer

WHOLE_DOC, WHOLE_CODE = 4000, 2000
PARSED = ["python", "javascript", "typescript", "dart"]


def tokens_of(content: Column) -> Column:
    return F.floor(F.length(content) / 4)


def first_line(content: Column, most: int = 120) -> Column:
    """First line that is not blank, without leading number signs."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: text.trimmed(x)), lambda x: x != "")
    return F.coalesce(F.substring(text.trimmed(F.regexp_replace(F.try_element_at(lines, F.lit(1)), "^#+", "")), 1, most), F.lit(""))


def clean(files: DataFrame, most: int = 100_000) -> DataFrame:
    """Files of 1 to ``most`` bytes that are not all white space."""
    return files.where(F.octet_length("content").between(1, most) & (F.trim(F.regexp_replace("content", r"\s+", " ")) != ""))


def keys(files: DataFrame) -> list[str]:
    """What tells files apart: the repository, where the rows have one, and the path."""
    return [c for c in ("repo_id", "file_path") if c in files.columns]


def whole(files: DataFrame, limit: int = WHOLE_DOC) -> DataFrame:
    rows = files.where(tokens_of(F.col("content")) <= limit)
    return rows.select(*keys(files), F.lit("whole").alias("strategy"), text.basename(F.col("file_path")).alias("symbol_name"), first_line(F.col("content")).alias("summary"), "content", F.lit(1).alias("line_start"))


HEADING = r"^#{1,4}\s+"


def _lines(files: DataFrame, limit: int | None) -> DataFrame:
    rows = files if limit is None else files.where(tokens_of(F.col("content")) > limit)
    return rows.select(*keys(files), F.split("content", "\n").alias("l"))


def _places(marks: Column) -> Column:
    """Where an array of booleans is true, from 0."""
    return F.filter(F.transform(marks, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())


def _joined(first: Column, after: Column) -> Column:
    return F.array_join(F.slice("l", first + 1, after - first), "\n")


def sections(files: DataFrame, limit: int | None = None) -> DataFrame:
    """A chunk for each heading of one to four number signs; text before the first is "Top".  Found within the row."""
    rows = _lines(files, limit).withColumn("heads", _places(F.transform("l", lambda s: s.rlike(HEADING))))
    opens = F.coalesce(F.get("heads", F.lit(0)) == 0, F.lit(False))
    rows = rows.withColumns({"first": opens.cast("long"), "starts": F.when(opens, F.col("heads")).otherwise(F.concat(F.array(F.lit(0)), F.col("heads")))})

    def section(at: Column, i: Column) -> Column:
        after = F.coalesce(F.get("starts", i + 1), F.size("l"))
        title = F.when((i > 0) | (F.col("first") == 1), F.trim(F.regexp_extract(F.get("l", at), rf"{HEADING}(.*)$", 1)))
        return F.struct((i + F.col("first")).alias("section"), F.coalesce(title, F.lit("Top")).alias("symbol_name"), (at + 1).alias("line_start"), after.alias("line_end"), _joined(at, after).alias("content"))

    out = rows.select(*keys(files), F.explode(F.transform("starts", section)).alias("x")).select(*keys(files), "x.*")
    return out.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def blocks(files: DataFrame, limit: int | None = WHOLE_CODE) -> DataFrame:
    """Runs of lines between blank-line gaps, with their true line numbers.  Found within the row."""
    rows = _lines(files, limit).withColumn("blank", F.transform("l", lambda s: F.trim(s) == ""))
    edge = lambda side: _places(F.transform("blank", lambda b, i: ~b & F.coalesce(F.get("blank", i + side), F.lit(True))))
    rows = rows.withColumns({"starts": edge(-1), "ends": edge(1)})

    def block(at: Column, i: Column) -> Column:
        after = F.get("ends", i) + 1
        return F.struct((i + 1).cast("long").alias("block"), (at + 1).alias("line_start"), after.alias("line_end"), F.trim(_joined(at, after)).alias("content"))

    return rows.select(*keys(files), F.explode(F.transform("starts", block)).alias("x")).select(*keys(files), "x.*")


def strategy(language: Column, content: Column) -> Column:
    """Which chunker a file goes to."""
    doc = language.isin("markdown", "rst", "text")
    parsed = language.isin(PARSED)
    size = tokens_of(content)
    return F.when(doc & (size <= WHOLE_DOC), "doc_whole").when(doc, "doc_sections").when(size <= WHOLE_CODE, "code_whole").when(parsed, "code_symbols").otherwise("code_blocks")


def symbol_type(node_type: Column) -> Column:
    """Kind of symbol of a syntax-node type: the first word that it holds."""
    has = lambda *w: text.any_holds(node_type, list(w))
    return (
        F.when(has("class"), "class").when(has("method"), "method").when(has("function", "arrow"), "function").when(has("interface"), "interface")
        .when(has("enum"), "enum").when(has("type", "struct"), "type").when(has("trait", "impl"), "trait").otherwise("definition")
    )


def module_docstring(content: Column, language: Column) -> Column:
    """The text that opens a module: a string, a block comment, or a run of comment lines."""
    py = F.coalesce(F.nullif(F.trim(F.regexp_extract(content, r'(?s)^\s*"""(.*?)"""', 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(content, r"(?s)^\s*'''(.*?)'''", 1)), F.lit("")))
    js = F.nullif(F.trim(F.regexp_extract(content, r"(?s)^\s*/\*\*(.*?)\*/", 1)), F.lit(""))
    run = F.regexp_extract(content, r"^((?:\s*(?:#|//)[^\n]*\n)+)", 1)
    rest = F.nullif(F.trim(F.regexp_replace(run, r"(?m)^\s*(?:#|//)\s*", "")), F.lit(""))
    return F.coalesce(F.when(language == "python", py), F.when(language.isin("javascript", "typescript"), js), rest, F.lit(""))


def import_block(content: Column, language: Column) -> Column:
    """The import lines of a file, in order."""
    pattern = F.when(language == "python", r"^(import|from)\s").when(language.isin("javascript", "typescript"), r"require").when(language == "go", r'^\s*(import\b|"[^"]+"\s*$)').when(language == "rust", r"^\s*use\s").when(language == "java", r"^\s*import\s")
    return F.when(pattern.isNotNull(), F.array_join(F.filter(F.split(content, "\n"), lambda x: F.regexp(x, pattern)), "\n")).otherwise("")


def python_definitions(source: str) -> list[dict]:
    """Definitions of Python source, nested ones too; none where it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines, out = source.split("\n"), []
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            body = lines[node.lineno - 1 : node.end_lineno]
            if sum(map(len, body)) // 4 > WHOLE_CODE:
                body = body[:5]
            doc = (ast.get_docstring(node) or "").split("\n")[0]
            out.append({"name": node.name, "kind": "class" if isinstance(node, ast.ClassDef) else "function", "line_start": node.lineno, "line_end": node.end_lineno, "doc": doc, "content": "\n".join(body)})
    return sorted(out, key=lambda x: (x["line_start"], x["name"]))


def brace_definitions(source: str, language: str) -> list[dict]:
    """Definitions of a language with braces, nested ones too: the ranges that ``lexer`` finds."""
    lines, out = source.split("\n"), []
    for d in lexer.definitions(source, language):
        body = lines[d["line_start"] - 1 : d["line_end"]]
        if sum(map(len, body)) // 4 > WHOLE_CODE:
            body = body[:5]
        out.append({"name": d["name"], "kind": d["kind"], "line_start": d["line_start"], "line_end": d["line_end"], "doc": "", "content": "\n".join(body)})
    return sorted(out, key=lambda x: (x["line_start"], x["name"]))


DEFINITIONS = "array<struct<name:string,kind:string,line_start:int,line_end:int,doc:string,content:string>>"


def code_symbols(files: DataFrame) -> DataFrame:
    """A chunk for each definition of files in languages that are parsed, in Arrow batches."""

    @F.pandas_udf(DEFINITIONS)
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, languages in batches:
            yield pd.Series([python_definitions(s or "") if x == "python" else brace_definitions(s or "", x) for s, x in zip(sources, languages, strict=True)])

    rows = files.where(F.col("language").isin(PARSED))
    return rows.select(*keys(files), F.explode(parse("content", "language")).alias("d")).select(*keys(files), "d.*")


def insight_chunk(rows: DataFrame) -> DataFrame:
    """Saved insights (repo_id, content, tags) as chunks."""
    name = F.substring(F.md5(F.col("content").cast("binary")), 1, 8)
    return rows.select("repo_id", text.short_hash(F.concat(F.lit("insight:"), "repo_id"), F.lit("0"), name).alias("chunk_id"), F.lit("__insights__").alias("file_path"), F.lit("insight").alias("chunk_type"), F.array_join("tags", ", ").alias("symbol_name"), F.substring("content", 1, 120).alias("summary"), "content")


def commit_chunks(lines: DataFrame) -> DataFrame:
    """Lines hash|message|author|date as chunks; lines of fewer than two parts are left out."""
    parts = F.split("line", r"\|", 4)
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 2)
    get = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(""))
    return rows.select(text.short_hash(F.lit("__commits__"), F.lit("0"), F.substring(get(0), 1, 8)).alias("chunk_id"), F.lit("__commits__").alias("file_path"), F.substring(get(0), 1, 8).alias("symbol_name"), get(1).alias("summary"), get(2).alias("author"), get(3).alias("date"))


def code_whole(files: DataFrame) -> DataFrame:
    """Short code files as one chunk each; the summary has the path, what opens the module, and its first definitions."""
    names = F.regexp_extract_all("content", F.lit(r"(?m)^(?:export\s+)?(?:class|(?:async\s+)?def|(?:async\s+)?function)\s+([\p{L}\p{N}_]+)"), F.lit(1))
    parts = F.split("file_path", "/")
    path = F.array_join(F.slice(parts, -F.least(F.lit(2), F.size(parts)), 2), "/")
    about = F.nullif(F.substring(module_docstring(F.col("content"), F.col("language")), 1, 200), F.lit(""))
    defines = F.when(F.size(names) > 0, F.concat(F.lit("Defines: "), F.array_join(F.slice(names, 1, 5), ", ")))
    return files.select(*keys(files), F.lit("code_whole").alias("strategy"), text.basename(F.col("file_path")).alias("symbol_name"), F.concat_ws(" | ", path, about, defines).alias("summary"), "content", F.lit(1).alias("line_start"))


def chunk_files(files: DataFrame) -> DataFrame:
    """(repo_id if there is one, file_path, strategy, symbol_name, summary, content, line_start): every file through the chunker of its language and size.

    Long files that are parsed fall into their imports and definitions; those without any, and
    other long code, into blocks between blank lines.
    """
    key = keys(files)
    files = files.select(*key, "content", "language").withColumn("strategy", strategy(F.col("language"), F.col("content")))
    of = lambda name: files.where(F.col("strategy") == name)
    shape = lambda rows, name, symbol, summary: rows.select(*key, F.lit(name).alias("strategy"), symbol.cast("string").alias("symbol_name"), summary.cast("string").alias("summary"), "content", F.col("line_start").cast("int").alias("line_start"))
    none = F.lit(None)
    docs = shape(whole(of("doc_whole")), "doc_whole", F.col("symbol_name"), F.col("summary")).unionByName(shape(sections(of("doc_sections")), "doc_sections", F.col("symbol_name"), none))
    found = code_symbols(of("code_symbols"))
    heads = of("code_symbols").select(*key, import_block(F.col("content"), F.col("language")).alias("content"), F.lit(1).alias("line_start")).where("content <> ''").join(found.select(*key).distinct(), key, "left_semi")
    symbols = shape(found, "code_symbols", F.col("name"), F.col("doc")).unionByName(shape(heads, "code_symbols", F.lit("imports"), none))
    rest = of("code_blocks").unionByName(of("code_symbols").join(found.select(*key).distinct(), key, "left_anti").select(*files.columns))
    return docs.unionByName(code_whole(of("code_whole"))).unionByName(symbols).unionByName(shape(blocks(rest, None), "code_blocks", none, none))
