"""Symbols and typed relationships of source files, by expressions over whole files.

Positions are line numbers: the number of line ends before a match, plus one.  A
file is bounded (100 000 bytes by the source filter), so arrays of its lines are too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import fixed, text

from . import lexer

W = r"[\p{L}\p{N}_]"


def matches(files: DataFrame, pattern: str, groups: dict[str, int], around: int = 0) -> DataFrame:
    """A row for each match of the pattern in content: the groups, and its line; with ``around``, the match and so many characters before and after it."""
    p = F.lit(pattern)
    found = F.regexp_extract_all("content", p, F.lit(0))
    rows = files.withColumn("__m", found).where(F.size("__m") > 0)
    rows = rows.withColumn("__g", F.split("content", pattern, -1))
    lines = lambda a: F.transform(a, lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))))
    steps = lambda gap, own: F.transform(gap, lambda g, i: g + F.coalesce(F.get(own, i - 1), F.lit(0)))
    rows = rows.withColumns({"__gl": lines(F.col("__g")), "__ml": lines(F.col("__m"))})
    rows = rows.withColumn("__s", F.slice(steps(F.col("__gl"), F.col("__ml")), F.lit(1), F.size("__m")))
    rows = rows.withColumn("__line", F.transform(text.running_sums(F.col("__s")), lambda n: n + 1))
    rows = rows.withColumns({f"__{n}": F.regexp_extract_all("content", p, F.lit(g)) for n, g in groups.items()})
    names = list(groups)
    if around:
        start = text.running_sums(steps(F.transform(F.slice("__g", F.lit(1), F.size("__m")), F.length), F.transform("__m", F.length)))
        shown = lambda m, at: F.substr("content", F.greatest(at - around, F.lit(0)) + 1, at + F.length(m) + around - F.greatest(at - around, F.lit(0)))
        rows = rows.withColumn("__at", start).withColumn("__context", F.zip_with("__m", "__at", shown))
        names.append("context")
    zipped = F.arrays_zip("__line", *[f"__{n}" for n in names])
    keep = [c for c in files.columns if c != "content"]
    return rows.select(*keep, F.explode(zipped).alias("z")).select(*keep, F.col("z.__line").alias("line"), *[F.col(f"z.__{n}").alias(n) for n in names])


def edge(rows: DataFrame, kind: str, symbol: Column | None, target: Column, line: Column | None) -> DataFrame:
    none = F.lit(None)
    return rows.select("repo_id", F.lit(kind).alias("kind"), F.col("file_path").alias("source_file"), (none if symbol is None else symbol).cast("string").alias("source_symbol"), none.cast("string").alias("target_file"), target.alias("target_symbol"), (none if line is None else line).cast("int").alias("line"))


def imports(files: DataFrame) -> DataFrame:
    """IMPORTS of Python, JavaScript, TypeScript and Go files."""
    lang = F.col("language")
    py = F.concat(F.regexp_extract_all("content", F.lit(r"(?m)^from\s+([\p{L}\p{N}_.]+)\s+import"), F.lit(1)), F.regexp_extract_all("content", F.lit(r"(?m)^import\s+([\p{L}\p{N}_.]+)"), F.lit(1)))
    js = F.regexp_extract_all("content", F.lit(r"""(?:import|require)\s*\(?\s*['"]([^'"]+)['"]"""), F.lit(1))
    go = F.regexp_extract_all("content", F.lit(r'"([^"]*/[^"]*)"'), F.lit(1))
    found = F.when(lang == "python", py).when(lang.isin("javascript", "typescript"), js).when(lang == "go", go)
    rows = files.select("repo_id", "file_path", "language", F.explode(found).alias("target"))
    return edge(rows, "IMPORTS", None, F.col("target"), None)


def inherits(files: DataFrame) -> DataFrame:
    """INHERITS: bases of Python classes (last dotted part), and extends of others."""
    py = matches(files.where("language = 'python'"), rf"(?m)^class\s+({W}+)\(([^)]+)\)", {"child": 1, "bases": 2})
    py = py.withColumn("base", F.explode(F.split("bases", ","))).withColumn("base", F.trim(F.element_at(F.split(F.trim("base"), r"\."), -1)))
    py = py.where((F.col("base") != "") & ~F.col("base").isin(fixed.NOT_BASES))
    other = matches(files.where("language IN ('javascript', 'typescript', 'java', 'kotlin', 'csharp')"), rf"class\s+({W}+)\s+extends\s+({W}+)", {"child": 1, "base": 2})
    with_line = F.when(F.col("language").isin("javascript", "typescript"), F.col("line"))
    return edge(py, "INHERITS", F.col("child"), F.col("base"), F.col("line")).unionByName(edge(other, "INHERITS", F.col("child"), F.col("base"), with_line))


def implements(files: DataFrame) -> DataFrame:
    """IMPLEMENTS: each interface of the list after the word."""
    rows = matches(files.where("language IN ('javascript', 'typescript', 'java', 'kotlin', 'csharp')"), rf"class\s+({W}+)[^\n]*?implements\s+([\p{{L}}\p{{N}}_, ]+)", {"child": 1, "list": 2})
    rows = rows.withColumn("base", F.explode(F.split("list", ","))).withColumn("base", F.trim("base")).where("base <> ''")
    with_line = F.when(F.col("language").isin("javascript", "typescript"), F.col("line"))
    return edge(rows, "IMPLEMENTS", F.col("child"), F.col("base"), with_line)


def imported_names(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, name): local names of single-line ``from`` imports."""
    lines = F.regexp_extract_all("content", F.lit(r"(?m)^from\s+[\p{L}\p{N}_.]+\s+import\s+([^\n(]+)"), F.lit(1))
    rows = files.where("language = 'python'").select("repo_id", "file_path", F.explode(lines).alias("list")).select("repo_id", "file_path", F.explode(F.split("list", ",")).alias("item"))
    return rows.select("repo_id", "file_path", F.trim(F.element_at(F.split(F.trim("item"), " as "), -1)).alias("name")).where("name <> ''").distinct()


def calls(files: DataFrame) -> DataFrame:
    """CALLS of imported names whose first character is not a lower-case letter; one for each place."""
    found = matches(files.where("language = 'python'"), rf"({W}+)\s*\(", {"name": 1})
    found = found.where(F.substring("name", 1, 1) == F.upper(F.substring("name", 1, 1)))
    rows = found.join(imported_names(files), ["repo_id", "file_path", "name"], "left_semi")
    return edge(rows, "CALLS", None, F.col("name"), F.col("line"))


def tested_by(files: DataFrame) -> DataFrame:
    """TESTED_BY: what test files import, other than test helpers."""
    tests = files.where(text.is_test_file(F.col("file_path"), F.col("language")))
    rows = imports(tests).where(~text.any_holds(F.lower("target_symbol"), fixed.TEST_WORDS))
    return rows.select("repo_id", F.lit("TESTED_BY").alias("kind"), "source_file", text.stem(F.col("source_file")).alias("source_symbol"), F.col("source_file").alias("target_file"), "target_symbol", "line")


def edges(files: DataFrame) -> DataFrame:
    out = imports(files)
    for f in (inherits, implements, calls, tested_by):
        out = out.unionByName(f(files))
    return out


def short_params(params: Column, most: int = 6) -> Column:
    """Parameters without self, cls, starred ones and defaults; the first ``most``."""
    each = F.transform(F.split(params, ","), lambda p: F.trim(F.split(p, "=")[0]))
    kept = F.filter(each, lambda p: (p != "") & ~F.trim(F.split(p, ":")[0]).isin("self", "cls") & ~F.startswith(p, F.lit("*")))
    return F.array_join(F.slice(kept, 1, most), ", ")


def python_nodes(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of Python files with their line ranges.

    A block ends before the next line that is neither blank nor a comment and is
    indented no more: one pass from the last line to the first keeps, in a stack, the
    next line of each smaller indent.  Methods are the definitions inside the block of
    a class.  A signature goes on over lines to its closing bracket.
    """
    rows = files.where("language = 'python'").select("repo_id", "file_path", "language", F.split("content", "\n").alias("l"))

    def fact(s: Column, i: Column) -> Column:
        bare = F.ltrim(s)
        opens = s.rlike(rf"^\s*(?:async\s+)?def\s+{W}+\s*\(|^class\s+{W}+")
        return F.struct(i.alias("i"), (F.length(s) - F.length(bare)).alias("ind"), ((F.trim(s) != "") & ~F.startswith(bare, F.lit("#"))).alias("real"), opens.alias("opens"))

    def back(acc: Column, x: Column) -> Column:
        kept = F.filter(acc["stack"], lambda e: e["ind"] <= x["ind"])
        found = F.struct(x["i"].alias("i"), x["ind"].alias("ind"), F.try_element_at(kept, F.lit(-1))["i"].alias("next"))
        grown = F.struct(F.concat(kept, F.array(F.struct(x["ind"].alias("ind"), x["i"].alias("i")))).alias("stack"), F.when(x["opens"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))
        return F.when(x["real"], grown).otherwise(acc)

    start = F.struct(F.expr("cast(array() AS array<struct<ind:int,i:int>>)").alias("stack"), F.expr("cast(array() AS array<struct<i:int,ind:int,next:int>>)").alias("out"))
    rows = rows.withColumn("found", F.aggregate(F.reverse(F.transform("l", fact)), start, back, lambda acc: acc["out"]))

    def signed(i: Column) -> Column:
        rest = F.slice("l", i + 1, F.size("l"))
        more = F.slice(rest, F.lit(1), F.greatest(F.array_position(F.transform(rest, lambda s: F.contains(s, F.lit(")"))), F.lit(True)).cast("int"), F.lit(1)))
        return F.when(F.contains(F.get("l", i), F.lit(")")), F.get("l", i)).otherwise(F.array_join(F.transform(more, lambda s: F.trim(s)), " "))

    defs = rows.select("repo_id", "file_path", "language", F.explode(F.transform("found", lambda f: F.struct(f["i"].alias("i"), f["ind"].alias("ind"), F.coalesce(f["next"], F.size("l")).alias("end"), F.get("l", f["i"]).alias("s"), signed(f["i"]).alias("sig")))).alias("d")).select("repo_id", "file_path", "language", "d.*")
    is_class = F.col("s").rlike("^class")
    name = F.when(is_class, F.regexp_extract("s", rf"^class\s+({W}+)", 1)).otherwise(F.regexp_extract("s", rf"def\s+({W}+)", 1))
    before = Window.partitionBy("repo_id", "file_path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    defs = defs.withColumn("name", name).withColumn("around", F.last(F.when(is_class, F.struct("name", "end")), ignorenulls=True).over(before))
    inner = F.when(~is_class & (F.col("ind") > 0) & (F.col("i") < F.col("around.end")), F.col("around.name"))
    out = defs.withColumns({"parent_name": inner, "line_start": F.col("i") + 1, "line_end": F.col("end")})
    out = out.where((F.col("ind") == 0) | F.col("parent_name").isNotNull())
    return out.select(
        "repo_id",
        F.concat("file_path", F.lit("::"), F.when(F.col("parent_name").isNotNull(), F.concat("parent_name", F.lit("."))).otherwise(""), "name").alias("qualified_name"),
        F.when(is_class, "class").when(F.col("parent_name").isNotNull(), "method").otherwise("function").alias("kind"),
        "file_path", "name", "parent_name", "line_start", "line_end",
        F.when(~is_class, short_params(F.regexp_extract("sig", r"\(([^)]*)\)?", 1))).alias("params"),
        F.when(~is_class, F.nullif(F.trim(F.regexp_extract("sig", r"\)\s*->\s*([^:]+)", 1)), F.lit(""))).alias("return_type"),
        (text.is_test_file(F.col("file_path"), F.col("language")) & F.startswith("name", F.lit("test"))).alias("is_test"),
    )


def generic_nodes(files: DataFrame) -> DataFrame:
    """Classes and functions of languages without a reader of their own, by key words, with nominal ranges."""
    rest = files.where("language NOT IN ('python', 'javascript', 'typescript', 'dart')")
    classes = matches(rest, rf"class\s+({W}+)", {"name": 1}).withColumns({"kind": F.lit("class"), "params": F.lit(None).cast("string"), "line_end": F.col("line") + 20})
    functions = matches(rest, rf"(?:function|func|fun|fn|def)\s+({W}+)\s*\(([^)]*)\)", {"name": 1, "params": 2}).withColumns({"kind": F.lit("function"), "params": F.substring("params", 1, 60), "line_end": F.col("line") + 15})
    return _listed(classes.unionByName(functions))


LEXED = "array<struct<name:string,kind:string,params:string,line:int,line_end:int>>"


def brace_nodes(files: DataFrame, languages: list[str], kinds: list[str]) -> DataFrame:
    """What ``lexer`` finds in files of these languages, to the brace that closes it."""

    @F.pandas_udf(LEXED)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, names in batches:
            yield pd.Series([[{"name": d["name"], "kind": d["kind"], "params": d["params"], "line": d["line_start"], "line_end": d["line_end"]} for d in lexer.definitions(s or "", x) if d["kind"] in kinds] for s, x in zip(sources, names, strict=True)])

    rows = files.where(F.col("language").isin(languages))
    found = rows.select("repo_id", "file_path", F.explode(read("content", "language")).alias("d")).select("repo_id", "file_path", "d.*")
    return _listed(found.withColumn("params", F.substring("params", 1, 60)))


def script_nodes(files: DataFrame) -> DataFrame:
    """Classes, functions and arrow functions of JavaScript and TypeScript."""
    return brace_nodes(files, ["javascript", "typescript"], ["class", "function"])


def dart_nodes(files: DataFrame) -> DataFrame:
    """Classes (mixins, enums and extensions too), functions and methods of Dart."""
    return brace_nodes(files, ["dart"], ["class", "function", "method"])


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("repo_id", F.concat("file_path", F.lit("::"), "name").alias("qualified_name"), "kind", "file_path", "name", F.col("line").alias("line_start"), "line_end", "params")


def nodes(files: DataFrame) -> DataFrame:
    return python_nodes(files).unionByName(script_nodes(files), allowMissingColumns=True).unionByName(dart_nodes(files), allowMissingColumns=True).unionByName(generic_nodes(files), allowMissingColumns=True)


def key_flows(files: DataFrame) -> DataFrame:
    """Entry points: decorated routes, tasks that are sent, main files."""
    api = matches(files.where("language = 'python'"), r"""@router\.(get|post|put|patch|delete)\(\s*["']([^"']+)["']""", {"verb": 1, "path": 2})
    api = api.select("file_path", F.lit("API").alias("type"), F.concat_ws(" ", F.upper("verb"), "path").alias("flow"))
    task = matches(files, r"""send_task\(\s*["']([^"']+)["']""", {"name": 1}).select("file_path", F.lit("TASK").alias("type"), F.element_at(F.split("name", r"\."), -1).alias("flow"))
    main = files.where(text.basename(F.col("file_path")).isin("main.py", "app.py", "index.ts", "main.ts")).select("file_path", F.lit("MAIN").alias("type"), text.basename(F.col("file_path")).alias("flow"))
    return api.unionByName(task).unionByName(main)
