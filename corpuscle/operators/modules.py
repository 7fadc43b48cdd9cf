"""Modules that import each other: imports resolved to the files that they mean.

A file answers to its dotted path, and to this path without leading folders, as the
root of its packages is not known: without the first, and without more for as long as
two parts are left.  Where several files answer to a name, the one that leaves out
least, then the first by path, stands for it; so a name that all folders have
("utils") is one row and meets each import once.  An import asks for its target and,
as a target may be something inside a module, for each beginning of it; the longest
name that a file answers to counts.  Relative imports start from the folder of their
file, and mean whole paths alone.  Names meet by equality; their number is bounded by
the depth of paths.

With repo_id in both tables, imports find files of their own repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text

from .graph import both_have
from .maintenance import scope

# Files that stand for their folder.
FOLDER_FILES = ["__init__", "index"]


def path_parts(path: Column) -> Column:
    """Parts of a path without the file's ending; those of the folder for files that stand for it."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    whole = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.element_at(parts, -1).isin(FOLDER_FILES) & (F.size(parts) > 1), whole).otherwise(parts)


def dotted(parts: Column) -> Column:
    return F.array_join(parts, ".")


def file_names(files: DataFrame) -> DataFrame:
    """(repo_id if there is one, name, file_path, left_out): the names that files answer to, one file for each."""
    key = scope(files)
    rows = files.select(*key, "file_path").distinct().withColumn("p", path_parts(F.col("file_path")))
    outs = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda k: (k <= 1) | (F.size("p") - k >= 2))
    rows = rows.select(*key, "file_path", "p", F.explode(outs).alias("left_out"))
    rows = rows.select(*key, dotted(F.slice("p", F.col("left_out") + 1, F.size("p"))).alias("name"), "file_path", "left_out")
    return rows.groupBy(*key, "name").agg(F.min(F.struct("left_out", "file_path")).alias("m")).select(*key, "name", "m.*")


def import_parts(source: Column, target: Column) -> tuple[Column, Column]:
    """The parts of an import's target, from the root of the tree where it is relative; and whether it is."""
    folder = F.slice(F.split(source, "/"), F.lit(1), F.size(F.split(source, "/")) - 1)
    slashed, dots = target.rlike(r"^\.{1,2}/"), F.length(F.regexp_extract(target, r"^\.+", 0))
    ups = F.when(slashed, F.size(F.split(F.regexp_extract(target, r"^(?:\.{1,2}/)+", 0), r"\.\./")) - 1).otherwise(F.greatest(dots - 1, F.lit(0)))
    bare = F.regexp_replace(target, r"^(?:(?:\.{1,2}/)+|\.+)", "")
    rest = F.when(F.contains(target, F.lit("/")), F.split(F.regexp_replace(bare, r"\.(?:js|jsx|mjs|ts|tsx|vue|dart)$", ""), "/")).otherwise(F.split(bare, r"\."))
    relative = slashed | (dots > 0)
    base = F.when(relative, F.slice(folder, F.lit(1), F.greatest(F.size(folder) - ups, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(base, rest), lambda p: p != ""), relative


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id if both have it, source_file, target_symbol, file_path, imports): the file that each import means, and how often it stands there."""
    key = both_have(edges, files)
    names = file_names(files if key else files.select("file_path"))
    own = [*key, "source_file", "target_symbol"]
    parts, relative = import_parts(F.col("source_file"), F.col("target_symbol"))
    rows = edges.where("kind = 'IMPORTS'").groupBy(*own).agg(F.count(F.lit(1)).alias("imports")).withColumns({"p": parts, "relative": relative})
    rows = rows.where(F.size("p") > 0).select(*own, "imports", "relative", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    met = rows.withColumn("name", dotted(F.slice("p", F.lit(1), F.col("n")))).join(names, [*key, "name"])
    met = met.where((F.col("left_out") == 0) | ~F.col("relative")).where("file_path <> source_file")
    return met.groupBy(*own, "imports").agg(F.max_by("file_path", "n").alias("file_path"))


def module_graph(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id if both have it, src, dst, imports, files): how often, and from how many files, a module imports another."""
    found = resolve_imports(edges, files)
    rows = found.withColumns({"src": text.module_of(F.col("source_file")), "dst": text.module_of(F.col("file_path"))}).where("src <> dst")
    return rows.groupBy(*scope(rows), "src", "dst").agg(F.sum("imports").alias("imports"), F.count_distinct("source_file").alias("files"))


def module_importers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id if both have it, file_path, importers): imports of a file by its dotted path, or by that without its top folder."""
    key = both_have(edges, files)
    parts = F.split(F.regexp_replace("file_path", r"\.[^./]*$", ""), "/")
    names = F.array_distinct(F.array(dotted(parts), dotted(F.slice(parts, F.lit(2), F.size(parts)))))
    n = files.select(*key, "file_path").distinct().withColumn("target_symbol", F.explode(F.filter(names, lambda x: x != "")))
    return edges.where("kind = 'IMPORTS'").join(n, [*key, "target_symbol"]).groupBy(*key, "file_path").agg(F.count(F.lit(1)).alias("importers"))


def module_symbols(nodes: DataFrame, most: int = 20) -> DataFrame:
    """(repo_id if there is one, module, symbols): the first different symbol names of each module, in order of file and line."""
    key = [*scope(nodes), "module"]
    rows = nodes.withColumn("module", text.module_of(F.col("file_path")))
    seen = rows.groupBy(*key, "name").agg(F.min(F.struct("file_path", "line_start")).alias("at"))
    top = seen.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("at", "name"))).where(F.col("r") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"])
    return top.groupBy(*key).agg(listed.alias("symbols"))
