"""Index maintenance: walks, snapshot differences, upserts, registry and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import fixed, text
from corpuscle.operators.joins import paired


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder on any store, with their texts; those of a size out of bounds are not read, bytes that are no UTF-8 become U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = root.split("://")[-1].rstrip("/")
    below = F.substr("path", F.locate(bare, F.col("path")) + len(bare) + 1)  # what lies above the root does not count
    rows = raw.where((F.col("length") >= 1) & (F.col("length") <= fixed.MAX_FILE_SIZE)).where(is_wanted(below))
    return rows.select(F.col("path").alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), short_hash_of_bytes(F.col("content")).alias("file_hash"), F.col("modificationTime").cast("double").alias("last_modified"))


def short_hash_of_bytes(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def is_wanted(path: Column) -> Column:
    """Neither below a folder that is left out or hidden, nor of a suffix that is, nor a hidden file."""
    parts = F.split(F.regexp_replace(path, "^[a-z]+:/*", "/"), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(folders, lambda p: p.isin(fixed.SKIP_DIRS) | (F.startswith(p, F.lit(".")) & (F.length(p) > 1)))
    return ~bad & ~text.suffix(path).isin(fixed.SKIP_SUFFIXES) & ~F.startswith(text.basename(path), F.lit("."))


def priority(path: Column, recent: Column | None = None) -> Column:
    """0: named documents, 1: files changed lately, 2: below src, app or lib, 3: the rest."""
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in fixed.PRIORITY_PARTS]))
    out = F.when(text.basename(path).isin(fixed.PRIORITY_FILES), 0)
    out = out.when(F.coalesce(recent, F.lit(False)), 1) if recent is not None else out
    return out.when(inside, 2).otherwise(3)


def outside_environments(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Files that lie in no folder with a marker of a virtual environment: pyvenv.cfg, bin/python or lib/python*/site-packages."""
    root = F.nullif(F.regexp_extract(path, r"^(.*?)/(?:pyvenv\.cfg$|bin/python$|lib/python[^/]*/site-packages/)", 1), F.lit(""))
    marked = files.select(root.alias("__env")).where("__env IS NOT NULL").distinct()
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = files.select(F.col(path).alias("__p"), F.explode(above).alias("__env")).join(marked, "__env").select("__p").distinct()
    return files.join(inside, files[path] == inside["__p"], "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "file_path", value: str = "file_hash") -> DataFrame:
    """Every key of either snapshot with its status: added, updated, removed or unchanged."""
    o, n = old.select(F.col(key), F.col(value).alias("__o")), new.select(F.col(key), F.col(value).alias("__n"))
    status = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.col("__o") != F.col("__n"), "updated").otherwise("unchanged")
    return o.join(n, key, "full").select(key, status.alias("status"))


def reconcile_counts(diff: DataFrame) -> DataFrame:
    """One row: how many keys of a ``snapshot_diff`` were added, updated, removed and left unchanged."""
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "removed", "unchanged")])


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (repository, path, hash) is not indexed yet; only these need chunking."""
    key = [*scope(files), "file_path", "file_hash"]
    return files.join(known.select(*key), key, "left_anti")


def scope(rows: DataFrame) -> list[str]:
    """The repository, where rows have one: paths and names are unique within it alone."""
    return ["repo_id"] if "repo_id" in rows.columns else []


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, the later of a key; new rows are later than old ones."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def replace_nodes(old: DataFrame, new: DataFrame, order: str, path: str = "file_path") -> DataFrame:
    """As replace_files; of rows of a repository with one qualified name the last in the order stays."""
    w = Window.partitionBy(*scope(old), "qualified_name").orderBy(F.desc("__new"), F.desc(order))
    both = old.join(new.select(*scope(old), path).distinct(), [*scope(old), path], "left_anti").withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def replace_files(old: DataFrame, new: DataFrame, path: str = "file_path") -> DataFrame:
    """Old rows of files, by repository and path, that new has no rows of, and all new ones."""
    return old.join(new.select(*scope(old), path).distinct(), [*scope(old), path], "left_anti").unionByName(new)


def keep_first_edges(edges: DataFrame, order: str) -> DataFrame:
    """The first of equal edges of a repository; edges without a source symbol are places, and all stay."""
    w = Window.partitionBy(*scope(edges), "kind", "source_file", "source_symbol", "target_symbol").orderBy(order)
    return edges.withColumn("__r", F.row_number().over(w)).where("__r = 1 OR source_symbol IS NULL").drop("__r")


def write_partitioned(rows: DataFrame, folder: str, by: str = "repo_id") -> None:
    """Replaces the partitions that ``rows`` has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)


def register(repos: DataFrame, seen: DataFrame) -> DataFrame:
    """Repositories with the union of their known and seen paths, in order. Both: repo_id, local_paths."""
    both = repos.unionByName(seen)
    return both.groupBy("repo_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("local_paths")))).alias("local_paths"))


def drop_repo(workspaces: DataFrame, repo: str) -> DataFrame:
    return workspaces.withColumn("repo_ids", F.array_remove("repo_ids", repo))


def forget_repo(spark: SparkSession, repo: str, repos: DataFrame, mappings: DataFrame, workspaces: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The registry without a repository: its row, its paths and its places in workspaces; its partition of a stored table goes too."""
    if folder is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/repo_id={repo}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return repos.where(F.col("repo_id") != repo), mappings.where(F.col("repo_id") != repo), drop_repo(workspaces, repo)


def save_workspace(workspaces: DataFrame, name: str, repo_ids: list[str]) -> DataFrame:
    """Workspaces (name, repo_ids) with the repositories added to the one of this name, which is made if it is new."""
    added = workspaces.sparkSession.createDataFrame([(name, repo_ids)], "name string, repo_ids array<string>")
    both = workspaces.select("name", "repo_ids", F.lit(0).alias("at")).unionByName(added.withColumn("at", F.lit(1)))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "repo_ids"))), lambda x: x["repo_ids"]))
    return both.groupBy("name").agg(F.array_distinct(listed).alias("repo_ids"))


def map_workspaces(mappings: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Path mappings (path, repo_id) with the workspace of their repository: the first by name; null if it is in none."""
    member = workspaces.select("name", F.explode("repo_ids").alias("repo_id")).groupBy("repo_id").agg(F.min("name").alias("workspace"))
    return mappings.join(member, "repo_id", "left")


def search_targets(repos: DataFrame, workspaces: DataFrame, workspace: str | None = None, repo: str | None = None, cwd: str | None = None) -> DataFrame:
    """(repo_id, status): which repositories a search reads: those of the workspace, else the repository, else what the folder belongs to.

    One row says what is wrong where nothing is found: unknown workspace, empty
    workspace, unknown repository, unindexed folder, or no target.
    """
    known = repos.select("repo_id").distinct()
    if workspace is not None:
        own = workspaces.where(F.col("name") == workspace)
        out, wrong = own.select(F.explode("repo_ids").alias("repo_id")).join(known, "repo_id", "left_semi"), F.when(own.agg(F.count(F.lit(1))).scalar() == 0, "unknown workspace").otherwise("empty workspace")
    elif repo is not None:
        out, wrong = known.where(F.col("repo_id") == repo), F.lit("unknown repository")
    elif cwd is not None:
        at = resolve_context(repos.sparkSession.createDataFrame([(cwd,)], "path string"), repos, workspaces)
        by_workspace = at.where("status = 'workspace'").join(workspaces.select(F.col("name").alias("workspace"), F.explode("repo_ids").alias("member")), "workspace").select(F.col("member").alias("repo_id"))
        out, wrong = at.where("status = 'repo'").select("repo_id").unionByName(by_workspace), F.lit("unindexed folder")
    else:
        out, wrong = known.where("false"), F.lit("no target")
    out = out.distinct().withColumn("status", F.lit("found"))
    none = out.agg(F.count(F.lit(1)) == 0).scalar()
    return out.unionByName(repos.sparkSession.range(1).select(F.lit(None).cast("string").alias("repo_id"), wrong.alias("status")).where(none))


def repo_list(repos: DataFrame, chunks: DataFrame) -> DataFrame:
    """Repositories by name, with the files and chunks that are indexed of each."""
    held = chunks.groupBy("repo_id").agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"))
    return repos.join(held, "repo_id", "left").fillna(0, ["files", "chunks"]).orderBy("name", "repo_id")


def history(spark: SparkSession, path: str, last: int = 5) -> DataFrame:
    """(file, role, text) of saved conversations: one JSONL file, or the ``last`` by name of a folder; lines that are no JSON objects are left out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in store.listStatus(at) if f.getPath().getName().endswith(".jsonl"))[-last:]
    kinds = "role string, text string, content string, message struct<role: string, content: string>, __bad string"
    if not names:
        return spark.createDataFrame([], "file string, role string, text string")
    rows = spark.read.schema(kinds).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(names)
    rows = rows.select("*", F.col("_metadata.file_name").alias("file")).where("__bad IS NULL")
    return rows.select("file", F.coalesce("role", "message.role").alias("role"), F.coalesce("text", "content", "message.content").alias("text")).where("role IS NOT NULL AND text IS NOT NULL")


def organisation(remote: Column) -> Column:
    """Owner of a remote address: after the colon of the short form, else the part before the last."""
    parts = F.split(remote, "/")
    return F.when(remote.rlike(r"^[^/]+@[^/]+:"), F.regexp_extract(remote, r":([^/]+)/", 1)).when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")


def repo_id(remote: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the address in lower case, without .git."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(remote), r"(\.git)?/?$", "").cast("binary"), 256), 1, 12)


def prefix_match(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root) where the root is an ancestor of the path or the path itself; by key, not by product."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return paths.withColumn("root", F.explode(above)).join(roots.select("root").distinct(), "root")


def resolve_context(asked: DataFrame, repos: DataFrame, workspaces: DataFrame) -> DataFrame:
    """For each path: its workspace or repository, found exactly, else by the longest ancestor, else unindexed."""
    hit = prefix_match(asked.select("path"), repos.select(F.col("local_path").alias("root")))
    hit = hit.join(repos.select(F.col("local_path").alias("root"), "repo_id"), "root").withColumn("exact", F.col("root") == F.col("path"))
    w = Window.partitionBy("path").orderBy(F.desc("exact"), F.desc(F.length("root")), "repo_id")
    best = hit.withColumn("r", F.row_number().over(w)).where("r = 1").select("path", "repo_id", "exact")
    member = workspaces.select("name", F.explode("repo_ids").alias("repo_id")).groupBy("repo_id").agg(F.min("name").alias("workspace"))
    out = asked.select("path").distinct().join(best, "path", "left").join(member, "repo_id", "left")
    status = F.when(F.col("repo_id").isNull(), "unindexed").when(F.col("exact") & F.col("workspace").isNotNull(), "workspace").otherwise("repo")
    return out.select("path", "repo_id", "workspace", status.alias("status"))


def related_repos(repos: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs of repositories with the same parent folder or organisation, each where its least common key is.

    The result grows with the square of an organisation; ``most`` rows of one meet in a task.
    """
    key = lambda kind, value: F.when(value != "", F.concat(F.lit(kind), value))
    r = repos.where("repo_id IS NOT NULL").select("repo_id", F.explode(F.array(key("0", organisation(F.col("remote"))), key("1", F.regexp_replace("local_path", "/[^/]*$", "")))).alias("key"))
    r = r.where("key IS NOT NULL").groupBy("repo_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    r = r.select("repo_id", "keys", F.posexplode("keys").alias("at", "key"))
    met = paired(r, "key", "repo_id", most)
    # the least key of either is the least in common
    least = (F.col("x.at") == 0) | (F.col("y.at") == 0) | (F.element_at(F.array_intersect("x.keys", "y.keys"), 1) == F.col("x.key"))
    return met.where(least).select(F.least("x.repo_id", "y.repo_id").alias("a"), F.greatest("x.repo_id", "y.repo_id").alias("b"))
