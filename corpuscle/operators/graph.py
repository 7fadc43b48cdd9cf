"""Look-ups, joins and traversals over nodes and edges held as two DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.sources.scratch import cut

from .joins import salted_join

FEW, FEW_KEYS, GRAM = 300, 1 << 16, 8


def substring_join(left: DataFrame, right: DataFrame, needle: str, hay: str) -> DataFrame:
    """left x right where the needle of left is inside the hay of right, in any letter case.

    Few distinct needles are broadcast, and right is read once where it lies.  More are joined by key.  Each needle has the
    rarest of its runs of GRAM characters (itself, if shorter), by occurrences in the
    hays; a needle with a run that no hay has is out.  Where a hay holds a needle's run, it
    answers with the part of itself around it that is as long as the needle, once for
    each shape (place of the run, length) of that run's needles, and parts meet needles
    as equal texts.  So needles that share a run are not compared one by one, and hot
    runs and hot needles are split (``salted_join``).

    Null or empty needles, and null hays, meet nothing.  Repeated rows each have their matches.
    """
    needles = left.select(F.lower(needle).alias("__n")).where("length(__n) > 0").distinct()
    head = needles.limit(FEW + 1).count()
    left = left.withColumn("__n", F.lower(needle))
    if head <= FEW:
        found = right.withColumn("__l", F.lower(hay)).join(F.broadcast(needles), F.contains("__l", "__n"))
        return left.join(found, "__n").drop("__n", "__l")
    hays = right.select(F.col(hay).alias("__h")).where("__h IS NOT NULL").distinct()
    out = salted_join(cut(_holders(needles, hays), "parts"), left, ["__n"])
    return out.join(right.withColumn("__h", F.col(hay)), "__h").drop("__n", "__h")


def _holders(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(__h, __n): the parts of hays that may be needles; a needle that a hay holds is among the hay's parts."""
    needles, hays = cut(needles, "needles"), cut(hays.withColumn("__l", F.lower("__h")), "hays")
    size = F.least(F.length("__n"), F.lit(GRAM))
    sizes = [r[0] for r in needles.select(size.alias("l")).distinct().collect()]  # at most GRAM of them
    keyed = hays.select("__h", "__l", F.inline(F.flatten(F.array(*[_runs(F.col("__l"), F.lit(n)) for n in sizes]))))
    asked = needles.select("__n", F.inline(_runs(F.col("__n"), size)))
    few = asked.select("g").distinct()
    if few.limit(FEW_KEYS + 1).count() <= FEW_KEYS:  # other runs of the hays stay where they are
        keyed = keyed.join(F.broadcast(few), "g", "left_semi")
    often = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    of_needle = asked.join(often, "g", "left")
    best = of_needle.groupBy("__n").agg(F.min(F.when(F.col("c").isNotNull(), F.struct("c", "g", "p"))).alias("m"), F.bool_and(F.col("c").isNotNull()).alias("all_known"))
    shapes = cut(best.where("all_known").select("m.c", "m.g", F.col("m.p").alias("o"), F.length("__n").alias("len")).distinct(), "shapes")
    counts = shapes.groupBy("g").agg(F.max("c").alias("__l"), F.count(F.lit(1)).alias("__r"))
    around = salted_join(keyed, shapes.drop("c"), ["g"], counts=counts).where("p >= o")
    return around.select("__h", F.substr("__l", F.col("p") - F.col("o") + 1, F.col("len")).alias("__n")).distinct()


def _runs(hay: Column, n: Column) -> Column:
    """(p, g): all runs of n characters and their places from 1; none where the text is shorter."""
    last = F.length(hay) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(i.alias("p"), F.substr(hay, i, n).alias("g")))).otherwise(F.array().cast("array<struct<p:int,g:string>>"))


def edges_to(edges: DataFrame, target: str, kind: str | None = None) -> DataFrame:
    """Edges whose target symbol or file holds the text."""
    hit = F.coalesce(text.like_any_case(F.col("target_symbol"), target), F.lit(False)) | F.coalesce(text.like_any_case(F.col("target_file"), target), F.lit(False))
    return edges.where(hit if kind is None else hit & (F.col("kind") == kind))


def importers(edges: DataFrame, module: str) -> DataFrame:
    return edges.where((F.col("kind") == "IMPORTS") & text.like_any_case(F.col("target_symbol"), module))


def callers(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where((F.col("kind") == "CALLS") & text.like_any_case(F.col("target_symbol"), symbol))


def test_edges(edges: DataFrame, path: str) -> DataFrame:
    return edges.where((F.col("kind") == "TESTED_BY") & ((F.col("source_file") == path) | F.coalesce(F.col("target_file") == path, F.lit(False))))


def nodes_at_lines(nodes: DataFrame, lo: int, hi: int) -> DataFrame:
    """Nodes whose line range overlaps lo..hi."""
    return nodes.where((F.col("line_start") <= hi) & (F.col("line_end") >= lo))


def enclosing_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge with the nodes of its source file, in its repository, around its line; all of the file's nodes if none is."""
    key = both_have(edges, nodes)
    n = nodes.select(*key, F.col("file_path").alias("source_file"), "qualified_name", "line_start", "line_end")
    inside = F.coalesce(F.col("line").between(F.col("line_start"), F.col("line_end")), F.lit(False))
    rows = edges.join(n, [*key, "source_file"]).withColumn("inside", inside)
    w = Window.partitionBy(*key, "source_file", "kind", "target_symbol", "line")
    return rows.withColumn("any_inside", F.max("inside").over(w)).where(F.col("inside") | ~F.col("any_inside")).drop("any_inside")


def both_have(left: DataFrame, right: DataFrame) -> list[str]:
    """The repository as a key, where both sides know it."""
    return ["repo_id"] if "repo_id" in left.columns and "repo_id" in right.columns else []


def of_repo(rows: DataFrame, repo: str | None) -> DataFrame:
    """The rows of one repository; all, without one."""
    return rows if repo is None else rows.where(F.col("repo_id") == repo)


def resolve_targets(edges: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """Edges (edge_id, target_symbol, target_file) with their nodes: by file and name, else by name, else by path.

    The first stage that finds a node counts; the last two give ``most`` nodes at most,
    in order of qualified_name.  With repo_id on both sides, nodes are those of the
    edge's own repository, and edge_id need be unique only there.
    """
    key = both_have(edges, nodes)
    e = cut(edges.withColumns({"name": F.element_at(F.split("target_symbol", r"\."), -1), "module_path": F.replace("target_symbol", F.lit("."), F.lit("/"))}), "edges")
    n = nodes.select(*key, "qualified_name", F.col("file_path").alias("node_file"), F.col("name").alias("node_name"))
    names = e.select(F.col("name").alias("node_name")).distinct()
    if names.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        named = cut(n.join(F.broadcast(names), "node_name", "left_semi"), "named")
    else:
        named = n = cut(n, "nodes")
    own = [*key, "edge_id"]
    first = e.select(*own, F.col("target_file").alias("node_file"), F.col("name").alias("node_name")).join(named, [*key, "node_file", "node_name"]).select(*own, "qualified_name", F.lit(1).alias("stage"))
    w = Window.partitionBy(*key, "node_name").orderBy("qualified_name")
    best = named.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    second = e.select(*own, F.col("name").alias("node_name")).join(best, [*key, "node_name"]).select(*own, "qualified_name", F.lit(2).alias("stage"))
    left = e.join(first.unionByName(second).select(*own), own, "left_anti").select(*own, "module_path")
    if key:  # distinct needles and paths meet once, then each repository's own
        needles = left.select(F.lower("module_path").alias("module_path")).distinct()
        found = substring_join(needles, n.select("node_file").distinct(), "module_path", "node_file")
        third = left.withColumn("module_path", F.lower("module_path")).join(found, "module_path").join(n, [*key, "node_file"]).drop("module_path")
    else:
        third = substring_join(left, n.select("node_file", "qualified_name"), "module_path", "node_file")
    w3 = Window.partitionBy(*own).orderBy("qualified_name")
    third = third.withColumn("r", F.row_number().over(w3)).where(F.col("r") <= most).select(*own, "qualified_name", F.lit(3).alias("stage"))
    every = first.unionByName(second).unionByName(third)
    return every.withColumn("least", F.min("stage").over(Window.partitionBy(*own))).where("stage = least").drop("least")


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) of nodes within max_depth steps of the seeds, by least depth; links: (src, dst)."""
    links = links.select("src", "dst").distinct()
    seen = seeds.select(F.col("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def trace(edges: DataFrame, nodes: DataFrame, path: str, depth: int = 2, repo: str | None = None) -> DataFrame:
    """(depth, parent, child, target) of the imports below a file; an import without a file is a leaf.

    A file is opened once, at its least depth.
    """
    spark = edges.sparkSession
    edges, nodes = of_repo(edges, repo), of_repo(nodes, repo)
    imp = cut(edges.where("kind = 'IMPORTS'").select("source_file", "target_symbol").distinct(), "imports")
    files = cut(nodes.select("file_path").distinct(), "files")
    todo = spark.createDataFrame([(path,)], "source_file string")
    seen, out = todo, None
    for level in range(1, depth + 1):
        found = cut(imp.join(todo, "source_file").withColumn("module_path", F.replace("target_symbol", F.lit("."), F.lit("/"))))
        hit = substring_join(found.select("module_path").distinct(), files, "module_path", "file_path")
        rows = found.join(hit, "module_path", "left").select(F.lit(level).alias("depth"), F.col("source_file").alias("parent"), F.col("file_path").alias("child"), F.col("target_symbol").alias("target"))
        out = rows if out is None else out.unionByName(rows)
        todo = cut(rows.where("child IS NOT NULL").select(F.col("child").alias("source_file")).distinct().join(seen, "source_file", "left_anti"))
        seen = seen.unionByName(todo)
    return out


def references(edges: DataFrame, nodes: DataFrame, hits: DataFrame, symbol: str, repo: str | None = None) -> DataFrame:
    """Tagged places of a symbol: defined, imported, called, inherited, and other texts that hold it.

    hits: (file_path) of chunks in which the symbol occurs as a phrase.
    """
    shape = lambda df, tag, f, s, line: df.select(F.lit(tag).alias("category"), f.alias("file"), s.alias("symbol"), line.cast("int").alias("line"))
    edges, nodes, none = cut(of_repo(edges, repo), "edges"), cut(of_repo(nodes, repo), "nodes"), F.lit(None)
    hits = of_repo(hits, repo)
    defined = shape(nodes.where(F.col("name") == symbol), "defined_in", F.col("file_path"), F.col("qualified_name"), F.col("line_start"))
    imported = shape(importers(edges, symbol).select("source_file").distinct(), "imported_by", F.col("source_file"), none.cast("string"), none)
    called = shape(callers(edges, symbol), "called_by", F.col("source_file"), F.col("target_symbol"), F.col("line"))
    inherited = shape(edges.where((F.col("kind") == "INHERITS") & (F.col("target_symbol") == symbol)), "inherited_by", F.col("source_file"), F.col("source_symbol"), F.col("line"))
    known = defined.unionByName(imported).unionByName(called).unionByName(inherited)
    texts = hits.select("file_path").distinct().where(~F.startswith("file_path", F.lit("__")))
    rest = texts.join(known.select(F.col("file").alias("file_path")).distinct(), "file_path", "left_anti")
    return known.unionByName(shape(rest, "referenced_in", F.col("file_path"), none.cast("string"), none))


TARGET = ["target_symbol", "target_file"]


def _sources(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, kind, target_symbol, target_file): the source nodes of few edges; nodes of their files alone are kept."""
    key = both_have(edges, nodes)
    e = cut(edges.select(*key, "kind", "source_file", *TARGET, "line").distinct(), "edges")
    files = e.select(*key, F.col("source_file").alias("file_path")).distinct()
    inside = enclosing_nodes(e, nodes.join(files, [*key, "file_path"], "left_semi"))
    return inside.select(F.col("qualified_name").alias("node"), "kind", *TARGET)


def _reached(targets: DataFrame, nodes: DataFrame, like: bool) -> DataFrame:
    """(target_symbol, target_file, node): the nodes that some targets mean."""
    if like:
        pairs = nodes.withColumn("__name", F.lower("name")).join(F.broadcast(targets), F.contains(F.lower("target_symbol"), F.col("__name")) & (F.col("__name") != ""))
        return pairs.select(*TARGET, F.col("qualified_name").alias("node")).distinct()
    e = cut(targets.withColumn("edge_id", F.to_json(F.struct(*TARGET))), "targets")
    return resolve_targets(e, nodes.drop("repo_id")).join(e, "edge_id").select(*TARGET, F.col("qualified_name").alias("node")).distinct()


def _candidates(edges: DataFrame, own: DataFrame, like: bool) -> DataFrame:
    """(target_symbol, target_file) of the edges that may mean one of few nodes: by its name, or by its path."""
    t = edges.select(*TARGET, F.lower("target_symbol").alias("low"))
    if like:
        names = own.select(F.lower("name").alias("name")).where("name <> ''").distinct()
        return t.join(F.broadcast(names), F.contains("low", "name"), "left_semi").select(*TARGET).distinct()
    names, paths = own.select("name").distinct(), own.select(F.lower("file_path").alias("path")).distinct()
    by_name = t.withColumn("name", F.element_at(F.split("target_symbol", r"\."), -1)).join(names, "name", "left_semi").select(*TARGET)
    part = F.replace("low", F.lit("."), F.lit("/"))
    by_path = t.join(F.broadcast(paths), F.contains(F.col("path"), part), "left_semi").select(*TARGET)
    return by_name.unionByName(by_path).distinct()


def symbol_links(edges: DataFrame, nodes: DataFrame, own: DataFrame, like: bool = False) -> DataFrame:
    """(src, dst, kind, direction): the links of a few nodes, ``own``, as src: an edge's source nodes and its resolved targets, both ways.

    With ``like``, a target symbol reaches every node whose name it holds.  An edge leaves
    from nodes of its own repository; targets are sought among all nodes given, so a
    caller that means one repository gives the rows of one.  Of edges and nodes, which
    are read several times and not written, only those are shuffled that may be at an
    end of such a link.
    """
    key = both_have(edges, nodes)
    some = own.select(F.col("qualified_name").alias("node")).distinct()
    files = own.select(*key, F.col("file_path").alias("source_file")).distinct()
    leaving = cut(_sources(edges.join(files, [*key, "source_file"], "left_semi"), nodes).join(some, "node", "left_semi"), "leaving")
    targets = cut(leaving.select(*TARGET).unionByName(_candidates(edges, own, like)).distinct(), "candidates")
    reached = cut(_reached(targets, nodes, like), "reached")

    def meets(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
        return rows.join(found, (rows["target_symbol"] == found["s"]) & rows["target_file"].eqNullSafe(found["f"]), how)

    ends = reached.select(F.col("target_symbol").alias("s"), F.col("target_file").alias("f"), F.col("node").alias("end"))
    mine = cut(ends.join(some.withColumnRenamed("node", "end"), "end", "left_semi"), "mine")
    arriving = _sources(meets(edges, mine.select("s", "f").distinct(), "left_semi"), nodes)
    link = lambda rows, a, b, way: rows.where(F.col(a) != F.col(b)).select(F.col(a).alias("src"), F.col(b).alias("dst"), "kind", F.lit(way).alias("direction"))
    forward = link(meets(leaving, ends, "inner"), "node", "end", "forward")
    return forward.unionByName(link(meets(arriving, mine, "inner"), "end", "node", "reverse")).distinct()


def impact(edges: DataFrame, nodes: DataFrame, path: str, max_depth: int = 3, max_nodes: int = 50, changed: tuple[int, int] | None = None, fan: int = 5, like: bool = False, repo: str | None = None) -> DataFrame:
    """Symbols within max_depth of a file's symbols, both ways, at their least distance.

    Each symbol is expanded over ``fan`` links of each direction, in order of the other
    end; of all symbols the ``max_nodes`` first by distance and name stay.  ``repo``: the
    repository that the path is in, where tables hold several.  A level looks up the
    links of its own symbols alone; as nearer symbols come first, none is begun when
    there are ``max_nodes``.  Edges and nodes are read at each level, so they should be stored.
    """
    edges, nodes = of_repo(edges, repo), of_repo(nodes, repo)
    start = nodes.where(F.col("file_path") == path)
    if changed is not None:
        start = nodes_at_lines(start, *changed)
    own = cut(start, "start")
    seen = own.select("qualified_name").distinct()
    none = own.where("false").select("*", F.lit(0).alias("distance"), F.lit("").alias("via"), F.lit("").alias("direction"))
    out, found = none, 0
    w = Window.partitionBy("src", "direction").orderBy("dst", "kind")
    for depth in range(1, max_depth + 1):
        if own.isEmpty() or found >= max_nodes:
            break
        links = symbol_links(edges, nodes, own, like).withColumn("r", F.row_number().over(w)).where(F.col("r") <= fan)
        step = links.groupBy(F.col("dst").alias("qualified_name")).agg(F.min(F.struct("direction", "kind")).alias("m")).join(seen, "qualified_name", "left_anti")
        step = cut(step.select("qualified_name", F.lit(depth).alias("distance"), F.col("m.kind").alias("via"), F.col("m.direction").alias("direction")))
        own = cut(nodes.join(step, "qualified_name"), "reached")
        out, seen, found = out.unionByName(own), seen.unionByName(step.select("qualified_name")), found + own.count()
    return out.withColumn("is_new_file", F.col("file_path") != path).orderBy("distance", "qualified_name").limit(max_nodes)


def file_links(edges: DataFrame) -> DataFrame:
    """(src, dst) between files: an edge's target file, and back."""
    known = edges.where("target_file IS NOT NULL AND target_file <> source_file").select(F.col("source_file").alias("src"), F.col("target_file").alias("dst")).distinct()
    return known.unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def two_hop(deps: DataFrame, limit: int = 25) -> DataFrame:
    """Chains a -> b -> c by falling fan-out, then links that no chain holds; the first ``limit``."""
    fan = deps.groupBy("src").agg(F.count_distinct("dst").alias("fan"))
    x, y = deps.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), deps.select(F.col("src").alias("b"), F.col("dst").alias("c")).distinct()
    chains = x.join(y, "b").where("a <> c AND a <> b AND b <> c").join(fan.withColumnRenamed("src", "a"), "a").select(F.lit(0).alias("part"), "fan", F.concat_ws(" -> ", "a", "b", "c").alias("chain"))
    held = x.join(y, "b").where("a <> c AND a <> b AND b <> c")
    inside = held.select("a", "b").unionByName(held.select(F.col("b").alias("a"), F.col("c").alias("b"))).distinct()
    single = x.where("a <> b").join(inside, ["a", "b"], "left_anti").select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("fan"), F.concat_ws(" -> ", "a", "b").alias("chain"))
    return chains.unionByName(single).orderBy("part", F.desc("fan"), "chain").limit(limit)


def overlap_join(left: DataFrame, right: DataFrame, keys: str) -> DataFrame:
    """Pairs of rows whose arrays share an element, with the number of common elements; equal rows make pairs of their own.

    A pair counts where it meets by the least of its common elements, so pairs need not
    be grouped; an element that very many rows share is split on both sides.  Null
    arrays and null elements meet nothing.
    """
    n = F.count(F.lit(1))

    def side(df: DataFrame, column: str, times: str, elements: str) -> DataFrame:
        rows = df.groupBy(*df.columns).agg(n.alias(times))
        return cut(rows.withColumn(elements, F.array_distinct(F.array_compact(column))), "side").withColumn("__k", F.explode(elements))

    a, b = side(left, f"l_{keys}", "__a", "__ls"), side(right, f"r_{keys}", "__b", "__rs")
    pairs = salted_join(a, b, ["__k"]).withColumn("__c", F.array_intersect("__ls", "__rs")).where("__k = array_min(__c)")
    times = F.explode(F.array_repeat(F.lit(0), (F.col("__a") * F.col("__b")).cast("int")))
    return pairs.select(*left.columns, *right.columns, F.size("__c").cast("long").alias("common"), times.alias("__t")).drop("__t")


def item_risk(distance: Column, tested: Column, sensitive: Column, caller_files: Column) -> Column:
    """Risk of one affected symbol: nearness, no tests, a sensitive path, many callers."""
    near = F.greatest(F.lit(0.0), 0.3 - (distance - 1) * 0.1)
    many = F.when(caller_files > 3, 0.15).when(caller_files > 1, 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), near + F.when(tested, 0.0).otherwise(0.25) + F.when(sensitive, 0.20).otherwise(0.0) + many)


def overall_risk(rows: DataFrame, sensitive_source: Column) -> DataFrame:
    """One row: counts, risk and level of a set of affected symbols (risk, tested, file_path)."""
    n = F.count(F.lit(1))
    untested = F.count_if(~F.col("tested"))
    spread = F.when(n >= 10, 0.30).when(n >= 5, 0.20).when(n >= 2, 0.10).otherwise(0.0)
    risk = F.least(F.lit(1.0), spread + F.when(F.max(sensitive_source), 0.25).otherwise(0.0) + F.coalesce(F.try_divide(untested, n) * 0.25, F.lit(0.0)) + F.coalesce(F.max("risk") * 0.20, F.lit(0.0)))
    out = rows.agg(n.alias("affected"), F.count_distinct("file_path").alias("files"), untested.alias("untested"), risk.alias("risk"))
    return out.withColumn("level", risk_level(F.col("risk")))


def impact_report(edges: DataFrame, nodes: DataFrame, path: str, changed: tuple[int, int] | None = None, most: int = 25, repo: str | None = None) -> DataFrame:
    """What a change of a file touches: each symbol with its distance, tests, callers, risk and level; riskiest first, the first ``most``.

    A file is tested if a TESTED_BY edge's target holds its module path or its stem as
    a part; its callers are the files with a CALLS edge whose target holds its stem.
    """
    edges, nodes = of_repo(edges, repo), of_repo(nodes, repo)
    hit = cut(impact(edges, nodes, path, changed=changed), "impact")
    files = cut(hit.select("file_path").distinct().withColumn("stem", text.stem(F.col("file_path"))), "files")
    parts = edges.where("kind = 'TESTED_BY'").select(F.explode(F.split("target_symbol", r"[./]")).alias("stem"))
    parts = parts.join(F.broadcast(files.select("stem").distinct()), "stem", "left_semi").distinct()
    tested = files.join(parts, "stem", "left_semi").select("file_path").withColumn("tested", F.lit(True))
    calls = edges.where("kind = 'CALLS'").select("source_file", "target_symbol")
    callers = substring_join(files, calls, "stem", "target_symbol").groupBy("file_path").agg(F.count_distinct("source_file").alias("callers"))
    rows = hit.join(tested, "file_path", "left").join(callers, "file_path", "left")
    rows = rows.withColumns({"tested": F.coalesce("tested", F.lit(False)), "callers": F.coalesce("callers", F.lit(0))})
    risk = F.round(item_risk(F.col("distance"), F.col("tested"), text.is_sensitive(F.col("file_path")), F.col("callers")), 2)
    rows = rows.withColumn("risk", risk).withColumn("level", risk_level(F.col("risk")))
    return rows.select("qualified_name", "file_path", "distance", "direction", "tested", "callers", "risk", "level").orderBy(F.desc("risk"), "distance", "qualified_name").limit(most)


def risk_level(risk: Column) -> Column:
    return F.when(risk > 0.7, "critical").when(risk > 0.5, "high").when(risk > 0.3, "medium").otherwise("low")
