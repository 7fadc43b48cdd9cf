"""Impact by levels against brute force over all links; what it writes on the way."""

import random
from collections import defaultdict

import pytest

from corpuscle.operators import graph

EDGES = "repo_id string, kind string, source_file string, source_symbol string, target_file string, target_symbol string, line int"
NODES = "repo_id string, qualified_name string, kind string, file_path string, name string, line_start int, line_end int"


def links_by_hand(edges, nodes, like):
    every, out = sorted(nodes, key=lambda n: n[1]), defaultdict(set)
    for repo, kind, source, _, file, symbol, line in edges:
        around = [n for n in nodes if (n[0], n[3]) == (repo, source)]
        inside = [n for n in around if line is not None and n[5] <= line <= n[6]]
        name, path = symbol.split(".")[-1], symbol.replace(".", "/").lower()
        if like:
            ends = [n for n in nodes if n[4] and n[4].lower() in symbol.lower()]
        else:
            ends = [n for n in nodes if (n[3], n[4]) == (file, name)] or [n for n in every if n[4] == name][:3] or [n for n in every if path and path in n[3].lower()][:3]
        for a in inside or around:
            for b in ends:
                if a[1] != b[1]:
                    out[a[1], "forward"].add((b[1], kind))
                    out[b[1], "reverse"].add((a[1], kind))
    return out


def impact_by_hand(edges, nodes, path, like, most):
    links = links_by_hand(edges, nodes, like)
    seen = last = {n[1] for n in nodes if n[3] == path}
    rows = []
    for depth in (1, 2, 3):
        step = defaultdict(list)
        for src in last:
            for way in ("forward", "reverse"):
                for dst, kind in sorted(links[src, way])[:5]:
                    step[dst].append((way, kind))
        last = set(step) - seen
        seen = seen | last
        rows += sorted((depth, q, min(step[q])[1], min(step[q])[0]) for q in last)
    return rows[:most]


@pytest.mark.parametrize("seed,like,few,most", [(1, False, 300, 50), (2, False, 0, 50), (3, True, 300, 50), (4, False, 300, 3)])
def test_levels_equal_brute_force(spark, monkeypatch, seed, like, few, most):
    r = random.Random(seed)
    monkeypatch.setattr(graph, "FEW", few)
    if not few:
        monkeypatch.setattr(graph, "FEW_KEYS", 2)
    files = [f"{a}/{b}.py" for a in ("App/core", "app/web", "lib") for b in ("m1", "m12", "token", "page")]
    names = "run go Token m1 page helper aid use".split()
    nodes = []
    for f in files:
        for i, name in enumerate(r.sample(names, 3)):
            nodes.append(("r", f"{f}::{name}", "function", f, name, 10 * i, 10 * i + 8))
    target = lambda: r.choice([r.choice(names), "x." + r.choice(names), "app.core.m1", "App.web", "lib.page", "json", "tokens", "app"])
    edges = [("r", r.choice(["CALLS", "IMPORTS"]), r.choice(files), None, r.choice([None, None, *files]), target(), r.choice([None, 3, 9, 14, 25, 99])) for _ in range(30)]
    got = graph.impact(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), files[0], max_nodes=most, like=like)
    want = impact_by_hand(edges, nodes, files[0], like, most)
    assert [(x.distance, x.qualified_name, x.via, x.direction) for x in got.collect()] == want and len(want) >= 3


def test_only_links_of_the_levels_are_written(spark, monkeypatch):
    """Other files, however many, are neither resolved nor copied."""
    rows, cut = [], graph.cut

    def counted(df, *name):
        out = cut(df, *name)
        rows.append(out.count())
        return out

    nodes = [("r", f"a/f{i}.py::g{i}", "function", f"a/f{i}.py", f"g{i}", 1, 9) for i in range(400)]
    edges = [("r", kind, f"a/f{i}.py", None, None, f"g{i + 1}", 2) for i in range(399) for kind in ("CALLS", "TESTED_BY")]
    e, n = spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES)
    monkeypatch.setattr(graph, "cut", counted)
    report = graph.impact_report(e, n, "a/f200.py").collect()
    assert sorted((r.distance, r.qualified_name) for r in report) == sorted((abs(i - 200), f"a/f{i}.py::g{i}") for i in range(197, 204) if i != 200)
    assert max(rows) < 30
