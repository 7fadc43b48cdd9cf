"""Joins of substrings and of common elements with hot keys, against brute force."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import graph, joins, maintenance


@pytest.fixture
def split_all(monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(joins, "CELL", 4)


def check_substrings(spark, needles, hays):
    left = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "i int, needle string")
    right = spark.createDataFrame([(j, h) for j, h in enumerate(hays)], "j int, hay string")
    pairs = itertools.product(enumerate(needles), enumerate(hays))
    want = sorted((i, j) for (i, n), (j, h) in pairs if n and h and n.lower() in h.lower())
    assert sorted((r.i, r.j) for r in graph.substring_join(left, right, "needle", "hay").collect()) == want
    return want


def test_needles_that_share_a_run(spark, split_all):
    """A third of all hays hold one run that all needles have; others overlap themselves, repeat, or are short."""
    needles = [f"app/core/m{i}" for i in range(60)] + ["aaaaaaaaaa", "aaaaaaaa", "AAAaaaaaaa", "a", "m5", "m5", "", None, "no/such/place", "é/Ünï/code/x"]
    hays = [f"src/app/core/m{i}/m{i % 7}.py" for i in range(40)] + ["a" * 30, "b" * 30, "É/üNÏ/CODE/X.py", "x", "", None, "app/core/m1", "app/core/m1"] + [f"web/view{i}.ts" for i in range(60)]
    assert len(check_substrings(spark, needles, hays)) > 100


def test_needle_in_a_third_of_all_hays(spark, split_all):
    check_substrings(spark, ["one/long/needle", "one/long/needle", "else/where/here"], [f"{i}/one/long/needle/{i}" if i % 3 == 0 else f"{i}/else" for i in range(120)])


def test_no_rows(spark, split_all):
    assert check_substrings(spark, [], ["a"]) == check_substrings(spark, ["a"], []) == []


def test_hot_keys_are_dealt_over_cells(spark):
    """A key that a third of all rows have comes in parts of about the same size, and each pair meets once."""
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    a, b = joins.dealt(left, right, ["k"], 100)
    for side, rows in ((a, 1000), (b, 300)):
        sizes = [r["count"] for r in side.where("k = 0").groupBy("__i", "__j").count().collect()]
        assert len(sizes) == 10 * 3 and max(sizes) < 150
        assert side.where("k <> 0 AND (__i <> 0 OR __j <> 0)").isEmpty()
    got = joins.salted_join(left, right, ["k"], 100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


@pytest.mark.parametrize("most", [3, 1000])
def test_overlap_of_a_hot_element(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "CELL", most)
    make = lambda i: ["hot", f"s{i % 5}", None, "hot"] if i % 3 == 0 else [f"s{i % 5}", f"t{i % 7}"]
    left = [(i // 2, make(i // 2 * 2)) for i in range(60)] + [(99, None), (98, []), (97, [None])]
    right = [(f"r{i}", make(i)) for i in range(40)] + [("n", None), ("m", [None])]
    a = spark.createDataFrame(left, "id int, l_k array<string>")
    b = spark.createDataFrame(right, "u string, r_k array<string>")
    common = lambda x, y: len((set(x or []) & set(y or [])) - {None})
    want = Counter((i, u, common(x, y)) for (i, x), (u, y) in itertools.product(left, right) if common(x, y))
    assert Counter((r.id, r.u, r.common) for r in graph.overlap_join(a, b, "k").collect()) == want


@pytest.mark.parametrize("most", [None, 3])
def test_related_repos_meet_once_in_cells(spark, most):
    """Every pair comes once, whatever keys it shares and however often an id occurs; a large organisation is spread over tasks."""
    rows = [(i, f"https://host/org{i % 2}/r{i}", f"/p{i % 3}/r{i}") for i in range(40)]
    rows += [(3, "git@host:org0/x.git", "/p9/x"), (5, "git@host:org0/y.git", "/p9/y"), (5, "git@host:org0/y.git", "/p9/y"), (50, None, None), (51, "", "/r"), (52, "alone", "/r"), (None, "git@host:org0/z.git", "/p0/z"), (53, "https://host/0/a", "/1/a"), (54, "https://host/1/a", "/0/a")]
    keys = {}
    for i, remote, path in rows:
        parts = (remote or "").split("/")
        org = remote.split(":")[1].split("/")[0] if (remote or "").startswith("git@") else parts[-2] if len(parts) > 1 else ""
        keys.setdefault(i, set()).update({("org", org), ("parent", (path or "").rsplit("/", 1)[0])} - {("org", ""), ("parent", "")})
    expected = sorted((a, b) for a in keys for b in keys if a is not None and b is not None and a < b and keys[a] & keys[b])
    got = maintenance.related_repos(spark.createDataFrame(rows, "repo_id long, remote string, local_path string"), most)
    assert sorted(map(tuple, got.collect())) == expected
    if most:
        made = got.where("a < 40 AND b < 40 AND a % 2 = 1 AND b % 2 = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(made) > 2 and max(r["count"] for r in made) < sum(r["count"] for r in made) / 2
