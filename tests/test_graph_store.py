"""The stored graph: loads merge, reruns change nothing, failures and readers keep the version before."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.sources.graph_store import GraphStore


def nodes(spark, *rows):
    return spark.createDataFrame(rows, "kind string, key string, title string, year int")


def edges(spark, *rows):
    return spark.createDataFrame(rows, "kind string, src string, dst string, pos int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_two_loads_merge_and_a_rerun_changes_nothing(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), 8)
    assert store.read("nodes") is None and store.manifest()["version"] == 0
    first = (nodes(spark, ("Paper", "1", "one", 2000), ("Paper", "2", "two", None), ("Author", "1", "Kim", None)), edges(spark, ("AUTHORED", "1", "1", 1)))
    second = (nodes(spark, ("Paper", "2", None, 2002), ("Paper", "3", "three", 2003), ("Paper", "3", "also", 2001), (None, "9", "", 1)), edges(spark, ("AUTHORED", "1", "2", 1), ("AUTHORED", "1", "1", 2)))
    assert store.merge(*first) == 1
    assert store.merge(*first) == 1 and store.versions() == [1]
    assert store.merge(*second) == 2
    assert rows(store.read("nodes")) == [("Author", "1", "Kim", None), ("Paper", "1", "one", 2000), ("Paper", "2", None, 2002), ("Paper", "3", "three", 2003)]
    assert rows(store.read("edges")) == [("AUTHORED", "1", "1", 2), ("AUTHORED", "1", "2", 1)]
    assert len(rows(store.read("nodes", 1))) == 3
    assert store.merge(*second) == 2


def test_unchanged_buckets_keep_their_files(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), 16)
    store.merge(nodes(spark, *[("Paper", str(i), "t", i) for i in range(200)]))
    before = store.manifest()["tables"]["nodes"]["buckets"]
    store.merge(nodes(spark, *[("Paper", str(i), "t" if i else "new", i) for i in range(60)]))
    after = store.manifest()["tables"]["nodes"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.read("nodes").count() == 200
    store.merge(nodes(spark, ("Paper", "5", "t", None)))
    store.vacuum(1)
    assert store.read("nodes").count() == 200 and len(store.versions()) == 1
    named = {f.split("/")[1] for f in store.manifest()["tables"]["nodes"]["buckets"].values()}
    assert {f.name for f in (tmp_path / "g" / "data").iterdir()} == named


def test_a_failed_load_leaves_the_version_before(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), 4)
    store.merge(nodes(spark, ("Paper", "1", "one", 1)), edges(spark, ("CITES", "1", "1", 0)))
    reader = store.read("nodes")
    bad = edges(spark, ("CITES", "1", "2", 1)).withColumn("pos", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        store.merge(nodes(spark, ("Paper", "2", "two", 2)), bad)
    assert store.versions() == [1] and rows(store.read("nodes")) == rows(reader) == [("Paper", "1", "one", 1)]


def test_only_one_of_two_loads_commits(spark, tmp_path):
    a, b = GraphStore(spark, str(tmp_path / "g"), 4), GraphStore(spark, str(tmp_path / "g"), 4)
    a.merge(nodes(spark, ("Paper", "1", "one", 1)))
    seen = b.manifest()
    a.merge(nodes(spark, ("Paper", "2", "two", 2)))
    b.manifest = lambda version=None: seen
    with pytest.raises(RuntimeError, match="version 2"):
        b.merge(nodes(spark, ("Paper", "3", "three", 3)))
    assert a.versions() == [1, 2] and len(rows(a.read("nodes"))) == 2


def test_edges_without_their_nodes_and_new_columns(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), 4)
    ends = {"HAS": ("Paper", "Keyword")}
    n = nodes(spark, ("Paper", "1", "one", 1), ("Keyword", "k", None, None))
    store.merge(n, edges(spark, ("HAS", "1", "k", 1), ("HAS", "1", "absent", 2), ("HAS", "k", "1", 3), ("OTHER", "x", "y", 4)), ends)
    assert rows(store.read("edges")) == [("HAS", "1", "k", 1), ("OTHER", "x", "y", 4)]
    store.merge(spark.createDataFrame([("Paper", "1", 0.5), ("Paper", "2", 0.25)], "kind string, key string, score double"))
    got = rows(store.read("nodes").where("kind = 'Paper'").select("key", "title", "score"))
    assert got == [("1", "one", 0.5), ("2", None, 0.25)]
    assert rows(store.read("nodes").where("kind = 'Keyword'").select("key", "score")) == [("k", None)]
    assert store.merge(n.limit(0), None) == 2
