"""The stored vector index against a search of everything."""
from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.sources import vector_index as I


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """4,000 vectors around 40 centres, and what numpy says of every 20th as a query."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 24))
    x = centre[rng.integers(0, 40, 4000)] + rng.normal(0, 0.5, (4000, 24))
    x[17] = 0
    rows = spark.createDataFrame([(i, v.tolist(), "even" if i % 2 == 0 else "odd") for i, v in enumerate(x)], "id long, v array<double>, kind string")
    path = str(tmp_path_factory.mktemp("index"))
    assert I.build(rows, path, 40) == 40
    u = I.unit(x)
    want = {}
    for q in range(0, 4000, 20):
        s = np.maximum(np.round(u @ u[q], 9), 0)
        order = [i for i in np.lexsort((np.arange(4000), -s)) if i != q][:10]
        want[q] = [(i, s[i]) for i in order]
    return path, rows.where("id % 20 = 0").select(F.col("id").alias("query"), "v"), want


def _lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query"], []).append((r["id"], pytest.approx(r["sim"], abs=1e-8)))
    return out


def test_exact_search_is_exact(spark, store, monkeypatch):
    path, queries, want = store
    monkeypatch.setattr(I, "QUERY_BLOCK", 70)
    assert _lists(I.search(spark, path, queries, 10, exact=True)) == want


def test_probes_reach_the_recall_and_read_a_share_of_the_files(spark, store):
    path, queries, want = store
    exact = I.search(spark, path, queries, 10, exact=True)
    assert I.recall(I.search(spark, path, queries, 10, probes=6), exact) >= 0.9
    assert I.recall(exact, exact) == 1.0
    one = I.search(spark, path, queries.where("query = 40"), 10, probes=3)
    cells = I.probed(spark, path, np.array([queries.where("query = 40").first()["v"]]), 3)[0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert {int(c) for c in re.search(r"PartitionFilters: \[cell#\d+ IN \(([\d,]+)\)\]", plan)[1].split(",")} == set(cells.tolist())
    files = spark.read.parquet(f"{path}/cells").select(F.input_file_name().alias("f"), "cell").distinct()
    assert files.where(F.col("cell").isin(*cells.tolist())).count() <= files.count() / 5
    assert len(one.collect()) == 10


def test_conditions_come_before_ranks(spark, store):
    path, queries, _ = store
    got = I.search(spark, path, queries.where("query = 0"), 5, exact=True, where=F.col("kind") == "odd").collect()
    assert len(got) == 5 and all(r["id"] % 2 for r in got)


def test_small_and_empty_stores(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0]), ("a", [0.5, 0.5])], "id string, v array<double>")
    I.build(rows, str(tmp_path / "s"))
    got = I.search(spark, str(tmp_path / "s"), spark.createDataFrame([("q", [2.0, 0.0])], "query string, v array<double>"), 3, exact=True).orderBy("rank").collect()
    assert [(r["id"], round(r["sim"], 4)) for r in got] == [("a", 1.0), ("b", 1.0), ("a", 0.7071)]
    assert I.search(spark, str(tmp_path / "s"), spark.createDataFrame([], "query string, v array<double>"), 3).count() == 0
    I.build(rows.limit(0), str(tmp_path / "e"))
