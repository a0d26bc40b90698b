"""Queries that used to hold or make pairs: linkage, titles."""
from __future__ import annotations

import random
import tracemalloc

import numpy as np

from lectern.operators import clustering as C
from lectern.operators import joins as J


def test_average_linkage_holds_no_table_of_pairs():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    x = centres[np.arange(2000) % 40] + rng.normal(size=(2000, 8)) * 0.02
    tracemalloc.start()
    labels = C.average_linkage(x, 0.01)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert labels == [i % 40 for i in range(2000)]
    assert peak < 4_000_000  # the table of pairs would be 32 MB


def test_average_linkage_of_equal_rows_ends():
    x = np.repeat(np.random.default_rng(4).normal(size=(7, 5)), 30, axis=0)
    assert C.average_linkage(x, 1e-6) == [i // 30 for i in range(210)]
    assert C.average_linkage(np.zeros((5, 3)), 0.5) == [0, 1, 2, 3, 4]


def test_title_and_year_without_pairs_of_a_common_title(spark):
    rng = random.Random(5)
    refs = [(i, f"t{i % 5}", rng.choice([None, 1990, 1991, 1999])) for i in range(200)]
    papers = [(1000 - i, f"t{i % 4}", rng.choice([None, 1990, 1991]) if i % 4 else 1990) for i in range(300)]
    got = J.title_year_matches(spark.createDataFrame(refs, "ref int, t string, y int"), spark.createDataFrame(papers, "id int, t string, pubyear int"))
    want = {r: [i for i, u, z in papers if t == u and (y is None or z is None or y == z)] for r, t, y in refs}
    assert {r["ref"]: r["id"] for r in got.collect()} == {r: min(ids) for r, ids in want.items() if ids}
    assert "min(id" in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[-1]
