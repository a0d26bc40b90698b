"""What queries write and pair on their way."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import aggregations as G
from lectern.plans import catalog
from tests.compare import SMALL


def test_tfidf_writes_tables_and_no_checkpoints(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda *_: (_ for _ in ()).throw(AssertionError("uncompressed rows on disk")))
    rows = [(d, t) for d in range(20) for t in ("every", f"w{d % 5}", f"x{d}")]
    got = G.tfidf_vocabulary(spark.createDataFrame(rows, "doc int, token string"), 20, 2, ["the"], 1.0)
    assert {r["token"]: r["freq"] for r in got.collect()} == {"every": 20, **{f"w{i}": 4 for i in range(5)}, **{f"x{i}": 1 for i in range(20)}}


def test_graph_means_pair_people_with_vectors_alone(spark, monkeypatch):
    from lectern.operators import joins as J

    seen, plain = [], J.undirected_edges
    monkeypatch.setattr(J, "undirected_edges", lambda *links: (seen.append(links[0]), plain(*links))[1])
    got: DataFrame = catalog.queries()["vec08_graph_means"](spark, SMALL)
    ids = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("vec_id").alias("rid"))
    assert got.count() == ids.count() and seen[0].join(ids, "rid", "left_anti").isEmpty()


def test_pairwise_sends_a_block_to_a_bounded_number_of_tasks(spark, monkeypatch):
    import numpy as np

    from lectern.operators import vectors as V

    monkeypatch.setattr(V, "PAIR_BLOCK", 10)
    monkeypatch.setattr(V, "PAIR_BLOCKS", 4)
    x = np.random.default_rng(6).normal(size=(130, 4))
    rows = spark.createDataFrame([(i, v.tolist(), v[:2].tolist()) for i, v in enumerate(x)], "id long, v array<double>, g array<double>")
    seen, plain = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, *a: (seen.append(df), plain(df, *a))[1])
    got = V.pairwise(rows)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = 0.7 * unit(x) @ unit(x).T + 0.3 * unit(x[:, :2]) @ unit(x[:, :2]).T
    assert {(r["a"], r["b"]): round(r["sim"], 9) for r in got.collect()} == {(a, b): round(float(want[a, b]), 9) for a in range(130) for b in range(a, 130)}
    # 33 rows a block: 4 blocks meet in 10 pairs; blocks of 10 would be sent 91 times
    assert seen[0].count() == 10
