"""Graph embedding by sampled neighbourhoods: gradients, samples, and links that were held out."""
from __future__ import annotations

import numpy as np
import pytest

from lectern.operators import aggregations as A
from lectern.operators import clustering as C
from lectern.operators import graph_embedding as G


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    c = G.Config(hidden=5, size=4)
    w = G.Weights.start(3, c)
    w.b1 += rng.normal(0, 0.1, 5)
    x, hop = rng.normal(size=(12, 3)), rng.normal(size=(12, 2, 6))

    def loss(w):
        z, kept = G.forward(w, x, hop)
        value, d = G.edge_gradients(z.reshape(3, 4, 4))
        return value.sum(), z, kept, d.reshape(12, 4)

    _, z, kept, d = loss(w)
    got, flat = G.backward(w, hop, z, kept, d).flat(), w.flat()
    for i in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert got[i] == pytest.approx((loss(w.like(flat + step))[0] - loss(w.like(flat - step))[0]) / 2e-5, rel=1e-3, abs=1e-6)


def test_neighbours_are_drawn_with_replacement_and_by_seed(spark):
    nodes = spark.range(5).toDF("n")
    lists = G.neighbours(spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (3, 0)], "n long, near long"))
    draw = lambda *salt: sorted(map(tuple, G.drawn(nodes, lists, 40, *salt).collect()))
    rows = draw(7)
    assert rows == draw(7) != draw(8) and len(rows) == 200
    of = {k: {near for n, _, near in rows if n == k} for k in range(5)}
    assert of == {0: {1, 2, 3}, 1: {0}, 2: {0}, 3: {0}, 4: {4}}


def _planted(spark):
    """Nodes of six groups; four features tell the groups, twelve louder ones say nothing. Links within groups, of which a tenth is held out, and absent pairs."""
    rng = np.random.default_rng(5)
    group = rng.integers(0, 6, 300)
    pairs = [(i, j) for i in range(300) for j in range(i) if rng.random() < (0.15 if group[i] == group[j] else 0.005)]
    held = [p for p in pairs if rng.random() < 0.1]
    kept = sorted(set(pairs) - set(held))
    absent = []
    while len(absent) < 4 * len(held):
        i, j = (int(x) for x in rng.integers(0, 300, 2))
        if i > j and (i, j) not in set(pairs):
            absent.append((i, j))
    centre = rng.normal(size=(6, 4))
    vectors = spark.createDataFrame([(i, [*(centre[group[i]] + rng.normal(0, 0.6, 4)).tolist(), *rng.normal(0, 2, 12).tolist()]) for i in range(300)], "id long, v array<double>")
    edges = lambda x: spark.createDataFrame([(int(a), int(b)) for a, b in x], "a long, b long")
    return vectors, edges(kept), edges(held), edges(absent)


def test_held_out_links_beat_the_means(spark):
    vectors, kept, held, absent = _planted(spark)
    area = lambda v: A.auc(G.link_scores(v, held, absent)).first()["auc"]
    trained, losses = G.train(vectors, kept, G.Config(hidden=32, size=16, samples=(10, 5), epochs=8, steps=3, rate=0.02))
    assert losses[-1] < losses[0]
    means, got = area(C.neighbour_means(vectors, kept, 2)), area(trained)
    print("auc", got, "of means", means, "losses", losses)
    assert got > means and got > 0.7
    norms = {round(float(np.linalg.norm(r["v"])), 6) for r in trained.collect()}
    assert norms == {1.0} and trained.count() == 300


def test_without_edges_or_nodes(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    none = spark.createDataFrame([], "a long, b long")
    c = G.Config(hidden=4, size=3, samples=(2, 2), epochs=1, steps=1)
    out, losses = G.train(vectors, none, c)
    assert out.count() == 2 and losses == [0.0]
    assert G.train(vectors.limit(0), none, c)[0].count() == 0
    loops = spark.createDataFrame([(1, 1), (1, 9), (2, 1), (1, 2)], "a long, b long")
    assert G.train(vectors, loops, c)[0].count() == 2
