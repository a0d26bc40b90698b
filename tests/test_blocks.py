"""Pairs by shared items in blocks against all pairs, and edges that stay a forest."""
from __future__ import annotations

import random

import numpy as np
import pytest

from lectern.operators import blocks as B
from lectern.operators import identity as I


def _world(rng, people, names, papers):
    who = [(f"r{i:03d}", f"n{i % names}") for i in range(people)]
    return who, [(r, p) for r, _ in who for p in rng.sample(range(papers), rng.randint(0, min(12, papers)))]


def _shared(who, links):
    held = {r: {p for q, p in links if q == r} for r, _ in who}
    return {(a, b): held[a] & held[b] for a, x in who for b, y in who if a < b and x == y and held[a] & held[b]}


def _groups(who, edges):
    of = {r: r for r, _ in who}
    for _ in who:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    return of


def _edges(monkeypatch, run):
    """The edges that reach the components."""
    seen, plain = [], I.components
    monkeypatch.setattr(I, "components", lambda nodes, edges: (seen.append(edges.count()), plain(nodes, edges))[1])
    return {r["rid"]: r["canonical"] for r in run().collect()}, seen[0]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(B, "MEMBERS", 9)


def _frames(spark, who, links):
    return spark.createDataFrame(who, "rid string, name string"), spark.createDataFrame(links, "rid string, paper_id int")


@pytest.mark.parametrize("papers", [20, 400])
def test_shared_items_by_tile_are_all_of_them(papers):
    rng = np.random.default_rng(papers)
    own = [rng.choice(papers, rng.integers(0, 15), replace=False) for _ in range(60)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    rows, cols = rng.permutation(60)[:25], rng.permutation(60)[:40]
    got = B.shared(B.Sets(starts, np.concatenate(own), papers), rows, cols)
    assert got.tolist() == [[len(set(own[a]) & set(own[b])) for b in cols] for a in rows]


def test_pairs_of_many_blocks(spark, small):
    who, links = _world(random.Random(1), 90, 3, 30)
    got = I.shared_papers(*_frames(spark, who + [("r999", None)], links + [("r999", 1), ("r001", None)]))
    assert {(r["a"], r["b"]): r["shared"] for r in got.collect()} == {k: len(v) for k, v in _shared(who, links).items()}


@pytest.mark.parametrize("least", [3, 6])
def test_duplicate_groups_of_many_blocks_from_a_forest(spark, small, monkeypatch, least):
    who, links = _world(random.Random(2), 90, 3, 30)
    got, edges = _edges(monkeypatch, lambda: I.duplicate_groups(*_frames(spark, who, links), least))
    assert got == _groups(who, [k for k, v in _shared(who, links).items() if len(v) >= least])


def test_a_crowded_name_sends_no_pairs_to_the_components(spark, monkeypatch):
    who, links = [(f"r{i:03d}", "n") for i in range(300)], [(f"r{i:03d}", p) for i in range(300) for p in range(4)]
    got, edges = _edges(monkeypatch, lambda: I.duplicate_groups(*_frames(spark, who, links), 4))
    assert set(got.values()) == {"r000"} and edges < 300


def test_groups_without_papers_that_list_the_name_twice(spark, small, monkeypatch):
    who, links = _world(random.Random(3), 90, 3, 30)
    twice = [(p, f"n{p % 3}") for p in range(30)] + [(0, "n0")]
    bad = lambda a, v: sum((p, dict(who)[a]) in twice for p in v)
    got, _ = _edges(monkeypatch, lambda: I.duplicate_groups(*_frames(spark, who, links), 3, spark.createDataFrame(twice, "paper_id int, name string")))
    want = _groups(who, [(a, b) for (a, b), v in _shared(who, links).items() if len(v) >= 3 and 2 * bad(a, v) < len(v)])
    assert got == want and want != _groups(who, [k for k, v in _shared(who, links).items() if len(v) >= 3])


def test_papers_twice_are_counted_within_a_name(spark, monkeypatch):
    # 300 people of as many names on one paper: no pair of them is of one name, and none must be made.
    who, links = [(f"r{i:03d}", f"n{i}") for i in range(300)], [(f"r{i:03d}", 1) for i in range(300)]
    people, held = _frames(spark, who, links)
    plans, plain = [], I.components
    monkeypatch.setattr(I, "components", lambda nodes, edges: (plans.append(edges._jdf.queryExecution().toString()), plain(nodes, edges))[1])
    twice = spark.createDataFrame([(1, f"n{i}") for i in range(300)], "paper_id int, name string")
    assert all(r["rid"] == r["canonical"] for r in I.duplicate_groups(people, held, 1, twice).collect())
    assert "(paper_id" not in "".join(x for x in plans[0].splitlines() if "Join" in x and "a#" in x) and "hashpartitioning(a#" not in plans[0]


def test_same_name_merge_from_a_forest(spark, small, monkeypatch):
    who, edges = _world(random.Random(4), 90, 3, 24)
    inst = {r: ("가람대학교", "", f"Inst {r}")[int(r[1:]) % 3] for r, _ in who}
    people = spark.createDataFrame([(r, n, inst[r]) for r, n in who], "rid string, name string, institution string")
    got, sent = _edges(monkeypatch, lambda: I.same_name_merge(people, spark.createDataFrame(edges, "rid string, other int"), 6, 4))
    ko = lambda r: inst[r].startswith("가")
    near = [(a, b) for (a, b), v in _shared(who, edges).items() if len(v) >= (4 if ko(a) != ko(b) else 6)]
    near += [(a, b) for a, x in who for b, y in who if a < b and x == y and inst[a] and inst[b] and (inst[a] in inst[b] or inst[b] in inst[a])]
    assert got == _groups(who, near)


def test_shared_people_of_a_crowded_name_send_no_pairs(spark, monkeypatch):
    people = spark.createDataFrame([(i, "n", "") for i in range(300)], "rid int, name string, institution string")
    got, sent = _edges(monkeypatch, lambda: I.same_name_merge(people, spark.createDataFrame([(i, o) for i in range(300) for o in range(3)], "rid int, other int"), 3))
    assert set(got.values()) == {0} and sent < 300


def test_weak_pairs_of_many_blocks_without_a_join_of_pairs(spark, small):
    who, links = _world(random.Random(5), 90, 3, 30)
    ids = {r: i % 4 for i, (r, _) in enumerate(who) if i % 5}
    got = I.weak_pairs(*_frames(spark, who, links), spark.createDataFrame(list(ids.items()), "rid string, author_id int"), 3)
    verdict = lambda a, b: "undecided" if a not in ids or b not in ids else "same" if ids[a] == ids[b] else "different"
    assert sorted(map(tuple, got.collect())) == sorted((a, b, verdict(a, b)) for (a, b), v in _shared(who, links).items() if len(v) < 3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
