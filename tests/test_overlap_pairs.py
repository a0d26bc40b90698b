"""Pairs by keywords in common against all pairs, short and long lists, without candidates beside the result."""
from __future__ import annotations

import random

import pytest

from lectern.operators import joins as J


def _pairs(held, least):
    return {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and len(held[a] & held[b]) >= least}


@pytest.mark.parametrize("least,longest", [(1, 5), (2, 6), (2, 20), (4, 7), (4, 20), (7, 12)])
@pytest.mark.parametrize("sets", [20, 20_000])
def test_pairs_of_short_and_long_lists(spark, monkeypatch, least, longest, sets):
    monkeypatch.setattr(J, "MOST_SETS", sets)
    rng = random.Random(least * 100 + longest)
    held = {i: set(rng.sample([f"k{n}" for n in range(24)], rng.randint(1, longest))) for i in range(80)}
    rows = [(i, n) for i, names in held.items() for n in names] + [(0, n) for n in held[0]] + [(90, None), (91, None), (None, "k1")]
    got = J.overlap_pairs(spark.createDataFrame(rows, "paper_id int, name string"), least).collect()
    assert {(r["a"], r["b"]): r["shared"] for r in got} == _pairs(held, least) and len(got) == len(_pairs(held, least))


def test_common_keywords_make_no_candidates(spark):
    # 600 papers meet in pairs of keywords at most; before, all pairs with the commonest keyword were candidates that were shuffled to be made distinct.
    rows = [(i, n) for i in range(600) for n in ("every", f"a{i // 2}", f"b{i}")]
    x = J.overlap_pairs(spark.createDataFrame(rows, "paper_id int, name string"), 2)
    assert sorted((r["a"], r["b"], r["shared"]) for r in x.collect()) == [(i, i + 1, 2) for i in range(0, 600, 2)]
    assert "hashpartitioning(a#" not in x._jdf.queryExecution().executedPlan().toString()


def test_sets_of_one_paper_go_before_the_join(spark, monkeypatch):
    from lectern.llm import common

    seen, plain = [], common.stage
    monkeypatch.setattr(common, "stage", lambda df: (seen.append(plain(df)), seen[-1])[1])
    rows = [(i, n) for i in range(300) for n in (i, i + 1, 1000 + i, 2000 + i // 100)]
    x = J.overlap_pairs(spark.createDataFrame(rows, "paper_id int, name int"), 2).collect()
    assert sorted((r["a"], r["b"], r["shared"]) for r in x) == [(i, i + 1, 2) for i in range(299) if (i + 1) % 100]
    # 1,800 sets of two, of which only those of neighbours are joined
    assert seen[-1].count() == 2 * 297
