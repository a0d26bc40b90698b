"""Growing graphs, owned filters, keyword slots, pairwise products and clusters against plain versions."""
from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from lectern.operators import clustering as C
from lectern.operators import identity as I
from lectern.operators import researchers as R
from lectern.operators import sessions as S
from lectern.operators import vectors as V


def _graph(rng, nodes, degree):
    return [(a, b, rng.choice([None, 1990 + b % 30]), f"t{b % 7}") for a in range(nodes) for b in rng.sample(range(nodes), rng.randint(0, degree)) if a != b]


def _grow(steps, start, inside, outside, k, most):
    order = lambda rows: sorted(rows, key=lambda e: (e[2] is None, -(e[2] or 0), e[3], e[1]))
    out, shown = [], {}
    for session, step, node in sorted(steps):
        seen = shown.setdefault(session, set(start.get(session, ())))
        seen.add(node)
        own = order(e for e in inside if e[0] == node)
        near = [e[1] for e in own]
        near += [e[1] for e in order(e for e in outside if e[0] == node) if e[1] not in near]
        room = most - len(seen)
        if room <= 0:
            out.append((session, step, node, [], True, True))
            continue
        left = [n for n in near if n not in seen]
        added = left[: min(k, room)]
        more = len(left) > len(added)
        out.append((session, step, node, added, more, room < k and more))
        seen.update(added)
    return out


@pytest.mark.parametrize("k,most", [(6, 100), (2, 9)])
def test_growing_graphs_up_to_the_limit(spark, k, most):
    rng = random.Random(k)
    inside, outside = _graph(rng, 150, 40), _graph(rng, 150, 20)
    steps = [(s, i, rng.randrange(160)) for s in range(5) for i in range(30)]
    start = {s: {steps[s * 30][2], 140 + s} for s in range(4)}
    frame = lambda rows: spark.createDataFrame(rows, "src int, dst int, year int, title string")
    got = S.growing_graph(spark.createDataFrame(steps, "session int, step int, node int"), spark.createDataFrame([(s, n) for s, ns in start.items() for n in ns], "session int, node int"), frame(inside), frame(outside), k, most)
    want = _grow(steps, start, inside, outside, k, most)
    assert sorted((r["session"], r["step"], r["node"], list(r["added"]), r["more"], r["capped"]) for r in got.collect()) == want
    assert any(r[5] and r[3] for r in want) and any(r[5] and not r[3] for r in want) and any(r[4] and not r[5] for r in want)


def _own(turns):
    """Panel and chat by the rule, turn by turn, with a set of owned fields."""
    out, state = [], {}
    for conv, turn, panel, touched, y0, y1, kind, kci in sorted(turns, key=lambda t: t[:2]):
        f, owned = state.setdefault(conv, ({"y": (None, None), "paper_type": None, "kci_only": None}, set()))
        pair = (y1, y0) if y0 is not None and y1 is not None and y0 > y1 else (y0, y1)
        if panel:
            if {"year_start", "year_end"} & set(touched):
                pair = pair if "year_end" in touched else (y0, y0)
                empty = pair == (None, None)
                if not empty or "year_start" in owned:
                    f["y"] = pair
                    owned -= {"year_start", "year_end"}
                    owned |= set() if empty else {"year_start", "year_end"}
            for name, value in (("paper_type", kind), ("kci_only", kci)):
                if name in touched and (value or name in owned):
                    f[name] = value
                    owned -= {name}
                    owned |= {name} if value else set()
        else:
            if pair != (None, None):
                f["y"] = pair
                owned -= {"year_start", "year_end"}
            for name, value in (("paper_type", kind), ("kci_only", kci)):
                if value is not None:
                    f[name] = value
                    owned -= {name}
        out.append((conv, turn, *f["y"], f["paper_type"], f["kci_only"], sorted(owned)))
    return out


def test_owned_filters_over_random_turns(spark):
    rng = random.Random(8)
    pick = lambda *x: rng.choice([None, None, *x])
    turns = [(c, t, rng.random() < 0.6, [f for f in ("year_start", "year_end", "paper_type", "kci_only") if rng.random() < 0.5], pick(2001, 2010), pick(2005, 2020), pick("journal", ""), pick(True, False)) for c in range(60) for t in range(12)]
    turns = [t if t[2] or t[6] != "" else (*t[:6], None, t[7]) for t in turns]  # a chat gives no empty type
    d = spark.createDataFrame(turns, "conv_id int, turn int, panel boolean, touched array<string>, year_start int, year_end int, paper_type string, kci_only boolean")
    got = sorted((tuple(r[:-1]) + (list(r["owned"]),) for r in S.owned_filters(d, ("paper_type", "kci_only")).collect()), key=lambda r: r[:2])
    assert got == _own(turns)


def _pick(papers, k, groups, most=10):
    """papers: latest first, each its keywords in order. The rule of slots, read as a program."""
    seen, where = {}, {}
    for n, words in enumerate(papers):
        for w in words:
            seen.setdefault(w, set()).add(n)
            where.setdefault(w, len(where))
    hangul = lambda w: bool(re.search("[가-힣]", w))

    def fill(order, groups):
        items, slot = [], {}
        for w, source in order:
            g = groups.get(w)
            if g in slot:
                slot[g][2].update(seen[w])
                if hangul(w) and not hangul(slot[g][0]):
                    slot[g][0] = w
            elif len(items) < k:
                items.append([w, source, set(seen[w])])
                if g is not None:
                    slot[g] = items[-1]
        return items

    if len(papers) == 1:
        order, groups = [(w, "single_paper") for w in where], {}
    else:
        repeated = sorted((w for w in where if len(seen[w]) > 1), key=lambda w: -len(seen[w]))
        rest = [(w, "recent") for w in where if len(seen[w]) < 2]
        order = [(w, "repeated") for w in repeated]
        filled = len(repeated) < k
        order += rest if filled else []
        if len({hangul(w) for w, _, _ in fill(order, {})}) > 1:
            groups = {w: groups[w] for w, _ in order[:most] if w in groups}
        else:
            groups = {}
        if not filled and len(fill(order, groups)) < k:
            order += rest
    return [(i, w, s, len(p)) for i, (w, s, p) in enumerate(fill(order, groups), 1)]


CASES = [
    ([["a", "b", "c", "d"]], 3, {"a": "x", "b": "x"}),
    ([["learning", "학습", "b"], ["학습", "learning", "c"]], 3, {"learning": "x", "학습": "x"}),
    ([["learning", "학습", "b"], ["학습", "learning", "b"]], 3, {"learning": "x", "학습": "x", "b": "y"}),
    ([["e", "f"], ["e", "g"], ["h"]], 3, {"f": "x", "g": "x"}),
    ([["가", "k1", "k2", "k3"], ["k1", "k2", "k3", "z"], ["k1", "가", "나"]], 2, {"가": "x", "k1": "x", "나": "x"}),
]


def test_keyword_slots(spark):
    rng = random.Random(4)
    names = [f"w{i}" for i in range(8)] + [f"말{i}" for i in range(5)]
    cases = CASES + [([rng.sample(names, rng.randint(1, 7)) for _ in range(rng.randint(1, 4))], rng.randint(1, 4), {w: rng.choice("xyz") for w in rng.sample(names, 7)}) for _ in range(25)]
    for k in {c[1] for c in cases}:
        some = [c for c in cases if c[1] == k]
        links, tags, meaning = [], [], {}
        for i, (papers, _, groups) in enumerate(some):
            for n, words in enumerate(papers):
                paper = 1000 * i + 100 - n
                links += [(2 * i, paper), (2 * i + 1, paper)]
                tags += [(paper, p, f"{i}:{w}") for p, w in enumerate(words)]
            meaning |= {f"{i}:{w}": f"{i}{g}" for w, g in groups.items()}
        frame = spark.createDataFrame
        got = R.keyword_slots(frame(links, "rid int, paper_id int"), frame(tags, "paper_id int, pos int, name string"), frame(list(meaning.items()), "name string, meaning string"), k)
        of = {}
        for r in got.orderBy("a", "slot").collect():
            of.setdefault(r["a"] // 2, []).append((r["slot"], r["keyword"].split(":")[1], r["source"], r["papers"]))
        for i, (papers, _, groups) in enumerate(some):
            assert of[i] == _pick(papers, k, groups), (papers, k, groups)


@pytest.mark.parametrize("graph", [True, False])
def test_pairs_equal_numpy(spark, graph):
    rng = np.random.default_rng(2)
    v, g = rng.normal(size=(2000, 8)), rng.normal(size=(2000, 3))
    v[5] = 0
    rows = spark.createDataFrame([(i, v[i].tolist(), g[i].tolist() if graph or i != 7 else None) for i in range(2000)], "id int, v array<double>, g array<double>")
    unit = lambda x: np.divide(x, n := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=n > 0)
    want = unit(v) @ unit(v).T
    want = 0.7 * want + 0.3 * unit(g) @ unit(g).T if graph else want
    np.fill_diagonal(want, 1)
    got = V.pairwise(rows, block=300).toPandas()
    assert len(got) == 2000 * 2001 // 2 and (got.a <= got.b).all() and not got.duplicated(["a", "b"]).any()
    assert np.abs(got.sim.to_numpy() - want[got.a, got.b]).max() < 1e-12
    assert V.pairwise(rows.limit(0)).count() == 0


def _by_argmin(x, cut):
    """The nearest two clusters merge, again and again."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] >= cut:
            break
        groups[best[1]] += groups.pop(best[2])
    label = {k: n for n, g in enumerate(sorted(groups, key=min)) for k in g}
    return [label[k] for k in range(len(x))]


def test_clusters_of_a_chain_equal_those_of_the_least_distance():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 9, 24):
        for cut in (0.2, 0.6, 0.9, 2.1):
            x = rng.normal(size=(max(n // 3, 1), 5))[rng.integers(0, max(n // 3, 1), n)] + rng.normal(0, 0.4, (n, 5))
            assert C.average_linkage(x, cut) == _by_argmin(x, cut)
    took = []
    for n in (1000, 2000):
        x = rng.normal(size=(n, 16))
        began = time.perf_counter()
        C.average_linkage(x, 0.8)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_candidates_are_confirmed_by_papers(spark):
    f = spark.createDataFrame
    people = f([(1, "n", "i"), (2, "m", "i"), (3, "o", "i"), (4, "n", None), (5, "p", "i")], "rid int, name string, institution string")
    links = f([(1, 10), (2, 20), (5, 50)], "rid int, paper_id int")
    cands = f([(100, "n", "i", 9), (101, "n", "i", 5), (102, "n", "i", 1), (103, "n", "i", None), (200, "m", "i", 1), (300, "o", "i", 3), (301, "o", "i", 3), (500, "p", "i", 1), (501, "p", "i", 2), (502, "p", "i", 3), (503, "p", "i", 4)], "cand int, name string, institution string, articles int")
    listed = f([(101, 10), (102, 10), (101, 10), (200, 21), (500, 50)], "cand int, paper_id int")
    got = {r["rid"]: (r["cand"], r["status"], r["confidence"]) for r in I.choose_candidates(people, links, cands, listed).collect()}
    assert got == {1: (101, "matched", "confirmed"), 2: (200, "matched", "inferred"), 3: (300, "ambiguous", None), 5: (503, "ambiguous", None)}
