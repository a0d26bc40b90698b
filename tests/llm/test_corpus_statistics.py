"""Source divergence, quality classifier and collocations against plain versions."""
from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import collocations as K
from lectern.llm import quality_classifier as Q
from lectern.llm import source_divergence as S
from lectern.llm import word_columns as W
from tests.compare import rows_of
from tests.llm.conftest import docs_in


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


# Words of columns


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_words_of_slices(most):
    rng = random.Random(most)
    texts = [None, "", "One two  TWO", "é" * 9, "x" * 200, " ".join(rng.choice(["ab", "Cd", "é1", "."]) for _ in range(80)), None]
    inside = ~W.bytes_in((0x20, 0x20))
    got = defaultdict(list)
    hashes = {}
    for first, starts, data in W.slices(pa.array(texts), ~inside, most):
        w = W.Words(starts, data, inside)
        code, names = w.encoded()
        for t, c, h in zip((w.text + first).tolist(), code.tolist(), w.hashes().tolist()):
            got[t].append(names[c].as_py().decode())
            assert hashes.setdefault(names[c].as_py(), h) == h
    assert dict(got) == {i: low(t).split(" ") if "  " not in t else low(t).split() for i, t in enumerate(texts) if t}
    assert len(set(hashes.values())) == len(hashes)


def test_tally_adds_up_whatever_its_bound():
    rows = [(random.Random(i).choice("abc"), i) for i in range(100)]
    want = Counter()
    for k, n in rows:
        want[k] += n
    for most in (1, 5, 1000):
        t, got = W.Tally(["k"], ["n"], most), Counter()
        for i in range(0, 100, 10):
            for b in t.add(pa.table({"k": [x[0] for x in rows[i : i + 10]], "n": [x[1] for x in rows[i : i + 10]]})):
                for k, n in zip(*(c.to_pylist() for c in b.columns)):
                    got[k] += n
        for b in t.rest():
            for k, n in zip(*(c.to_pylist() for c in b.columns)):
                got[k] += n
        assert got == want


# 11


def divergence(docs, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in docs:
        lang, source = r["lang"] or "", r["source"] or ""
        groups.add((lang, source))
        found = Counter(term.findall(low(r["text"])))
        df[lang].update(found.keys())
        n[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, c in df[lang].items() if c >= least), key=str.encode)
        v = len(kept)
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        share = lambda counts: [1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * v) for t in kept]
        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -f, i) for i, (f, _, o) in enumerate(pairs, 1)]
            terms = sorted((b - a, t.encode(), t) for t, a, b in zip(kept, p[s], q) if n[lang, s][t] and a > b)
            out += [(lang, s, "term", t, -f, i) for i, (f, _, t) in enumerate(terms[:top], 1)]
    return out


@pytest.mark.parametrize("least,top,block", [(1, 3, 1), (2, 50, 3), (30, 50, 1024), (10**6, 50, 2)])
def test_divergence(spark, edge, least, top, block, monkeypatch):
    monkeypatch.setattr(S, "CELLS", 16)
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in S.audit(docs, least=least, top=top, block=block).collect()]
    assert sorted(got) == sorted(divergence(docs_in(spark, edge), least, top))


def test_divergence_of_a_long_text_in_parts(spark, monkeypatch):
    text = " ".join(["alpha", "beta", "Alpha", "gamma"] * 50)
    runs = lambda: sorted(map(tuple, S.term_runs(spark.createDataFrame([("en", "s", text), ("en", "s", "beta"), ("en", "t", None)], "lang string, source string, text string").coalesce(1)).collect()))
    want = [("en", "alpha", "s", 1, 100), ("en", "beta", "s", 2, 51), ("en", "gamma", "s", 1, 50)]
    assert runs() == want
    part = W.slices
    monkeypatch.setattr(S, "slices", lambda c, ends: part(c, ends, 64))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(S)
    try:
        assert runs() == want
    finally:
        cloudpickle.unregister_pickle_by_value(S)


def test_shares_beyond_64_bits():
    counts, below = np.array([[5 * 10**12, 3]]), np.array([7 * 10**12, 9])
    assert S.shares(counts, below).tolist() == [[1 + 10**9 * (5 * 10**12 + 5) // (7 * 10**12), 1 + 10**9 * 8 // 9]]


def test_too_many_groups_are_an_error(spark, edge):
    with pytest.raises(ValueError, match="more than 3 groups"):
        S.audit(spark.read.parquet(f"{edge}/documents.parquet"), most_groups=3)


# 12


def test_pairs_by_sums_of_squares():
    rng = np.random.default_rng(0)
    m = Q.Machine(0.3, rng.normal(0, 1, (Q.width(1), 1 + Q.RANK)))
    texts = ["a b a c", "", None, "Zed!! *** 12\nx"]
    at, f, v = Q.features(pa.array(texts), [np.array([3.0, np.nan, 0, 1e6])])
    for i, y in enumerate(Q.margins(m, at, f, v)):
        own = list(zip(f[at[i] : at[i + 1]].tolist(), v[at[i] : at[i + 1]].tolist()))
        want = m.bias + sum(m.weights[j, 0] * x for j, x in own) + sum(m.weights[a, 1:] @ m.weights[b, 1:] * x * z for (a, x), (b, z) in itertools.combinations(own, 2))
        assert y == pytest.approx(want, rel=1e-6)


def test_features_of_a_long_text_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choice(["One", "two!", "***", "4", "é"]) for _ in range(400))
    texts = pa.array(["x", text, None, "last one"])
    want = [x.tolist() for x in Q.features(texts, [])]
    part = W.slices
    monkeypatch.setattr(Q, "slices", lambda c, ends: part(c, ends, 50))
    assert [x.tolist() for x in Q.features(texts, [])] == want


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in Q.op12_quality_classifier(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good, bad = ([r["score"] for r in rows if labels[r["doc_id"]] == k] for k in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.97 and sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_quality_of_awkward_rows(spark, edge):
    rows = Q.op12_quality_classifier(spark, edge).collect()
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    same = defaultdict(set)
    for r in rows:
        same[r["doc_id"]].add(r["score"])
    assert len(same[1]) == 1


def test_quality_without_labels_of_both_kinds(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for rows, want in (([], 1.0), ([(50, 1), (51, 1)], 1.0), ([(50, 0)], 0.0)):
        m = Q.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert {round(r[0], 9) for r in Q.predict(docs.select("text"), m).select("quality_score").collect()} == {want}


def test_text_ids_and_other_columns(spark):
    docs = spark.createDataFrame([("a", "fine words here", 1), ("b", "### $$$ !!!", 2), ("c", None, None)], "key string, `t.x` string, quality_score int")
    m = Q.fit(docs, spark.createDataFrame([("a", 1), ("b", 0)], "key string, q int"), id_col="key", text_col="t.x", label_col="q", meta=("quality_score",))
    out = Q.predict(docs, m, "t.x", ("quality_score",))
    assert out.columns == ["key", "t.x", "quality_score", "quality_score_"]
    score = {r["key"]: r["quality_score_"] for r in out.collect()}
    assert score["a"] > 0.5 > score["b"]


# 13


def collocations(docs, least, longest, share, top):
    f, n = defaultdict(Counter), Counter()
    for r in docs:
        lang = r["lang"] if r["lang"] is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(r["text"])):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        kept = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda x: any(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1))  # noqa: E731,B023
            if not any(100 * b >= share * a for x, b in c.items() if len(x) > len(p) and b >= least and inside(x)):
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,longest,share,top", [(12, 4, 80, 2000), (3, 3, 50, 7), (40, 2, 80, 2000)])
def test_phrases(spark, edge, least, longest, share, top):
    docs = spark.read.parquet(f"{edge}/documents.parquet").where("doc_id <> 40 OR doc_id IS NULL")
    got = sorted(map(tuple, K.mine(docs, least=least, longest=longest, share=share, top=top).collect()))
    assert got == collocations([r for r in docs_in(spark, edge) if r["doc_id"] != 40], least, longest, share, top)
    assert got


@pytest.mark.parametrize("rows,bits", [(1, 8), (2, 11), (3, 26)])
def test_sketches_of_any_width_lose_nothing(spark, edge, rows, bits):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    want = Counter()
    for r in docs_in(spark, edge):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(r["text"])):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((r["lang"] or "und", " ".join(w[i : i + k]), k) for k in range(1, 5) for i in range(len(w) - k + 1))
    want = {k: c for k, c in want.items() if c >= 5}
    got = K.frequent(docs, least=5, rows=rows, bits=bits).where("size > 0").collect()
    assert {(r["lang"], r["phrase"], r["size"]): r["c"] for r in got} == want and len(got) == len(want) > 100


def test_small_splits_are_counted_together(spark, monkeypatch):
    def made(plan) -> int:
        name = plan.nodeName()
        if name == "MapInArrow":
            return plan.metrics().apply("pythonNumRowsReceived").value()
        kids = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
        return sum(map(made, kids))

    most = K.TASKS * spark.sparkContext.defaultParallelism
    docs = spark.createDataFrame([("one two three four", "en")] * (8 * most), "text string, lang string").repartition(4 * most)
    want = {("one two three four"[a:b], 8 * most) for a, b in ((0, 3), (4, 7), (8, 13), (14, 18), (0, 7), (4, 13), (8, 18), (0, 13), (4, 18), (0, 18))} | {("", 32 * most)}
    for bytes_, tasks in ((K.TASK_BYTES, most), (18 * 8 // 3, 3 * most)):
        monkeypatch.setattr(K, "TASK_BYTES", bytes_)
        counts = K.frequent(docs, least=5)
        assert {(r["phrase"], r["c"]) for r in counts.collect()} == want
        assert made(counts._jdf.queryExecution().executedPlan()) == tasks * len(want)


def test_full_cells_are_found_again():
    keys = np.random.default_rng(2).integers(1, 1 << 62, 5000).astype(np.uint64)
    for words, bits in ((10**5, 26), (10**5, 12), (10**9, 20)):
        sketch = K.Sketch(words, 2, bits)
        counts = np.where(np.arange(5000) < 40, 300, 1)
        parts = []
        for b in K._emit(sketch, keys, counts, 300):
            for row, block, places, n in zip(*(c.to_pylist() for c in b.columns)):
                cells = np.zeros(1 << sketch.block, np.int64)
                cells[np.frombuffer(places, np.uint16)] += np.frombuffer(n, np.uint32)
                parts.append((row, block, np.packbits((cells >= 300).reshape(-1, 1 << sketch.fold).any(axis=1)).tobytes()))
        held = K.Survivors(sketch, parts).hold(keys)
        assert held[:40].all() and held[40:].mean() < 0.1


def test_first_rows_of_hot_values(spark):
    from pyspark.sql import functions as F

    rows = [("hot" if i % 9 else f"v{i % 4}", i * 7919 % 101, f"p{i}") for i in range(3000)]
    got = K.first_of_each(spark.createDataFrame(rows, "k string, s int, p string").repartition(5), "k", [F.desc("s"), F.asc("p")], 20).collect()
    want = []
    for k in {r[0] for r in rows}:
        want += [(*r, i) for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:20], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_scores_beyond_64_bits(spark):
    rows = [("en", "a", 1, 6 * 10**18), ("en", "b", 1, 7 * 10**18), ("en", "a b", 2, 5 * 10**18)]
    r = K.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, c long")).collect()[0]
    assert (r["a"], r["l"], r["r"], r["score"]) == (5 * 10**18, 6 * 10**18, 7 * 10**18, 2_000_000 * 5 // 13)
