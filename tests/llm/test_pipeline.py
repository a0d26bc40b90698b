"""The stages in turn, on awkward rows and on the smallest tables."""
from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as P
from lectern.llm import common
from lectern.llm.common import stage
from tests.llm.test_operators import ALNUM, SPACE, _near, _secrets, _targets, low

KEYS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(stage(f(spark, out[-1], small)))
    return out


def test_columns(steps):
    assert all(s.columns == KEYS for s in steps[:-1]) and steps[-1].columns[:5] == KEYS


def test_language_stage_keeps_clean_documents(steps):
    assert steps[1].count() >= 0.98 * steps[0].count()


def test_one_of_each_group_stays(steps):
    want = sorted(k for k, _, _, kept in _near(steps[1].collect()) if kept)
    assert sorted(r["doc_id"] for r in steps[2].collect()) == want


def test_repeated_and_missing_ids_are_decided_by_text(spark):
    word = lambda k, i: f"w{k}x{i}"
    text = lambda k, *other: " ".join(["changed" if i in other else word(k, i) for i in range(80)])
    rows = [(7, text(1)), (7, text(1)), (7, text(2, 40)), (3, text(2)), (None, text(2, 41)), (None, text(3)), (None, text(3).upper()), (9, text(4)), (9, text(4, 40)), (8, text(5)), (12, text(5)), (None, None), (20, ""), (20, ""), (30, text(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted(((r["doc_id"], (r["text"] or "")[:3].lower()) for r in P.near_dedup(spark, docs, "").collect()), key=repr)
    assert got == sorted([(7, "w1x"), (3, "w2x"), (None, "w3x"), (9, "w4x"), (8, "w5x"), (None, ""), (20, ""), (30, "w6x")], key=repr)


def _shuffled(plan) -> int:
    """Rows that the exchanges of an executed plan have written."""
    name = plan.nodeName()
    kids = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(map(_shuffled, kids))


def test_dropping_copies_shuffles_few_texts_and_leaves_few_tables(spark):
    rows = [(i, " ".join(f"w{i if i % 50 else 0}x{j}" for j in range(30)), "en", "s", 1) for i in range(400)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    before, most = common.written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.near_dedup(spark, docs, "")
        assert common.written() - before <= 3
        assert {r["doc_id"] for r in out.collect()} == {i for i in range(400) if i % 50 or not i}
        assert _shuffled(out._jdf.queryExecution().executedPlan()) < 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_no_benchmark_passage_stays(spark, small, steps):
    items = [(str(r[0]), ALNUM.findall(low(r[1]))) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    by_first: dict = {}
    for i, w in items:
        for k in range(len(w) - 9):
            by_first.setdefault(tuple(w[k : k + 10]), i)
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    after = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    dirty = lambda t: (w := ALNUM.findall(low(t))) and any(tuple(w[j : j + 10]) in by_first for j in range(len(w) - 9))
    assert not any(dirty(t) for t in after.values())
    assert all(after.get(i) == t for i, t in before.items() if not dirty(t))


def test_no_secret_stays(steps):
    assert all(not _secrets(r["text"])[0] for r in steps[4].collect())
    assert steps[4].count() == steps[3].count()
    assert all(r["n_chars"] == len(r["text"]) for r in steps[4].collect())


def test_mixture_meets_its_targets(steps):
    """Source by source, the words of the mixture are the target by the plain rule, and no document is taken more than twice."""
    n = lambda t: len(SPACE.findall(t or ""))
    size, taken, by_doc, own = Counter(), Counter(), Counter(), {}
    for r in steps[4].collect():
        size[r["source"]] += n(r["text"])
        own[r["doc_id"]] = r
    for r in steps[5].collect():
        taken[r["source"]] += n(r["text"])
        by_doc[r["doc_id"]] += n(r["text"])
        w, of = SPACE.findall(r["text"]), own[r["doc_id"]]
        assert r["text"] == of["text"] or w == SPACE.findall(of["text"])[: len(w)]
        assert (r["source"], r["lang"], r["n_chars"]) == (of["source"], of["lang"], len(r["text"]))
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in _targets(dict(size)).items())
    assert all(k <= 2 * n(own[i]["text"]) for i, k in by_doc.items())


def test_shards_are_shuffled_and_whole(steps):
    rows = steps[5].select("doc_id", "take", "shard").collect()
    assert len({(r["doc_id"], r["take"]) for r in rows}) == len(rows)
    by_shard = Counter(r["shard"] for r in rows)
    assert set(by_shard) == set(range(2))


def test_columns_with_dots_pass_through_every_stage(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet").withColumnRenamed("cls", "c.l.s").withColumnRenamed("hits", "a`b").withColumnRenamed("n", "text.n")
    names = docs.columns
    for _, f in P.STAGES:
        docs = stage(f(spark, docs, edge))
        assert docs.columns[: len(names)] == names and docs.count() > 0
    assert {(r["c.l.s"], r["text.n"]) for r in docs.collect()} == {("x", 6)}


def test_no_folder_is_an_error_outside_local_sessions(spark, monkeypatch):
    from lectern.llm import common

    class Bare:
        def __init__(self, master):
            self.conf = self.sparkContext = self
            self.master, self.applicationId = master, f"app-{master}"

        def get(self, *_):
            return None

        getConf = lambda self: self

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Bare("spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(Bare("local-cluster[2,1,1024]"))
    assert common.shared_dir(Bare("local[2]")) == common.shared_dir(Bare("local[2]"))


def test_run_leaves_only_its_result(spark, small):
    from lectern.llm import common

    before = common.written()
    out = P.run(spark, small)
    assert common.written() == before + 1 and out.count() > 0


def test_awkward_and_empty_rows(spark, edge, empty):
    assert P.run(spark, edge).count() > 0
    assert P.run(spark, empty).count() == 0


def test_run_equals_its_stages(spark, small, steps):
    assert sorted(map(tuple, P.run(spark, small).select("doc_id", "take", "shard").collect())) == sorted(map(tuple, steps[-1].select("doc_id", "take", "shard").collect()))


def test_written_tables_can_be_deleted(spark):
    from lectern.llm import common

    df = stage(spark.range(3))
    path = df.inputFiles()[0]
    assert common.cleanup(spark) > 0 and not common._WRITTEN
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
