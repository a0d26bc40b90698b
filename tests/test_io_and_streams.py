"""Readers and sinks on real files, streams against their batch twins, registered functions."""
from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from lectern.functions.register import register
from lectern.sources import readers as R
from lectern.sources import writers as W
from lectern.streaming import state as S


def test_corpus_files_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"meta": {}, "papers": [{"CN": "1", "Title": "x"}, {"Title": "no id"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"CN": "2", "Keyword": ["k"]}, {"CN": ""}]))
    assert sorted(r["CN"] for r in R.read_corpus(spark, str(tmp_path)).collect()) == ["1", "2"]


def test_ranking_csv(spark, tmp_path):
    (tmp_path / "rank 2023.csv").write_text('Rank;Title;Issn;SJR;SJR Best Quartile;H index\n1;A;"12345678, 87654321";1,25;Q1;9\n2;B;-;;-;x\n')
    got = {r["title"]: r for r in R.read_ranking(spark, str(tmp_path)).collect()}
    assert got["A"]["sjr"] == 1.25 and got["A"]["issn"] == ["12345678", "87654321"] and got["A"]["year"] == 2023
    assert got["B"]["sjr"] is None and got["B"]["h_index"] is None


def test_registry_encodings_and_headers(spark, tmp_path):
    for name, enc in (("r_20240101.csv", "euc-kr"), ("r_20250101.csv", "utf-8")):
        (tmp_path / name).write_bytes("학술지명,ISSN\n가나,1234-5678\n".encode(enc))
        assert R.read_registry(spark, str(tmp_path / name)).first()["학술지명"] == "가나"
    assert R.latest_file(["x/r_20240101.csv", "x/r_20250101.csv"]).endswith("20250101.csv")
    assert R.find_column(["P-ISSN", "이름"], "ISSN") == "P-ISSN" and R.find_column(["a"], "b") is None


def test_find_records():
    rows = [{"x": 1}, {"x": 2}]
    assert R.find_records(rows) == rows and R.find_records("x") == []
    for key in R.CONTAINERS:
        assert R.find_records({"first": [{"no": 1}], key: rows}) == rows and R.find_records({"body": {key: rows}}) == rows
    assert R.find_records({"result": {"n": 1}, "returnObject": {"a": {"Records": rows}}}) == rows
    assert R.find_records({"n": [1, 2], "a": {"b": rows}}) == rows and R.find_records({"record": []}) == []
    assert R.find_records({"a": 1}) == [] and R.find_records({"record": {"x": 1}}) == []


def test_article_xml(spark):
    df = spark.createDataFrame([("<article><id>7</id><year>x</year><authors><author order='1'><name>n</name></author></authors></article>",), (None,)], "x string")
    a, b = [r[0] for r in df.select(R.article(F.col("x"))).collect()]
    assert a["id"] == "7" and a["authors"]["author"][0]["name"] == "n" and b is None


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", "z", 1), (2, "d", "q", 2), (3, "e", "r", 1)], "k int, v string, w string, s int")
    got = {r["k"]: (r["v"], r["w"]) for r in W.upsert(old, new, ["k"], [F.col("s").desc()], ["v"]).collect()}
    assert got == {1: ("a", "x"), 2: ("d", "y"), 3: ("e", "r")}
    got = {r["k"]: r["v"] for r in W.insert_ignore(old, new, ["k"], ["s"]).collect()}
    assert got == {1: "a", 2: "b", 3: "e"}


def test_signed_cache(spark):
    old = spark.createDataFrame([("a", "s1", "c", "o"), ("b", "s1", "c", "o"), ("c", "s1", "c", "o")], "k string, sig string, col string, oth string")
    new = spark.createDataFrame([("a", "s1", "n"), ("b", "s2", "n"), ("d", "s9", "n")], "k string, sig string, col string")
    got = {r["k"]: (r["sig"], r["col"], r["oth"]) for r in W.keep_if_signed(old, new, "k", "sig", "col", "oth").collect()}
    assert got == {"a": ("s1", "n", "o"), "b": ("s2", "n", None), "c": ("s1", "c", "o"), "d": ("s9", "n", None)}


def _hits(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(u, t0 + dt.timedelta(seconds=s), i) for i, (u, s) in enumerate([(1, 0), (1, 10), (1, 59), (1, 60), (2, 5), (1, 130), (1, 131), (1, 132)])]
    return spark.createDataFrame(rows, "u long, ts timestamp, i long")


def test_fixed_windows_start_at_the_first_hit(spark):
    got = {r["i"]: (r["n"], r["allowed"]) for r in S.fixed_windows(_hits(spark), "u", "ts", "i", 60, 2).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (3, False), 3: (1, True), 4: (1, True), 5: (1, True), 6: (2, True), 7: (3, False)}


def test_negative_cache(spark):
    got = S.negative_cache(_hits(spark).where("u = 1"), "u", "ts", 60).orderBy("tried").collect()
    assert [(r["tried"] - dt.datetime(2024, 1, 1)).total_seconds() for r in got] == [0, 60, 130]


def _run(stream, mode="append"):
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    hits = _hits(spark)
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in"))
    _run(S.stream_fixed_windows(stream, "u", "ts", 60, 2))
    got = sorted((r["u"], r["ts"], r["n"], r["allowed"]) for r in spark.table("out").collect())
    want = S.fixed_windows(hits, "u", "ts", "i", 60, 2).select("i", "n", "allowed").join(hits, "i").select("u", "ts", "n", "allowed")
    assert got == sorted(map(tuple, want.collect()))


def test_daily_reads_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 14, 59)
    rows = [(1, 7, t), (1, 7, t + dt.timedelta(minutes=1)), (1, 7, t + dt.timedelta(minutes=2)), (1, 7, t + dt.timedelta(days=9))]
    df = spark.createDataFrame(rows, "user_id long, paper_id long, read_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    _run(S.stream_daily_reads(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "complete")
    assert sorted(r["view_count"] for r in spark.table("out").collect()) == [1, 1, 2]


def test_registered_functions(spark):
    assert "split_terms" in register(spark)
    assert spark.sql("SELECT clean_term('  Ａ&amp;B. ') AS t").first()["t"] == "A&B"
    assert [r["term"] for r in spark.sql("SELECT * FROM split_terms('딥러닝; Deep Learning')").collect()] == ["딥러닝", "deep learning"]


def test_codes_expire_block_and_are_used_up(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(0, "x"), (1, "code"), (2, "x"), (3, "ok"), (4, "ok"), (10, "code"), (11, "x"), (12, "x"), (13, "x"), (14, "ok"), (20, "code"), (21, "x"), (22, "code"), (23, "x"), (24, "x"), (81, "ok"), (100, "code"), (160, "ok")]
    df = spark.createDataFrame([(1, i, at(s), kind) for i, (s, kind) in enumerate(rows)] + [(2, 99, at(5), "ok")], "u int, i int, ts timestamp, kind string")
    got = {r["i"]: r["verdict"] for r in S.verifications(df, "u", "ts", "i", F.col("kind") == "code", F.col("kind") == "ok", 60, 3).collect()}
    assert got == {0: "expired", 2: "wrong", 3: "verified", 4: "expired", 6: "wrong", 7: "wrong", 8: "blocked", 9: "expired", 11: "wrong", 13: "wrong", 14: "wrong", 15: "verified", 17: "expired", 99: "expired"}


def test_cached_answers(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("k", i, at(s)) for i, s in enumerate([0, 0, 59, 60, 119, 200])] + [(None, 9, at(3))], "k string, i int, ts timestamp")
    assert {r["i"]: r["hit"] for r in S.cached(df, "k", "ts", ["i"], 60).collect()} == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False, 9: False}


def test_a_subject_over_many_batches_is_folded_as_a_whole(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, i, at(7 * i)) for i in range(500)], "u int, i int, ts timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r["i"]: r["n"] for r in S.fixed_windows(df, "u", "ts", "i", 60, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: i % 9 + 1 for i in range(500)}
