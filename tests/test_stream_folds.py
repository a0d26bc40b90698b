"""Streams of the stateful folds: equal to the batch folds over shuffled micro-batches, and no state after its time."""
from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators.dates import local_day
from lectern.streaming import folds as S
from lectern.streaming import state as B

T0 = dt.datetime(2024, 3, 1, 14, 0)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    S.use_rocksdb(spark)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def events(seed: int, n: int = 240, step: int = 400):
    """Rows u, i, ts, kind in order of time, some at the same time."""
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 1, rng.randint(1, step)])
        rows.append((rng.randint(1, 4), i, T0 + dt.timedelta(seconds=at), rng.choice(["code", "ok", "no", "error"])))
    return rows


SCHEMA = "u long, i long, ts timestamp, kind string"


def streamed(spark, tmp_path, make, rows, batches: int = 6):
    """The rows that a stream gives: the input comes in `batches` files of consecutive times, each shuffled, then one row a year later."""
    rng = random.Random(9)
    cut = [rows[i * len(rows) // batches : (i + 1) * len(rows) // batches] for i in range(batches)]
    last = (999, -1, rows[-1][2] + dt.timedelta(days=365), "no")
    source = tmp_path / "in"
    for k, part in enumerate([*cut, [last], [(998, -2, last[2] + dt.timedelta(days=1), "no")]]):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"b{k}"))
        for f in os.listdir(source / f"b{k}"):
            os.utime(source / f"b{k}" / f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    name = f"fold_{random.getrandbits(40)}"
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    if q.exception():
        raise q.exception()
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "cp")).select("key").collect()
    return spark.table(name), held


def rows_of(df):
    return sorted((tuple(str(x) if isinstance(x, (dt.date, dt.datetime)) else x for x in r) for r in df.collect()), key=repr)


def test_usage_limits(spark, tmp_path):
    rows = events(1)
    how = (F.col("i") % 4 == 0, F.col("kind") == "error", 3600, 2, 3)
    got, held = streamed(spark, tmp_path, lambda s: S.stream_usage_limits(s.withColumn("day", F.to_date("ts")), "u", "day", "ts", "i", *how), rows)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("ts"))
    want = B.usage_limits(batch, "u", "day", "ts", "i", *how).select(F.col("u").cast("string"), F.col("day").cast("string"), "i", "opens", "used", "allowed", "left")
    assert rows_of(got.where("i >= 0")) == rows_of(want)
    assert len({(r["opens"], r["allowed"]) for r in want.collect()}) == 4
    assert {r["key"][0] for r in held} <= {"999", "998"}


def test_negative_cache(spark, tmp_path):
    rows = events(2)
    got, held = streamed(spark, tmp_path, lambda s: S.stream_negative_cache(s.where("kind = 'error' OR i < 0"), "u", "ts", 1800), rows)
    want = B.negative_cache(spark.createDataFrame(rows, SCHEMA).where("kind = 'error'"), "u", "ts", 1800).select(F.col("u").cast("string"), "tried")
    assert rows_of(got.where("u < '9'")) == rows_of(want) and want.count() > 8
    assert {r["key"][0] for r in held} <= {"999", "998"}


def test_verifications(spark, tmp_path):
    rows = events(3)
    how = (F.col("kind") == "code", F.col("kind") == "ok", 900, 2)
    got, held = streamed(spark, tmp_path, lambda s: S.stream_verifications(s, "u", "ts", "i", *how), rows)
    want = B.verifications(spark.createDataFrame(rows, SCHEMA), "u", "ts", "i", *how).select(F.col("u").cast("string"), "i", "verdict")
    assert rows_of(got.where("i >= 0")) == rows_of(want)
    assert {r["verdict"] for r in want.collect()} == {"verified", "wrong", "blocked", "expired"}
    assert held == []


def test_daily_budget(spark, tmp_path):
    rows = events(4, step=2000)
    got, held = streamed(spark, tmp_path, lambda s: S.stream_daily_budget(s, "ts", "i", 40), rows)
    want = B.daily_budget(spark.createDataFrame(rows, SCHEMA), local_day(F.col("ts")), ["ts", "i"], 40).select("day", "i", "n", "allowed")
    assert rows_of(got.where("i >= 0")) == rows_of(want)
    assert want.select("day").distinct().count() >= 2 and {r["allowed"] for r in want.collect()} == {True, False}
    assert all(str(r["key"][0]).startswith("2025") for r in held)
