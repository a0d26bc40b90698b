"""Counters, quotas and negative caches: batch folds, and their Structured Streaming twins.

A window starts at a subject's first hit and lasts a fixed time; the next hit after that starts another. No time window of
Spark SQL does that (session windows end by gaps), so in batch a subject's hits pass in order of time through a task that holds one
batch of rows and the last window's start, however many hits there are; within a batch the fold jumps from window to window. All
else (places, counts, verdicts) is built-in functions. In a stream the same state is held by Spark.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def window_starts(hits: DataFrame, keys: list[str], ts: str, ties: list[str], seconds: int, name: str = "start") -> DataFrame:
    """hits with the start (microseconds) of the window of each: a key's first hit starts one, and so does the first hit
    `seconds` or more after the last start."""
    span = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    d = hits.withColumns({"__at": at, "__key": F.to_json(F.struct(*keys))}).repartition(*keys).sortWithinPartitions("__key", "__at", *ties)
    width = len(hits.columns)

    def fold(batches):
        last, start = None, None
        for b in batches:
            us, key = b.column(width).to_numpy(zero_copy_only=False), b.column(width + 1).to_numpy(zero_copy_only=False)
            out = np.empty(len(us), np.int64)
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(us)] if len(us) else []
            for i, end in zip(edges, edges[1:]):
                if key[i] != last:
                    last, start = key[i], None
                while i < end:
                    if start is None or us[i] >= start + span:
                        start = int(us[i])
                    j = i + int(np.searchsorted(us[i:end], start + span))
                    out[i:j] = start
                    i = j
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(out)], names=[*b.schema.names[:width], name])

    return d.mapInArrow(fold, T.StructType([*hits.schema.fields, T.StructField(name, T.LongType())]))


def fixed_windows(hits: DataFrame, subject: str, ts: str, key: str, seconds: int, limit: int) -> DataFrame:
    """subject, key, start, n (the hit's number in its window), allowed, left (seconds until the window ends) of every hit."""
    x = window_starts(hits.select(subject, key, ts), [subject], ts, [key], seconds)
    n = F.row_number().over(Window.partitionBy(subject, "start").orderBy(ts, key))
    left = (F.col("start") + seconds * 1_000_000 - F.unix_micros(F.col(ts).cast("timestamp"))) / 1_000_000
    return x.select(subject, key, (F.col("start") / 1_000_000).alias("start"), n.alias("n"), (n <= limit).alias("allowed"), left.alias("left"))


def quota(uses: DataFrame, subject: str, session: str, order: list, limit: int, failed: Column) -> DataFrame:
    """Each use's running count in its session, failures handed back, and whether it was within the limit.

    Without rejections changing the count, running sums suffice: a use is allowed while the successes before it are fewer."""
    w = Window.partitionBy(subject, session).orderBy(*order)
    before = F.coalesce(F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return uses.withColumn("used", F.least(before, F.lit(limit))).withColumn("allowed", before < limit)


def usage_limits(uses: DataFrame, subject: str, session: str, ts: str, key: str, opens: Column, failed: Column, seconds: int, chats: int, turns: int) -> DataFrame:
    """Two counters: uses that open a session count for their subject, all others for their session of that subject. Each counter's window
    starts at its first use and lasts `seconds`; a failed use is handed back, and one beyond the limit changes nothing.

    subject, session, key, opens, used (after the use), allowed, left of every use."""
    d = uses.select(subject, session, key, ts, F.coalesce(opens, F.lit(False)).alias("opens"), F.coalesce(failed, F.lit(False)).alias("failed"))
    d = d.withColumn("counter", F.when(F.col("opens"), None).otherwise(F.col(session).cast("string")))
    x = window_starts(d, [subject, "counter", "opens"], ts, [key], seconds)
    limit = F.when(F.col("opens"), chats).otherwise(turns)
    w = Window.partitionBy(subject, "counter", "opens", "start").orderBy(ts, key).rowsBetween(Window.unboundedPreceding, -1)
    before = F.least(F.coalesce(F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w), F.lit(0)), limit)
    used = F.when(before < limit, before + 1).otherwise(limit)
    return x.select(subject, session, key, "opens", used.cast("int").alias("used"), (before < limit).alias("allowed"), (limit - used).cast("int").alias("left"))


def negative_cache(failures: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Failures that would be tried: the first of a key, then the first at least `seconds` after the last one tried."""
    x = window_starts(failures.select(key, ts), [key], ts, [], seconds)
    return x.select(key, F.timestamp_micros("start").alias("tried")).distinct()


def cached(requests: DataFrame, key: str, ts: str, ties: list[str], seconds: int) -> DataFrame:
    """requests with hit: whether an answer to the key was stored less than `seconds` before. A miss stores one; a hit does not renew it."""
    x = window_starts(requests, [key], ts, ties, seconds, "__start")
    n = F.row_number().over(Window.partitionBy(key, "__start").orderBy(ts, *ties))
    return x.withColumn("hit", n > 1).drop("__start")


def verifications(rows: DataFrame, subject: str, ts: str, key: str, issued: Column, right: Column, seconds: int = 900, most: int = 5) -> DataFrame:
    """subject, key, verdict of every row that issues no code: verified, wrong, blocked (the `most`th wrong one, which ends the code) or
    expired (no code, one older than `seconds`, ended or used). A new code ends the one before."""
    d = rows.select(subject, key, ts, F.coalesce(issued, F.lit(False)).alias("issued"), F.coalesce(right, F.lit(False)).alias("right"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    d = d.withColumn("code", F.sum(F.col("issued").cast("int")).over(Window.partitionBy(subject).orderBy(ts, key)))
    of = Window.partitionBy(subject, "code")
    since = F.col("at") - F.max(F.when(F.col("issued"), F.col("at"))).over(of)
    d = d.withColumn("live", ~F.col("issued") & F.coalesce(since < seconds * 1_000_000, F.lit(False)))
    before = of.orderBy(ts, key).rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum((F.col("live") & c).cast("int")).over(before), F.lit(0))
    ended = ~F.col("live") | (count(F.col("right")) > 0) | (count(~F.col("right")) >= most)
    verdict = F.when(ended, "expired").when(F.col("right"), "verified").when(count(~F.col("right")) + 1 >= most, "blocked").otherwise("wrong")
    return d.withColumn("verdict", verdict).where(~F.col("issued")).select(subject, key, "verdict")


def daily_budget(calls: DataFrame, day: Column, order: list, limit: int, ts: str = "ts", minutes: int = 5) -> DataFrame:
    """Each call's number in its local day, and whether the day's budget still held. order begins with ts.

    A day is numbered in slices of some minutes: the calls before the slice, by its counts, and the place within it."""
    d = calls.withColumn("day", day).withColumn("__slice", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (60 * minutes)))
    per = d.groupBy("day", "__slice").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("day").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(per.select("day", "__slice", before.alias("__before")), ["day", "__slice"])
    n = F.row_number().over(Window.partitionBy("day", "__slice").orderBy(*order)) + F.col("__before")
    return d.withColumn("n", n.cast("int")).withColumn("allowed", F.col("n") <= limit).drop("__slice", "__before")


def stream_fixed_windows(hits: DataFrame, subject: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """The streaming twin of fixed_windows: state holds the window's start and count; it expires by event time.

    Hits of one batch are folded in time order; rows later than the watermark are dropped by Spark."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = []
        for t in sorted(t for b in batches for t in b[ts].astype("int64").tolist()):
            if start is None or t >= start + seconds * 1_000_000_000:
                start, n = t, 0
            n += 1
            rows.append((key[0], pd.Timestamp(t), n, n <= limit))
        state.update((start, n))
        due = (start + seconds * 1_000_000_000) // 1_000_000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame(rows, columns=[subject, ts, "n", "allowed"])

    return hits.withWatermark(ts, f"{seconds} seconds").groupBy(subject).applyInPandasWithState(
        fold, f"{subject} long, {ts} timestamp, n int, allowed boolean", "start long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def stream_daily_reads(reads: DataFrame, delay: str = "1 day") -> DataFrame:
    """The streaming twin of daily reads: local days are windows that start nine hours before UTC's."""
    day = F.window("read_at", "1 day", startTime="15 hours")
    return reads.withWatermark("read_at", delay).groupBy("user_id", "paper_id", day.alias("w")).agg(F.max("read_at").alias("read_at"), F.count("*").alias("view_count"))
