"""Streaming twins of the batch folds: quotas with compensation, verification codes, negative caches and daily budgets.

Each keeps one small state for a key in Spark's state store and folds a micro-batch's rows of that key in order of time, so it gives the
rows that the batch fold gives, however a micro-batch is ordered inside. A timer by event time clears a key's state once its window, code or
day is over; rows later than the watermark are dropped by Spark. The store must be RocksDB's (use_rocksdb), which timers need."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MICRO = 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers need, for streams started in this session from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: fold(state, rows in order of time as (microseconds, ...)) -> state, output rows, microseconds at which the state is over
Fold = Callable[[tuple | None, list[tuple]], tuple[tuple | None, list[tuple], int | None]]


class FoldProcessor(StatefulProcessor):
    """Folds a key's rows (at_us, then the columns named) with one value as state."""

    def __init__(self, fold: Fold, state: str, read: list[str], keys: int, out: list[str]):
        self.fold, self.schema, self.read, self.keys, self.out = fold, state, read, keys, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = [tuple(None if x is pd.NA or x is pd.NaT or x != x else x for x in r) for df in rows if len(df) for r in df[["at_us", *self.read]].astype(object).itertuples(index=False)]
        got.sort(key=lambda r: tuple((x is not None, x) for x in r))
        state, made, due = self.fold(tuple(self.state.get()) if self.state.exists() else None, got)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if state is None or (due is not None and due // 1000 <= timerValues.getCurrentWatermarkInMs()):
            self.state.clear()
        else:
            self.state.update(state)
            if due is not None:
                self.handle.registerTimer(due // 1000)
        if made:
            yield pd.DataFrame([(*key[: self.keys], *r) for r in made], columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def folded(rows: DataFrame, keys: dict[str, Column], ts: str, read: list[str], fold: Fold, state: str, out: str, delay: str, shown: int | None = None) -> DataFrame:
    """The stream of a fold over rows by keys (name -> column). out: the schema of what a row gives, keys first (`shown` of them)."""
    # Plain names, as the workers' frames come without those that begin with an underscore.
    d = rows.select(F.col(ts).cast("timestamp").alias("at_ts"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(read)], *[c.alias(f"k{i}") for i, c in enumerate(keys.values())])
    d = d.withWatermark("at_ts", delay).withColumn("at_us", F.unix_micros("at_ts"))
    from pyspark.sql import types as T

    names = T.StructType.fromDDL(out).names
    processor = FoldProcessor(fold, state, [f"c{i}" for i in range(len(read))], len(keys) if shown is None else shown, names)
    return d.groupBy(*[f"k{i}" for i in range(len(keys))]).transformWithStateInPandas(processor, out, "append", "EventTime")


def stream_usage_limits(uses: DataFrame, subject: str, session: str, ts: str, key: str, opens: Column, failed: Column, seconds: int, chats: int, turns: int, delay: str = "10 minutes") -> DataFrame:
    """The streaming twin of usage_limits: a counter's window starts at its first use and lasts `seconds`; a failed use is handed back, and
    one beyond the limit changes nothing. subject and session come as strings; key, opens, used, allowed and left as there."""
    u = uses.withColumns({"__opens": F.coalesce(opens, F.lit(False)), "__failed": F.coalesce(failed, F.lit(False))}).withColumn("__session", F.col(session).cast("string"))

    def fold(state, rows):
        start, n = state or (None, 0)
        made = []
        for at, k, opens, failed, of in rows:
            if start is None or at >= start + seconds * MICRO:
                start, n = at, 0
            limit = chats if opens else turns
            allowed = n < limit
            used = n + 1 if allowed else limit
            made.append((of, k, bool(opens), used, allowed, limit - used))
            n += allowed and not failed
        return (start, int(n)), made, start + seconds * MICRO

    keys = {"subject": F.col(subject).cast("string"), "counter": F.when(F.col("__opens"), None).otherwise(F.col("__session")), "opens": F.col("__opens")}
    kind = uses.schema[key].dataType.simpleString()
    out = f"subject string, session string, {key} {kind}, opens boolean, used int, allowed boolean, left int"
    return folded(u, keys, ts, [key, "__opens", "__failed", "__session"], fold, "start long, n int", out, delay, 1)


def stream_negative_cache(failures: DataFrame, key: str, ts: str, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """The streaming twin of negative_cache: key (string) and the times at which it would be tried."""

    def fold(state, rows):
        start, made = state[0] if state else None, []
        for (at,) in rows:
            if start is None or at >= start + seconds * MICRO:
                start = at
                made.append((at,))
        return (start,), made, start + seconds * MICRO

    tried = folded(failures, {"key": F.col(key).cast("string")}, ts, [], fold, "start long", f"{key} string, at long", delay)
    return tried.select(key, F.timestamp_micros("at").alias("tried"))


def stream_verifications(rows: DataFrame, subject: str, ts: str, key: str, issued: Column, right: Column, seconds: int = 900, most: int = 5, delay: str = "10 minutes") -> DataFrame:
    """The streaming twin of verifications: subject (string), key, verdict. The state is the live code's time and its wrong tries."""
    d = rows.withColumns({"__issued": F.coalesce(issued, F.lit(False)), "__right": F.coalesce(right, F.lit(False))})

    def fold(state, rows):
        code, wrong = state or (None, 0)
        made = []
        for at, k, issued, right in rows:
            if issued:
                code, wrong = at, 0
            elif code is None or at >= code + seconds * MICRO:
                made.append((k, "expired"))
            elif right:
                code = None
                made.append((k, "verified"))
            else:
                wrong += 1
                made.append((k, "blocked" if wrong >= most else "wrong"))
                code = None if wrong >= most else code
        return (None if code is None else (code, wrong)), made, None if code is None else code + seconds * MICRO

    kind = rows.schema[key].dataType.simpleString()
    return folded(d, {"subject": F.col(subject).cast("string")}, ts, [key, "__issued", "__right"], fold, "code long, wrong int", f"subject string, {key} {kind}, verdict string", delay)


def stream_daily_budget(calls: DataFrame, ts: str, key: str, limit: int, hours: int = 9, delay: str = "10 minutes") -> DataFrame:
    """The streaming twin of daily_budget: day (of the clock `hours` ahead of UTC), key, n, allowed. A day is one counter, whose state goes when it ends."""
    day = F.to_date(F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + hours * 3600 * MICRO))

    def fold(state, rows):
        n, made = state[0] if state else 0, []
        for _, k in rows:
            n += 1
            made.append((k, n, n <= limit))
        local = rows[0][0] + hours * 3600 * MICRO
        end = (local // (86_400 * MICRO) + 1) * 86_400 * MICRO - hours * 3600 * MICRO
        return (n,), made, end

    kind = calls.schema[key].dataType.simpleString()
    out = folded(calls, {"day": day.cast("string")}, ts, [key], fold, "n int", f"day string, {key} {kind}, n int, allowed boolean", delay)
    return out.withColumn("day", F.to_date("day"))
