"""Local days and periods, histories and soft deletes. The local zone is nine hours ahead of UTC and has no summer time."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET = "INTERVAL 9 HOURS"


def local_day(ts: Column) -> Column:
    return F.to_date(ts + F.expr(OFFSET))


def period_start(ts: Column, period: str) -> Column:
    """UTC start of the local day, week (from Monday) or month."""
    return F.date_trunc(period, ts + F.expr(OFFSET)) - F.expr(OFFSET)


def daily_reads(reads: DataFrame) -> DataFrame:
    """One row per user, paper and local day: the last time and the number of views."""
    return reads.groupBy("user_id", "paper_id", local_day(F.col("read_at")).alias("day")).agg(F.max("read_at").alias("read_at"), F.count("*").alias("view_count"))


def history(reads: DataFrame, now: str, days: int) -> DataFrame:
    """Each user's reads in the `days` days up to now, or up to the last read if that is older; both ends count."""
    last = reads.groupBy("user_id").agg(F.max("read_at").alias("__last"))
    end = F.least(F.col("__last"), F.lit(now).cast("timestamp"))
    return reads.join(last, "user_id").where((F.col("read_at") <= end) & (F.col("read_at") >= end - F.expr(f"INTERVAL {days} DAYS"))).drop("__last")


def soft_delete(rows: DataFrame, hit: Column, now: str) -> DataFrame:
    return rows.withColumn("deleted_at", F.when(hit, F.lit(now).cast("timestamp")))
