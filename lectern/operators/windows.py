"""Ranking, fusion, latest-per-key and paging."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; the order must be total. Spark prunes to k per group before it shuffles."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")


def with_total(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page with the count of all rows: a scalar aggregate beside a top-k, not a window over everything."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(rows.agg(F.count("*").alias("total")))


def rrf(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """id, score: reciprocal-rank fusion of two rankings (id, rank from 1)."""
    a, b = first.select("id", F.col("rank").alias("ra")), second.select("id", F.col("rank").alias("rb"))
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return a.join(b, "id", "full").select("id", (part("ra") + part("rb")).alias("score"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return top_per_group(rows, key, order, 1)


#: Up to so many rows one task ranks; more are ranked in ranges.
ONE_TASK = 1_000_000


def global_rank(rows: DataFrame, order: list, name: str, n_rows: int) -> DataFrame:
    """rows with their place (from 1) in a total order.

    Beyond ONE_TASK rows the order is dealt out in ranges: places within a range, plus the sizes of the ranges before it. The
    dealt rows are checkpointed, so that sizes and places come from the same ranges."""
    if n_rows <= ONE_TASK:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    ensure_checkpoint_dir(rows.sparkSession)
    parts = max(2, -(-n_rows // ONE_TASK))
    x = rows.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()).checkpoint()
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = x.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__b", before).select("__p", "__b")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) + F.col("__b")
    return x.join(F.broadcast(sizes), "__p").withColumn(name, place).drop("__p", "__b")


def global_before(rows: DataFrame, order: list, value: str, name: str, n_rows: int) -> DataFrame:
    """rows with the sum of value over all rows that come earlier in a total order, in ranges beyond ONE_TASK rows."""
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if n_rows <= ONE_TASK:
        return rows.withColumn(name, before(Window.orderBy(*order)))
    ensure_checkpoint_dir(rows.sparkSession)
    x = rows.repartitionByRange(max(2, -(-n_rows // ONE_TASK)), *order).withColumn("__p", F.spark_partition_id()).checkpoint()
    sums = x.groupBy("__p").agg(F.sum(value).alias("__s")).select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return x.join(F.broadcast(sums), "__p").withColumn(name, before(Window.partitionBy("__p").orderBy(*order)) + F.col("__b")).drop("__p", "__b")


_OWN_DIRS: dict[str, str] = {}


def ensure_checkpoint_dir(spark) -> None:
    """Checkpoints go to the folder that the session names; a local session that names none gets one of its own, any other an error,
    because its executors would not share the driver's folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        import re
        import tempfile

        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or _OWN_DIRS.get(sc.applicationId)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir is not set: start the session with it, naming a folder that driver and executors share")
            named = _OWN_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(named)


def spread(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """k rows at even places: round-half-even of i * (n - 1) / (k - 1)."""
    w = Window.partitionBy(group)
    x = rows.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(float(k - 1)), 0).cast("int"))
    return x.where((F.col("__n") <= k) | F.array_contains(places, F.col("__i"))).drop("__i", "__n")


def relabel(rows: DataFrame) -> DataFrame:
    """Rows g, label, year, at -> g, label, rank from 0: latest year first (undated last), then last place, size, first place."""
    c = rows.groupBy("g", "label").agg(F.max("year").alias("y"), F.max("at").alias("last"), F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("g").orderBy(F.col("y").desc_nulls_last(), F.col("last").desc(), F.col("n").desc(), F.col("first"))
    return c.select("g", "label", (F.row_number().over(w) - 1).alias("rank"))


def bounded_recent(rows: DataFrame, owner: str, key: str, at: list, keep: int) -> DataFrame:
    """Each owner's `keep` latest distinct keys."""
    return top_per_group(latest(rows, [owner, key], at), [owner], at, keep)


def quota(rows: DataFrame, quotas: dict[str, int], group: str, order: list) -> DataFrame:
    """As many of each group as its quota, 0 where it has none."""
    q = F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(group))
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__rn") <= F.coalesce(q, F.lit(0))).drop("__rn")


def prefix_score(name: Column, q: str) -> Column:
    return F.when(name == q, 3).when(name.startswith(q), 2).otherwise(1)
