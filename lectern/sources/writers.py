"""Sinks: insert-ignore, upserts, graph merges, vector synchronisation and backups, as whole-table rewrites of Parquet."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import ensure_checkpoint_dir, latest


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared one that the session names; as ensure_checkpoint_dir says where it names none."""
    ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """existing and the new rows whose key it lacks; of several new ones with a key the first by order."""
    return existing.unionByName(latest(new, keys, order).join(existing, keys, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list, columns: list[str] | None = None) -> DataFrame:
    """The last new row of each key replaces `columns` (all that are not keys) of the existing one; other keys are added."""
    columns = columns or [c for c in existing.columns if c not in keys]
    n = latest(new, keys, order).select(*keys, *[F.col(c).alias(f"__{c}") for c in existing.columns if c not in keys], F.lit(True).alias("__new"))
    e = existing.withColumn("__old", F.lit(True)).join(n, keys, "full")
    take = lambda c: F.when(F.col("__new") & (F.col("__old").isNull() | F.lit(c in columns)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return e.select(*[F.col(c) if c in keys else take(c) for c in existing.columns])


def keep_if_signed(old: DataFrame, new: DataFrame, key: str, signature: str, column: str, sibling: str) -> DataFrame:
    """Store new's column; the sibling stays only where the signature is unchanged, else it is emptied."""
    n = new.select(key, F.col(signature).alias("__s"), F.col(column).alias("__c"), F.lit(True).alias("__n"))
    x = old.join(n, key, "full")
    same = F.col("__n").isNull() | F.col(signature).eqNullSafe(F.col("__s"))
    return x.select(key, F.when(F.col("__n"), F.col("__s")).otherwise(F.col(signature)).alias(signature), F.when(F.col("__n"), F.col("__c")).otherwise(F.col(column)).alias(column), F.when(same, F.col(sibling)).alias(sibling))


def merge_graph(nodes: DataFrame, edges: DataFrame, path: str) -> int:
    """Merge nodes (kind, key) and edges (kind, src, dst) into the store at path, a node by its key and an edge by its ends once each; the
    version that holds them. What the store held before stays."""
    from .graph_store import GraphStore

    return GraphStore(nodes.sparkSession, path).merge(nodes, edges)


def sync(target: DataFrame, source: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What the target becomes (the source's rows) and the stale keys that go."""
    return source, target.join(source, key, "left_anti").select(key)


def sync_store(target: DataFrame, source: DataFrame, key: str, path: str) -> DataFrame:
    """Write to path what the target becomes: source's rows replace those of their key, keys that source lacks go. The written table, whose
    count must be that of the source's keys, else an error."""
    kept, stale = sync(target.select(key), source.select(key), key)
    after = upsert(target.join(stale, key, "left_anti"), source, [key], [F.col(key)])
    after.write.mode("overwrite").parquet(path)
    out = target.sparkSession.read.parquet(path)
    found, wanted = out.count(), kept.distinct().count()
    if found != wanted:
        raise ValueError(f"the store holds {found} rows, its source {wanted} keys")
    return out


def backup(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each table as Parquet under path; the rows of each, read back."""
    out = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    return out
