"""A stored graph that loads merge into: node and edge tables in buckets by key, and manifests that say which files hold a version.

A merge reads the buckets that its rows fall into, writes anew those that change, and then commits one manifest for both tables; all other
buckets keep their files. Readers take the newest manifest (or a version they name), so they never see half a load, and a load that
fails leaves the version before it. Two loads at a time cannot both commit: the second finds its version taken and raises. Manifests and
files are reached through Hadoop's file systems, so any store that Spark reads will do."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables and the columns that name a row.
KEYS = {"nodes": ["kind", "key"], "edges": ["kind", "src", "dst"]}
BUCKETS = 64


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def versions(self) -> list[int]:
        home = self._path(f"{self.path}/manifests")
        if not self._fs.exists(home):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(home) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty one (version 0) if there is none."""
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "buckets": self.buckets, "tables": {}}
        stream = self._fs.open(self._path(self._name(found[-1] if version is None else version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _commit(self, manifest: dict) -> None:
        """Written beside, then renamed to a name that must be free."""
        sc = self.spark.sparkContext
        draft = self._path(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        none = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(self._name(manifest["version"])), none)
        except Exception as e:
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} is taken or cannot be committed") from e

    # Reading

    def read(self, table: str, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """A table of the newest version or of a named one (only: some of its buckets); None if it was never loaded."""
        return self._read(self.manifest(version), table, only)

    def _read(self, manifest: dict, table: str, only: list[int] | None = None) -> DataFrame | None:
        held = manifest["tables"].get(table)
        if held is None:
            return None
        schema = T.StructType.fromJson(held["schema"])
        folders = [f"{self.path}/{f}" for b, f in sorted(held["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # Merging

    def merge(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, ends: dict[str, tuple[str, str]] | None = None, order: str | None = None) -> int:
        """Merge nodes (kind, key, ...) and edges (kind, src, dst, ...) into the store; the version that holds them.

        Of several rows with a key the greatest by `order` counts (then by all columns); it replaces the columns that it has, other columns of the
        stored row stay. ends: kinds of an edge kind's ends; edges of such kinds whose ends are no nodes are left out. A merge that changes
        nothing makes no version."""
        manifest = self.manifest()
        new = {"version": manifest["version"] + 1, "buckets": manifest["buckets"], "tables": dict(manifest["tables"])}
        for table, rows in (("nodes", nodes), ("edges", edges)):
            if rows is not None:
                rows = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in KEYS[table]))
                if table == "edges" and ends:
                    rows = self._between_nodes(new, rows, ends)
                found = self._merged(new, table, rows, order)
                if found is not None:
                    new["tables"][table] = found
        if new["tables"] == manifest["tables"]:
            return manifest["version"]
        self._commit(new)
        return new["version"]

    def _between_nodes(self, manifest: dict, edges: DataFrame, ends: dict[str, tuple[str, str]]) -> DataFrame:
        nodes = self._read(manifest, "nodes")
        nodes = nodes.select("kind", "key") if nodes is not None else self.spark.createDataFrame([], "kind string, key string")
        for k, column in enumerate(("src", "dst")):
            kind = F.create_map(*[F.lit(x) for name, pair in ends.items() for x in (name, pair[k])])
            known = nodes.select(F.col("kind").alias("__kind"), F.col("key").alias(column), F.lit(True).alias("__known"))
            edges = edges.withColumn("__kind", F.try_element_at(kind, "kind")).join(known, ["__kind", column], "left")
            edges = edges.where(F.col("__kind").isNull() | F.col("__known")).drop("__kind", "__known")
        return edges

    def _merged(self, manifest: dict, table: str, rows: DataFrame, order: str | None) -> dict | None:
        keys, held = KEYS[table], manifest["tables"].get(table)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(manifest["buckets"])).cast("int")
        others = [c for c in rows.columns if c not in keys and c != order]
        best = F.max(F.struct(*([F.col(order).alias("__order")] if order else []), *others)) if others or order else F.lit(None)
        rows = rows.groupBy(*keys).agg(best.alias("__new"))
        touched = sorted(r[0] for r in rows.select(bucket).distinct().collect())
        if not touched:
            return None
        old = self._read(manifest, table, touched)
        columns = [c for c in (old.columns if old is not None else []) if c not in keys]
        after = [*columns, *[c for c in others if c not in columns]]
        if old is None:
            merged = rows.select(*keys, *[F.col(f"__new.{c}").alias(c) for c in after])
        else:
            both = old.withColumn("__old", F.lit(True)).join(rows.withColumn("__in", F.lit(True)), keys, "full")
            take = lambda c: F.col(c) if c not in others else F.col(f"__new.{c}") if c not in columns else F.when(F.col("__in"), F.col(f"__new.{c}")).otherwise(F.col(c))
            merged = both.select(*keys, *[take(c).alias(c) for c in after])
        changed = touched if old is None or after != columns else self._changed(old, merged, bucket)
        if not changed:
            return None
        folder = f"data/{table}-{uuid.uuid4().hex}"
        out = merged.withColumn("__bucket", bucket).where(F.col("__bucket").isin(*changed))
        out.repartition("__bucket").sortWithinPartitions("__bucket", *keys).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        buckets = {**(held["buckets"] if held else {}), **{str(b): f"{folder}/__bucket={b}" for b in changed}}
        return {"schema": json.loads(merged.schema.json()), "buckets": buckets}

    @staticmethod
    def _changed(old: DataFrame, merged: DataFrame, bucket) -> list[int]:
        """Buckets whose rows differ, by counts and sums of two hashes of all columns; maps are hashed as sorted entries."""

        def told(df: DataFrame, tag: str) -> DataFrame:
            whole = [F.to_json(F.struct(F.array_sort(F.map_entries(f.name)))) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema.fields]
            null = F.concat_ws("", *[F.when(F.col(f.name).isNull(), "1").otherwise("0") for f in df.schema.fields])
            digests = [F.sum(F.xxhash64(F.lit(s), null, *whole).cast("decimal(38,0)")).alias(f"{tag}{s}") for s in (1, 2)]
            return df.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias(f"{tag}0"), *digests)

        both = told(old, "a").join(told(merged, "b"), "__bucket", "full")
        same = F.lit(True)
        for s in range(3):
            same = same & F.col(f"a{s}").eqNullSafe(F.col(f"b{s}"))
        return sorted(r[0] for r in both.where(~same).select("__bucket").collect())

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the last `keep`, and files that none of these names; how many folders went. No load may run meanwhile."""
        found = self.versions()
        named = {f.split("/")[1] for v in found[-keep:] for t in self.manifest(v)["tables"].values() for f in t["buckets"].values()}
        gone = 0
        home = self._path(f"{self.path}/data")
        for s in self._fs.listStatus(home) if self._fs.exists(home) else []:
            if s.getPath().getName() not in named:
                gone += bool(self._fs.delete(s.getPath(), True))
        for v in found[:-keep]:
            self._fs.delete(self._path(self._name(v)), False)
        return gone
