"""A stored vector index: cells of a k-means partition, probed by search and re-ranked exactly.

The cells' centres are fitted on a bounded sample; every vector is stored, in the folder of its nearest cell, with its length taken to one. A
search reads the folders of the cells nearest to its queries and ranks what they hold by exact cosine; with exact=True it reads all.
Queries are a stated set, held in blocks of QUERY_BLOCK against the rows that Spark reads: a task keeps each query's best rows of a batch, so nothing but
top-k lists is shuffled. A vector of length 0 is stored in cell 0 and has similarity 0."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that the centres are fitted on at most, about; cells at most; queries that are held at a time.
SAMPLE, MOST_CELLS, QUERY_BLOCK = 100_000, 4096, 1_000


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def centres_of(vectors: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 11) -> np.ndarray:
    """Unit centres of k-means on about `sample` vectors, those with the least hashes of their ids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, sample / max(vectors.count(), 1))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / float(1 << 53)
    x = vectors.where(draw < share).select(array_to_vector(F.col("v").cast("array<double>")).alias("raw"))
    x = Normalizer(inputCol="raw", outputCol="features").transform(x).select("features")
    found = KMeans(k=cells, seed=seed, maxIter=10, initSteps=2).fit(x).clusterCenters() if x.head(1) else []
    return unit(np.array(found)) if len(found) else np.zeros((1, 1))


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> int:
    """Write rows id, v and whatever else they have to path, by cell; the number of cells (default: the square root of the rows)."""
    n = vectors.count()
    cells = min(cells or int(n**0.5) + 1, MOST_CELLS, max(n, 1))
    centres = centres_of(vectors, cells, sample)
    spark = vectors.sparkSession
    held, at = spark.sparkContext.broadcast(centres), vectors.columns.index("v")

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = unit(np.asarray(b.column(at).flatten(), float).reshape(b.num_rows, -1))
                cell = (x @ held.value.T).argmax(axis=1).astype(np.int32)
                unit_v = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                columns = [unit_v if i == at else c for i, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    from pyspark.sql import types as T

    v = vectors.withColumn("v", F.col("v").cast("array<double>"))
    placed = v.mapInArrow(place, T.StructType([*v.schema.fields, T.StructField("cell", T.IntegerType())]))
    # A large cell may take several files: rows of a cell are dealt by id as well, in pieces of some hundred thousand.
    pieces = max(1, n // max(len(centres), 1) // 200_000)
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(pieces))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return len(centres)


def probed(spark: SparkSession, path: str, queries: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest cells of each query (rows)."""
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell"])
    centres = np.array([r["v"] for r in rows])
    if centres.shape[1] != queries.shape[1]:
        return np.tile(np.arange(len(centres)), (len(queries), 1))
    near = np.argsort(-(unit(queries) @ centres.T), axis=1, kind="stable")
    return near[:, :probes]


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, where=None) -> DataFrame:
    """query, id, sim (clipped at 0, 9 decimals), rank: each query's k nearest rows by exact cosine among the cells probed, ties by id. Rows query, v.

    where: a condition on the stored columns, applied before ranking. A row never is an answer to a query of its own id."""
    store = spark.read.parquet(f"{path}/cells")
    store = store.where(where) if where is not None else store
    asked = [(r["query"], np.array(r["v"], float)) for r in queries.select("query", "v").toLocalIterator()]
    parts = []
    for i in range(0, len(asked), QUERY_BLOCK):
        block = asked[i : i + QUERY_BLOCK]
        q = np.array([v for _, v in block])
        cells = None if exact else probed(spark, path, q, probes)
        rows = store if cells is None else store.where(F.col("cell").isin(*(int(c) for c in np.unique(cells))))
        parts.append(_best(rows, [x for x, _ in block], unit(q), cells, k))
    kind = queries.schema["query"].dataType
    if not parts:
        return store.select(F.lit(None).cast(kind).alias("query"), "id", F.lit(0.0).alias("sim"), F.lit(0).alias("rank")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= k)
    return out.select(F.col("query").cast(kind).alias("query"), "id", "sim", "rank")


def _best(rows: DataFrame, names: list, q: np.ndarray, cells: np.ndarray | None, k: int) -> DataFrame:
    """query, id, sim: the best k of every batch of rows for each query that probes the batch's cells."""
    from pyspark.sql import types as T

    asks: dict[int, np.ndarray] = {}
    if cells is not None:
        for c in np.unique(cells):
            asks[int(c)] = np.flatnonzero((cells == c).any(axis=1))
    held = rows.sparkSession.sparkContext.broadcast((names, q, asks))
    kind = rows.schema["id"].dataType

    def run(batches):
        names, q, asks = held.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0), np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
            order = np.argsort(np.asarray(ids), kind="stable")
            of = b.column(2).to_numpy()
            values = ids.to_pylist()
            found_q, found_at, found_s = [], [], []
            for cell in np.unique(of) if asks else (None,):
                who = asks.get(int(cell), np.zeros(0, int)) if asks else np.arange(len(q))
                at = order[of[order] == cell] if asks else order
                if not len(who) or q.shape[1] != x.shape[1]:
                    continue
                s = np.maximum(np.round(x[at] @ q[who].T, 9), 0.0)
                for j, w in enumerate(who):
                    top = np.argsort(-s[:, j], kind="stable")[: k + 1]  # one more, as the query itself may be among them
                    found_q += [int(w)] * len(top)
                    found_at += at[top].tolist()
                    found_s += s[top, j].tolist()
            keep = [i for i in range(len(found_q)) if values[found_at[i]] != names[found_q[i]]]
            yield pa.RecordBatch.from_arrays([pa.array([str(names[found_q[i]]) for i in keep], pa.string()), ids.take(pa.array([found_at[i] for i in keep], pa.int64())), pa.array([found_s[i] for i in keep], pa.float64())], names=["query", "id", "sim"])

    return rows.select("id", "v", "cell").mapInArrow(run, T.StructType([T.StructField("query", T.StringType()), T.StructField("id", kind), T.StructField("sim", T.DoubleType())]))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers that a search found."""
    both = exact.select("query", "id").join(found.select("query", "id").withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
