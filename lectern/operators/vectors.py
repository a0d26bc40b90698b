"""Vector similarity, BM25 and hybrid search."""
from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import ensure_checkpoint_dir, global_rank, rrf


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


#: Query vectors that are held against all rows at a time.
QUERY_BLOCK = 1_000


def best_cosine(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """id, score: the greatest cosine with any of the query vectors, a stated query set that is held against all rows in blocks."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    best = []
    for k in range(blocks):
        q = queries.select(F.col("v").alias("qv"))
        q = q if blocks == 1 else q.where(F.pmod(F.xxhash64("qv"), F.lit(blocks)) == k)
        best.append(vectors.crossJoin(F.broadcast(q)).groupBy("id").agg(F.max(cosine("v", "qv")).alias("score")))
    return functools.reduce(DataFrame.union, best).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))


def query_similarity(vectors: DataFrame, query: list[float]) -> DataFrame:
    """id, sim: clipped at 0. The query vector is a literal, so nothing is joined."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", F.greatest(F.lit(0.0), cosine(F.col("v"), q)).alias("sim"))


def _term_counts(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """id, size and the counts of the wanted terms (an array) of documents id, toks: a row of a few numbers each."""
    tf = F.array(*[F.size("toks") - F.size(F.array_remove("toks", t)) for t in wanted]).cast("array<int>")
    return docs.select("id", F.size("toks").alias("size"), tf.alias("tf"))


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.5, b: float = 0.75, share: float = 0.25, counts: DataFrame | None = None) -> DataFrame:
    """id, score of every document (id, toks). Repeated query terms add; a negative idf becomes `share` times the mean idf.

    Lengths and the terms' counts (counts: already computed by _term_counts) are all that scores need; only where an idf is negative
    are the document frequencies of all words counted, for their mean."""
    wanted = list(dict.fromkeys(terms))
    counts = _term_counts(docs, wanted) if counts is None else counts
    got = counts.agg(F.count("*").alias("n"), F.avg("size").alias("avg"), *[F.count_if(F.col("tf")[k] > 0).alias(f"d{k}") for k in range(len(wanted))]).first()
    n_docs, avg = got["n"], got["avg"]
    if not n_docs or not avg:
        return counts.select("id", F.lit(0.0).alias("score"))
    weights = [math.log(n_docs - got[f"d{k}"] + 0.5) - math.log(got[f"d{k}"] + 0.5) if got[f"d{k}"] else None for k in range(len(wanted))]
    if any(w is not None and w < 0 for w in weights):
        df = docs.select(F.explode(F.array_distinct("toks")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
        mean = df.agg(F.avg(F.log(F.lit(float(n_docs)) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))).first()[0]
        weights = [share * (mean or 0.0) if w is not None and w < 0 else w for w in weights]
    score, size = F.lit(0.0), F.col("size")
    for k, w in enumerate(weights):
        if w is not None:
            tf = F.col("tf")[k]
            score = score + terms.count(wanted[k]) * w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / float(avg)))
    return counts.select("id", score.alias("score"))


def ranked(scores: DataFrame, score: str, n_rows: int) -> DataFrame:
    """id, rank by score, ties by id."""
    return global_rank(scores.select("id", score), [F.col(score).desc(), F.col("id").asc()], "rank", n_rows).select("id", "rank")


def hybrid_search(docs: DataFrame, vectors: DataFrame, terms: list[str], query: list[float], floor: float = 0.7) -> DataFrame:
    """id, score, sim of what reaches floor times the best similarity; fusion of the lexical and the vector ranking.

    Both are computed before any filter, as filters must only shrink a result. Vectors and texts are read once each: what
    the rankings need is a few numbers a row, kept in the checkpoint folder."""
    ensure_checkpoint_dir(docs.sparkSession)
    sim = query_similarity(vectors, query).withColumn("sim", F.round("sim", 9)).checkpoint()
    counts = _term_counts(docs, list(dict.fromkeys(terms))).checkpoint()
    n, top = sim.agg(F.count("*"), F.max("sim")).first()
    lex = bm25(docs, terms, counts=counts).withColumn("score", F.round("score", 9))
    fused = rrf(ranked(sim, "sim", n), ranked(lex, "score", counts.count()))
    best = sim.where(F.col("sim") >= floor * F.lit(top))
    return fused.join(best, "id").select("id", F.round("score", 6).alias("score"), F.round("sim", 6).alias("sim"))


def best_sentence(sentences: DataFrame, query: list[float]) -> DataFrame:
    """Rows id, pos, sentence, v -> the sentence of each document that is closest to the query, ties to the first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = sentences.withColumn("s", F.round(cosine(F.col("v"), q), 9))
    return s.groupBy("id").agg(F.max_by("sentence", F.struct("s", -F.col("pos"))).alias("sentence"), F.round(F.max("s"), 6).alias("sim"))


def blended(rows: DataFrame, target: dict, weight: float = 0.7) -> DataFrame:
    """Rows id, v, g: similarity to target's v and g; the graph part counts only if every row has a graph vector."""
    whole = rows.agg((F.count_if(F.col("g").isNull()) == 0).alias("whole"))
    lit = lambda x: F.array(*[F.lit(float(y)) for y in x])
    c = cosine(F.col("v"), lit(target["v"]))
    if target.get("g") is None:
        return rows.select("id", F.round(c, 6).alias("sim"))
    return rows.crossJoin(F.broadcast(whole)).select("id", F.round(F.when(F.col("whole"), weight * c + (1 - weight) * cosine(F.col("g"), lit(target["g"]))).otherwise(c), 6).alias("sim"))


#: Rows of a block of the pairwise product, at least and at most, and of a tile of two blocks that is sent out at once. There are PAIR_BLOCKS blocks if these bounds allow, and each is
#: sent to as many tasks.
PAIR_BLOCK, LARGEST_BLOCK, PAIR_BLOCKS = 512, 8_192, 32


def pairwise(rows: DataFrame, weight: float = 0.7, block: int | None = None) -> DataFrame:
    """a <= b, sim of all pairs of a stated set of rows id, v, g (ids unique): 1 on the diagonal; the graph part counts only if every row has g.

    The result has a row for each pair, so the set is one that a user names. Rows are gathered in blocks of `block` (default: larger ones for more rows, so that no more
    than some PAIR_BLOCKS copies are shuffled), each block meets the blocks from itself on by a join of block numbers, and a task multiplies two blocks, tile by tile."""
    import numpy as np
    import pyarrow as pa

    n, whole = rows.agg(F.count("*"), F.coalesce(F.min(F.col("g").isNotNull().cast("int")), F.lit(0))).first()
    if not n:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("sim")).limit(0)
    kind = rows.schema["id"].dataType.simpleString()
    block = block or min(LARGEST_BLOCK, max(PAIR_BLOCK, -(-n // PAIR_BLOCKS)))
    blocks = -(-n // block)
    d = global_rank(rows.select("id", F.col("v").cast("array<double>").alias("v"), F.col("g").cast("array<double>").alias("g")), [F.col("id")], "r", n)
    d = d.withColumn("k", F.floor((F.col("r") - 1) / block).cast("int")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("r", "id", "v", "g"))).alias("m"))
    pick = lambda c: F.transform("m", lambda s: s[c])
    d = d.select("k", pick("id").alias("ids"), F.flatten(pick("v")).alias("v"), F.flatten(pick("g")).alias("g") if whole else F.array().cast("array<double>").alias("g"))
    d = d.checkpoint() if d.sparkSession.sparkContext.getCheckpointDir() else d
    left = d.withColumn("k2", F.explode(F.sequence(F.col("k"), F.lit(blocks - 1))))
    both = left.join(d.toDF("k2", "ids2", "v2", "g2"), "k2").select("k", "k2", "ids", "v", "g", "ids2", "v2", "g2")

    def unit(column, rows_):
        x = np.asarray(column.values).reshape(rows_, -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    tile = PAIR_BLOCK

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                k, k2 = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                ids, ids2 = b.column(2)[i].values, b.column(5)[i].values
                u, u2 = unit(b.column(3)[i], len(ids)), unit(b.column(6)[i], len(ids2))
                g, g2 = (unit(b.column(4)[i], len(ids)), unit(b.column(7)[i], len(ids2))) if whole else (None, None)
                for at in range(0, len(ids), tile):
                    for to in range(at if k == k2 else 0, len(ids2), tile):
                        p, q = slice(at, at + tile), slice(to, to + tile)
                        s = u[p] @ u2[q].T
                        if whole:
                            s = weight * s + (1 - weight) * (g[p] @ g2[q].T)
                        own = k == k2 and at == to
                        x, y = np.nonzero(np.triu(np.ones(s.shape, bool))) if own else np.nonzero(np.ones(s.shape, bool))
                        value = np.where(x == y, 1.0, s[x, y]) if own else s[x, y]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x + at)), ids2.take(pa.array(y + to)), pa.array(value)], names=["a", "b", "sim"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, sim double")


#: What the encoder wants ahead of a text.
PASSAGE, QUERY = "passage: ", "query: "


def passage_text(title: Column, abstract: Column, keywords: Column) -> Column:
    """What a paper's vector is made of: the title twice, the abstract, the keywords (an array); absent parts go."""
    part = lambda c: F.nullif(c, F.lit(""))
    return F.concat(F.lit(PASSAGE), F.concat_ws(" ", part(title), part(title), part(abstract), part(F.array_join(keywords, " "))))


def query_text(query: Column) -> Column:
    return F.concat(F.lit(QUERY), query)


def embedded(rows: DataFrame, text: str, encoder: Callable[[], Callable], name: str = "v") -> DataFrame:
    """rows with the vector of a text column. encoder: makes, once in a task, a function from a list of texts to their vectors.

    A null text has no vector."""
    import pyarrow as pa
    from pyspark.sql import types as T

    at = rows.columns.index(text)

    def run(batches: Iterator):
        encode = encoder()
        for b in batches:
            texts = b.column(at).to_pylist()
            some = [t for t in texts if t is not None]
            made = iter(encode(some) if some else [])
            vectors = [None if t is None else [float(x) for x in next(made)] for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))
