"""Unsupervised graph embedding by sampled neighbourhoods (two mean-aggregating layers), trained over partitions.

An epoch samples each node's neighbours with replacement as joins: a slot draws a place in the node's list by a hash of seed, epoch, node and slot.
A step then passes messages: nodes' embeddings under the current weights, a join that brings them to the step's edges and negative
samples, gradients of embeddings added up by node, and gradients of weights added up over partitions. Only weights and
their gradients (a fixed size) reach the driver, where Adam updates them. A second-hop sample is drawn once for a node and epoch and shared
by all who reach the node.

Fixed size per row: 1 + S1 + S2 feature vectors. Nodes without neighbours are their own neighbours. Runs with a seed agree up to the
order of floating-point sums."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ensure_checkpoint_dir, global_rank


@dataclass(frozen=True)
class Config:
    hidden: int = 256
    size: int = 128
    samples: tuple[int, int] = (25, 10)
    epochs: int = 30
    steps: int = 8
    rate: float = 0.005
    negatives: int = 5
    seed: int = 42


@dataclass
class Weights:
    """Two layers on (own, neighbours' mean) side by side, with their biases."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def start(cls, width: int, c: Config) -> Weights:
        rng = np.random.default_rng(c.seed)
        draw = lambda n, m: rng.uniform(-1, 1, (n, m)) / np.sqrt(n)
        return cls(draw(2 * width, c.hidden), np.zeros(c.hidden), draw(2 * c.hidden, c.size), np.zeros(c.size))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.w1, self.b1, self.w2, self.b2)])

    def like(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for x in (self.w1, self.b1, self.w2, self.b2):
            out.append(flat[at : at + x.size].reshape(x.shape))
            at += x.size
        return Weights(*out)


@dataclass
class Adam:
    rate: float
    m: np.ndarray | float = 0.0
    v: np.ndarray | float = 0.0
    t: int = 0
    eps: float = field(default=1e-8, repr=False)

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return x - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + self.eps)


def forward(w: Weights, x: np.ndarray, hop: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Unit embeddings of nodes x (B, F) with sampled neighbours hop (B, S, 2F: own and their sampled mean), and what backward needs."""
    own = np.concatenate([x, hop[:, :, : x.shape[1]].mean(axis=1)], axis=1)
    s = np.maximum(own @ w.w1 + w.b1, 0)
    g = np.maximum(hop @ w.w1 + w.b1, 0)
    both = np.concatenate([s, g.mean(axis=1)], axis=1)
    o = both @ w.w2 + w.b2
    norm = np.maximum(np.linalg.norm(o, axis=1, keepdims=True), 1e-12)
    return o / norm, (own, s, g, both, norm)


def backward(w: Weights, hop: np.ndarray, z: np.ndarray, kept: tuple, dz: np.ndarray) -> Weights:
    own, s, g, both, norm = kept
    do = (dz - z * (z * dz).sum(axis=1, keepdims=True)) / norm
    d = do @ w.w2.T
    h = w.w1.shape[1]
    ds = d[:, :h] * (s > 0)
    dg = (d[:, h:] / hop.shape[1])[:, None, :] * (g > 0)
    w1 = own.T @ ds + np.tensordot(hop, dg, axes=([0, 1], [0, 1]))
    return Weights(w1, ds.sum(axis=0) + dg.sum(axis=(0, 1)), both.T @ do, do.sum(axis=0))


def edge_gradients(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses of rows (edges, 2 + negatives, size) of both ends and the negatives, and the gradients of all of them."""
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -35, 35)))
    u, v, neg = z[:, 0], z[:, 1], z[:, 2:]
    pos, far = (u * v).sum(axis=1), np.einsum("bkd,bd->bk", neg, u)
    p, n = sig(pos) - 1, sig(far)
    d = np.empty_like(z)
    d[:, 0] = p[:, None] * v + np.einsum("bk,bkd->bd", n, neg)
    d[:, 1] = p[:, None] * u
    d[:, 2:] = n[:, :, None] * u[:, None, :]
    return -np.log(np.maximum(sig(pos), 1e-12)) - np.log(np.maximum(1 - n, 1e-12)).sum(axis=1), d


def _uniform(*parts) -> Column:
    """A number in [0, 1) by the hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*[F.lit(p) if isinstance(p, (int, str)) else p for p in parts]), 11) / float(1 << 53)


def numbered(vectors: DataFrame) -> tuple[DataFrame, int]:
    """n (from 0), id, x of rows id, v."""
    count = vectors.count()
    x = global_rank(vectors.select("id", F.col("v").cast("array<double>").alias("x")), [F.col("id")], "r", count)
    return x.select((F.col("r") - 1).cast("long").alias("n"), "id", "x"), count


def neighbours(both: DataFrame) -> DataFrame:
    """n, place, near, degree: each node's neighbours in order."""
    w = Window.partitionBy("n")
    return both.select("n", "near", (F.row_number().over(w.orderBy("near")) - 1).alias("place"), F.count("*").over(w).alias("degree"))


def drawn(nodes: DataFrame, lists: DataFrame, size: int, *salt) -> DataFrame:
    """n, slot, near: `size` neighbours of each node with replacement; a node without any draws itself."""
    degree = lists.where("place = 0").select("n", "degree")
    x = nodes.select("n").join(degree, "n", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    x = x.withColumn("place", F.floor(_uniform(*salt, F.col("n"), F.col("slot")) * F.col("degree")).cast("int"))
    return x.join(lists.select("n", "place", "near"), ["n", "place"], "left").select("n", "slot", F.coalesce("near", "n").alias("near"))


def sampled(nodes: DataFrame, lists: DataFrame, samples: tuple[int, int], *salt) -> DataFrame:
    """n, x, hop (own features and sampled mean of each drawn neighbour, one after the other) of each node."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    far = drawn(nodes, lists, samples[1], 2, *salt).join(nodes.select(F.col("n").alias("near"), array_to_vector("x").alias("y")), "near")
    mean = far.groupBy("n").agg(Summarizer.mean(F.col("y")).alias("m")).select("n", vector_to_array("m").alias("m"))
    full = nodes.join(mean, "n").select(F.col("n").alias("near"), F.concat("x", "m").alias("f"))
    hop = drawn(nodes, lists, samples[0], 1, *salt).join(full, "near").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("slot", "f"))).alias("h"))
    return nodes.join(hop, "n").select("n", "x", F.flatten(F.transform("h", lambda s: s["f"])).alias("hop"))


def _numbers(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1)


def _nodes_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = _numbers(b.column(1), b.num_rows)
    return x, _numbers(b.column(2), b.num_rows).reshape(b.num_rows, -1, 2 * x.shape[1])


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def embedded(inputs: DataFrame, weights: Weights) -> DataFrame:
    """n, z."""
    held = inputs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(forward(held.value, *_nodes_of(b))[0])], names=["n", "z"])

    return inputs.mapInArrow(run, "n long, z array<double>")


#: Numbers of a gradient in one row.
CHUNK = 4096


def gradients(inputs: DataFrame, weights: Weights, edges: DataFrame, n_nodes: int, c: Config, *salt) -> tuple[float, np.ndarray] | None:
    """Mean loss of the edges (a, b) and the mean gradient of the weights, None without edges."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    negative = F.transform(F.sequence(F.lit(1), F.lit(c.negatives)), lambda k: F.floor(_uniform(3, *salt, F.col("a"), F.col("b"), k) * n_nodes).cast("long"))
    member = edges.select("a", "b", F.posexplode(F.concat(F.array("a", "b"), negative)).alias("place", "n"))
    rows = member.join(embedded(inputs, weights), "n").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("place", "n", "z"))).alias("m"))
    rows = rows.select(F.transform("m", lambda s: s["n"]).alias("ns"), F.flatten(F.transform("m", lambda s: s["z"])).alias("zs"))

    def of_edges(batches):
        for b in batches:
            if b.num_rows:
                n = _numbers(b.column(0), b.num_rows)
                loss, d = edge_gradients(_numbers(b.column(1), b.num_rows).reshape(*n.shape, -1))
                d = np.concatenate([d, np.zeros((*n.shape, 2))], axis=2)  # loss and count travel with the first end
                d[:, 0, -2], d[:, 0, -1] = loss, 1
                yield pa.RecordBatch.from_arrays([pa.array(n.ravel()), _lists(d.reshape(n.size, -1))], names=["n", "d"])

    per_node = rows.mapInArrow(of_edges, "n long, d array<double>").groupBy("n").agg(Summarizer.sum(array_to_vector("d")).alias("d"))
    held = inputs.sparkSession.sparkContext.broadcast(weights)

    def of_nodes(batches):
        total, extra = None, np.zeros(2)
        for b in batches:
            if b.num_rows:
                d = _numbers(b.column(3), b.num_rows)
                x, hop = _nodes_of(b)
                z, kept = forward(held.value, x, hop)
                g = backward(held.value, hop, z, kept, d[:, :-2]).flat()
                total, extra = g if total is None else total + g, extra + d[:, -2:].sum(axis=0)
        if total is not None:
            flat = np.concatenate([total, extra])
            parts = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tolist() for p in parts])], names=["k", "g"])

    near = inputs.join(per_node, "n").select("n", "x", "hop", vector_to_array("d").alias("d"))
    sums = near.mapInArrow(of_nodes, "k int, g array<double>").groupBy("k").agg(Summarizer.sum(array_to_vector("g")).alias("g")).orderBy("k").collect()
    if not sums:
        return None
    flat = np.concatenate([r["g"].toArray() for r in sums])
    return flat[-2] / flat[-1], flat[:-2] / flat[-1]


def train(vectors: DataFrame, edges: DataFrame, config: Config | None = None) -> tuple[DataFrame, list[float]]:
    """id, v (unit embeddings) of rows id, v and undirected edges a, b, and the mean loss of each epoch.

    Edges with an end outside the vectors and loops are left out; without any edge the first weights decide."""
    c = config or Config()
    ensure_checkpoint_dir(vectors.sparkSession)
    nodes, count = numbered(vectors)
    nodes = nodes.checkpoint()
    first = nodes.select(F.size("x").alias("w")).first()
    if first is None:
        return vectors.select("id", F.col("v").cast("array<double>").alias("v")), []
    end = lambda k: nodes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"))
    e = edges.select("a", "b").join(end("a"), "a").join(end("b"), "b").where("na <> nb")
    e = e.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct().checkpoint()
    lists = neighbours(e.toDF("n", "near").union(e.select("b", "a"))).checkpoint()
    x = nodes.select("n", "x")
    weights, adam, losses = Weights.start(first["w"], c), Adam(c.rate), []
    for epoch in range(c.epochs):
        inputs = sampled(x, lists, c.samples, c.seed, epoch).checkpoint()
        fold = F.pmod(F.xxhash64(F.lit(c.seed), F.lit(epoch), "a", "b"), F.lit(c.steps))
        of_epoch = []
        for step in range(c.steps):
            found = gradients(inputs, weights, e.where(fold == step), count, c, c.seed, epoch)
            if found is not None:
                of_epoch.append(found[0])
                weights = weights.like(adam.step(weights.flat(), found[1]))
        losses.append(float(np.mean(of_epoch)) if of_epoch else 0.0)
    z = embedded(sampled(x, lists, c.samples, c.seed, c.epochs).checkpoint(), weights)
    return nodes.select("n", "id").join(z, "n").select("id", F.col("z").alias("v")), losses


def link_scores(vectors: DataFrame, edges: DataFrame, absent: DataFrame) -> DataFrame:
    """score, y of held-out edges and absent pairs (a, b): the dot product of the ends' vectors; for AGG29's area under the curve."""
    from .vectors import dot

    pairs = edges.select("a", "b", F.lit(True).alias("y")).union(absent.select("a", "b", F.lit(False)))
    a, b = vectors.toDF("a", "va"), vectors.toDF("b", "vb")
    return pairs.join(a, "a").join(b, "b").select(F.round(dot("va", "vb"), 9).alias("score"), "y")
