"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = 1 / (1 + exp(-y)), y = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. The pairs are never listed: their sum is
half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2, so a text costs as many steps as it has features.

Features: words in BUCKETS hashed buckets, by their logarithmic counts scaled to length one; shares of kinds of bytes, of
repeated words and the like, as values and by bins; metadata columns, by bins of their logarithms. Workers extract them in numpy from whole texts, for training as for
scoring. Training takes at most about `rows` labelled rows, those with the least hashes of the id, in the labels' own
proportion; their features (at most BUCKETS and a few a row) go to the driver, where Adagrad steps in numpy fit the machine. A fifth of them is kept aside to
set a temperature and a bias (least log loss), so scores are probabilities.

Defined results: null and empty texts have structure features only and get a score; without labelled rows of both kinds every score is the
share of label 1 (1 without any); rows without an id are not learned from and not held out; a document with several labels is one row for each;
repeated rows are scored each; an empty table gives no rows; a very long text is worked on in parts whose counts are added. Only id, text and the metadata
columns named are read; other columns pass through and may have any names.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, col, free_name, map_rows, small_batches, table
from .language_id import fold
from .word_columns import LOWER, Words, bytes_in, slices, summed

BUCKETS, RANK, BINS = 1 << 16, 8, 12
#: Labelled rows that are learned from at most, about; and times that each is seen.
ROWS, EPOCHS = 8000, 12
RATE, DECAY, STEP = 0.08, 1e-5, 32
_SPACE = bytes_in((0x20, 0x20), (0x09, 0x0D))
_KINDS = np.zeros(256, np.int64)  # space 0
for _k, _spans in enumerate((((0x61, 0x7A),), ((0x41, 0x5A),), ((0x30, 0x39),), ((0x80, 0xFF),), ((0x0A, 0x0A), (0x0D, 0x0D))), 1):
    _KINDS[bytes_in(*_spans)] = _k
_KINDS[np.frombuffer(b".,;:'\"-()", np.uint8)] = 6
_KINDS[np.frombuffer(b"!?", np.uint8)] = 7
_KINDS[np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>@~^_+=\\/[]{}`", np.uint8))] = 8
KINDS = 9
STATS = 12


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # features x (1 + rank): w and v
    scale: float = 1.0
    shift: float = 0.0


def width(meta: int) -> int:
    return BUCKETS + STATS * (1 + BINS) + meta * (BINS + 1)


def features(texts: pa.Array, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, features, values) of texts, side by side. meta: numbers by text, NaN for none."""
    n = len(texts)
    keys, counts, kinds, words = [], [], np.zeros((n, KINDS), np.int64), np.zeros(n, np.int64)
    for first, starts, data in slices(texts, _SPACE):
        w = Words(starts, data, ~_SPACE, LOWER)
        bucket = (w.hashes() >> np.uint64(48)).astype(np.int64) % BUCKETS
        key, c = np.unique((w.text + first) * BUCKETS + bucket, return_counts=True)
        keys.append(key)
        counts.append(c)
        words += np.bincount(w.text + first, minlength=n)
        of = np.searchsorted(starts, np.arange(len(data)), "right") - 1 if len(starts) == 1 else np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))
        kinds += np.bincount((of + first) * KINDS + _KINDS[data], minlength=n * KINDS).reshape(n, KINDS)
    key, c = summed(np.concatenate(keys) if keys else np.zeros(0, np.int64), np.concatenate(counts) if counts else np.zeros(0, np.int64))
    text, value = key // BUCKETS, np.log1p(c)
    value = value / np.sqrt(np.bincount(text, value**2, n))[text]
    stats = _stats(kinds, words, np.bincount(text, minlength=n))
    bins = np.minimum((stats * BINS).astype(np.int64), BINS - 1)
    place = np.arange(STATS)
    of = np.repeat(np.arange(n), STATS)
    parts = [(text, key % BUCKETS, value), (of, np.tile(BUCKETS + place, n), stats.ravel()), (of, (BUCKETS + STATS + place * BINS + bins).ravel(), np.full(n * STATS, 0.5))]
    for m, x in enumerate(meta):
        bin_ = np.where(np.isnan(x), BINS, np.minimum(np.log1p(np.maximum(np.nan_to_num(x), 0)), BINS - 1)).astype(np.int64)
        parts.append((np.arange(n), BUCKETS + STATS * (1 + BINS) + m * (BINS + 1) + bin_, np.full(n, 0.5)))
    text, feature, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(text, kind="stable")
    return np.append(0, np.cumsum(np.bincount(text, minlength=n))), feature[order], value[order].astype(np.float32)


def _stats(kinds: np.ndarray, words: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 about each text's form."""
    k, w, size = kinds.astype(float), np.maximum(words, 1), np.maximum(kinds.sum(axis=1), 1)
    letters = np.maximum(k[:, 1] + k[:, 2] + k[:, 4], 1)
    solid = size - k[:, 0] - k[:, 5]
    share = [k[:, 2] / letters, k[:, 3] / size, k[:, 4] / size, k[:, 5] / w, k[:, 6] / w, k[:, 7] / w, k[:, 8] / w, letters / size, distinct / w, solid / w / 20, np.log1p(words) / 12, (words == 0).astype(float)]
    return np.clip(np.stack(share, 1), 0, 1)


def margins(m: Machine, at: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """y of each row, in time linear in its features."""
    x = m.weights[feature] * value[:, None]
    sums = np.add.reduceat(x, at[:-1], axis=0)
    squares = np.add.reduceat(x[:, 1:] ** 2, at[:-1], axis=0)
    return (m.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares.sum(axis=1))).astype(float)


def probability(m: Machine, y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m.scale * y + m.shift, -35, 35)))


def train(rows: list[tuple[int, int, np.ndarray, np.ndarray]], meta: int = 0, seed: int = 3, epochs: int = EPOCHS) -> Machine:
    """Fit on (id, label, features, values); the order of rows does not matter."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], len(r[2])))
    labels = np.array([r[1] for r in rows], float)
    rng = np.random.default_rng(seed)
    weights = np.zeros((width(meta), 1 + RANK), np.float32)
    if not len(rows) or labels.min() == labels.max():
        return Machine(40.0 * float(np.sign(labels.mean() - 0.5)) if len(rows) else 40.0, weights)
    weights[:, 1:] = rng.normal(0, 0.05, (len(weights), RANK))
    turn = rng.permutation(len(rows))
    aside = turn[: len(rows) // 5] if len(rows) >= 50 else turn[:0]
    fit = turn[len(aside) :]
    m = Machine(float(np.log(labels[fit].mean() / max(1 - labels[fit].mean(), 1e-3)) if 0 < labels[fit].mean() < 1 else 0.0), weights)
    seen = np.full_like(weights, 1e-2)
    for _ in range(epochs):
        for start in range(0, len(fit), STEP):
            part = fit[start : start + STEP]
            feature, value = np.concatenate([rows[i][2] for i in part]), np.concatenate([rows[i][3] for i in part])
            sizes = np.array([len(rows[i][2]) for i in part])
            at = np.append(0, np.cumsum(sizes))
            x = m.weights[feature] * value[:, None]
            sums = np.add.reduceat(x, at[:-1], axis=0)
            y = m.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - np.add.reduceat(x[:, 1:] ** 2, at[:-1], axis=0).sum(axis=1))
            err = (1 / (1 + np.exp(-np.clip(y, -35, 35))) - labels[part]).astype(np.float32) / len(part)
            each = np.repeat(err, sizes)[:, None] * value[:, None]
            grad = np.empty_like(x)
            grad[:, :1] = each
            grad[:, 1:] = each * (np.repeat(sums[:, 1:], sizes, axis=0) - x[:, 1:])
            key, total = summed(feature, grad)
            total += DECAY * m.weights[key]
            seen[key] += total**2
            m.weights[key] -= np.float32(RATE) * total / np.sqrt(seen[key])
            m.bias -= RATE * float(err.sum())
        fit = rng.permutation(fit)
    if len(aside) and 0 < labels[aside].sum() < len(aside):
        y = np.array([margins(m, np.array([0, len(rows[i][2])]), rows[i][2], rows[i][3])[0] for i in aside])
        m.scale, m.shift = _calibrated(y, labels[aside])
    return m


def _calibrated(y: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and shift of least log loss, by Newton steps with a little shrinkage to (1, 0)."""
    p, x = np.array([1.0, 0.0]), np.stack([y, np.ones_like(y)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -35, 35)))
        g = x.T @ (q - label) + 1e-1 * (p - [1.0, 0.0])
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-1 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return max(float(p[0]), 1e-3), float(p[1])


def _extract(docs: DataFrame, meta: tuple[str, ...]) -> DataFrame:
    """id, label, features, values over rows id, label, text and metadata columns."""

    def run(batches):
        for b in batches:
            found = features(b.column(2), [b.column(3 + i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(len(meta))])
            offsets = pa.array(found[0].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in ((found[1], pa.int32()), (found[2], pa.float32()))]
            yield batch_of([b.column(0), b.column(1), *lists])

    d = docs.toDF(*map(str, range(len(docs.columns))))
    return small_batches(d).mapInArrow(run, "`0` long, `1` int, `2` array<int>, `3` array<float>").toDF("id", "label", "features", "values")


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta: tuple[str, ...] = (),
        rows: int = ROWS) -> Machine:
    """Train on about `rows` labelled rows at most, whatever the size of either table; where is a condition on id."""
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.where(where) if where is not None else known
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "id"), 11) / float(1 << 53)
    d = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), *[col(c).cast("double").alias(f"meta{i}") for i, c in enumerate(meta)])
    sample = d.join(known.where(draw < share), "id").select(F.xxhash64("id").alias("id"), "label", "text", *[f"meta{i}" for i in range(len(meta))])
    got = _extract(sample, meta).toArrow()
    lists = [[x.values.to_numpy() for x in got[c]] for c in ("features", "values")]
    return train(list(zip(got["id"].to_pylist(), got["label"].to_pylist(), [x.astype(np.int64) for x in lists[0]], lists[1])), len(meta))


def predict(docs: DataFrame, machine: Machine, text_col: str = "text", meta: tuple[str, ...] = (), name: str = "quality_score") -> DataFrame:
    """docs with one more column: the probability of label 1."""
    name = free_name(docs, name)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    at, more = docs.columns.index(text_col), [docs.columns.index(c) for c in meta]

    def run(batches):
        for b in batches:
            if b.num_rows:
                numbers = [b.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in more]
                yield batch_of([*b.columns, pa.array(probability(held.value, margins(held.value, *features(b.column(at), numbers))))])

    return map_rows(docs, run, f"{name} double")


#: The bound of op12 between predictions.
BOUND = 0.3


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = fit(docs, table(spark, sf_dir, "labels"), fold("id", 5) != 0, meta=("n_chars",))
    out = predict(docs, machine, meta=("n_chars",), name="score")
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= BOUND).cast("int").alias("predicted"))
