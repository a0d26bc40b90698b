"""Language-model scores from a hidden Markov model trained on the whole corpus.

Tokens are words (ASCII letters lower-cased) and an end for each text. Counting is exact: every partition counts, Spark adds.
A latent state emits a class of words: each of the TOP commonest words is one, all others fall into HASHED classes by a
hash, and within a class words have add-0.1 shares of their counts (an unseen word has the share of one unseen type). So
the emission table has a fixed size however large the vocabulary. Baum-Welch: each partition runs scaled forward and
backward recursions over its training texts and emits expected counts; Spark adds them; the driver normalises STATES x classes
numbers. Scoring runs the scaled forward recursion over each whole text, which gives its exact likelihood.

A text of more than LONG tokens is one sequence like any other: its pieces are stepped through side by side, first from each
state, which gives a STATES x STATES transfer matrix for each; the matrices, multiplied in order, give the forward vector before and the
backward vector behind each piece, and with these the pieces are as good as the whole.

Word counts: words of at least a threshold (chosen so that at most COMMON words reach it) are broadcast; a text's other words
are joined with the count table, so neither side of the vocabulary is dropped. Expected counts are added as whole numbers of
1 / UNIT and rare words' logarithms as decimals, so sums do not depend on the order in which tasks end, and reruns agree.

Defined results: a null text is an empty one and has its end token only; a null id is trained on and not held out; without training
texts all counts are 0; words of equal counts are ordered by their bytes; repeated rows count and are scored each; an empty
table gives no rows. Only id and text are read, so other columns may have any names.
"""
from __future__ import annotations

import math
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, table

STATES, ITERATIONS = 6, 4
TOP, HASHED = 4096, 4096
COMMON = 200_000
GROUP = 600_000
#: Texts of more than LONG tokens are stepped through in pieces.
LONG, PIECE = 20_000, 2_000
#: Expected counts are added in so many parts of one.
UNIT = 1 << 20
#: So many texts are split into words at a time.
SLICE = 500
STRENGTH = 50.0
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    out = text.lower().split() if text else []
    out.append(END)
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over rows t (binary)."""

    def run(batches):
        seen: dict[bytes, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                for w in tokens(t):
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) > 500_000:
                    yield rows()
                    seen.clear()
        yield rows()

    return small_batches(docs.select("t")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What workers need of the counts: the common words' classes and log counts, and each class's total."""

    def __init__(self, common: list[tuple[bytes, int]], sums: dict[int, tuple[int, int]], n: int, v: int):
        common = sorted(common, key=lambda x: (-x[1], x[0]))
        self.words = [w for w, _ in common]
        self.n, self.v = n, v
        counts = np.array([c for _, c in common], float)
        self.cls = np.array([i if i < TOP else hashed(w) for i, w in enumerate(self.words)], np.int32)
        self.logc = np.log10(counts + 0.1)
        total = np.array([sums.get(k, (0, 0)) for k in range(HASHED)], float).reshape(HASHED, 2)
        for w, c in common[:TOP]:
            total[hashed(w) - TOP] -= (c, 1)
        mass = np.concatenate([np.zeros(TOP), total[:, 0] + 0.1 * (total[:, 1] + 1)])
        mass[: min(TOP, len(common))] = counts[:TOP] + 0.1
        self.log_mass = np.log10(np.maximum(mass, 1e-300))
        self.share = mass / mass.sum()
        #: Terms within a class of one word cancel, so a common word's share there is 1.
        self.base = math.log10(n + 0.1 * (v + 1)) if n else 0.0

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}


def hashed(word: bytes) -> int:
    return TOP + zlib.crc32(word) % HASHED


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the written table of counts. What reaches the driver: COMMON words, HASHED sums and a histogram of some 3,000 bins."""
    cls = (F.crc32("word") % HASHED).cast("int")
    sums = {r["k"]: (r["c"], r["v"]) for r in counts.groupBy(cls.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    # Counts up to 1,023 have a bin each; above, a power of two has 64. A bin's least count is a threshold.
    wide = F.when(F.col("c") < 1024, 1).otherwise(F.shiftright(F.expr("cast(conv('1' || repeat('0', length(bin(c)) - 1), 2, 10) as bigint)"), 6))
    per = sorted(((r["b"], r["n"]) for r in counts.select((F.col("c") - F.col("c") % wide).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for c, k in per:
        if held + k > COMMON:
            break
        least, held = c, held + k
    common = [(bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") >= least).collect()] if least is not None else []
    return Vocabulary(common, sums, sum(c for c, _ in sums.values()), sum(v for _, v in sums.values()))


class Parameters:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # K, K x K, classes x K


def first_guess(vocab: Vocabulary, states: int, seed: int = 5) -> Parameters:
    rng = np.random.default_rng(seed)
    emit = vocab.share[:, None] * np.exp(rng.normal(0, 1.0, (len(vocab.share), states)))
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    return Parameters(np.full(states, 1 / states), move if states > 1 else np.ones((1, 1)), emit / emit.sum(axis=0))


def classes(words: list[bytes], index: dict, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token, and its place among the common words (-1: none)."""
    at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, count=len(words))
    if not len(vocab.cls):
        return np.fromiter(map(hashed, words), np.int32, count=len(words)), at
    cls = vocab.cls[at]
    for i in np.flatnonzero(at < 0).tolist():
        cls[i] = hashed(words[i])
    return cls, at


class _Columns:
    """Sequences in step: at step t the rows [off[t], off[t] + n[t]) hold the t-th tokens of the n[t] sequences that have one."""

    def __init__(self, seqs: list[np.ndarray]):
        self.rank = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        sizes = np.array([len(seqs[i]) for i in self.rank])
        t = np.concatenate([np.arange(k) for k in sizes])
        order = np.argsort(t, kind="stable")
        self.obs = np.concatenate([seqs[i] for i in self.rank])[order]
        self.doc = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.n = np.bincount(t).tolist()
        self.off = np.concatenate(([0], np.cumsum(self.n))).tolist()


def grouped(items: list, size, most: int):
    """Runs of items, longest first, of about `most` tokens."""
    run, total = [], 0
    for x in sorted(items, key=size, reverse=True):
        run.append(x)
        total += size(x)
        if total >= most:
            yield run
            run, total = [], 0
    if run:
        yield run


def buffered(batches, column: int, most: int = 8 * GROUP):
    """Lists of batches of about `most` tokens: texts of like length are then stepped through together."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.column(column).nbytes // 2
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def forward_scales(seqs: list[np.ndarray], p: Parameters, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the probability of each class sequence by the scaled forward recursion, and the last scaled vector of each.

    before: for each sequence the distribution of its first state, where it isn't the model's."""
    c, k = _Columns(seqs), len(p.start)
    scale, last = np.empty(len(c.obs)), np.empty((len(seqs), k))
    a = np.broadcast_to(p.start, (len(seqs), k)) if before is None else before[c.rank]
    for t, n in enumerate(c.n):
        i = c.off[t]
        a = (a if t == 0 else a[:n] @ p.move) * p.emit[c.obs[i : i + n]]
        s = a.sum(axis=1)
        scale[i : i + n] = s
        a = a / s[:, None]
        done = c.n[t + 1] if t + 1 < len(c.n) else 0
        last[done:n] = a[done:n]
    out, end = np.empty(len(seqs)), np.empty_like(last)
    out[c.rank] = np.bincount(c.doc, np.log10(scale), minlength=len(seqs))
    end[c.rank] = last
    return out, end


def pieces_of(seq: np.ndarray) -> list[np.ndarray]:
    return [seq[i : i + PIECE] for i in range(0, len(seq), PIECE)]


def transfers(pieces: list[np.ndarray], p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """For each piece and each state before its first token, log10 of the piece's probability and the scaled vector behind it."""
    k, at = len(p.start), max(1, GROUP // (PIECE * len(p.start)))
    runs = [pieces[i : i + at] for i in range(0, len(pieces), at)]
    got = [forward_scales([x for x in run for _ in range(k)], p, np.tile(np.eye(k), (len(run), 1))) for run in runs]
    return np.concatenate([x for x, _ in got]).reshape(-1, k), np.concatenate([x for _, x in got]).reshape(-1, k, k)


def _chain(seq: np.ndarray, p: Parameters) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], float]:
    """A long sequence's pieces; the state distribution before each, given all that is earlier; the weight of each state at
    its last token, by all that is later; and log10 of the sequence's probability."""
    pieces = pieces_of(seq)
    logs, ends = transfers(pieces, p)
    top = logs.max(axis=1)
    matrix = 10.0 ** (logs - top[:, None])[:, :, None] * ends  # rows: state at the first token; columns: state at the last
    before, total, d = [], 0.0, p.start
    for m, log in zip(matrix, top):
        before.append(d)
        f = d @ m
        s = f.sum()
        total += math.log10(s) + log
        d = f / s @ p.move
    behind, b = [], np.ones(len(p.start))
    for m in matrix[::-1]:
        behind.append(b)
        b = p.move @ (m @ b)
        b = b / b.max()
    return pieces, before, behind[::-1], total


def log_likelihood(seqs: list[np.ndarray], p: Parameters) -> np.ndarray:
    """log10 probability of each class sequence."""
    out = np.empty(len(seqs))
    short = [i for i, s in enumerate(seqs) if len(s) <= LONG]
    if short:
        out[short] = forward_scales([seqs[i] for i in short], p)[0]
    for i, s in enumerate(seqs):
        if len(s) > LONG:
            out[i] = _chain(s, p)[3]
    return out


def expected_counts(seqs: list[np.ndarray], p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, moves and emissions (classes x K) expected under p."""
    k = len(p.start)
    starts, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(p.emit), k))
    short = [s for s in seqs if len(s) <= LONG]
    if short:
        first, moves, emit, _, _ = _counts(short, p)
        starts = first.sum(axis=0)
    for s in seqs:
        if len(s) <= LONG:
            continue
        pieces, before, behind, _ = _chain(s, p)
        edge, at = [], max(1, GROUP // PIECE)
        for i in range(0, len(pieces), at):
            first, m, e, end, begin = _counts(pieces[i : i + at], p, np.array(before[i : i + at]), np.array(behind[i : i + at]))
            starts = starts + (first[0] if i == 0 else 0)
            moves, emit = moves + m, emit + e
            edge += zip(end, begin)
        for (end, _), (_, begin), piece in zip(edge, edge[1:], pieces[1:]):  # from one piece to the next
            x = end[:, None] * p.move * (p.emit[piece[0]] * begin)
            moves = moves + x / x.sum()
    return starts, moves, emit


def _counts(seqs: list[np.ndarray], p: Parameters, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Posterior of each sequence's first state; expected moves within and emissions; the forward vector at each one's last
    token and the backward one at its first.

    before: the distribution of each first state, where it isn't the model's; behind: each state's weight at the last token."""
    c, k = _Columns(seqs), len(p.start)
    move = p.move.astype(np.float32)
    e = p.emit.astype(np.float32)[c.obs]
    a = np.empty_like(e)
    scale = np.empty(len(c.obs), np.float32)
    start = np.broadcast_to(p.start, (len(seqs), k)) if before is None else before[c.rank]
    ends = np.ones((len(seqs), k), np.float32) if behind is None else (behind / behind.max(axis=1, keepdims=True))[c.rank].astype(np.float32)
    for t, n in enumerate(c.n):
        i = c.off[t]
        x = (start.astype(np.float32) if t == 0 else a[c.off[t - 1] : c.off[t - 1] + n] @ move) * e[i : i + n]
        s = np.maximum(x.sum(axis=1), 1e-30)
        scale[i : i + n] = s
        np.divide(x, s[:, None], out=a[i : i + n])
    last = np.empty((len(seqs), k))
    for t, n in enumerate(c.n):
        done = c.n[t + 1] if t + 1 < len(c.n) else 0
        last[done:n] = a[c.off[t] + done : c.off[t] + n]
    moves = np.zeros((k, k))
    b = np.ones((0, k), np.float32)
    back = move.T.copy()
    g = a  # becomes the posterior, step by step
    keep = None
    for t in range(len(c.n) - 1, -1, -1):
        i, n, m = c.off[t], c.n[t], len(b)
        here = ends[:n].copy()
        if behind is not None:  # the end's weights are free up to a factor: take the one that makes the posterior sum to 1
            here[m:] /= np.maximum((a[i + m : i + n] * here[m:]).sum(axis=1, keepdims=True), 1e-30)
        if m:
            j = c.off[t + 1]
            w = b * e[j : j + m] / scale[j : j + m, None]
            moves += (a[i : i + m].T @ w) * move
            here[:m] = w @ back
        b = here
        if t + 1 < len(c.n):
            g[c.off[t + 1] : c.off[t + 1] + m] *= keep
        keep = here
    if c.n:
        g[: c.n[0]] *= keep
    emit = np.stack([np.bincount(c.obs, g[:, s], minlength=len(p.emit)) for s in range(k)], axis=1)
    first, end, begin = (np.empty((len(seqs), k)) for _ in range(3))
    first[c.rank], end[c.rank], begin[c.rank] = g[: len(seqs)], last, b
    return first, moves, emit, end, begin


_INDEX: dict = {}


def _index(held, key: str) -> tuple[Vocabulary, dict]:
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = (held.value, held.value.index())
    return _INDEX[key]


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Rows id, t, fit once more as numbers: cls (16-bit classes of the whole text), the sums over common words, and the other words.

    The passes of training and scoring read this instead of the texts."""
    held, key = docs.sparkSession.sparkContext.broadcast(vocab), uuid.uuid4().hex

    def run(batches):
        v, index = _index(held, key)
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                n, known, logc, mass, rare, seq = [], [], [], [], [], []
                for t in b.column(1).to_pylist():
                    words = tokens(t)
                    c, at = classes(words, index, v)
                    ok = at >= 0
                    n.append(len(words))
                    known.append(int(ok.sum()))
                    logc.append(float(v.logc[at[ok]].sum()))
                    mass.append(float(v.log_mass[c].sum()))
                    rare.append([words[j] for j in np.flatnonzero(~ok).tolist()])
                    seq.append(c.astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logc, pa.float64()), pa.array(mass, pa.float64()),
                     pa.array(rare, pa.list_(pa.binary())), pa.array(seq, pa.binary())],
                    names=["id", "fit", "n", "known", "logc", "mass", "rare", "cls"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = small_batches(docs.select("id", "t", "fit")).mapInArrow(run, f"id {kind}, fit boolean, n long, known long, logc double, mass double, rare array<binary>, cls binary")
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "*"))


def train(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> Parameters:
    """Baum-Welch over the encoded rows to fit. Rows with a number below 0 carry starts and moves."""
    p = first_guess(vocab, states)
    sc, size = encoded.sparkSession.sparkContext, len(vocab.share)
    seqs = encoded.where("fit").select("cls")
    cols = [f"s{i}" for i in range(states)]
    for _ in range(iterations):
        now = sc.broadcast(p)

        def run(batches, now=now):
            starts, moves, emit = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
            for held in buffered(batches, 0):
                seqs = [np.frombuffer(raw, "<i2") for b in held for raw in b.column(0).to_pylist()]
                for group in grouped(seqs, len, GROUP):
                    x, y, z = expected_counts(group, now.value)
                    starts, moves, emit = starts + x, moves + y, emit + z
            at = np.flatnonzero(emit.sum(axis=1))
            rows = np.rint(np.concatenate([starts[None], moves, emit[at]]) * UNIT).astype(np.int64)
            names = np.concatenate([-np.arange(1, states + 2), at])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *[pa.array(rows[:, i]) for i in range(states)]], names=["cls", *cols])

        got = seqs.mapInArrow(run, "cls long, " + ", ".join(f"{c} long" for c in cols)).groupBy("cls").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in cols]).collect()
        starts, moves, emit = np.zeros(states), np.zeros((states, states)), np.zeros(p.emit.shape)
        for r in got:
            x = [float(r[c]) / UNIT for c in cols]
            if r["cls"] >= 0:
                emit[r["cls"]] = x
            elif r["cls"] == -1:
                starts[:] = x
            else:
                moves[-2 - r["cls"]] = x
        p = Parameters((starts + 1) / (starts.sum() + states), (moves + 1) / (moves.sum(axis=1, keepdims=True) + states),
                       (emit + STRENGTH * vocab.share[:, None]) / (emit.sum(axis=0) + STRENGTH))
        now.unpersist()
    return p


def score(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary, p: Parameters) -> DataFrame:
    """id, n_tokens, n_known, base_score and score of the encoded rows. counts: the written table of word counts."""
    now = encoded.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        for held in buffered(batches, 6):
            seqs = [np.frombuffer(raw, "<i2") for b in held for raw in b.column(6).to_pylist()]
            ll = np.zeros(len(seqs))
            for group in grouped(range(len(seqs)), lambda i: len(seqs[i]), GROUP):
                ll[group] = log_likelihood([seqs[i] for i in group], now.value)
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(ll[at : at + b.num_rows])], names=[*b.schema.names[:6], "ll"])
                at += b.num_rows

    kind = encoded.schema["id"].dataType.simpleString()
    part = encoded.select("row", "id", "n", "known", "logc", "mass", "cls").mapInArrow(run, f"row long, id {kind}, n long, known long, logc double, mass double, ll double")
    words = encoded.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    c = F.coalesce("c", F.lit(0))
    more = words.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("known2"), F.sum((F.col("k") * F.log10(c + 0.1)).cast("decimal(28,12)")).cast("double").alias("logc2"))
    logc = F.col("logc") + F.coalesce("logc2", F.lit(0.0))
    base = logc - F.col("n") * vocab.base if vocab.n else F.lit(float("-inf"))
    return part.join(more, "row", "left").select(
        "id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), base.alias("base_score"), (F.col("ll") - F.col("mass") + logc).alias("score"))


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    held_out = F.coalesce(fold == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("t"))
    docs = docs.withColumn("fit", F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 10 != 0, F.lit(True)))
    counts = stage(word_counts(docs.where("fit")))
    vocab = vocabulary(counts)
    encoded = encode(docs, vocab)
    out = score(encoded, counts, vocab, train(encoded, vocab)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", "score")
