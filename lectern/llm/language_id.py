"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

Training takes about `per_lang` labelled rows of each language (all of them where there are fewer), those with the least
hashes of the id, and of each a stretch of at most `stretch` characters from a place that the hash names, cut out before anything reaches
the driver. Each of the EPOCHS sees of a stretch a random window of at most `window` bytes. These bounds, and `most_langs`
languages (more labels are an error), are parameters, so the driver's memory is bounded. Stochastic gradient descent runs in numpy on the
driver. A text's vector is the mean of the embeddings of its byte n-grams (orders 1 to 4, over lower-cased letters with
single spaces), so scores are means of one precomputed table of fixed size, which every worker holds. Whole texts are scored.

A fifth of the sample is kept aside: it sets the temperature (least log loss) and the rejection bound, the score that all
but REJECT of its rightly predicted rows reach, and never above MOST_BOUND.

Defined results: null text or text without a letter is `und` with score 0 and rejected; where no labelled row exists every text is
`und`; rows with a null label or id are not learned from; a very long text is scored whole, in pieces whose n-grams count
once; repeated rows each get a row; an empty table gives no rows; ties go to the language that sorts first. Only id, text and
(to learn) lang are read; other columns pass through and may have any names.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, col, free_name, map_rows, table

BUCKETS, DIM, ORDERS = 1 << 16, 16, (1, 2, 3, 4)
PER_LANG, EPOCHS, RATE = 600, 6, 0.4
#: Bytes of a sampled text that one epoch of training sees at most; 16 at least.
WINDOW = 1 << 12
#: Characters of a sampled text that reach the driver at most, and labels that are learned at most.
STRETCH, MOST_LANGS = 1 << 14, 500
REJECT, MOST_BOUND = 0.002, 0.45
PIECE = 1 << 20
#: ASCII letters lower-cased, other ASCII bytes blank, the rest as it is.
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    bound: float


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def normal(text: bytes) -> np.ndarray:
    """Bytes of the text for n-grams: words apart by one space, one at either end."""
    return np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8)


def grams(x: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of all n-grams, an array for each order."""
    code, out = np.zeros(len(x), np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            break
        code = (code[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
        if n in ORDERS:
            h = (code + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0xC2B2AE35)) >> np.uint32(16))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def logits(model: Model, text: bytes) -> np.ndarray:
    x, total, n = normal(text), np.zeros(len(model.langs)), 0
    for i in range(0, len(x), PIECE):
        # N-grams belong to the piece in which they start.
        for g in grams(x[i : i + PIECE + max(ORDERS) - 1]):
            g = g[:PIECE]
            total += np.take(model.table, g, axis=0).sum(axis=0)
            n += len(g)
    return total / max(n, 1) + model.bias


def train(rows: list[tuple[int, bytes, str]], seed: int = 7, window: int = WINDOW) -> Model:
    """Fit on (id, text, lang) rows; their order does not matter."""
    rows = sorted(r for r in rows if has_letter(r[1]))
    langs = sorted({r[2] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(rows))
    aside = {*fold[: len(rows) // 5].tolist()} if len(rows) >= 50 else set()
    fit = [(normal(t), langs.index(y)) for i, (_, t, y) in enumerate(rows) if i not in aside]
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            x, y = fit[k]
            size = int(min(len(x), 2 ** rng.uniform(3.5, math.log2(window))))  # pieces of all lengths, so that short texts are learned too
            at = int(rng.integers(0, len(x) - size + 1))
            u, c = np.unique(np.concatenate(grams(x[at : at + size])), return_counts=True)
            share = (c / c.sum()).astype(np.float32)
            h = share @ e[u]
            g = _softmax(h @ w + bias)
            g[y] -= 1
            lr = np.float32(RATE * (1 - step / steps))
            back = w @ g
            w -= lr * np.outer(h, g)
            bias -= lr * np.float32(0.1) * g
            e[u] -= lr * np.minimum(share * len(u), 4)[:, None] * back
            step += 1
    model = Model(langs, (e @ w).astype(np.float32), bias.astype(float), 1.0, 0.0)
    if aside:
        z = np.array([logits(model, rows[i][1]) for i in sorted(aside)])
        y = np.array([langs.index(rows[i][2]) for i in sorted(aside)])
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.2, 5, 40), key=loss))
        p = _softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        model.bound = float(min(MOST_BOUND, right[int(REJECT * len(right))])) if len(right) else 0.0
    return model


def _draw(salt: str) -> Column:
    """A number in [0, 1) of 53 bits by the hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), "id"), 11) / float(1 << 53)


def fit(docs: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, window: int = WINDOW,
        stretch: int = STRETCH, most_langs: int = MOST_LANGS) -> Model:
    """Train on about per_lang rows of each language and stretches of at most `stretch` characters, whatever the table's size."""
    d = docs.select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text"))
    d = d.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull())
    d = d.where(where) if where is not None else d
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} labels; raise most_langs or clean the column {lang_col}")
    if not counts:
        return train([])
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, per_lang / n)])
    at = F.floor(_draw("stretch") * F.greatest(F.length("text") - stretch + 1, F.lit(1))).cast("int")
    sample = d.where(_draw("language") < F.try_element_at(share, "lang")).select("id", F.substring("text", at + 1, F.lit(stretch)).cast("binary").alias("text"), "lang")
    return train([(r["id"], bytes(r["text"]), r["lang"]) for r in sample.toLocalIterator()], window=window)


def predict(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """docs with one more struct column: lang, score and rejected."""
    name = free_name(docs, name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = held.value
        for b in batches:
            lang, score = [], []
            for t in b.column(at).cast(pa.binary()).to_pylist():
                if not t or not m.langs or not has_letter(t):
                    lang.append("und")
                    score.append(0.0)
                else:
                    p = _softmax(logits(m, t) / m.temperature)
                    k = int(p.argmax())
                    lang.append(m.langs[k])
                    score.append(float(p[k]))
            rejected = pa.array([k == "und" or s < m.bound for k, s in zip(lang, score)], pa.bool_())
            yield batch_of([*b.columns, pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), rejected], names=["lang", "score", "rejected"])])

    return map_rows(docs, run, f"{name} struct<lang:string,score:double,rejected:boolean>")


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold("id", 4) != 2)
    d = docs.select("doc_id", "text")
    out = predict(d, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                      F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))
