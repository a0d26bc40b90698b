"""Near-duplicate detection by SetSketch registers, likelihood estimates and a check on full shingle sets.

Rows with one word sequence form a class; only classes are compared. Each class gets M SetSketch registers
(base B, exponential rate A): register j holds floor(1 - log_B(x_j)) of the least of the exponential variates that
its shingles draw, so registers of a union are the maxima of registers. ROWS registers make a band; classes that agree
on a band share a bucket. Within a bucket no pairs are listed wholesale:

1. every member is paired with the bucket's pivot (its smallest document);
2. buckets of up to SMALL members: their pairs that are still in different components;
3. larger buckets: pairs from different components with a common token among the rarest that a pair at the threshold
   must share (prefix filter). A token at some place of a set's prefix bounds the sizes of its partners, and sizes are part
   of the join's key, so sets that share a template, but too little for a link, do not meet. Nothing is left out, however large the bucket.

Each pair is first held against the maximum-likelihood estimate of its similarity from the two sketches (dropped when
SIGMAS standard errors below the threshold) and then against the full sets.

Defined results: a null or wordless text has an empty set and is linked with nothing; fewer words than a shingle make
one shingle; a very long text has all its shingles; of equally small documents the one with the least digest is the pivot; repeated
rows each get a row; a null id never becomes a component's name unless the class has no other, in which case the component is
null; an empty table gives an empty result. Ids may have any type that has an order. Only id and text columns are read, so
other columns may have any names.

A pair at the threshold itself is missed by all bands with probability (1 - 0.75**4)**32, about 5e-6; one at 0.8 with
5e-8.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, col, free_name, map_rows, small_batches, stage, table
from .hashing import Bitmap, WordHash, hashes_of, runs, scramble

M, ROWS = 128, 4
BANDS = M // ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
SMALL = 64
SIGMAS = 6.0
#: Digests of classes that a task remembers as sent.
SEEN = 500_000
DF_SLOTS = 1 << 18
#: Ratio of a class of sizes to the next, and finer classes in one.
WIDE, FINE = 2.0 / 3.0**0.5, 8

_U = np.uint64
_MULT = np.array([int.from_bytes(hashlib.blake2b(b"m%d" % j, digest_size=8).digest(), "little") | 1 for j in range(M)], dtype=_U)
_ADD = np.array([int.from_bytes(hashlib.blake2b(b"a%d" % j, digest_size=8).digest(), "little") for j in range(M)], dtype=_U)


def shingle_set(words: list[bytes], memo: dict, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, _U)
    return np.unique(runs(hashes_of(words, memo), min(size, len(words))))


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes: the union's registers are the maxima of the parts' registers."""
    least = np.full(M, np.iinfo(_U).max, _U)
    for i in range(0, len(s), 2048):
        x = s[i : i + 2048, None] * _MULT
        x += _ADD
        np.minimum(least, x.min(axis=0), out=least)
    x = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)), 0, TOP + 1).astype(np.int64)


def band_keys(reg: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        acc = scramble(acc + reg.reshape(BANDS, ROWS)[:, j].astype(_U))
    return acc.view(np.int64)


def estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs, given how many registers of the first are larger, smaller and equal,
    and both cardinalities: Newton's place is taken by a golden-section search, as the log-likelihood is concave."""
    u, v = na / (na + nb), nb / (na + nb)
    lb = math.log(BASE)

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / lb

    def ll(j):
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = ll(c) > ll(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def _class_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def with_class(docs: DataFrame, text_col: str = "text", name: str = "cls") -> tuple[DataFrame, str]:
    """docs with one more column, the digest of the word sequence (null without words), as in sketches(), and its name."""
    at, name = docs.columns.index(text_col), free_name(docs, name)

    def run(batches):
        for b in batches:
            words = [t.lower().split() if t else [] for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield batch_of([*b.columns, pa.array([_class_of(w) if w else None for w in words], pa.binary())])

    return map_rows(docs, run, f"{name} binary"), name


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """One row per input row: id, cls (digest of the word sequence, null without words), n (set size), keys (band keys)."""

    def run(batches):
        memo = WordHash()
        for b in batches:
            ids, out = b.column(0), ([], [], [])
            for t in b.column(1).to_pylist():
                words = t.lower().split() if t else []
                if words:
                    s = shingle_set(words, memo, size)
                    row = (_class_of(words), len(s), band_keys(registers(s)))
                else:
                    row = (None, 0, None)
                for o, x in zip(out, row):
                    o.append(x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))],
                names=["id", "cls", "n", "keys"],
            )

    d = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("t"))
    return small_batches(d).mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, cls binary, n long, keys array<long>")


def class_sets(docs: DataFrame, wanted: DataFrame, text_col: str, size: int) -> DataFrame:
    """cls, reg and the full set s of the classes in `wanted`, once each.

    A bitmap of bounded size keeps most other texts from the shuffle, and a semi-join the rest; a task sends a class once."""
    head = F.conv(F.hex(F.substring("cls", 1, 8)), 16, -10).cast("long")
    held = docs.sparkSession.sparkContext.broadcast(Bitmap(wanted.select(head.alias("h")), "h"))

    def texts(batches):
        seen, bits = set(), held.value
        for b in batches:
            ks, ts = [], []
            for t in b.column(0).to_pylist():
                words = t.lower().split() if t else ()
                if words:
                    k = _class_of(words)
                    if int.from_bytes(k[:8], "big") in bits and k not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(k)
                        ks.append(k)
                        ts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(ts, pa.binary())], names=["cls", "t"])

    def sets(batches):
        memo = WordHash()
        for b in batches:
            regs, ss = [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t.lower().split(), memo, size)
                regs.append(registers(s))
                ss.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(regs, pa.list_(pa.int64())), pa.array(ss, pa.list_(pa.int64()))], names=["cls", "reg", "s"])

    found = small_batches(docs.select(col(text_col).cast("binary").alias("t"))).mapInArrow(texts, "cls binary, t binary")
    found = found.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("t").alias("t"))
    return stage(found.mapInArrow(sets, "cls binary, reg array<long>, s array<long>"))


def _list_arrays(col: pa.Array) -> list[np.ndarray]:
    """The items of a list column as views of its values."""
    flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold: the sketches' joint estimate is not far below, and 100 * both >= percent * either."""
    floor = percent / 100 - SIGMAS * math.sqrt(percent / 100 * (1 - percent / 100) / M)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            sa, sb = _list_arrays(cols["sa"]), _list_arrays(cols["sb"])
            ra, rb = (np.stack(_list_arrays(cols[c])) for c in ("ra", "rb"))
            na, nb = (np.array([len(x) for x in y], float) for y in (sa, sb))
            more, less = (ra > rb).sum(1), (ra < rb).sum(1)
            est = estimate(more, less, M - more - less, na, nb)
            ok = np.zeros(b.num_rows, bool)
            for i in np.flatnonzero(est >= floor):
                both = len(np.intersect1d(sa[i], sb[i], assume_unique=True))
                ok[i] = 100 * both >= percent * (na[i] + nb[i] - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([cols["a"].filter(keep), cols["b"].filter(keep)], names=["a", "b"])

    left = sets.select(F.col("cls").alias("a"), F.col("reg").alias("ra"), F.col("s").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("reg").alias("rb"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (least node of its component), by alternating large-star and small-star steps until nothing moves."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # Large star: u's larger neighbours move to the least of u and its neighbours.
        both = e.union(e.select("v", "u")).toDF("u", "v")
        m = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        e = stage(both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Small star: each node and its smaller neighbours move to the least of them.
        m = stage(e.groupBy("u").agg(F.min("v").alias("m")))
        e = stage(e.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", "m")).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())
        before = now


def _prefix_pairs(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among `crowd` (cls, comp, out) that can reach the threshold.

    Order all tokens by how many crowded sets hold them (counted in a fixed number of slots), rarest first. Two sets at the
    threshold share a token in the first n - ceil(t n) + 1 places of each, and the first shared token's places bound
    the overlap: a token at place p of a set of n leaves its partner a size from t n to (n - p + 1) (1 + t) / t - n. Partners are
    joined by token and class of size: wide classes within that range, fine ones at its upper end. Tokens of one set alone are left out.
    At least one of a pair is `out`, not in the largest component of its bucket.
    """
    t = percent / 100
    mine = stage(sets.join(crowd, "cls").select("cls", "comp", "out", "s"))

    def count(batches):
        n = np.zeros(DF_SLOTS, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount((b.column(0).flatten().to_numpy().view(_U) >> _U(46)).astype(np.int64), minlength=DF_SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])

    df = np.zeros(DF_SLOTS, np.int64)
    for b in mine.select("s").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_batches():
        df[b.column(0).to_numpy()] = b.column(1).to_numpy()
    held = mine.sparkSession.sparkContext.broadcast(df)

    def prefix(batches):
        freq = held.value
        for b in batches:
            ks, toks, places, sizes = [], [], [], []
            for k, s in zip(b.column(0).to_pylist(), _list_arrays(b.column(1)) if b.num_rows else ()):
                n = len(s)
                f = freq[(s.view(_U) >> _U(46)).astype(np.int64)]
                order = np.lexsort((s, f))[: n - math.ceil(t * n) + 1]
                at = np.flatnonzero(f[order] > 1)
                ks += [k] * len(at)
                toks.append(s[order[at]])
                places.append(at + 1)
                sizes.append(np.full(len(at), n))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), cat(toks), cat(places), cat(sizes)], names=["cls", "tok", "p", "n"])

    rows = stage(mine.select("cls", "s").mapInArrow(prefix, "cls binary, tok long, p long, n long").join(crowd, "cls"))
    fine = lambda m: F.floor(F.log(m.cast("double")) * FINE / math.log(WIDE) + 1e-9).cast("int")
    # Half a size of room either way keeps rounding from losing a partner.
    most = (F.col("n") - F.col("p") + 1) * ((1 + t) / t) - F.col("n") + 0.5
    x = rows.where("out").withColumns({"lo": fine(F.greatest(F.col("n") * t - 0.5, F.lit(1.0))), "hi": fine(F.greatest(F.least(F.col("n") / t + 0.5, most), F.lit(1.0)))}).where(most >= F.col("n") * t)
    top = F.floor(F.col("hi") / FINE).cast("int")
    first = F.floor(F.col("lo") / FINE).cast("int")
    # Keys: wide classes below the topmost as they are, fine ones of the topmost as negative numbers.
    wide = F.when(first < top, F.sequence(first, top - 1)).otherwise(F.array().cast("array<int>"))
    ends = F.transform(F.sequence(F.greatest(F.col("lo"), top * FINE), F.col("hi")), lambda f: -1 - f)
    x = x.withColumn("k", F.explode(F.concat(wide, ends))).alias("x")
    own = fine(F.col("n"))
    y = rows.withColumn("k", F.explode(F.array(F.floor(own / FINE).cast("int"), -1 - own))).alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * t / (1 + t) - 1e-9)
    can = 1 + F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p")) >= need
    near = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.comp") != F.col("y.comp")) & can
    # Of a pair with several common tokens all but the first fail the bound or repeat it; distinct() leaves one. Ranges of
    # two `out` sets need not hold each other, so both ways count.
    return x.join(y, near & (F.col("x.cls") != F.col("y.cls"))).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: id, cls, n_shingles, component_id (the least id that links lead to), kept, comp (a digest that names the
    component, null without words)."""
    sk = stage(sketches(docs, id_col, text_col, size))
    cl = sk.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    member = stage(cl.select("cls", "id", F.explode("keys").alias("key")))
    bucket = member.groupBy("key").agg(F.count("*").alias("size"), F.min_by("cls", F.struct(F.col("id").isNull(), F.col("id"), F.col("cls"))).alias("pivot")).where("size > 1")
    member = stage(member.join(bucket, "key").select("key", "cls", "size", "pivot"))

    sets = class_sets(docs, stage(member.select("cls").distinct()), text_col, size)
    pairs = lambda d, a, b: d.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    tried = stage(pairs(member, "cls", "pivot"))
    edges = stage(verified(tried, sets, percent))
    comp = stage(components(edges))

    # Buckets that hold more than one component still.
    at = stage(member.join(comp.select(F.col("node").alias("cls"), "comp"), "cls", "left").select("key", "cls", "size", F.coalesce("comp", "cls").alias("comp")))
    per = at.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("most")).where("comps > 1")
    at = stage(at.join(per, "key"))
    few = at.where(F.col("size") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.cls") < F.col("y.cls"))).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    crowd = at.where(F.col("size") > SMALL).groupBy("cls").agg(F.first("comp").alias("comp"), F.bool_or(F.col("comp") != F.col("most")).alias("out"))
    crowd = stage(crowd)
    if not crowd.isEmpty():
        more = more.union(_prefix_pairs(crowd, sets, percent))
    more = stage(more.distinct().join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        edges = edges.union(verified(more, sets, percent))
        comp = stage(components(edges))

    ids = sk.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id")).join(comp.select(F.col("node").alias("cls"), "comp"), "cls", "left")
    ids = stage(ids.select("cls", "id", F.coalesce("comp", "cls").alias("comp")))
    least = stage(ids.groupBy("comp").agg(F.min("id").alias("component_id")))
    of = stage(ids.join(least, "comp").select("cls", "component_id", "comp"))
    out = sk.select("id", "cls", F.col("n").alias("n_shingles")).join(of, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select("id", "cls", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "comp")


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l USING (doc_id) LEFT JOIN n USING (doc_id)
"""
