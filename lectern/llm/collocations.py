"""Phrase collocation mining: merged count-min sketches, an exact second pass over survivors, then scores and subsumption.

First pass: each map task counts its n-grams by 64-bit hashes, adds them to the cells of ROWS sketch rows and emits the touched
cells; Spark brings the parts of a stretch of cells together, and a scan adds them. A cell's sum is never below the count of any
n-gram in it, so an n-gram of LEAST or more has LEAST or more in all its cells, and nothing frequent is lost. (Counters stop at LEAST,
which decides the same.) Sketches are as wide as the corpus has words, and lie spread over the tasks; what map tasks get of one is a bitmap of its
full cells of at most 2**BITS bits a row, folded if the sketch is wider. This goes by order: words and pairs first; then runs of
three and four words all of whose pairs survive. Second pass: survivors alone are counted exactly, by their words, and those of less than LEAST go.
A frequent phrase makes a row in nearly every task of that pass, so small input splits are brought together there (TASK_BYTES).

In a corpus so large that most of a bitmap is set, more n-grams survive than need be: the second pass then costs what a plain
aggregation costs, and the result is the same.

Candidates are joined with the counts of their parts; a phrase goes if a longer one that holds it has at least SHARE percent of its
count. Ranks are by a range-partitioned sort, so no task holds a language.

Defined results: a null text is empty, a null lang `und`; phrases do not cross pieces or texts; repeated rows count each; an empty table gives no
rows; ties go to the higher count, then to the phrase first by its UTF-8 bytes; a text without piece ends or spaces is one piece or word, however long. Products
are decimals of 38 digits. Only text and lang are read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, free_name, small_batches, stage, table
from .hashing import runs, scramble
from .word_columns import LOWER, Tally, Words, bytes_in, slices

LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
ROWS, BITS = 2, 26
#: Entries that a map task gathers before it emits cells.
GATHER = 4_000_000
#: A map task of the second pass takes about so many bytes of text, as long as each core has TASKS of them.
TASK_BYTES, TASKS = 96 << 20, 2
#: It adds up its rows when it has more than HELD, and hands them on when more than KEPT are left.
HELD, KEPT = 900_000, 750_000
_U = np.uint64
_BREAK = bytes_in((0x0A, 0x0D)) | np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_WORD = ~(_BREAK | bytes_in((0x20, 0x20), (0x09, 0x09)))
#: Multipliers that make a row's cells of a hash; their count bounds `rows`.
_ROW = (np.random.default_rng(13).integers(1, 1 << 62, 8, dtype=np.int64) * 2 + 1).astype(_U)


class Pieces:
    """The words of a slice, and how many words of the same piece follow each."""

    def __init__(self, starts: np.ndarray, data: np.ndarray):
        self.words = Words(starts, data, _WORD, LOWER)
        n = len(self.words)
        piece = np.cumsum(_BREAK[data], dtype=np.int64)[self.words.at]
        new = np.ones(n, bool)
        new[1:] = (piece[1:] != piece[:-1]) | (self.words.text[1:] != self.words.text[:-1])
        ends = np.append(np.flatnonzero(new)[1:], n) if n else np.zeros(0, np.int64)
        self.left = ends[np.cumsum(new) - 1] - np.arange(n) if n else ends

    def starts_of(self, k: int) -> np.ndarray:
        """Where runs of k words begin, as a mask over the words."""
        return self.left >= k


def hashed(words: Words, tags: np.ndarray, k: int) -> np.ndarray:
    """A hash for each place, of the run of k words there and its language's tag; places at the end stay 0."""
    out = np.zeros(len(words), _U)
    found = runs(words.hashes(), k)
    out[: len(found)] = scramble(found ^ tags[: len(found)])
    return out


def _tag(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Sketch:
    """Where hashes have their cells: `rows` rows of 2**width cells, in stretches of 2**block."""

    def __init__(self, words: int, rows: int = ROWS, bits: int = BITS):
        self.rows, self.bits = rows, bits
        self.width = min(max(int(words).bit_length(), 16), 39, bits + 13)
        #: A bitmap has a bit for 2**fold cells, and a byte or more for a stretch.
        self.fold = max(self.width - bits, 0)
        self.block = min(max(self.width - 13, 10, self.fold + 3), 16)

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return scramble(hashes * _ROW[row]) >> _U(64 - self.width)


class Survivors:
    """Bitmaps of the full cells of a sketch."""

    def __init__(self, sketch: Sketch, parts):
        self.sketch = sketch
        self.held = [np.zeros(max(1 << (sketch.width - sketch.fold - 3), 1), np.uint8) for _ in range(sketch.rows)]
        for row, block, bits in parts:
            found = np.frombuffer(bits, np.uint8)
            at = block * len(found)
            self.held[row][at : at + len(found)] |= found

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(self.sketch.rows):
            slot = self.sketch.cells(hashes, row) >> _U(self.sketch.fold)
            out &= (self.held[row][(slot >> _U(3)).astype(np.int64)] >> (7 - (slot & _U(7))).astype(np.uint8) & 1).astype(bool)
        return out


def _emit(sketch: Sketch, keys: np.ndarray, counts: np.ndarray, least: int):
    """Rows of touched cells: row of the sketch, stretch, places within it and counts."""
    small = np.uint8 if least < 256 else np.uint32
    for row in range(sketch.rows):
        cell, order = np.unique(sketch.cells(keys, row), return_inverse=True)
        n = np.minimum(np.bincount(order, weights=counts, minlength=len(cell)), least).astype(small)
        block = (cell >> _U(sketch.block)).astype(np.int64)
        place = (cell & _U((1 << sketch.block) - 1)).astype(np.uint16)
        head = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(cell) else np.zeros(0, np.int64)
        bound = np.append(head, len(cell))
        blobs = [pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((bound * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (place, n)]
        got = pa.RecordBatch.from_arrays([pa.array(np.full(len(head), row, np.int32)), pa.array(block[head]), *blobs], names=["row", "block", "places", "counts"])
        yield from (got.slice(i, 4096) for i in range(0, len(head), 4096))


def _sliced(batches):
    """(languages' tags by text, languages, pieces, number of the first text) of the slices of batches lang, text."""
    for b in batches:
        langs = b.column(0).to_pylist()
        tags = {k: _tag(k) for k in set(langs)}
        by_text = np.array([tags[k] for k in langs], _U)
        for first, starts, data in slices(b.column(1), _BREAK):
            p = Pieces(starts, data)
            if len(p.words):
                yield by_text[p.words.text + first], langs, p, first
            p = None


def _alive(p: Pieces, tags: np.ndarray, filters: list[Survivors], longest: int) -> dict[int, np.ndarray]:
    """For each order, hashes of the runs that may be frequent as far as the filters say; 0 elsewhere is masked by the second item."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if not filters:
        for k in (1, 2)[:longest]:
            out[k] = (hashed(p.words, tags, k), p.starts_of(k))
        return out
    for k in range(1, longest + 1):
        h, mask = hashed(p.words, tags, k), p.starts_of(k)
        if k > 1:  # both parts must survive
            before = out[k - 1][1]
            mask &= before
            mask[:-1] &= before[1:]
        if k < 3 or len(filters) > 1:
            mask[mask] = filters[0 if k < 3 else 1].hold(h[mask])
        out[k] = (h, mask)
    return out


def sketched(docs: DataFrame, sketch: Sketch, filters: list[Survivors], least: int, longest: int) -> Survivors:
    """Counts the runs that the filters leave (words and pairs without a filter, longer runs behind the first) into a sketch and keeps its full cells."""
    told = docs.sparkSession.sparkContext.broadcast(filters)
    orders = range(3, longest + 1) if filters else range(1, min(longest, 2) + 1)

    def count(batches):
        held, n = [], 0

        def rows():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from _emit(sketch, keys, counts, least)

        for tags, _, p, _ in _sliced(batches):
            alive = _alive(p, tags, told.value, longest)
            for k in orders:
                h, mask = alive[k]
                held.append(h[mask])
                n += len(held[-1])
            if n > GATHER:
                yield from rows()
                held, n = [], 0
        if n:
            yield from rows()

    small = np.uint8 if least < 256 else np.uint32

    def add(batches):
        now, cells = None, np.zeros(1 << sketch.block, np.int64)

        def bits():
            full = (cells >= least).reshape(-1, 1 << sketch.fold).any(axis=1)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([np.packbits(full).tobytes()], pa.binary())], names=["row", "block", "bits"])

        for b in batches:
            for key, places, counts in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if key != now:
                    if now and (cells >= least).any():
                        yield bits()
                    now = key
                    cells[:] = 0
                cells[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, small)
        if now and (cells >= least).any():
            yield bits()

    parts = small_batches(docs).mapInArrow(count, "row int, block long, places binary, counts binary").repartition("row", "block").sortWithinPartitions("row", "block")
    found = parts.mapInArrow(add, "row int, block long, bits binary")
    return Survivors(sketch, ((r["row"], r["block"], bytes(r["bits"])) for r in found.collect()))


def _exact(docs: DataFrame, filters: list[Survivors], longest: int) -> DataFrame:
    """lang, phrase, size, c: exact counts of what survives, added up in tasks; phrase '' of size 0 has a language's number of words."""
    told = docs.sparkSession.sparkContext.broadcast(filters)

    def counted(tags, langs, p, first):
        code, names = p.words.encoded()
        name = {k: i for i, k in enumerate(dict.fromkeys(langs))}
        lang = np.array([name[k] for k in langs], np.int64)[p.words.text + first]
        known = pa.array(list(name))
        n = np.bincount(lang, minlength=len(name))
        some = np.flatnonzero(n)
        yield _table(known.take(pa.array(some)), pa.array([""] * len(some)), 0, n[some])
        alive = _alive(p, tags, told.value, longest)
        # Codes of runs: exact numbers for (code of the run without its last word, last word), not hashes.
        run_code, base = lang, len(names)
        for k in range(1, longest + 1):
            at = np.flatnonzero(alive[k][1])
            if not len(at):
                break
            key = run_code[at] * base + code[at + k - 1]
            _, example, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            run_code = np.full(len(code), -1, np.int64)
            run_code[at] = inverse
            where = at[example]
            parts = [names.take(pa.array(code[where + j])) for j in range(k)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if k > 1 else parts[0]
            yield _table(known.take(pa.array(lang[where])), phrase.cast(pa.string()), k, count)

    def run(batches):
        tally = Tally(["lang", "phrase", "size"], ["c"], HELD, KEPT)
        for piece in _sliced(batches):
            for t in counted(*piece):
                yield from tally.add(t)
            piece = t = None  # the next slice is read without this one in memory
            pa.default_memory_pool().release_unused()
        yield from tally.rest()

    got = small_batches(docs).mapInArrow(run, "lang string, phrase string, size int, c long")
    return got.groupBy("lang", "phrase", "size").agg(F.sum("c").alias("c"))


def _table(lang: pa.Array, phrase: pa.Array, size: int, c: np.ndarray) -> pa.Table:
    return pa.table({"lang": lang.cast(pa.string()), "phrase": phrase, "size": pa.array(np.full(len(c), size, np.int32)), "c": pa.array(c.astype(np.int64))})


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """lang, phrase, size, c: every run of up to `longest` words that occurs `least` times or more in its language, exact, and size 0 for each language's words."""
    d = docs.select(F.coalesce(col(lang_col), F.lit("und")).alias("lang"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    filters = [sketched(d, Sketch(size // 5, rows, bits), [], least, longest)]
    if longest > 2:
        filters.append(sketched(d, Sketch(size // 5, rows, bits), list(filters), least, longest))
    tasks = max(TASKS * d.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES)
    return _exact(d.coalesce(tasks), filters, longest).where((F.col("c") >= least) | (F.col("size") == 0))


def _wide(c: str):
    return F.col(c).cast("decimal(38,0)")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of each phrase of two words or more, by the cut of the least score (the first of those that tie)."""
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("c").alias("a"))
    part = counts.where("size > 0").select("lang", "phrase", "c")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    words = F.split("phrase", " ")
    cut = cut.withColumns({"head": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "tail": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    cut = cut.join(part.withColumnsRenamed({"phrase": "head", "c": "l"}), ["lang", "head"]).join(part.withColumnsRenamed({"phrase": "tail", "c": "r"}), ["lang", "tail"])
    cut = cut.withColumn("score", F.expr("(cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cut.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def subsumed(phrases: DataFrame, longest: int = LONGEST, share: int = SHARE) -> DataFrame:
    """phrases without those inside a longer one of at least `share` percent of their count."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    over = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    out = phrases.join(over, ["lang", "phrase"], "left")
    return out.where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * share)).drop("longer")


def first_of_each(df: DataFrame, by: str, order: list, top: int, rank: str = "rank") -> DataFrame:
    """The first `top` rows of each value of `by`, numbered from 1, by a range-partitioned sort: a value's rows lie in as many tasks as they need."""
    at, p, first, rows, before = (free_name(df, x) for x in ("at", "p", "first", "rows", "before"))
    sorted_ = stage(df.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order).withColumn(at, F.monotonically_increasing_id()))
    sorted_ = sorted_.withColumn(p, F.shiftright(at, 33))
    parts = sorted_.groupBy(by, p).agg(F.min(at).alias(first), F.count("*").alias(rows))
    earlier = F.coalesce(F.sum(rows).over(Window.partitionBy(by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(by, p, first, earlier.alias(before)).where(F.col(before) < top)
    out = sorted_.join(parts, [by, p]).withColumn(rank, F.col(at) - F.col(first) + F.col(before) + 1)
    return out.where(F.col(rank) <= top).drop(at, p, first, before)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases."""
    counts = stage(frequent(docs, text_col, lang_col, least, longest))
    kept = subsumed(stage(scored(counts)), longest, share)
    ranked = first_of_each(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    n = counts.where("size = 0").select("lang", F.col("c").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS x FROM d)),
g AS (SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS phrase FROM (SELECT lang, w, s, unnest(generate_series(1, len(w) - s + 1)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(s) WHERE len(w) >= s)),
f AS (SELECT lang, s, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
cut AS (SELECT lang, s, phrase, c AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS h, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS t
    FROM f, (VALUES (1), (2), (3)) v(k) WHERE k < s),
sc AS (SELECT cut.*, l.c AS l, r.c AS r, ((2000000::HUGEINT * a) // (l.c + r.c))::BIGINT AS score FROM cut
    JOIN f l ON l.lang = cut.lang AND l.phrase = cut.h AND l.s = cut.k JOIN f r ON r.lang = cut.lang AND r.phrase = cut.t AND r.s = cut.s - cut.k),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' ') AS phrase, max(c) AS longer
    FROM f, (VALUES (2), (3)) v(m), (VALUES (1), (2), (3)) u(i) WHERE s > m AND i <= s - m + 1 GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN sub USING (lang, phrase) WHERE sub.longer IS NULL OR 100 * sub.longer::HUGEINT < 80 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
