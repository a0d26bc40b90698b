"""Source divergence audit: how far the sources of a language differ in their terms, by sorted runs.

Two sorts and scans of runs. In a map task, where a document is whole, its words are sorted by (lang, term, source, document); the runs
give partial document frequencies and counts. These are repartitioned by (lang, term) and sorted by (lang, term, source),
and a scan that holds one term's sources at a time adds them up; terms in fewer than LEAST documents end there. A
second scan over the terms that stay emits partial pairs of sources and each source's first terms of a run; Spark adds the pairs and
ranks both. Sources of a language are worked on in blocks of BLOCK, so a task holds BLOCK x sources sums of one language at a time.

Arithmetic is exact: shares are whole numbers, and beyond 64 bits they are computed as Python integers.

Bounds: (lang, source) groups are listed on the driver and broadcast, at most MOST_GROUPS (an error beyond; the pairs asked for are as many as
the sum of the squares of a language's sources). All else is spread by term.

Defined results: each row is a document, whatever its id; null text, lang and source are ''; a group without kept terms has p from the smoothing
alone; a language without kept terms has value 0 for each pair, ordered by source; repeated rows count each; an empty table gives no
rows; ties go to the item that sorts first by its UTF-8 bytes. Only text, lang and source are read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, small_batches, stage, table
from .word_columns import Tally, Words, bytes_in, gather, slices, summed

LEAST, TOP, SCALE, ADD = 30, 50, 1_000_000_000, 5
BLOCK, MOST_GROUPS = 1024, 200_000
CELLS = 1 << 21
#: [^\x00-\x40\x5B-\x60\x7B-\x7F]
_TERM = ~bytes_in((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def term_runs(docs: DataFrame) -> DataFrame:
    """lang, term, source, df, n: partial sums of a task's documents, over rows lang, source, text."""

    def run(batches):
        tally = Tally(["lang", "term", "source"], ["df", "n"])
        for b in batches:
            group = pa.table({"lang": b.column(0), "source": b.column(1)}).group_by(["lang", "source"], use_threads=False).aggregate([])
            number = {k: i for i, k in enumerate(zip(group["lang"].to_pylist(), group["source"].to_pylist()))}
            of = np.array([number[k] for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
            whole: list[tuple[int, pa.Array, np.ndarray]] = []  # parts of one long text, which is one document
            for first, starts, data in slices(b.column(2), ~_TERM):
                words = Words(starts, data, _TERM)
                if not len(words):
                    continue
                code, names = words.encoded()
                pair, n = np.unique(words.text * len(names) + code, return_counts=True)
                text, code = pair // len(names) + first, pair % len(names)
                if len(starts) == 1:
                    whole.append((first, names.take(pa.array(code)), n))
                    continue
                yield from tally.add(_runs(of[text], code, names, n, group))
            for first in sorted({x[0] for x in whole}):
                parts = [x for x in whole if x[0] == first]
                enc = pa.chunked_array([x[1] for x in parts]).combine_chunks().dictionary_encode()
                code, n = summed(enc.indices.to_numpy().astype(np.int64), np.concatenate([x[2] for x in parts]))
                yield from tally.add(_runs(np.full(len(code), of[first]), code, enc.dictionary, n, group))
        yield from tally.rest()

    return small_batches(docs.select("lang", "source", "text")).mapInArrow(run, "lang string, term string, source string, df long, n long")


def _runs(group_of: np.ndarray, code: np.ndarray, names: pa.Array, n: np.ndarray, group: pa.Table) -> pa.Table:
    """Runs of (group, term) over rows of one document and term each."""
    key, sums = summed(group_of * len(names) + code, np.stack([np.ones(len(n), np.int64), n], 1))
    g = pa.array(key // len(names))
    return pa.table({"lang": group["lang"].take(g), "term": names.take(pa.array(key % len(names))).cast(pa.string()), "source": group["source"].take(g), "df": sums[:, 0], "n": sums[:, 1]})


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def kept_terms(runs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, sources, counts: a row for each term in `least` documents of a language or more."""

    def closed(t: pa.Table) -> pa.RecordBatch:
        lang, term = t["lang"].chunk(0), t["term"].chunk(0)
        head = np.flatnonzero(_changes(lang, term))
        df = np.add.reduceat(t["df"].to_numpy(), head)
        size = np.diff(np.append(head, t.num_rows))
        keep = df >= least
        rows = pa.array(np.flatnonzero(np.repeat(keep, size)))
        offsets = pa.array(np.append(0, np.cumsum(size[keep])).astype(np.int32))
        at = pa.array(head[keep])
        lists = [pa.ListArray.from_arrays(offsets, t[c].chunk(0).take(rows)) for c in ("source", "n")]
        return pa.RecordBatch.from_arrays([lang.take(at), term.take(at), *lists], names=["lang", "term", "sources", "counts"])

    def scan(batches):
        held: pa.Table | None = None
        for t in gather(batches):
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            columns = [t[c].chunk(0) for c in ("lang", "term", "source")]
            head = np.flatnonzero(_changes(*columns))
            at = pa.array(head)
            t = pa.table({c: x.take(at) for c, x in zip(("lang", "term", "source"), columns)} | {c: np.add.reduceat(t[c].to_numpy(), head) for c in ("df", "n")}).combine_chunks()
            last = int(np.flatnonzero(_changes(t["lang"].chunk(0), t["term"].chunk(0)))[-1])
            if last:
                yield closed(t.slice(0, last).combine_chunks())
            held = t.slice(last).combine_chunks()
        if held is not None:
            yield closed(held)

    near = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return near.mapInArrow(scan, "lang string, term string, sources array<string>, counts array<long>")


class Groups:
    """Sources of each language in order, their numbers of term occurrences, and each language's kept terms."""

    def __init__(self, rows: list[tuple[str, str, int]], terms: dict[str, int]):
        self.sources: dict[str, list[str]] = {}
        totals: dict[str, list[int]] = {}
        for lang, source, n in sorted(rows, key=lambda r: (r[0], r[1].encode())):
            self.sources.setdefault(lang, []).append(source)
            totals.setdefault(lang, []).append(n)
        #: Denominators: of the sources, and of the language.
        self.below = {k: (np.array([n + ADD * terms.get(k, 0) for n in v], np.int64), sum(v) + ADD * terms.get(k, 0)) for k, v in totals.items()}

    def order(self, lang: str) -> pa.Array:
        return pa.array(self.sources[lang])


def shares(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + ADD) / below), exact."""
    if int(count.max(initial=0)) + ADD > (2**63 - 1) // SCALE:
        return np.array([1 + SCALE * (int(c) + ADD) // int(d) for c, d in zip(count.ravel(), np.broadcast_to(below, count.shape).ravel())], np.int64).reshape(count.shape)
    return 1 + SCALE * (count + ADD) // below


def _listed(docs: DataFrame, held: DataFrame, most_groups: int) -> Groups:
    n = held.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    rows = docs.select("lang", "source").distinct().join(n, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    found = rows.limit(most_groups + 1).collect()
    if len(found) > most_groups:
        raise ValueError(f"more than {most_groups} groups of lang and source; raise most_groups or audit coarser sources")
    return Groups([(r["lang"], r["source"], r["n"]) for r in found], {r["lang"]: r["count"] for r in held.groupBy("lang").count().collect()})


def _partials(held: DataFrame, groups: Groups, top: int, block: int) -> DataFrame:
    """lang, source, part, item, value: partial sums of pairs, and the first terms of each source in a run."""
    told = held.sparkSession.sparkContext.broadcast(groups)
    kinds = [pa.string()] * 4 + [pa.int64()]
    names = ["lang", "source", "part", "item", "value"]

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def one(lang: str, number: int, t: pa.Table, sums: np.ndarray, order: pa.Array):
        """Adds the pairs of a chunk of terms to sums; yields the terms."""
        below, whole = told.value.below[lang]
        term, lists = t["term"].combine_chunks(), t["counts"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists, term = lists.chunk(0), term.chunk(0)
        of = t["sources"].combine_chunks()
        of = of.chunk(0) if isinstance(of, pa.ChunkedArray) else of
        counts = np.zeros((t.num_rows, len(order)), np.int64)
        row = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        counts[row, pc.index_in(of.flatten(), order).to_numpy()] = lists.flatten().to_numpy()
        p = shares(counts, below)
        first = number * block
        for g in range(first, min(first + block, len(order))):
            sums[g - first] += np.abs(p - p[:, g : g + 1]).sum(axis=0)
        over = p - shares(counts.sum(axis=1), np.int64(whole))[:, None]
        for g in range(first, min(first + block, len(order))):
            at = np.flatnonzero((counts[:, g] > 0) & (over[:, g] > 0))
            at = at[np.argsort(-over[at, g], kind="stable")][:top]
            if len(at):
                source = order[g].as_py()
                yield rows([lang] * len(at), [source] * len(at), ["term"] * len(at), term.take(pa.array(at)), over[at, g])

    def closed(lang: str, number: int, sums: np.ndarray, order: pa.Array):
        names = order.to_pylist()
        for g in range(len(sums)):
            other = np.flatnonzero(np.arange(len(names)) != number * block + g)
            yield rows([lang] * len(other), [names[number * block + g]] * len(other), ["pair"] * len(other), [names[h] for h in other], sums[g, other])

    def scan(batches):
        now, sums, order = None, None, None
        for t in gather(batches, 1 << 14):
            lang, number = t["lang"].chunk(0), t["block"].chunk(0)
            head = np.append(np.flatnonzero(_changes(lang, number)), t.num_rows)
            for a, b in zip(head[:-1].tolist(), head[1:].tolist()):
                key = (lang[a].as_py(), number[a].as_py())
                if key != now:
                    if now:
                        yield from closed(*now, sums, order)
                    now, order = key, told.value.order(key[0])
                    sums = np.zeros((min(block, len(order) - key[1] * block), len(order)), np.int64)
                step = max(CELLS // len(order), 1)
                for i in range(a, b, step):
                    yield from one(*now, t.slice(i, min(step, b - i)), sums, order)
        if now:
            yield from closed(*now, sums, order)

    blocks = {k: (len(v) - 1) // block for k, v in groups.sources.items() if len(v) > block}
    last = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), "lang"), F.lit(0)) if blocks else F.lit(0)
    near = held.withColumn("block", F.explode(F.sequence(F.lit(0), last))).sortWithinPartitions("lang", "block", "term")
    return near.mapInArrow(scan, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP, block: int = BLOCK,
          most_groups: int = MOST_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance from the others of its language, and the terms it has above the language's share."""
    d = docs.select(*[F.coalesce(col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    held = stage(kept_terms(term_runs(d), least))
    groups = _listed(d, held, most_groups)
    parts = stage(_partials(held, groups, top, block))
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    each = d.select("lang", "source").distinct()
    pairs = each.join(each.withColumnRenamed("source", "item"), "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gc AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(gc.c), 0) AS n FROM g LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(gc.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(gc.c, 0) + 5)) // (gn.n + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 5)) // (v.n + 5 * v.v) AS q
    FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN gc ON gc.lang = gn.lang AND gc.source = gn.source AND gc.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
