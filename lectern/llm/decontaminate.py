"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all items feed a suffix automaton (a separator of its own follows each item). A document's
words stream through it; after each word the automaton knows the longest match that ends there. Where that reaches
`window` words, the last `window` words are an item's window and are hit; an item of fewer words is hit as a whole.

Items of up to `block_words` words (by their size in bytes) are broadcast, and each worker builds their automaton. A larger
benchmark is dealt into blocks of that size, and the documents pass a fixed number of times, however many blocks there are: once to
look up hashes of their windows in a bitmap of the items' windows, whose hits are joined with the windows' blocks; those documents
alone go to the blocks that they need, block and documents in one task in pieces of SHARE documents; and once more to put the hits together.

Words are runs of ASCII letters (lower-cased), digits and bytes from 0x80 on. Defined results: a null or empty text has no
words and no hits; a null or wordless item matches nothing; a null item id counts as no item though its words are hit;
a very long text streams whole; hits that overlap or touch are one span; repeated rows each get a row; repeated items count once;
empty tables give no rows or no hits. Other columns pass through, whatever their names, and the operator's own column takes a name that is free.
"""
from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, batch_of, col, free_name, map_rows, small_batches, stage, table
from .hashing import Bitmap, WordHash, hashes_of, runs

WINDOW = 10
BLOCK_WORDS = 200_000
#: Documents that a task holds against one block's automaton, about.
SHARE = 2_000
PAIR_SLOTS = 1 << 22
HITS = "n_words long, items array<string>, spans array<struct<start:int,end:int,longest:int>>"
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), (
    "spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("longest", pa.int32())])))])
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split() if text else []


class Automaton:
    """Suffix automaton over the items' words, with what each state needs to name the items of a window."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        texts = [(i, [self.ids.setdefault(w, len(self.ids)) for w in words_of(t)]) for i, t in items]
        texts = [(i, t) for i, t in texts if t]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, str | None]] = []
        last = 0
        for n, (item, t) in enumerate(texts):
            for w in t:
                last = self._add(last, w)
                ends.append((last, item))
            last = self._add(last, -2 - n)
        self._name_items(ends, texts)
        self._index_pairs(texts)

    def _add(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 != length[q]:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[cur] = q
        return cur

    def _name_items(self, ends, texts) -> None:
        """of_window: the items in which the window that ends in a state occurs; of_short: (length, item) of whole items
        that are suffixes of a state; at_window: the state of a longer match's last `window` words."""
        n, w = len(self.len), self.window
        order = sorted(range(1, n), key=self.len.__getitem__)
        self.of_window: list[set | None] = [None] * n
        for s, item in ends:
            if self.len[s] >= w and item is not None:
                self.of_window[s] = (self.of_window[s] or set()) | {item}
        for s in reversed(order):
            up = self.link[s]
            if self.len[up] >= w and self.of_window[s]:
                self.of_window[up] = (self.of_window[up] or set()) | self.of_window[s]
        self.of_short: list[list] = [[] for _ in range(n)]
        for item, t in texts:
            if len(t) < w:
                s = 0
                for c in t:
                    s = self.next[s][c]
                self.of_short[s].append((len(t), item))
        self.at_window = [0] * n
        for s in order:
            up = self.link[s]
            if self.of_short[up]:
                self.of_short[s] = self.of_short[s] + self.of_short[up]
            self.at_window[s] = self.at_window[up] if self.len[up] >= w else s

    def _index_pairs(self, texts) -> None:
        """Which neighbouring words occur in items: stretches of a document without them need no stream."""
        self.shortest = min([self.window, *(len(t) for _, t in texts)])
        self.pairs = np.zeros(PAIR_SLOTS, bool)
        for _, t in texts:
            a = np.array(t, np.int64)
            self.pairs[self._slot(a[:-1], a[1:])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 1_000_003 + b) * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)

    def stretches(self, ids: np.ndarray):
        """[start, end) of the stretches that could hold a match."""
        if self.shortest < 2:
            ok = ids >= 0
            more = 1
        else:
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            ok[ok] = self.pairs[self._slot(ids[:-1][ok], ids[1:][ok])]
            more = 2
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i + more - 1 >= self.shortest:
                yield i, j + more - 1

    def match(self, words: list[bytes]) -> tuple[set, list[list[int]]]:
        """Items with an occurring window, and the hit stretches [start, end, longest match]."""
        items: set = set()
        spans: list[list[int]] = []
        if not self.ids or not words:
            return items, spans
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, count=len(words))
        nxt, link, length, w = self.next, self.link, self.len, self.window

        def hit(start, end, longest):
            while spans and spans[-1][1] >= start:
                s = spans.pop()
                start, longest = min(start, s[0]), max(longest, s[2])
            spans.append([start, end, longest])

        for i, j in self.stretches(ids):
            s = n = 0
            for at, c in enumerate(ids[i:j].tolist(), i + 1):
                while s and c not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if c in nxt[s]:
                    s = nxt[s][c]
                    n += 1
                if n >= w:
                    hit(at - w, at, n)
                    items |= self.of_window[self.at_window[s]] or set()
                for k, item in self.of_short[s]:
                    if k <= n:
                        hit(at - k, at, n)
                        if item is not None:
                            items.add(item)
        return items, spans


_BUILT: dict = {}


def _automaton(held, key: str, window: int) -> Automaton:
    """One automaton in a worker at a time, kept from task to task."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(held.value, window)
    return _BUILT[key]


def _items_of(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return items.select(col(item_id).cast("string").alias("i"), col(item_text).cast("binary").alias("t")).where("t is not null")


def find_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
              window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: float | None = None) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of n_words, items and spans (in words), and that column's name.

    cut: texts of which at most this share of words is hit lose their spans."""
    items = _items_of(items, item_id, item_text)
    size = items.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    name = free_name(docs, "hits")
    at = docs.columns.index(text_col)
    if blocks == 1:
        held = docs.sparkSession.sparkContext.broadcast([(r["i"], bytes(r["t"])) for r in items.distinct().toLocalIterator()])
        key = uuid.uuid4().hex

        def run(batches):
            for b in batches:
                auto = _automaton(held, key, window)
                texts = b.column(at).cast(pa.binary()).to_pylist()
                words = [words_of(t) for t in texts]
                yield _with_hits(list(b.columns), at, cut, words, map(auto.match, words))

        return map_rows(docs, run, f"{name} struct<{HITS}>"), name

    row, found = free_name(docs, "row"), free_name(docs, "found")
    kept = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = _hits_by_row(kept.select(col(row).alias("row"), col(text_col).cast("binary").alias("t")), items, blocks, window)
    hits = hits.select(F.col("row").alias("__row"), F.struct("items", "spans").alias(found))
    both = kept.join(hits, col(row) == F.col("__row"), "left").select(*[col(c) for c in docs.columns], found)

    def put(batches):
        for b in batches:
            cols = list(b.columns)
            found = [({i for x in r["items"] for i in x}, _merged([[y["start"], y["end"], y["longest"]] for x in r["spans"] for y in x])) if r else (set(), []) for r in cols.pop().to_pylist()]
            words = [words_of(t) for t in cols[at].cast(pa.binary()).to_pylist()]
            out = _with_hits(cols, at, cut, words, found)
            yield batch_of([*out.columns[:-1], b.column(b.num_columns - 1), out.columns[-1]])

    out = map_rows(both, put, f"{name} struct<{HITS}>")
    return out.select(*[col(c) for c in docs.columns], name), name


def _with_hits(cols: list, at: int, cut: float | None, words: list, found) -> pa.RecordBatch:
    """A batch of the columns and the hits (items and spans by row); with cut, texts lose their spans."""
    rows, texts = [], cols[at].to_pylist() if cut is not None else None
    for i, (w, (items, spans)) in enumerate(zip(words, found)):
        rows.append({"n_words": len(w), "items": sorted(items), "spans": [{"start": s, "end": e, "longest": m} for s, e, m in spans]})
        if texts is not None and spans and sum(s[1] - s[0] for s in spans) <= cut * len(w):
            texts[i] = without_spans(texts[i], spans)
    if texts is not None:
        cols[at] = pa.array(texts, cols[at].type)
    return batch_of([*cols, pa.array(rows, _HITS_ARROW)])


def _hits_by_row(docs: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """row, items and spans (a list of each from every block with hits) of rows row and t with a hit."""
    items = stage(items.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(blocks)).cast("int")).distinct())

    def windows(batches):
        memo = WordHash()
        for b in batches:
            hs, ns, bs = [], [], []
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(t)
                if words:
                    n = min(window, len(words))
                    h = np.unique(runs(hashes_of(words, memo), n))
                    hs.append(h.view(np.int64))
                    ns.append(np.full(len(h), n, np.int32))
                    bs.append(np.full(len(h), k, np.int32))
            cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays([cat(hs, np.int64), cat(ns, np.int32), cat(bs, np.int32)], names=["h", "n", "block"])

    wins = stage(small_batches(items.select("t", "block")).mapInArrow(windows, "h long, n int, block int").distinct())
    sizes = sorted(r["n"] for r in wins.select("n").distinct().collect())  # at most `window` numbers
    held = docs.sparkSession.sparkContext.broadcast(Bitmap(wins.select("h").distinct(), "h"))

    def look(batches):
        memo, bits = WordHash(), held.value
        for b in batches:
            rows, hs = [], []
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = hashes_of(words_of(t), memo)
                h = [x[bits.holds(x)] for x in (runs(words, n) for n in sizes) if len(x)]
                h = np.unique(np.concatenate(h)) if h else ()
                if len(h):
                    rows.append(row)
                    hs.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hs, pa.list_(pa.int64()))], names=["row", "h"])

    seen = small_batches(docs).mapInArrow(look, "row long, h array<long>").select("row", F.explode("h").alias("h"))
    need = stage(seen.join(wins.select("h", "block"), "h").select("row", "block").distinct())
    # A block's documents are dealt into shares; its items go to each of them, ahead of the documents.
    shares = stage(need.groupBy("block").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")))
    ahead = items.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(-1).cast("long").alias("row"), "i", "t")
    after = docs.join(need, "row").join(shares, "block").select("block", F.pmod(F.xxhash64("row"), F.col("shares")).cast("int").alias("share"), "row", F.lit(None).cast("string").alias("i"), "t")
    dealt = ahead.unionByName(after).repartition("block", "share").sortWithinPartitions("block", "share", "row")

    def match(batches):
        now, items, auto = None, [], None
        for b in batches:
            rows, found = [], []
            for block, share, row, i, t in zip(*[c.to_pylist() for c in b.columns]):
                if (block, share) != now:
                    now, items, auto = (block, share), [], None
                if row < 0:
                    items.append((i, t))
                    continue
                if auto is None:
                    auto = Automaton(items, window)
                names, spans = auto.match(words_of(t))
                if spans:
                    rows.append(row)
                    found.append({"items": sorted(names), "spans": [{"start": s, "end": e, "longest": m} for s, e, m in spans]})
            got = pa.array(found, pa.struct([("items", pa.list_(pa.string())), ("spans", _HITS_ARROW.field("spans").type)]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), got.field(0), got.field(1)], names=["row", "items", "spans"])

    kinds = HITS.split(", ", 1)[1]
    return small_batches(dealt).mapInArrow(match, f"row long, {kinds}").groupBy("row").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e, m in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1][1:] = [max(out[-1][1], e), max(out[-1][2], m)]
        else:
            out.append([s, e, m])
    return out


def without_spans(text: str, spans: list) -> str:
    """text without the words of the spans and without what stands between words of one span."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    out, last = [], 0
    for s, e, *_ in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.5, window: int = WINDOW, **names) -> DataFrame:
    """docs without the hit spans; a document of whose words more than max_coverage are hit goes as a whole."""
    found, name = find_hits(docs, items, text_col, window=window, cut=max_coverage, **names)
    n_hit = F.aggregate(F.col(f"{name}.spans"), F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return found.where(n_hit <= max_coverage * F.col(f"{name}.n_words")).select(*[col(c) for c in docs.columns])


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, h = find_hits(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.col(f"{h}.spans"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(f"{h}.items"), ",")
    return found.select("doc_id", F.col(f"{h}.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(f"{h}.items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
hit AS MATERIALIZED (
  SELECT d.doc_id, d.i, d.n, win.item_id FROM (
    SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (
      SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)) d
  JOIN win ON win.n = d.n AND win.g = d.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
