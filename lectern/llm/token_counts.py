"""Edit-aware token counts with a segment tree of pre-tokens for each document.

A text's pre-tokens are cut into leaves of LEAF pre-tokens; a leaf has its characters and its tokens, and the nodes of a binary
tree above have the sums of both. An edit (from a place, drop so many characters, insert a string) descends by characters to the
leaf that holds the first pre-token which could have looked at a changed character, encodes from there, and stops where a new
pre-token ends at an old leaf's end beyond the edit: what follows is as before, because the pattern never looks back. The
first touched leaf becomes a leaf or a small tree of the new pre-tokens, the others that were touched become empty, and only the sums
on their paths change. A tree that has grown lopsided or hollow (DEEP, or more empty leaves than full ones) is balanced again
from its leaves, without encoding.

The tokenizer is a public byte-level BPE vocabulary (a file of ranks); its path is a parameter, and the driver broadcasts its
bytes (under 2 MB). Counts equal those of encoding the whole new text.

Defined results: a null text is an empty one with no characters and 0 tokens; a very long text has a larger tree; edits past the end are clipped to
it; edits of a document apply in order of their number, equal numbers in order of place; repeated rows each get a row; an empty
table gives no rows. Columns other than those named pass through, whatever their names.
"""
from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, col, free_name, map_rows, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
#: The pattern looks at most so many characters beyond a pre-token's end.
AHEAD = 4
#: A tree is balanced again when a descent takes more than twice the least number of steps and so many more.
DEEP = 8
#: For each node, the root first, its characters, tokens and children (0: none, so it is a leaf).
_TREE = "struct<chars:array<int>,tokens:array<int>,left:array<int>,right:array<int>>"
_PARTS = ("chars", "tokens", "left", "right")
_SPLIT = regex.compile(PATTERN)


class Counter(dict):
    """Tokens of a pre-token, remembered up to a bound."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("lectern", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 40:
            if len(self) > 400_000:
                self.clear()
            self[piece] = n
        return n


_COUNTERS: dict = {}


def _counter(held, key: str) -> Counter:
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(held.value)
    return _COUNTERS[key]


def leaves_of(pieces: list[str], counter: Counter) -> tuple[list[int], list[int]]:
    """Characters and tokens of each leaf."""
    if not pieces:
        return [], []
    cut = np.arange(0, len(pieces), LEAF)
    chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, count=len(pieces)), cut)
    tokens = np.add.reduceat(np.fromiter(map(counter.__getitem__, pieces), np.int64, count=len(pieces)), cut)
    return chars.tolist(), tokens.tolist()


class Tree:
    """A segment tree over a text's leaves."""

    def __init__(self, chars: list[int], tokens: list[int], left: list[int], right: list[int]):
        self.chars, self.tokens, self.left, self.right = chars, tokens, left, right
        self._hollow = sum(not c and not a for c, a in zip(chars, left))

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        """A balanced tree over leaves with these characters and tokens."""
        tree = cls([0], [0], [0], [0])
        tree._grow(0, chars, tokens)
        return tree

    @property
    def total(self) -> int:
        return self.tokens[0]

    def _grow(self, top: int, chars: list[int], tokens: list[int]) -> None:
        """Make the leaf `top` a balanced tree over the given leaves."""
        todo = [(top, 0, len(chars))]
        up = []
        while todo:
            node, i, j = todo.pop()
            if j - i < 2:
                self.chars[node], self.tokens[node] = (chars[i], tokens[i]) if j > i else (0, 0)
                continue
            k = len(self.chars)
            for part in (self.chars, self.tokens, self.left, self.right):
                part += (0, 0)
            self.left[node], self.right[node] = k, k + 1
            up.append(node)
            todo += ((k, i, (i + j) // 2), (k + 1, (i + j) // 2, j))
        for node in reversed(up):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        a, b = self.left[node], self.right[node]
        self.chars[node], self.tokens[node] = self.chars[a] + self.chars[b], self.tokens[a] + self.tokens[b]

    def _down(self, place: int) -> tuple[list[int], int]:
        """The path to the leaf with the character at `place` (the last leaf for later ones), and where that leaf begins."""
        path, begin = [0], 0
        while self.left[path[-1]]:
            a = self.left[path[-1]]
            if place < begin + self.chars[a] or not self.chars[self.right[path[-1]]]:
                path.append(a)
            else:
                begin += self.chars[a]
                path.append(self.right[path[-1]])
        return path, begin

    def leaves(self) -> list[int]:
        """The leaves from left to right."""
        out, todo = [], [0]
        while todo:
            node = todo.pop()
            if self.left[node]:
                todo += (self.right[node], self.left[node])
            else:
                out.append(node)
        return out

    def edit(self, text: str, at: int, drop: int, insert: str, counter: Counter) -> tuple[str, int]:
        """Apply one edit; the new text and how many characters were encoded again."""
        at = min(max(at, 0), len(text))
        end = min(at + max(drop, 0), len(text))
        new, shift = text[:at] + insert + text[end:], len(insert) - (end - at)
        # A pre-token that ends more than AHEAD before the edit has not looked at it.
        path, begin = self._down(max(at - AHEAD - 1, 0))
        touched, old_end = [path], begin + self.chars[path[-1]]
        pieces, here = [], begin
        for m in _SPLIT.finditer(new, begin):
            pieces.append(m.group())
            here = m.end()
            while old_end < len(text) and (old_end < end or old_end + shift < here):
                path, start = self._down(old_end)
                touched.append(path)
                old_end = start + self.chars[path[-1]]
            if here == old_end + shift and old_end >= end and here >= at + len(insert):
                break
        else:
            while old_end < len(text):
                path, start = self._down(old_end)
                touched.append(path)
                old_end = start + self.chars[path[-1]]
        for path in touched:
            self._set(path, 0, 0)
        first = touched[0]
        self._grow(first[-1], *leaves_of(pieces, counter))
        for node in reversed(first[:-1]):
            self._add_up(node)
        live = len(self.chars) // 2 + 1
        if max(map(len, touched)) > 2 * live.bit_length() + DEEP or (live > 16 and 2 * self._hollow > live):
            self._balance()
        return new, here - begin

    def _set(self, path: list[int], chars: int, tokens: int) -> None:
        less, fewer = self.chars[path[-1]] - chars, self.tokens[path[-1]] - tokens
        self._hollow += not chars
        for node in path:
            self.chars[node] -= less
            self.tokens[node] -= fewer

    def _balance(self) -> None:
        kept = [k for k in self.leaves() if self.chars[k]]
        new = Tree.of([self.chars[k] for k in kept], [self.tokens[k] for k in kept])
        self.chars, self.tokens, self.left, self.right, self._hollow = new.chars, new.tokens, new.left, new.right, 0


def _ranks(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _column(trees: list[Tree]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([getattr(t, p) for t in trees], pa.list_(pa.int32())) for p in _PARTS], names=list(_PARTS))


def build(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> tuple[DataFrame, str]:
    """docs with one more column, the tree (its first node is the root, with the sums), and that column's name."""
    held, key, name = _ranks(docs.sparkSession, vocabulary), uuid.uuid4().hex, free_name(docs, "tree")
    at = docs.columns.index(text_col)

    def run(batches):
        counter = _counter(held, key)
        for b in batches:
            yield batch_of([*b.columns, _column([Tree.of(*leaves_of(_SPLIT.findall(t or ""), counter)) for t in b.column(at).to_pylist()])])

    return map_rows(docs, run, f"{name} {_TREE}"), name


def recount(docs: DataFrame, tree: str, edits: str, text_col: str = "text", vocabulary: str = VOCABULARY) -> tuple[DataFrame, str]:
    """Apply each row's edits (an array of structs seq, at, drop, insert) to its text and tree.

    Returns docs with text and tree replaced and a column more, the characters that were encoded again, and its name."""
    held, key, name = _ranks(docs.sparkSession, vocabulary), uuid.uuid4().hex, free_name(docs, "recoded")
    it, itree, ie = (docs.columns.index(c) for c in (text_col, tree, edits))

    def run(batches):
        counter = _counter(held, key)
        for b in batches:
            texts, trees, again = [], [], []
            for text, old, todo in zip(b.column(it).to_pylist(), b.column(itree).to_pylist(), b.column(ie).to_pylist()):
                t, done = Tree(*[old[p] for p in _PARTS]), 0
                for e in sorted(todo or [], key=lambda e: (e["seq"], e["at"], e["drop"], e["insert"] or "")):
                    text, n = t.edit(text or "", e["at"], e["drop"], e["insert"] or "", counter)
                    done += n
                texts.append(text)
                trees.append(t)
                again.append(done)
            cols = list(b.columns)
            cols[it], cols[itree] = pa.array(texts, b.schema.field(it).type), _column(trees)
            yield batch_of([*cols, pa.array(again, pa.int64())])

    return map_rows(docs, run, f"{name} long"), name


def n_tokens(tree: str) -> Column:
    """The tokens of a tree."""
    return F.element_at(col(tree).getField("tokens"), 1).cast("long")


def apply_edits(docs: DataFrame, edits: DataFrame, tree: str = "tree", id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs (with trees from build) after the edits table id, seq, at, drop, insert; documents without edits are not touched."""
    name, key = free_name(docs, "edits"), free_name(docs, "edited")
    per = edits.groupBy(col(id_col).alias(key)).agg(F.collect_list(F.struct("seq", "at", "drop", "insert")).alias(name))
    out, _ = recount(docs.join(per, docs["`" + id_col + "`"] == per[key], "left").select(*[col(c) for c in docs.columns], name), tree, name, text_col, vocabulary)
    return out.select(*[col(c) for c in docs.columns])


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of every whole text, and again after one edit of each: in its middle, 12 characters give way to a phrase."""
    docs, tree = build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    edit = F.struct(F.lit(1).alias("seq"), F.expr("cast(coalesce(length(text), 0) div 2 as int)").alias("at"), F.lit(12).alias("drop"), F.lit(" (revised) ").alias("insert"))
    n_leaves = F.size(F.filter(F.arrays_zip(f"{tree}.left", f"{tree}.chars"), lambda x: (x["left"] == 0) & (x["chars"] > 0)))
    docs = docs.select("doc_id", "text", tree, n_tokens(tree).alias("n_tokens"), n_leaves.alias("n_leaves"), F.array(edit).alias("edits"))
    out, again = recount(docs, tree, "edits")
    return out.select("doc_id", "n_tokens", "n_leaves", n_tokens(tree).alias("n_tokens_edited"), F.col(again).alias("chars_encoded_again"))
