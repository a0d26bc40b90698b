"""Licence scans with a positional index of rare words.

Licence templates (notices, key paragraphs or whole licences; a list or a table) are indexed by their words of high inverse
template frequency: postings are (template, position). A file's such words vote for (template, place minus position), that is, for where the
template would begin. Votes are intersected by that relative position around each place where the template's mandatory key phrase stands: a
tenth of its length either way, so that names, dates and edits do not take words out. Where they and the unindexed words could reach LEAST of the
template's weight, template and file are aligned from the key phrase outward, word by word and with gaps at any word, never further off than that
tenth. The aligned share of the weight is the score, and a label needs LEAST of it. A word weighs from 1 to 2 by its rarity, so a template
of which up to a tenth of the words outside its key phrase are dropped, changed, or joined by others keeps its label. All places of a key
phrase are tried; nothing is dropped, however long the file and however many licences it holds.

Base phrases are found wherever their words stand consecutively, and give labels as well.

Defined results: a null or empty text has no words, no places and no labels; a very long text is scanned whole; equal scores of a label count
once; repeated rows each get a row; an empty table gives no rows. Only id and text are read, so other columns may have any names.
"""
from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, col, small_batches, table

LEAST = 0.7
#: Words in more than this share of the templates are not indexed.
COMMON = 0.25
#: Templates are held by every worker, so a table of them has at most so many words; more is an error.
MOST_WORDS = 4_000_000
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label, mandatory key phrase, and words of the licence's usual notice or key paragraph.
TEMPLATES = (
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero general public license", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split() if text else []


class Index:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.label = [t[0] for t in templates]
        self.words = [t[2].encode().split() for t in templates]
        self.key = [t[1].encode().split() for t in templates]
        self.key_at = [next(i for i in range(len(w)) if w[i : i + len(k)] == k) for w, k in zip(self.words, self.key)]
        df = Counter(x for w in self.words for x in set(w))
        self.idf = {x: math.log((len(templates) + 1) / n) for x, n in df.items()}
        top = math.log(len(templates) + 1) or 1.0
        self.number = {x: i for i, x in enumerate(df)}
        self.worth = {x: 1 + v / top for x, v in self.idf.items()}
        self.weight = [sum(self.worth[x] for x in w) for w in self.words]
        self.band = [len(w) // 10 + 1 for w in self.words]
        self.base = [(p.encode().split(), label) for p, label in base]
        #: Postings of rare words, and each template's weight of all others.
        self.posting: dict[bytes, list[tuple[int, int]]] = {}
        self.unindexed = [0.0] * len(templates)
        for n, w in enumerate(self.words):
            for i, x in enumerate(w):
                if df[x] <= max(1, COMMON * len(templates)):
                    self.posting.setdefault(x, []).append((n, i))
                else:
                    self.unindexed[n] += self.worth[x]
        #: Templates, and the position in each, by the rarest word of their key phrase.
        self.seed: dict[bytes, list[tuple[int, int]]] = {}
        for n, k in enumerate(self.key):
            x = self.rarest(k)
            self.seed.setdefault(x, []).append((n, k.index(x)))
        #: A file without one of these words can hold no key phrase and no base phrase.
        self.need = frozenset([*self.seed, *(self.rarest(p) for p, _ in self.base)])

    def rarest(self, phrase: list[bytes]) -> bytes:
        return max(phrase, key=lambda x: (self.idf.get(x, 99.0), x))

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """Start and label of every base phrase."""
        out = []
        for phrase, label in self.base:
            i = -1
            try:
                while True:
                    i = words.index(phrase[0], i + 1)
                    if words[i : i + len(phrase)] == phrase:
                        out.append((i, label))
            except ValueError:
                pass
        return out

    def aligned(self, words: list[bytes], n: int, at: int) -> float:
        """The aligned weight of template n whose key phrase stands at `at`."""
        t, k, k_end, band = self.words[n], self.key_at[n], self.key_at[n] + len(self.key[n]), self.band[n]
        end = at + len(self.key[n])
        back, on = t[:k][::-1], t[k_end:]
        near = words[max(0, at - len(back) - band) : at][::-1], words[end : end + len(on) + band]
        return sum(self.worth[x] for x in self.key[n]) + self._side(back, near[0], band) + self._side(on, near[1], band)

    def _side(self, t: list[bytes], words: list[bytes], band: int) -> float:
        """Greatest weight of words of t that stand in words in the same order, each at most band places off."""
        worth = [self.worth[x] for x in t]
        if words[: len(t)] == t:
            return sum(worth)
        file = np.full(len(t) + 2 * band + len(words), -1, np.int64)
        file[band : band + len(words)] = [self.number.get(x, -1) for x in words]
        # row[c]: after i words of t and i + c - band words of the file
        c = np.arange(2 * band + 1)
        row = np.where(c >= band, 0.0, -np.inf)
        row[c - band > len(words)] = -np.inf
        best = 0.0
        for i, x in enumerate(t):
            step = row + np.where(file[i : i + len(c)] == self.number[x], worth[i], 0.0)
            step[:-1] = np.maximum(step[:-1], row[1:])
            at = i + 1 + c - band
            step[at < 0] = -np.inf
            row = np.maximum.accumulate(step)
            row[at > len(words)] = -np.inf
            best = max(best, float(row.max()))
        return best

    def match(self, words: list[bytes]) -> dict[str, float]:
        """Labels whose template aligns and whose key phrase stands in place, with their best score."""
        keys: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            for n, i in self.seed.get(w, ()):
                if at >= i and words[at - i : at - i + len(self.key[n])] == self.key[n]:
                    keys.setdefault(n, []).append(at - i)
        votes: dict[int, list[tuple[int, int]]] = {n: [] for n in keys}
        if keys:
            for at, w in enumerate(words):
                for n, i in self.posting.get(w, ()):
                    if n in votes:
                        votes[n].append((at - i, i))
        best: dict[str, float] = {}
        for n, places in keys.items():
            found, band, label = sorted(votes[n]), self.band[n], self.label[n]
            for at in places:
                start = at - self.key_at[n]
                near = {i for _, i in found[bisect_left(found, (start - band, -1)) : bisect_right(found, (start + band, len(self.words[n])))]}
                if sum(self.worth[self.words[n][i]] for i in near) + self.unindexed[n] < LEAST * self.weight[n] - 1e-9:
                    continue
                score = min(1.0, self.aligned(words, n, at) / self.weight[n])
                if score >= LEAST and score > best.get(label, 0):
                    best[label] = score
        return best


def templates_of(table: DataFrame, most_words: int = MOST_WORDS) -> tuple:
    """(label, key phrase, text) of a table of licences with these columns, normalised to words; phrases must stand in their texts."""
    own = lambda c: F.trim(F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    rows = table.select("label", own("phrase").alias("phrase"), own("text").alias("text")).where("label IS NOT NULL AND phrase <> '' AND text <> ''")
    n = rows.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    if n > most_words:
        raise ValueError(f"the licence templates have {n} words; workers hold at most {most_words}")
    found = sorted(tuple(r) for r in rows.distinct().collect())
    for label, phrase, text in found:
        if f" {phrase} " not in f" {text} ":
            raise ValueError(f"the key phrase {phrase!r} does not stand in a template of {label!r}")
    return tuple(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """id, n_words, places (starts of base phrases), base_labels, labels (both sorted) and score for every row."""
    held = docs.sparkSession.sparkContext.broadcast((tuple(templates), tuple(base)))

    def run(batches):
        ix = Index(*held.value)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                if ix.need.isdisjoint(words):
                    out.append((len(words), [], [], [], 0.0))
                    continue
                places, found = ix.places(words), ix.match(words)
                labels = sorted({x for _, x in places})
                # A bare phrase is half the evidence that an aligned template is.
                score = max([0.5 * bool(labels), *found.values()])
                out.append((len(words), sorted(p for p, _ in places), labels, sorted({*labels, *found}), score))
            n, p, bl, al, s = zip(*out) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.int64())), pa.array(bl, pa.list_(pa.string())), pa.array(al, pa.list_(pa.string())), pa.array(s, pa.float64())],
                names=["id", "n_words", "places", "base_labels", "labels", "score"])

    d = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("t"))
    kind = d.schema["id"].dataType.simpleString()
    return small_batches(d).mapInArrow(run, f"id {kind}, n_words long, places array<long>, base_labels array<string>, labels array<string>, score double")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
                      F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
