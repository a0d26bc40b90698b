"""Line-first quality rules in Spark SQL.

Each line with a word is held against three rules: it must end like a sentence (a terminal mark of its script, closing quotes
and brackets may follow), must not have the shape of a bar of links (two separators or more with few words between them), and must
not hold a boilerplate phrase. Lines that fail are removed; a document that loses more than `most_lost` per cent of the
characters of its lines is rejected, and so is one that fails the base rules. All rules are fields of Rules, a parameter.

Words are runs of anything but ASCII white space. Counts within a text compare 64-bit hashes of words and of windows.

Defined results: a null or empty text has no words and fails the base; a text without lines with words loses nothing; a very
long text is judged whole; equal lines each count, all but the first as repeated; repeated rows each
get a row; an empty table gives no rows. Only id and text are read; clean_lines keeps all columns, whatever their names.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_WORD, UPPER, ascii_lower, col, let, table

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits and patterns. Marks, closers and separators are characters; phrases are lower-case text."""

    least_words: int = 50
    most_repeated: int = 50
    most_lost: int = 50
    #: Marks that end a sentence: Latin, Greek and Cyrillic, then Chinese and Japanese, Arabic and Urdu, Indic, Armenian, Ethiopic, Khmer, Burmese and Tibetan.
    marks: str = ".!?…‼⁇⁈⁉\u037e" + "。！？｡．" + "؟۔" + "।॥" + "։" + "።፧" + "។៕" + "။" + "།"
    #: What may stand behind a mark.
    closers: str = "\"'”’»›)]}」』）】》〉\u00a0 "
    separators: str = "|›·•>→"
    least_separators: int = 2
    words_between: int = 3
    phrases: tuple[str, ...] = (
        "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable cookies", "enable javascript", "forgot your password",
        "lorem ipsum", "privacy policy", "read more", "share this", "sign in to", "skip to content", "subscribe to our", "terms of service", "terms of use",
        "uses cookies", "alle rechte vorbehalten", "aviso legal", "mentions légales", "todos los derechos", "tous droits réservés")

    @property
    def sentence_end(self) -> str:
        return f"[{self._in_class(self.marks)}][{self._in_class(self.closers)}]*$"

    @property
    def separator(self) -> str:
        return f"[{self._in_class(self.separators)}]"

    @property
    def between(self) -> str:
        return rf"[^\x20\x09-\x0D{self._in_class(self.separators)}]+"

    @property
    def phrase(self) -> str:
        return "|".join(self.phrases)

    @staticmethod
    def _in_class(marks: str) -> str:
        return "".join("\\" + c if c in "[]\\^-" else c for c in marks)


RULES = Rules()
_SPACE = r"[\x20\x09-\x0D]"


def _trim(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{_SPACE}+|{_SPACE}+$", "")


def line_fails(line: Column, rules: Rules = RULES) -> Column:
    """Whether a trimmed line is to be removed."""
    bars = F.regexp_count(line, F.lit(rules.separator))
    bar = (bars >= rules.least_separators) & (F.regexp_count(line, F.lit(rules.between)) <= rules.words_between * (bars + 1))
    return ~line.rlike(rules.sentence_end) | bar | ascii_lower(line).rlike(rules.phrase)


def lines(text: Column) -> Column:
    """The trimmed lines with a word."""
    return F.filter(F.transform(F.split(text, "\n", -1), _trim), lambda x: x != "")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more: sort the windows' hashes, keep those with an equal neighbour,
    and measure what their places cover."""

    def of_windows(win: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])))
            at = F.sort_array(F.transform(twin, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + F.least(F.lit(3), p + 3 - a["end"])).alias("n"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        marked = F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(F.sort_array(marked), of_sorted))

    def of_hashes(h: Column) -> Column:
        n = F.size(h) - 2
        return F.when(n > 0, let(F.transform(F.slice(h, 1, F.greatest(n, F.lit(1))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), of_windows)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = RULES) -> DataFrame:
    """id and a row of figures for each document."""
    t = F.coalesce(col(text_col), F.lit(""))
    of_words = let(F.regexp_extract_all(t, F.lit(SPACE_WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("rep")))
    # A line that equals an earlier one counts; lines are compared with their white space.
    raw = let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(SPACE_WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    lost = let(lines(t), lambda ls: F.aggregate(
        ls, F.struct(F.lit(0).alias("bad"), F.lit(0).alias("lost"), F.lit(0).alias("all"), F.lit(0).alias("n")),
        lambda a, x: let(line_fails(x, rules), lambda f: F.struct(
            (a["bad"] + f.cast("int")).alias("bad"), (a["lost"] + F.when(f, F.length(x)).otherwise(0)).alias("lost"), (a["all"] + F.length(x)).alias("all"), (a["n"] + 1).alias("n")))))
    d = docs.select(
        col(id_col).alias("id"), of_words.alias("w"), raw.alias("dup"), lost.alias("l"),
        F.length(F.regexp_replace(t, rf"{_SPACE}+", "")).alias("chars"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("sym"))
    n, rep = F.col("w.n"), F.col("w.rep")
    failed = (n < rules.least_words) | (100 * rep.cast("long") > rules.most_repeated * n.cast("long"))
    long = lambda c: c.cast("long")
    return d.select(
        "id", long(n).alias("n_words"), long(F.col("chars")).alias("word_chars"), long(F.col("sym")).alias("n_symbols"), long(F.col("dup")).alias("n_dup_lines"),
        long(rep).alias("n_repeat_words"), failed.alias("base_failed"), long(F.col("l.n")).alias("n_lines"), long(F.col("l.bad")).alias("n_removed"),
        (~failed & (100 * long(F.col("l.lost")) <= rules.most_lost * long(F.col("l.all")))).alias("kept"))


def clean_lines(docs: DataFrame, text_col: str = "text", rules: Rules = RULES) -> DataFrame:
    """docs with the failing lines removed from the text; lines without a word stay."""
    keep = lambda x: let(_trim(x), lambda y: (y == "") | ~line_fails(y, rules))
    new = F.array_join(F.filter(F.split(col(text_col), "\n", -1), keep), "\n")
    return docs.select(*[(new if c == text_col else col(c)).alias(c) for c in docs.columns])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return measures(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_END = RULES.sentence_end.replace("'", "''")
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw,
    list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') AS ls FROM d),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twin AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twin) GROUP BY doc_id),
l AS (SELECT doc_id, x, NOT regexp_matches(x, '{_END}') OR regexp_matches(translate(x, '{UPPER}', '{LOWER}'), '{RULES.phrase}')
    OR (bars >= {RULES.least_separators} AND len(regexp_extract_all(x, '{RULES.between}')) <= {RULES.words_between} * (bars + 1)) AS bad
  FROM (SELECT doc_id, x, len(regexp_extract_all(x, '{RULES.separator}')) AS bars FROM (SELECT doc_id, unnest(ls) AS x FROM w))),
lost AS (SELECT doc_id, count(*) AS n, count(*) FILTER (bad) AS bad, sum(CASE WHEN bad THEN length(x) ELSE 0 END) AS lost, sum(length(x)) AS every FROM l GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, coalesce(n, 0) AS n_lines, coalesce(bad, 0) AS n_removed, coalesce(lost, 0) AS lost, coalesce(every, 0) AS every
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_lines, n_removed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= {RULES.most_lost} * every AS kept FROM m
"""
