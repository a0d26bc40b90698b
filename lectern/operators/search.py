"""Keyword lookup in stages and the filter state of a conversation."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyword_cascade(keys: DataFrame, query: str, synonyms: tuple[str, ...] = (), accept: Column | None = None) -> DataFrame:
    """name, stage: 1 the phrase, 2 all its words, 3 any word or synonym; each keyword at its first stage."""
    words = query.split()
    has = [F.col("name").contains(w) for w in words]
    stage = F.when(F.col("name") == query, 1).when(reduce(lambda a, b: a & b, has), 2).when(reduce(lambda a, b: a | b, [*has, *(F.col("name").contains(s) for s in synonyms)]), 3)
    out = keys.select("name", stage.alias("stage")).where("stage IS NOT NULL")
    return out if accept is None else out.where(accept)


#: Words of one meaning that a search may put in each other's place; the least similarity of a keyword's vector.
SYNONYMS = {"게놈": ("유전체",), "유전체": ("게놈",)}
LEAST_SIMILARITY = 0.65
#: The characters that a search takes out of its query.
_RESERVED = r"""[+\-!(){}\[\]^"~*?:\\/&|]"""


def keyword_search(keys: DataFrame, query: str, query_vector: list[float] | None = None, lang: str | None = None, limit: int = 5, synonyms: dict = SYNONYMS,
                   accept: Column | None = None, least: float = LEAST_SIMILARITY) -> DataFrame:
    """name, stage, score, paper_count of the best keywords at the first stage at which an acceptable one is found: 1 the phrase, 2 all words
    in any order, 3 and on a synonym each, last the vectors. keys: name, lang, paper_count and (for the last stage) v.

    The score of a name found by words is the share of its words that are meant; of one found by its vector, the cosine. accept
    is a condition on keys, and holds at every stage, so that an unusable keyword never ends the search."""
    import re

    from .vectors import cosine

    words = re.sub(_RESERVED, " ", query).lower().split()
    if not words:
        return keys.select("name", F.lit(0).alias("stage"), F.lit(0.0).alias("score"), "paper_count").limit(0)
    d = keys if lang is None else keys.where(F.col("lang") == lang)
    d = d if accept is None else d.where(accept)
    own = F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    padded = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
    phrase = lambda ws: padded.contains(" " + " ".join(ws) + " ")
    tried = [phrase(words), F.size(F.array_intersect(own, F.array(*map(F.lit, words)))) == len(set(words)), *(phrase(s.lower().split()) for s in synonyms.get(" ".join(words), ()))]
    stage = F.coalesce(*[F.when(t, k + 1) for k, t in enumerate(tried)])
    n = [len(words), len(words), *(len(s.split()) for s in synonyms.get(" ".join(words), ()))]
    score = F.element_at(F.array(*[F.lit(float(x)) for x in n]), stage) / F.size(own)
    if query_vector is not None:
        sim = F.round(cosine(F.col("v"), F.array(*[F.lit(float(x)) for x in query_vector])), 9)
        stage, score = F.coalesce(stage, F.when(sim >= least, len(tried) + 1)), F.when(stage.isNotNull(), score).otherwise(sim)
    found = d.select("name", stage.alias("stage"), F.round(score, 6).alias("score"), "paper_count").where("stage IS NOT NULL")
    # A scalar beside the rows: the first stage with a row.
    first = found.agg(F.min("stage").alias("__first"))
    return found.join(F.broadcast(first), F.col("stage") == F.col("__first")).drop("__first").orderBy(F.col("score").desc(), F.col("paper_count").desc(), "name").limit(limit)


def replay_filters(turns: DataFrame) -> DataFrame:
    """conv_id, turn and the filters in force after it: NULL leaves a filter, and the two years move together."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    years = F.when(F.col("year_start").isNotNull() | F.col("year_end").isNotNull(), F.struct("year_start", "year_end"))
    y = F.last(years, ignorenulls=True).over(w)
    return turns.select("conv_id", "turn", y.alias("y"), F.last("paper_type", ignorenulls=True).over(w).alias("paper_type")).select("conv_id", "turn", F.col("y.year_start").alias("year_start"), F.col("y.year_end").alias("year_end"), "paper_type")
