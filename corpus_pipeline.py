"""From raw documents to a training mixture in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last adds the output shard
and the pass); run() writes each as Parquet and reads it again for the next. Stages read doc_id, text, source and (to learn)
lang; n_chars, where there is one, follows the text; all other columns pass through, whatever their names. Every stage gives no
rows for an empty table, and rereads its input, so that a lost executor costs a recomputation at most.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate as d
from lectern.llm import language_id as l
from lectern.llm import mixing as m
from lectern.llm import near_dedup as n
from lectern.llm import secret_scan as s
from lectern.llm.common import cleanup, col, free_name, small_batches, stage, table, written
from lectern.llm.hashing import Bitmap


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """out with the columns of docs alone, in their order."""
    return out.select(*[col(c) for c in docs.columns])


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.select(*[n_chars.alias(c) if c == "n_chars" else col(c) for c in docs.columns])


def _may_hold(ids: DataFrame) -> Column:
    """Whether doc_id may be in ids (one column, written), by a bitmap of bounded size: rows that it rules out need no join, so their
    texts are not shuffled. Only a hash of the id passes through Python."""
    held = ids.sparkSession.sparkContext.broadcast(Bitmap(ids.select(F.xxhash64(ids.columns[0]).alias("h")), "h"))

    @F.arrow_udf("boolean")
    def holds(h: pa.Array) -> pa.Array:
        return pa.array(held.value.holds(h.to_numpy().view(np.uint64)))

    return holds(F.xxhash64("doc_id"))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose id is in ids (one column, written)."""
    may = _may_hold(ids)
    return docs.where(~may).union(docs.where(may).join(ids, F.col("doc_id") == F.col(ids.columns[0]), "left_anti"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, fitted on a bounded sample of the labelled ones, does not reject.

    Texts that are null or have no letter go; so does every document where none has a label. Very long texts are scored
    whole. Rows with equal texts share their fate; ties between languages go to the one that sorts first."""
    out = l.predict(docs, l.fit(docs))
    return _like(docs, out.where(~col(out.columns[-1]).getField("rejected")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact and near copies: the one with the least id.

    Where rows share an id or have none, they are decided by id and text: of a group's rows with the least id (or, if none of
    the group has an id, of all its rows) the one whose digest is least stays; of rows equal in id and words any one. A text that is null
    or without words is in no group; its row stays, once for each id and text. Very long texts take part with all their shingles."""
    since, docs = written(), small_batches(docs)
    found = stage(n.dedup(docs))
    cleanup(spark, since=since, keep=1)
    out = _without(docs, stage(found.where("NOT kept AND id IS NOT NULL").select(F.col("id").alias("__gone")).distinct()))
    again = stage(found.groupBy("id").count().where("count > 1 OR id IS NULL").select(F.col("id").alias("__again")))
    if again.isEmpty():
        return out
    some = docs.where(_may_hold(again)).join(again, F.col("doc_id") == F.col("__again"), "left_semi")
    some, cls = n.with_class(some.union(docs.where("doc_id IS NULL")))
    blank = free_name(some, "blank")
    some = some.withColumn(blank, F.when(F.col(cls).isNull(), F.col("text")))
    some = stage(some.dropDuplicates(["doc_id", cls, blank]))
    first = found.where("kept AND cls IS NOT NULL").groupBy("comp").agg(F.min("cls").alias("__first"), F.first("id").alias("__id"))
    some = some.join(first, (F.col(cls) == F.col("__first")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").union(some.where(F.col(cls).isNull()))
    return _without(out.where("doc_id IS NOT NULL"), again).union(_like(docs, some))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those that are mostly such passages go.

    A null or wordless text has no passage and stays as it is; an empty benchmark leaves all as it is; very long texts are
    cleaned whole; repeated rows and repeated items count once each. Passages that overlap are cut as one."""
    return _recounted(d.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of every secret.

    No row goes. A null text stays null, an empty one empty; very long texts are scanned whole; rows of one text are
    scanned once and all marked; findings of several kinds that overlap get one mark."""
    return _recounted(s.redact(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by source, a row for each time that a document is taken.

    A null or wordless text is never taken; a null source is a source of its own; rows without an id or with that of another are told
    apart by their text, and of equal rows it is immaterial which is cut; the one document of each source that the target cuts keeps
    its first words, however long it is."""
    return _recounted(m.mix(docs))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: The language classifier is fitted in numpy, which SQL cannot express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the folder's documents. The tables that stages write on the way are deleted, but for the result's."""
    docs, since = table(spark, sf_dir, "documents"), written()
    for _, f in STAGES:
        docs = stage(f(spark, docs, sf_dir))
        cleanup(spark, since=since, keep=1)
    return docs
