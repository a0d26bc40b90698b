"""Set operations."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, tables).distinct()


def reconcile(have: DataFrame, want: DataFrame) -> DataFrame:
    """Every row of either with what is to be done: keep, drop or add. Both sides' columns are the key."""
    keys = have.columns
    a, b = have.distinct().withColumn("__a", F.lit(1)), want.distinct().withColumn("__b", F.lit(1))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("__b").isNull(), "drop").when(F.col("__a").isNull(), "add").otherwise("keep").alias("action"))


def remaining(rows: DataFrame, shown: DataFrame, group: str, key: str) -> DataFrame:
    """How many rows of each group are not shown."""
    return rows.join(shown.distinct(), key, "left_anti").groupBy(group).agg(F.count("*").alias("remaining"))


def keywords_ko_first(tags: DataFrame) -> DataFrame:
    """Rows paper_id, name, pos, lang: a paper's keywords, Korean ones first, each in their order."""
    at = F.struct(F.when(F.col("lang") == "ko", 0).otherwise(1).alias("l"), "pos", "name")
    return tags.groupBy("paper_id").agg(F.array_sort(F.collect_list(at)).alias("k")).select("paper_id", F.array_join(F.transform("k", lambda x: x["name"]), "|").alias("keywords"))
