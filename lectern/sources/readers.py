"""Readers: corpus JSON, ranking and registry CSV, article XML, a paged source and the stores' scans."""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAPER = "struct<CN:string,DBCode:string,Title:string,Abstract:string,Keyword:array<string>,Pubyear:int,Pubdate:string>"
ARTICLE = """struct<id:string,title:string,year:string,authors:struct<author:array<struct<_order:int,name:string,institution:string>>>,keywords:struct<keyword:array<string>>,refs:struct<ref:array<struct<_id:string,_VALUE:string>>>>"""


def papers_in(text: Column) -> Column:
    """The papers of a corpus file's text: an object with `papers`, or a bare list. Those without a CN go."""
    held = F.coalesce(F.from_json(text, f"struct<papers:array<{PAPER}>>")["papers"], F.from_json(text, f"array<{PAPER}>"))
    return F.filter(held, lambda p: F.coalesce(p["CN"], F.lit("")) != "")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per paper of the corpus files under path."""
    return spark.read.text(path, wholetext=True).select(F.inline(papers_in(F.col("value"))))


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Journal rankings: `;` between fields, decimal commas, the year in the file's name; titles cut to 500 characters."""
    raw = spark.read.option("sep", ";").option("header", True).option("inferSchema", False).csv(path)
    year = F.regexp_extract(F.input_file_name(), r"([0-9]{4})[^/0-9]*$", 1).try_cast("int")
    return raw.select(F.substring("Title", 1, 500).alias("title"), F.split(F.replace("Issn", F.lit('"'), F.lit("")), ", *").alias("issn"), decimal_comma(F.col("SJR")).alias("sjr"),
                      F.col("`SJR Best Quartile`").alias("quartile"), F.col("`H index`").try_cast("int").alias("h_index"), year.alias("year"))


def latest_file(paths: list[str]) -> str:
    """The file with the latest date (8 digits) in its name."""
    return max(paths, key=lambda p: ((re.findall(r"\d{8}", p.rsplit("/", 1)[-1]) or [""])[-1], p))


def find_column(columns: list[str], *names: str) -> str | None:
    """A header by exact name, else by a part of it."""
    for n in names:
        if n in columns:
            return n
    return next((c for n in names for c in columns if n in c), None)


def read_registry(spark: SparkSession, path: str, encodings: tuple = ("euc-kr", "x-windows-949", "UTF-8"), mark: str = "ISSN") -> DataFrame:
    """A registry's CSV in the first encoding whose header holds `mark` and no replacement character."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Korean encodings are not among those allowed by default
    for e in encodings:
        df = spark.read.option("header", True).option("encoding", e).csv(path)
        if any(mark in c for c in df.columns) and not any("�" in c for c in df.columns):
            return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    raise ValueError(f"no encoding of {encodings} reads {path}")


def article(xml: Column) -> Column:
    return F.from_xml(xml, ARTICLE)


#: Keys under which records are found, in the order in which they are tried.
CONTAINERS = ("record", "Record", "records", "Records", "result", "RESULT", "outputData", "resultSet", "returnObject")


def find_records(node, names: tuple = CONTAINERS) -> list:
    """The first list of records of a parsed document: itself if it is a list; else a list under a known key, or in what stands
    under one; else, in order, what the other keys hold."""
    if not isinstance(node, dict):
        return node if isinstance(node, list) else []
    known = [(node.get(n), True) for n in names]
    for held, any_list in known + [(x, False) for x in node.values()]:
        if isinstance(held, list) and (any_list or (held and isinstance(held[0], dict))):
            return held
        if isinstance(held, dict) and (found := find_records(held, names)):
            return found
    return []


def records_of(documents: Column, schema: str, names: tuple = CONTAINERS) -> Column:
    """The records of parsed documents (JSON text), as an array of structs of the schema; NULL for what is no JSON."""
    import json

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def found(text):
        try:
            return None if text is None else json.dumps(find_records(json.loads(text), names), ensure_ascii=False)
        except ValueError:
            return None

    return F.from_json(pandas_udf(lambda s: s.map(found), "string")(documents), f"array<{schema}>")


class PagedSource(DataSource):
    """Records by keyword and page: a partition per keyword. Options: keywords (comma-separated), pages, size.

    The default pages are made up from the keyword; a subclass overrides fetch() to call a service."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "cn string, keyword string, page int, db_code string, year int"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options, self.fetch)

    @staticmethod
    def fetch(keyword: str, page: int, size: int) -> list[tuple]:
        codes = ("JAKO", "DIKO", "CFKO")
        at = [sum(keyword.encode()) % 7 + page * size + i for i in range(size)]
        return [(f"CN{n:05d}", keyword, page, codes[n % 3], 2000 + n % 25) for n in at]


class _Keyword(InputPartition):
    def __init__(self, keyword: str):
        self.keyword = keyword


class _PagedReader(DataSourceReader):
    def __init__(self, options, fetch):
        self.keywords = [k.strip() for k in options.get("keywords", "").split(",") if k.strip()]
        self.pages, self.size, self.fetch = int(options.get("pages", 1)), int(options.get("size", 10)), fetch

    def partitions(self) -> list[InputPartition]:
        return [_Keyword(k) for k in self.keywords]

    def read(self, partition) -> Iterator[tuple]:
        for page in range(self.pages):
            yield from self.fetch(partition.keyword, page, self.size)


def collected(rows: DataFrame, include: tuple = (), exclude: tuple = (), years: tuple = (None, None), cap: int | None = None) -> DataFrame:
    """A paged source's records once each (the first keyword's), by code and year, up to the cap."""
    from ..operators.filters import year_in_range

    x = rows.where(year_in_range(F.col("year"), *years))
    x = x.where(F.col("db_code").isin(*include)) if include else x
    x = x.where(~F.col("db_code").isin(*exclude)) if exclude else x
    x = x.groupBy("cn").agg(F.min_by(F.struct("keyword", "page", "db_code", "year"), F.struct("keyword", "page")).alias("r")).select("cn", "r.*")
    return x.orderBy("cn").limit(cap) if cap is not None else x


def vector_scan(vectors: DataFrame, query: list[float], year: tuple = (None, None), kinds: tuple = ()) -> DataFrame:
    """id, distance of the vectors whose metadata fit: plain typed columns, so the predicates reach the scan."""
    from ..operators.filters import year_in_range
    from ..operators.vectors import cosine

    x = vectors.where(year_in_range(F.col("year"), *year))
    x = x.where(F.col("kind").isin(*kinds)) if kinds else x
    return x.select("id", (1 - cosine(F.col("v"), F.array(*[F.lit(float(q)) for q in query]))).alias("distance"))


def traverse(start: DataFrame, *hops: tuple[DataFrame, str, str]) -> DataFrame:
    """Nodes reached from start (node) by edge tables (edges, from column, to column), a join for each hop."""
    out = start.select("node")
    for edges, a, b in hops:
        out = out.join(edges.select(F.col(a).alias("node"), F.col(b).alias("__to")), "node").select(F.col("__to").alias("node")).distinct()
    return out
