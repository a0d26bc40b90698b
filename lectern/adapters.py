"""Domain tables from the star-schema test tables: each adapter gives a DataFrame and, in CTES, the same rows in SQL.

Operators never mention the test tables; queries bind operators to them here. NULLs are planted by fixed rules on ids, so
that checks against SQL meet unknown years, citations and dates.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: name -> DuckDB SELECT
CTES: dict[str, str] = {}


def oracle(tables: str, body: str) -> str:
    """body with the named domain tables (and those they need) as CTEs before its own."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in CTES:
                if other != name and f" {other} " in CTES[name].replace("\n", " ") + " ":
                    need(other)
            order.append(name)

    for t in tables.split():
        need(t)
    ctes = ",\n".join(f"{t} AS MATERIALIZED ({CTES[t]})" for t in order)
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Tables of fewer bytes (in files) than this may lie in one row group, which one core alone would read.
LITTLE = 24 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A little table is dealt out to all cores; a larger one stays where it is, without a shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < LITTLE else df


CTES["papers"] = """SELECT o_orderkey AS id, 'Paper ' || (o_orderkey % 997) AS title,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS pubyear,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(month(o_orderdate) AS VARCHAR) END AS pubmonth,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y%m')
    WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y%m%d') END AS pubdate,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice / 10000) AS BIGINT) END AS citation_count,
  CASE o_orderstatus WHEN 'F' THEN 'JAKO' WHEN 'O' THEN 'DIKO' ELSE 'CFKO' END AS db_code,
  CASE WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN '국내박사' WHEN 1 THEN '국내석사' END END AS degree,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 25 AS INTEGER) END AS journal_id,
  'NATION_' || (o_custkey % 25) AS journal_name, o_custkey AS author, o_orderdate AS created FROM orders"""


def papers(spark, d) -> DataFrame:
    o, k, day = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    fmt = lambda p: F.date_format(day, p)
    return o.select(
        k.alias("id"), F.concat(F.lit("Paper "), k % 997).alias("title"), F.when(k % 11 != 0, F.year(day)).alias("pubyear"), F.when(k % 11 != 0, F.month(day).cast("string")).alias("pubmonth"),
        F.when(k % 17 == 0, None).when(k % 5 == 0, fmt("yyyy-MM-dd")).when(k % 5 == 1, fmt("yyyyMM")).when(k % 5 == 2, fmt("yyyy")).otherwise(fmt("yyyyMMdd")).alias("pubdate"),
        F.when(k % 13 != 0, F.floor(F.col("o_totalprice") / 10000).cast("long")).alias("citation_count"),
        F.when(F.col("o_orderstatus") == "F", "JAKO").when(F.col("o_orderstatus") == "O", "DIKO").otherwise("CFKO").alias("db_code"),
        F.when(F.col("o_orderstatus") == "O", F.when(k % 3 == 0, "국내박사").when(k % 3 == 1, "국내석사")).alias("degree"),
        F.when(k % 4 != 0, (F.col("o_custkey") % 25).cast("int")).alias("journal_id"), F.concat(F.lit("NATION_"), F.col("o_custkey") % 25).alias("journal_name"),
        F.col("o_custkey").alias("author"), day.alias("created"))


CTES["journals"] = """SELECT n_nationkey AS id, n_name AS title, lpad(CAST(10000000 + n_nationkey * 37 AS VARCHAR), 8, '0') AS issn,
  CASE WHEN n_nationkey % 2 = 0 THEN lpad(CAST(10000000 + (n_nationkey - n_nationkey % 4) * 37 AS VARCHAR), 8, '0') END AS e_issn,
  r_name IN ('ASIA', 'EUROPE') AS sci_indexed, CASE WHEN n_nationkey % 7 <> 0 THEN n_nationkey % 3 = 0 END AS kci_indexed,
  CASE WHEN n_nationkey % 5 <> 0 THEN 2020 + n_nationkey % 4 END AS sjr_year, CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey * 0.25 END AS sjr_score, n_nationkey % 9 AS h_index,
  CASE WHEN n_nationkey % 5 <> 0 THEN 'Q' || (n_nationkey % 5) END AS quartile, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 0.5 END AS if_value
  FROM nation JOIN region ON n_regionkey = r_regionkey"""


def journals(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    issn = lambda n: F.lpad((n * 37 + 10000000).cast("string"), 8, "0")
    return read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        k.alias("id"), F.col("n_name").alias("title"), issn(k).alias("issn"), F.when(k % 2 == 0, issn(k - k % 4)).alias("e_issn"), F.col("r_name").isin("ASIA", "EUROPE").alias("sci_indexed"),
        F.when(k % 7 != 0, k % 3 == 0).alias("kci_indexed"), F.when(k % 5 != 0, k % 4 + 2020).alias("sjr_year"), F.when(k % 6 != 0, k * 0.25).alias("sjr_score"), (k % 9).alias("h_index"),
        F.when(k % 5 != 0, F.concat(F.lit("Q"), k % 5)).alias("quartile"), F.when(k % 3 != 0, k * 0.5).alias("if_value"))


CTES["researchers"] = "SELECT p_partkey AS rid, p_name AS name, p_brand AS institution, p_type AS dept, p_size AS rank, p_retailprice AS price FROM part"


def researchers(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("name"), F.col("p_brand").alias("institution"), F.col("p_type").alias("dept"), F.col("p_size").alias("rank"), F.col("p_retailprice").alias("price"))


CTES["links"] = "SELECT l_partkey AS rid, l_orderkey AS paper_id, min(l_linenumber) AS author_order FROM lineitem GROUP BY 1, 2"
CTES["ext_links"] = "SELECT l_partkey AS rid, l_orderkey AS paper_id, min(l_linenumber) AS author_order FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2"


def links(spark, d, external: bool = False) -> DataFrame:
    li = read(spark, d, "lineitem")
    li = li.where("l_returnflag = 'R'") if external else li
    return li.groupBy(F.col("l_partkey").alias("rid"), F.col("l_orderkey").alias("paper_id")).agg(F.min("l_linenumber").alias("author_order"))


CTES["keywords"] = "SELECT l_orderkey AS paper_id, p_name AS name, min(l_linenumber) AS pos, CASE WHEN min(p_partkey) % 2 = 0 THEN 'ko' ELSE 'en' END AS lang FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


def keywords(spark, d) -> DataFrame:
    """Keyword names of papers, with their place: 64 keys."""
    return read(spark, d, "lineitem").join(read(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_orderkey").alias("paper_id"), F.col("p_name").alias("name")).agg(F.min("l_linenumber").alias("pos"), F.when(F.min("p_partkey") % 2 == 0, "ko").otherwise("en").alias("lang"))


CTES["cites"] = "SELECT src, dst FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL"


def cites(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst")).where("dst IS NOT NULL")


CTES["reads"] = "SELECT event_id, user_id, event_id % 200 AS paper_id, ts AS read_at, CAST(1 + event_id % 3 AS BIGINT) AS view_count, event_id % 29 = 0 AS deleted FROM events WHERE event_type = 'view'"


def reads(spark, d) -> DataFrame:
    e = F.col("event_id")
    return read(spark, d, "events").where("event_type = 'view'").select("event_id", "user_id", (e % 200).alias("paper_id"), F.col("ts").alias("read_at"), (e % 3 + 1).alias("view_count"), (e % 29 == 0).alias("deleted"))


CTES["bookmarks"] = "SELECT event_id AS id, user_id, event_id % 200 AS paper_id, event_id % 7 AS folder_id, ts AS created FROM events WHERE event_type = 'purchase'"


def bookmarks(spark, d) -> DataFrame:
    e = F.col("event_id")
    return read(spark, d, "events").where("event_type = 'purchase'").select(e.alias("id"), "user_id", (e % 200).alias("paper_id"), (e % 7).alias("folder_id"), F.col("ts").alias("created"))


CTES["docs"] = "SELECT doc_id, text, lang, source FROM documents"
CTES["vecs"] = "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings"


def docs(spark, d) -> DataFrame:
    return dealt(read(spark, d, "documents")).select("doc_id", "text", "lang", "source")


def vecs(spark, d) -> DataFrame:
    """Vectors as doubles, so that sums agree whatever the engine."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


CTES["related"] = """SELECT k1, k2, count(*) AS n FROM (SELECT a.name AS k1, b.name AS k2 FROM keywords a JOIN keywords b ON a.paper_id = b.paper_id AND a.name < b.name) GROUP BY 1, 2"""


def related(spark, d) -> DataFrame:
    from .operators.aggregations import cooccurrence

    return cooccurrence(keywords(spark, d)).select("k1", "k2", "n")


CTES["key_counts"] = "SELECT name, count(*) AS papers FROM keywords GROUP BY 1"


def key_counts(spark, d) -> DataFrame:
    return keywords(spark, d).groupBy("name").agg(F.count("*").alias("papers"))
