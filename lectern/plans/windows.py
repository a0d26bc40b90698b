"""Queries of windows and of dates and times."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import oracle
from ..operators import dates as T
from ..operators import windows as W
from ..operators.vectors import query_similarity
from .catalog import query
from .vectors import SIM, query_vector


@query("win01_page_with_total", oracle("papers", "SELECT id, (SELECT count(*) FROM papers WHERE db_code = 'JAKO') AS total FROM papers WHERE db_code = 'JAKO' ORDER BY id LIMIT 20 OFFSET 40"))
def win01(spark, d):
    return W.with_total(A.papers(spark, d).where("db_code = 'JAKO'").select("id"), ["id"], 20, 40)


@query("win02_merge_dedupe", oracle("links", "SELECT k, paper_id, author_order FROM (SELECT rid % 500 AS k, paper_id, author_order, row_number() OVER (PARTITION BY rid % 500, paper_id ORDER BY CASE WHEN rid < 500 THEN 0 ELSE 1 END, rid) AS rn FROM links) WHERE rn = 1"))
def win02(spark, d):
    x = A.links(spark, d).withColumn("k", F.col("rid") % 500)
    return W.latest(x, ["k", "paper_id"], [F.when(F.col("rid") < 500, 0).otherwise(1), "rid"]).select("k", "paper_id", "author_order")


@query("win03_distinct_on", oracle("links", "SELECT paper_id, rid FROM (SELECT paper_id, rid, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN rid % 2 = 0 THEN rid END ASC NULLS LAST, rid) AS rn FROM links) WHERE rn = 1"))
def win03(spark, d):
    return W.latest(A.links(spark, d), ["paper_id"], [F.when(F.col("rid") % 2 == 0, F.col("rid")).asc_nulls_last(), F.col("rid").asc()]).select("paper_id", "rid")


@query("win04_rrf", oracle("vecs", f"""WITH a AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS r FROM ({SIM})), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents)
  SELECT id, round(coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b USING (id)"""))
def win04(spark, d):
    from ..operators.vectors import ranked

    v = A.vecs(spark, d)
    a = ranked(query_similarity(v.where("id <> 0"), query_vector(v, 0)).withColumn("sim", F.round("sim", 9)), "sim", v.count())
    docs = A.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    b = ranked(docs, "n_chars", docs.count())
    return W.rrf(a, b).select("id", F.round("score", 9).alias("score"))


@query("win05_latest_read", oracle("reads", "SELECT user_id, paper_id, event_id, view_count FROM (SELECT *, row_number() OVER (PARTITION BY user_id, paper_id ORDER BY read_at DESC, event_id DESC) AS rn FROM reads WHERE NOT deleted) WHERE rn = 1"))
def win05(spark, d):
    return W.latest(A.reads(spark, d).where("NOT deleted"), ["user_id", "paper_id"], [F.col("read_at").desc(), F.col("event_id").desc()]).select("user_id", "paper_id", "event_id", "view_count")


@query("win06_papers_by_year", oracle("links papers", "SELECT rid, pubyear, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY paper_id) AS ids FROM links JOIN papers ON id = paper_id GROUP BY 1, 2"))
def win06(spark, d):
    x = A.links(spark, d).join(A.papers(spark, d), F.col("paper_id") == F.col("id"))
    return x.groupBy("rid", "pubyear").agg(F.array_join(F.array_sort(F.collect_list("paper_id")), ",").alias("ids"))


@query("win07_even_spread", oracle("links", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY paper_id) - 1 AS i, count(*) OVER (PARTITION BY rid) AS n FROM links) SELECT rid, paper_id FROM x WHERE n <= 5 OR i IN (SELECT CAST(round_even(g * (n - 1) / 4.0, 0) AS INT) FROM (SELECT unnest([0, 1, 2, 3, 4]) AS g))"))
def win07(spark, d):
    return W.spread(A.links(spark, d), "rid", ["paper_id"], 5).select("rid", "paper_id")


@query("win08_relabel", oracle("papers", """WITH c AS (SELECT author AS g, id % 3 AS label, max(pubyear) AS y, max(id) AS last, count(*) AS n, min(id) AS first FROM papers GROUP BY 1, 2)
  SELECT g, label, row_number() OVER (PARTITION BY g ORDER BY y DESC NULLS LAST, last DESC, n DESC, first) - 1 AS rank FROM c"""))
def win08(spark, d):
    return W.relabel(A.papers(spark, d).select(F.col("author").alias("g"), (F.col("id") % 3).alias("label"), F.col("pubyear").alias("year"), F.col("id").alias("at")))


@query("win09_recent_department", oracle("papers", "SELECT author, journal_name FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY pubyear DESC NULLS LAST, CAST(pubmonth AS INT) DESC NULLS LAST, id) AS rn FROM papers) WHERE rn = 1"))
def win09(spark, d):
    m = F.col("pubmonth").cast("int")
    return A.papers(spark, d).groupBy("author").agg(F.max_by("journal_name", F.struct(F.coalesce("pubyear", F.lit(-1)), F.coalesce(m, F.lit(-1)), -F.col("id"))).alias("journal_name"))


@query("win10_canonical_pick", oracle("researchers", "SELECT name, rid FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY (rid % 3 = 0) DESC, dept, rank DESC, price, rid) AS rn FROM researchers) WHERE rn = 1"))
def win10(spark, d):
    from ..operators.identity import canonical_pick

    r = A.researchers(spark, d).select("name", "rid", (F.col("rid") % 3 == 0).alias("anchored"), F.col("dept").alias("source"), F.col("rank").alias("papers"), F.col("price").alias("created"))
    return canonical_pick(r, "name")


_KST = "(read_at + INTERVAL 9 HOUR)"


@query("dat01_period_range", f"WITH r AS (SELECT ts AS read_at FROM events) SELECT p, start, count(*) AS n FROM (SELECT 'day' AS p, date_trunc('day', {_KST}) - INTERVAL 9 HOUR AS start FROM r UNION ALL SELECT 'week', date_trunc('week', {_KST}) - INTERVAL 9 HOUR FROM r UNION ALL SELECT 'month', date_trunc('month', {_KST}) - INTERVAL 9 HOUR FROM r) GROUP BY 1, 2")
def dat01(spark, d):
    e = A.read(spark, d, "events")
    p = F.explode(F.create_map(*[x for k in ("day", "week", "month") for x in (F.lit(k), T.period_start(F.col("ts"), k))])).alias("p", "start")
    return e.select(p).groupBy("p", "start").agg(F.count("*").alias("n"))


@query("dat02_reads_by_day", oracle("reads", f"SELECT user_id, CAST({_KST} AS DATE) AS day, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY read_at DESC, event_id DESC) AS papers FROM reads WHERE NOT deleted GROUP BY 1, 2"))
def dat02(spark, d):
    x = A.reads(spark, d).where("NOT deleted").groupBy("user_id", T.local_day(F.col("read_at")).alias("day")).agg(F.sort_array(F.collect_list(F.struct("read_at", "event_id", "paper_id")), asc=False).alias("r"))
    return x.select("user_id", "day", F.array_join(F.transform("r", lambda z: z["paper_id"]), ",").alias("papers"))


@query("dat03_read_upsert", oracle("reads", f"SELECT user_id, paper_id, CAST({_KST} AS DATE) AS day, max(read_at) AS read_at, count(*) AS view_count FROM reads GROUP BY 1, 2, 3"))
def dat03(spark, d):
    return T.daily_reads(A.reads(spark, d))


@query("dat04_history_window", oracle("reads", "WITH m AS (SELECT user_id, max(read_at) AS last FROM reads WHERE NOT deleted GROUP BY 1) SELECT r.user_id, r.event_id FROM reads r JOIN m USING (user_id) WHERE NOT deleted AND read_at <= least(last, TIMESTAMP '2024-01-20') AND read_at >= least(last, TIMESTAMP '2024-01-20') - INTERVAL 14 DAY"))
def dat04(spark, d):
    return T.history(A.reads(spark, d).where("NOT deleted"), "2024-01-20 00:00:00", 14).select("user_id", "event_id")


@query("dat05_month_keys", "SELECT DISTINCT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE) AS reset FROM events")
def dat05(spark, d):
    t = F.col("ts")
    return A.read(spark, d, "events").select(F.date_format(t, "yyyy-MM").alias("month"), F.date_format(t, "yyyy-MM-dd").alias("day"), F.add_months(F.trunc(t, "month"), 1).alias("reset")).distinct()


@query("dat06_soft_delete", oracle("reads", "SELECT event_id, CASE WHEN user_id = 3 AND paper_id < 100 OR user_id = 5 THEN TIMESTAMP '2024-02-01' END AS deleted_at FROM reads"))
def dat06(spark, d):
    hit = ((F.col("user_id") == 3) & (F.col("paper_id") < 100)) | (F.col("user_id") == 5)
    return T.soft_delete(A.reads(spark, d), hit, "2024-02-01 00:00:00").select("event_id", "deleted_at")


