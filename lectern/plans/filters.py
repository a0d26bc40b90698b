"""Queries of filters and predicates."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import oracle
from ..operators import filters as P
from ..operators.vectors import query_similarity
from .catalog import query
from .vectors import SIM, query_vector


@query("flt02_year_in_range", oracle("papers", "SELECT id FROM papers WHERE pubyear >= 1996 AND pubyear <= 1999"))
def flt02(spark, d):
    return A.papers(spark, d).where(P.year_in_range(F.col("pubyear"), *P.year_range(None, 1999, 1996))).select("id")


@query("flt03_year_bounds", oracle("papers", "SELECT min(pubyear) AS lo, max(pubyear) AS hi FROM papers WHERE db_code = 'JAKO'"))
def flt03(spark, d):
    return A.papers(spark, d).where("db_code = 'JAKO'").agg(F.min("pubyear").alias("lo"), F.max("pubyear").alias("hi"))


@query("flt04_list_filter", oracle("papers", "SELECT id FROM papers WHERE pubyear BETWEEN 1996 AND 2000 AND db_code IN ('JAKO', 'JAFO')"))
def flt04(spark, d):
    return P.list_filter(A.papers(spark, d), year=(1996, 2000), kind="journal", kci=True, sci=False).select("id")


@query("flt04_citation_index", oracle("papers", "SELECT id FROM (SELECT *, CASE id % 5 WHEN 0 THEN 'SCIE' WHEN 1 THEN 'SSCI' WHEN 2 THEN 'AHCI' WHEN 3 THEN 'SCI' ELSE db_code END AS code FROM papers) WHERE pubyear >= 1994 AND code IN ('SCIE', 'SSCI', 'AHCI')"))
def flt04_index(spark, d):
    """sci is true: SCIE, SSCI and AHCI alone. Codes go by id, as the test papers have none of these."""
    k = F.col("id") % 5
    code = F.when(k == 0, "SCIE").when(k == 1, "SSCI").when(k == 2, "AHCI").when(k == 3, "SCI").otherwise(F.col("db_code"))
    return P.list_filter(A.papers(spark, d).withColumn("db_code", code), year=(1994, None), sci=True).select("id")


@query("flt05_type_postfilter", oracle("papers", "SELECT id FROM papers WHERE db_code = 'DIKO' AND contains(degree, '박사')"))
def flt05(spark, d):
    return P.type_postfilter(A.papers(spark, d), "thesis_phd").select("id")


@query("flt06_researcher_paper_filter", oracle("links ext_links papers", "SELECT l.rid, l.paper_id FROM links l JOIN papers p ON p.id = l.paper_id LEFT JOIN ext_links e ON e.rid = l.rid AND e.paper_id = l.paper_id WHERE pubyear >= 1997 AND (e.rid IS NOT NULL OR db_code = 'JAKO') = false"))
def flt06(spark, d):
    e = A.links(spark, d, True).select("rid", "paper_id", F.lit("ART").alias("external_id"))
    x = A.links(spark, d).join(A.papers(spark, d), F.col("paper_id") == F.col("id")).join(e, ["rid", "paper_id"], "left")
    return P.researcher_filter(x, year=(1997, None), kci=False).select("rid", "paper_id")


@query("flt07_relevance_floor", oracle("vecs", f"SELECT id FROM (SELECT *, max(sim) OVER () AS top FROM ({SIM})) WHERE sim >= 0.7 * top"))
def flt07(spark, d):
    v = A.vecs(spark, d)
    return P.relevance_floor(query_similarity(v.where("id <> 0"), query_vector(v, 0)).withColumn("sim", F.round("sim", 9)), 0.7).select("id")


@query("flt08_distance_cut", oracle("vecs", f"SELECT id, round(1 - sim, 6) AS dist FROM (SELECT *, min(1 - sim) OVER () AS m FROM ({SIM})) WHERE 1 - sim <= 0.75 AND 1 - sim <= m + 0.05 ORDER BY 1 - sim, id LIMIT 10"))
def flt08(spark, d):
    v = A.vecs(spark, d)
    x = query_similarity(v.where("id <> 0"), query_vector(v, 0)).select("id", (1 - F.round("sim", 9)).alias("dist"))
    return P.distance_cut(x, 0.75, 0.05, 10).select("id", F.round("dist", 6).alias("dist"))


@query("flt09_similarity_floor", oracle("vecs", f"SELECT id FROM ({SIM}) WHERE sim >= 0.2"))
def flt09(spark, d):
    v = A.vecs(spark, d)
    return query_similarity(v.where("id <> 0"), query_vector(v, 0)).where(F.round("sim", 9) >= 0.2).select("id")


@query("flt10_usable_anchor", "SELECT doc_id FROM documents WHERE length(text) <= 120 AND len(string_split_regex(trim(text), '[ \\n\\t\\r]+')) <= 8")
def flt10(spark, d):
    return A.docs(spark, d).where(P.usable_anchor(F.col("text"))).select("doc_id")


@query("flt11_displayable", oracle("cites papers", "SELECT src, dst FROM cites LEFT JOIN (SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN title ELSE '한글 ' || title END AS t FROM papers) ON id = dst WHERE 'ART' || dst LIKE 'ART1%' OR (t IS NOT NULL AND NOT regexp_matches(t, '[가-힣]'))"))
def flt11(spark, d):
    t = F.when(F.col("id") % 3 == 1, F.col("title")).when(F.col("id") % 3 == 2, F.concat(F.lit("한글 "), F.col("title")))
    x = A.cites(spark, d).join(A.papers(spark, d).select("id", t.alias("t")), F.col("dst") == F.col("id"), "left")
    return x.where(P.displayable(F.concat(F.lit("ART"), F.col("dst")), F.col("t"), "ART1%")).select("src", "dst")


@query("flt12_valid_record", oracle("papers keywords", "SELECT id FROM papers WHERE pubdate IS NOT NULL AND (db_code = 'CFKO' OR EXISTS (SELECT 1 FROM keywords WHERE paper_id = id))"))
def flt12(spark, d):
    k = A.keywords(spark, d).groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("n"))
    return A.papers(spark, d).join(k, "id", "left").where(P.valid_record(F.col("pubdate"), F.col("n"), F.col("db_code"))).select("id")


@query("flt13_clean_keyword", r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \n]+')) AS raw FROM documents), v AS (SELECT raw, trim(regexp_replace(trim(raw), '^[.,;·]+|[.,;·]+$', '', 'g')) AS v FROM w)
  SELECT raw, v AS keyword FROM v WHERE length(v) BETWEEN 1 AND 60 AND regexp_matches(v, '[0-9A-Za-z가-힣]')""")
def flt13(spark, d):
    from ..operators.text import clean_keyword

    w = A.docs(spark, d).select(F.explode(F.split("text", "[ \\n]+")).alias("raw")).distinct()
    return w.select("raw", clean_keyword(F.col("raw")).alias("keyword")).where("keyword IS NOT NULL")


@query("flt14_person_name", oracle("researchers", "SELECT rid FROM (SELECT rid, CASE rid % 4 WHEN 0 THEN '김가람' WHEN 1 THEN '한국대학교' WHEN 2 THEN 'Kim' ELSE '가' END AS n FROM researchers) WHERE regexp_matches(n, '^[가-힣]{2,6}$') AND NOT regexp_matches(n, '대학|연구|학회')"))
def flt14(spark, d):
    from ..operators.text import person_name

    r = F.col("rid") % 4
    n = F.when(r == 0, "김가람").when(r == 1, "한국대학교").when(r == 2, "Kim").otherwise("가")
    return A.researchers(spark, d).where(person_name(n, "대학|연구|학회")).select("rid")


@query("flt15_candidate", oracle("papers keywords docs", "SELECT id FROM papers JOIN docs ON doc_id = id WHERE db_code = 'JAKO' AND length(text) >= 200 AND pubyear >= 1997 AND (SELECT count(*) FROM keywords WHERE paper_id = id) >= 3"))
def flt15(spark, d):
    k = A.keywords(spark, d).groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 3")
    p = A.papers(spark, d).where("db_code = 'JAKO' AND pubyear >= 1997")
    t = A.docs(spark, d).where(F.length("text") >= 200).select(F.col("doc_id").alias("id"))
    return p.join(t, "id", "left_semi").join(k, "id", "left_semi").select("id")


@query("flt16_bookmark_search", oracle("bookmarks papers keywords journals", """WITH k AS (SELECT paper_id, string_agg(name, ',' ORDER BY name) AS kw FROM keywords GROUP BY 1)
  SELECT b.id FROM bookmarks b JOIN papers p ON p.id = b.paper_id LEFT JOIN k ON k.paper_id = p.id LEFT JOIN journals j ON j.id = p.journal_id
  WHERE (p.title ILIKE '%paper 1%' OR kw ILIKE '%BOLT%') AND p.pubyear >= 1996 AND p.pubyear < 2000 AND p.db_code IN ('JAKO', 'DIKO') AND (j.sci_indexed IS NULL OR NOT j.sci_indexed)"""))
def flt16(spark, d):
    k = A.keywords(spark, d).groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("kw"))
    p = A.papers(spark, d).join(A.journals(spark, d).select(F.col("id").alias("jid"), "sci_indexed"), F.col("journal_id") == F.col("jid"), "left").withColumnRenamed("id", "pid")
    x = A.bookmarks(spark, d).join(p, F.col("paper_id") == F.col("pid")).join(k, "paper_id", "left")
    return P.bookmark_search(x, "paper 1", "BOLT", ("JAKO", "DIKO"), (1996, 2000), sci=False).select("id")


@query("flt17_is_bookmarked", oracle("papers bookmarks", "SELECT id, id IN (SELECT paper_id FROM bookmarks WHERE user_id = 3) AS bookmarked FROM papers"))
def flt17(spark, d):
    b = A.bookmarks(spark, d).where("user_id = 3").select(F.col("paper_id").alias("id"), F.lit(True).alias("b")).distinct()
    return A.papers(spark, d).select("id").join(b, "id", "left").select("id", F.coalesce("b", F.lit(False)).alias("bookmarked"))


@query("flt18_chip_gate", oracle("keywords", "SELECT name, count(*) AS n, count(*) > 4 AS narrow, count(*) >= 10 AS broad FROM keywords GROUP BY 1"))
def flt18(spark, d):
    n = F.count("*")
    return A.keywords(spark, d).groupBy("name").agg(n.alias("n"), (n > 4).alias("narrow"), (n >= 10).alias("broad"))


# Sorts, limits, paging


@query("srt01_result_sort", oracle("papers", "SELECT mode, id FROM (SELECT 'year_asc' AS mode, id, row_number() OVER (ORDER BY pubyear ASC NULLS LAST, id) AS rn FROM papers UNION ALL SELECT 'year_desc', id, row_number() OVER (ORDER BY pubyear DESC NULLS LAST, id) FROM papers UNION ALL SELECT 'citation', id, row_number() OVER (ORDER BY coalesce(citation_count, 0) DESC, id) FROM papers UNION ALL SELECT 'relevance', id, row_number() OVER (ORDER BY id) FROM papers) WHERE rn <= 20"))
def srt01(spark, d):
    out = None
    for mode in ("year_asc", "year_desc", "citation", "relevance"):
        x = A.papers(spark, d).orderBy(*P.result_order(mode, "id")).limit(20).select(F.lit(mode).alias("mode"), "id")
        out = x if out is None else out.union(x)
    return out


@query("srt02_list_sort", oracle("papers", "SELECT id, coalesce(pubyear, 0) AS y FROM papers ORDER BY y, id LIMIT 50"))
def srt02(spark, d):
    return A.papers(spark, d).select("id", F.coalesce("pubyear", F.lit(0)).alias("y")).orderBy("y", "id").limit(50)


@query("srt02_list_sort_whole", oracle("papers", "SELECT id, coalesce(pubyear, 0) AS y, row_number() OVER (ORDER BY coalesce(pubyear, 0), id) AS rn FROM papers"))
def srt02_whole(spark, d):
    return P.list_sorted(A.papers(spark, d), "oldest").select("id", F.coalesce("pubyear", F.lit(0)).alias("y"), "rn")


@query("srt03_researcher_sort", oracle("links papers", "SELECT rid, paper_id, rn FROM (SELECT rid, paper_id, row_number() OVER (PARTITION BY rid ORDER BY coalesce(pubyear, 0) DESC, coalesce(TRY_CAST(pubmonth AS INT), 0) DESC, title DESC, paper_id) AS rn FROM links JOIN papers ON id = paper_id) WHERE rn <= 3"))
def srt03(spark, d):
    x = A.links(spark, d).join(A.papers(spark, d), F.col("paper_id") == F.col("id"))
    w = Window.partitionBy("rid").orderBy(*P.researcher_order("recent"), "paper_id")
    return x.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("rid", "paper_id", "rn")


@query("srt04_sort_downgrade", oracle("links papers", """WITH x AS (SELECT rid, paper_id, pubyear, citation_count, count(*) FILTER (citation_count > 45) OVER (PARTITION BY rid) >= 3 AS ok FROM links JOIN papers ON id = paper_id)
  SELECT rid, paper_id, ok FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN ok THEN coalesce(citation_count, -1) ELSE 0 END DESC, coalesce(pubyear, 0) DESC, paper_id) AS rn FROM x) WHERE rn = 1"""))
def srt04(spark, d):
    x = A.links(spark, d).join(A.papers(spark, d), F.col("paper_id") == F.col("id"))
    return P.downgraded(x, "rid", F.col("citation_count") > 45, 3).where("rn = 1").select("rid", "paper_id", "ok")


@query("srt04_sort_downgrade_whole", oracle("links papers", """WITH x AS (SELECT rid, paper_id, pubyear, citation_count, count(*) FILTER (citation_count > 45) OVER (PARTITION BY rid) >= 3 AS ok FROM links JOIN papers ON id = paper_id)
  SELECT rid, paper_id, ok, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN ok THEN coalesce(citation_count, -1) ELSE 0 END DESC, coalesce(pubyear, 0) DESC, paper_id) AS rn FROM x"""))
def srt04_whole(spark, d):
    x = A.links(spark, d).join(A.papers(spark, d), F.col("paper_id") == F.col("id"))
    return P.downgraded(x, "rid", F.col("citation_count") > 45, 3).select("rid", "paper_id", "ok", "rn")


@query("srt05_name_search", oracle("researchers links", """WITH n AS (SELECT rid, count(*) AS papers FROM links GROUP BY 1), x AS (SELECT r.rid, r.name, CASE WHEN name = 'red bolt' THEN 3 WHEN starts_with(name, 'red') THEN 2 END AS s, n.papers FROM researchers r LEFT JOIN n USING (rid) WHERE name = 'red bolt' OR starts_with(name, 'red'))
  SELECT rid, name, papers, (SELECT count(*) FROM x) AS total FROM x ORDER BY s DESC, papers DESC NULLS LAST, rid LIMIT 20 OFFSET 10"""))
def srt05(spark, d):
    from ..operators.windows import prefix_score, with_total

    n = A.links(spark, d).groupBy("rid").agg(F.count("*").alias("papers"))
    x = A.researchers(spark, d).where(F.col("name").startswith("red")).join(n, "rid", "left").select("rid", "name", "papers")
    s = F.when(F.col("name") == "red bolt", 3).otherwise(prefix_score(F.col("name"), "red"))
    return with_total(x, [s.desc(), F.col("papers").desc_nulls_last(), "rid"], 20, 10)


@query("srt06_affinity_rank", oracle("researchers vecs", "SELECT rid, round(coalesce(a, 0), 4) AS affinity FROM researchers LEFT JOIN (SELECT id, round(list_dot_product(v, (SELECT v FROM vecs WHERE id = 0)), 4) AS a FROM vecs) ON id = rid ORDER BY coalesce(a, -1) DESC, rank DESC, rid LIMIT 30"))
def srt06(spark, d):
    from ..operators.vectors import dot

    v = A.vecs(spark, d)
    q = F.array(*[F.lit(x) for x in query_vector(v, 0)])
    a = v.select(F.col("id").alias("rid"), F.round(dot(F.col("v"), q), 4).alias("a"))
    return A.researchers(spark, d).join(a, "rid", "left").orderBy(F.coalesce("a", F.lit(-1.0)).desc(), F.col("rank").desc(), "rid").limit(30).select("rid", F.coalesce("a", F.lit(0.0)).alias("affinity"))


@query("srt07_bookmark_order", oracle("bookmarks papers", "SELECT b.id FROM bookmarks b JOIN papers p ON p.id = b.paper_id ORDER BY CASE WHEN lower(p.title) = 'paper 1' THEN 0 WHEN starts_with(lower(p.title), 'paper 1') THEN 1 ELSE 2 END, pubyear ASC NULLS FIRST, b.id LIMIT 100"))
def srt07(spark, d):
    x = A.bookmarks(spark, d).join(A.papers(spark, d).select(F.col("id").alias("pid"), F.lower("title").alias("t"), "pubyear"), F.col("paper_id") == F.col("pid"))
    return x.orderBy(F.when(F.col("t") == "paper 1", 0).when(F.col("t").startswith("paper 1"), 1).otherwise(2), F.col("pubyear").asc_nulls_first(), "id").limit(100).select("id")


@query("srt08_quota", oracle("papers", "SELECT id, db_code FROM (SELECT *, row_number() OVER (PARTITION BY db_code ORDER BY coalesce(citation_count, 0) DESC, coalesce(pubyear, 0) DESC, id) AS rn FROM papers) WHERE rn <= CASE db_code WHEN 'JAKO' THEN 60 WHEN 'DIKO' THEN 15 ELSE 0 END"))
def srt08(spark, d):
    from ..operators.windows import quota

    return quota(A.papers(spark, d), {"JAKO": 60, "DIKO": 15}, "db_code", [F.coalesce("citation_count", F.lit(0)).desc(), F.coalesce("pubyear", F.lit(0)).desc(), "id"]).select("id", "db_code")


@query("srt11_external_refs", oracle("cites papers", "SELECT src, dst, rn FROM (SELECT src, dst, row_number() OVER (PARTITION BY src % 50 ORDER BY CASE WHEN db_code = 'JAKO' THEN 0 ELSE 1 END, pubyear DESC NULLS LAST, title, dst, src) AS rn FROM cites JOIN papers ON id = dst WHERE dst % 7 <> 0) WHERE rn <= 6"))
def srt11(spark, d):
    x = A.cites(spark, d).where("dst % 7 <> 0").join(A.papers(spark, d), F.col("dst") == F.col("id")).withColumn("g", F.col("src") % 50)
    w = Window.partitionBy("g").orderBy(F.when(F.col("db_code") == "JAKO", 0).otherwise(1), F.col("pubyear").desc_nulls_last(), "title", "dst", "src")
    return x.withColumn("rn", F.row_number().over(w)).where("rn <= 6").select("src", "dst", "rn")


@query("srt12_bounded_recent", oracle("reads", "SELECT user_id, paper_id, read_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY read_at DESC, event_id DESC) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, paper_id ORDER BY read_at DESC, event_id DESC) AS r1 FROM reads) WHERE r1 = 1) WHERE r2 <= 6"))
def srt12(spark, d):
    from ..operators.windows import bounded_recent

    return bounded_recent(A.reads(spark, d), "user_id", "paper_id", [F.col("read_at").desc(), F.col("event_id").desc()], 6).select("user_id", "paper_id", "read_at")


@query("srt13_corpus_fill", oracle("papers cites", "WITH c AS (SELECT dst, count(*) AS n FROM cites GROUP BY 1), need AS (SELECT 6000 - count(*) AS k FROM papers WHERE db_code = 'JAKO') SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id % 97 DESC, coalesce(n, 0) DESC, id) AS rn FROM papers LEFT JOIN c ON dst = id WHERE db_code <> 'JAKO' AND NOT regexp_matches(title, '[13]$')) WHERE rn <= (SELECT k FROM need)"))
def srt13(spark, d):
    p, c = A.papers(spark, d), A.cites(spark, d).groupBy("dst").agg(F.count("*").alias("n"))
    need = max(0, 6000 - p.where("db_code = 'JAKO'").count())
    x = p.where((F.col("db_code") != "JAKO") & ~F.col("title").rlike("[13]$")).join(c, F.col("id") == F.col("dst"), "left")
    return x.orderBy((F.col("id") % 97).desc(), F.coalesce("n", F.lit(0)).desc(), "id").limit(need).select("id")
