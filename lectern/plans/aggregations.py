"""Queries of aggregations."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import oracle
from ..operators import aggregations as G
from .catalog import query

_TRANSL = (("blue bolt", "red bolt"), ("hot gear", "old bolt"))
_PAIRS = """SELECT a.name AS k1, b.name AS k2, min(least(a.lang, b.lang) || '-' || greatest(a.lang, b.lang)) AS lang_pair, count(*) AS n FROM keywords a JOIN keywords b ON a.paper_id = b.paper_id AND a.name < b.name GROUP BY 1, 2"""


@query("agg01_cooccurrence", oracle("keywords", f"SELECT * FROM ({_PAIRS}) WHERE (k1, k2) NOT IN (('blue bolt', 'red bolt'), ('hot gear', 'old bolt'))"))
def agg01(spark, d):
    return G.cooccurrence(A.keywords(spark, d), spark.createDataFrame(_TRANSL, "k1 string, k2 string"))


@query("agg02_subtract_pairs", oracle("keywords", f"""WITH a AS ({_PAIRS}), g AS ({_PAIRS.replace('WHERE', '').replace('GROUP BY', 'WHERE a.paper_id % 3 = 0 GROUP BY')}) SELECT k1, k2, a.n - coalesce(g.n, 0) AS n FROM a LEFT JOIN g USING (k1, k2) WHERE a.n - coalesce(g.n, 0) > 0"""))
def agg02(spark, d):
    k = A.keywords(spark, d)
    return G.subtract_counts(G.cooccurrence(k).select("k1", "k2", "n"), G.cooccurrence(k.where("paper_id % 3 = 0")))


_TERMS = ("blue bolt", "hot gear", "small ring")
_FS = f"""h AS (SELECT paper_id, name FROM keywords WHERE name IN {_TERMS}), r AS (SELECT rid, paper_id, false AS ext FROM links UNION ALL SELECT rid, paper_id, true FROM ext_links),
  fs AS (SELECT rid, count(DISTINCT name) AS kw_matches, count(DISTINCT paper_id) FILTER (NOT ext) AS internal, count(DISTINCT paper_id) FILTER (ext) AS external, array_to_string(list_sort(list_distinct(list(name))), '|') AS matched FROM r JOIN h USING (paper_id) GROUP BY 1)"""


@query("agg03_field_search", oracle("keywords links ext_links", f"WITH {_FS} SELECT * FROM fs"))
def agg03(spark, d):
    return G.field_search(A.links(spark, d), A.links(spark, d, True), A.keywords(spark, d), list(_TERMS))


@query("agg04_relevance", oracle("keywords links ext_links papers", f"""WITH {_FS}, c AS (SELECT rid, sum(citation_count) AS cites FROM links JOIN papers ON id = paper_id GROUP BY 1)
  SELECT rid, round(10 * kw_matches + internal + external + least(coalesce(cites, 0), 1000) / 1000, 6) AS score FROM fs LEFT JOIN c USING (rid)"""))
def agg04(spark, d):
    fs = G.field_search(A.links(spark, d), A.links(spark, d, True), A.keywords(spark, d), list(_TERMS))
    c = A.links(spark, d).join(A.papers(spark, d), F.col("paper_id") == F.col("id")).groupBy("rid").agg(F.sum("citation_count").alias("cites"))
    return fs.join(c, "rid", "left").select("rid", F.round(G.relevance(F.col("kw_matches"), F.col("internal"), F.col("external"), F.coalesce("cites", F.lit(0))), 6).alias("score"))


@query("agg05_folder_stats", oracle("bookmarks keywords", """WITH b AS (SELECT * FROM bookmarks), k AS (SELECT user_id, folder_id, name, count(*) AS n, min(b.id * 1000 + pos) AS seen FROM b JOIN keywords USING (paper_id) GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY user_id, folder_id ORDER BY n DESC, seen, name) AS rn FROM k), s AS (SELECT user_id, folder_id, string_agg(name, '|' ORDER BY rn) AS top FROM t WHERE rn <= 2 GROUP BY ALL)
  SELECT user_id, folder_id, n, last, top FROM (SELECT user_id, folder_id, count(*) AS n, max(created) AS last FROM b GROUP BY ALL) LEFT JOIN s USING (user_id, folder_id)"""))
def agg05(spark, d):
    b = A.bookmarks(spark, d)
    k = b.join(A.keywords(spark, d), "paper_id").select(F.struct("user_id", "folder_id").alias("g"), "name", (F.col("id") * 1000 + F.col("pos")).alias("at"))
    top = G.top_keywords(k, "g", 2).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("t")).select("g.*", F.array_join(F.transform("t", lambda x: x["name"]), "|").alias("top"))
    return b.groupBy("user_id", "folder_id").agg(F.count("*").alias("n"), F.max("created").alias("last")).join(top, ["user_id", "folder_id"], "left")


@query("agg06_reading_stats", oracle("reads keywords", """WITH r AS (SELECT * FROM reads WHERE NOT deleted), k AS (SELECT user_id, name, count(*) AS n, min(event_id * 1000 + pos) AS seen FROM r JOIN keywords USING (paper_id) GROUP BY ALL),
  t AS (SELECT user_id, name, count(*) OVER (PARTITION BY user_id) AS distinct_keywords, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen, name) AS rn FROM k)
  SELECT user_id, reads, distinct_keywords, name AS top_keyword FROM (SELECT user_id, count(*) AS reads FROM r GROUP BY 1) LEFT JOIN (SELECT * FROM t WHERE rn = 1) USING (user_id)"""))
def agg06(spark, d):
    r = A.reads(spark, d).where("NOT deleted")
    k = r.join(A.keywords(spark, d), "paper_id").groupBy("user_id", "name").agg(F.count("*").alias("n"), F.min(F.col("event_id") * 1000 + F.col("pos")).alias("at"))
    k = k.groupBy("user_id").agg(F.count("*").alias("distinct_keywords"), F.min_by("name", F.struct(-F.col("n"), "at", "name")).alias("top_keyword"))
    return r.groupBy("user_id").agg(F.count("*").alias("reads")).join(k, "user_id", "left")


@query("agg07_history_keywords", oracle("reads keywords", """SELECT user_id, name, sum(w) AS score, max(read_at) AS latest FROM (SELECT DISTINCT event_id, user_id, name, greatest(view_count, 1) AS w, read_at FROM reads JOIN keywords USING (paper_id) WHERE NOT deleted) GROUP BY 1, 2"""))
def agg07(spark, d):
    x = A.reads(spark, d).where("NOT deleted").join(A.keywords(spark, d), "paper_id").dropDuplicates(["event_id", "name"])
    return x.groupBy("user_id", "name").agg(F.sum(F.greatest("view_count", F.lit(1))).alias("score"), F.max("read_at").alias("latest"))


@query("agg08_top_result_keywords", oracle("papers keywords", """WITH t AS (SELECT id, row_number() OVER (ORDER BY citation_count DESC NULLS LAST, id) AS i FROM papers QUALIFY i <= 10)
  SELECT name, count(*) AS n, min(i) AS first FROM t JOIN keywords ON paper_id = id GROUP BY 1 ORDER BY n DESC, first, name LIMIT 5"""))
def agg08(spark, d):
    top = A.papers(spark, d).orderBy(F.col("citation_count").desc_nulls_last(), "id").limit(10)
    top = top.withColumn("i", F.row_number().over(Window.orderBy(F.col("citation_count").desc_nulls_last(), "id")))
    x = A.keywords(spark, d).join(F.broadcast(top.select("id", "i")), F.col("paper_id") == F.col("id"))
    return x.groupBy("name").agg(F.count("*").alias("n"), F.min("i").alias("first")).orderBy(F.col("n").desc(), "first", "name").limit(5)


@query("agg09_expand_chips", oracle("related", f"""WITH s AS (SELECT unnest({list(_TERMS)}) AS k), e AS (SELECT k1 AS a, k2 AS b, n FROM related UNION ALL SELECT k2, k1, n FROM related)
  SELECT b AS name, CAST(sum(n) AS BIGINT) AS n FROM e JOIN s ON a = k WHERE b NOT IN (SELECT k FROM s) GROUP BY 1 ORDER BY n DESC, name LIMIT 3"""))
def agg09(spark, d):
    r = A.related(spark, d)
    e = r.select(F.col("k1").alias("a"), F.col("k2").alias("b"), "n").union(r.select("k2", "k1", "n"))
    return e.where(F.col("a").isin(*_TERMS) & ~F.col("b").isin(*_TERMS)).groupBy(F.col("b").alias("name")).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "name").limit(3)


@query("agg10_type_histogram", oracle("papers", "SELECT db_code, count(*) AS n FROM papers GROUP BY 1"))
def agg10(spark, d):
    return A.papers(spark, d).groupBy("db_code").agg(F.count("*").alias("n"))


_ENT = "SELECT g, CASE WHEN count(*) > 1 THEN round(-sum(n / t * log2(n / t)) / log2(count(*)), 6) ELSE 0 END AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY g) AS t FROM c) GROUP BY g"


@query("agg11_entropy", oracle("papers", f"WITH c AS (SELECT journal_name AS g, pubyear, count(*) AS n FROM papers WHERE pubyear IS NOT NULL GROUP BY 1, 2) {_ENT}"))
def agg11(spark, d):
    c = A.papers(spark, d).where("pubyear IS NOT NULL").groupBy(F.col("journal_name").alias("g"), "pubyear").agg(F.count("*").alias("n"))
    return G.entropy(c, "g", "n")


@query("agg12_narrow_chips", oracle("papers", f"""WITH c AS (SELECT 'year' AS g, CAST(pubyear AS VARCHAR) AS v, count(*) AS n FROM papers WHERE pubyear IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'type', db_code, count(*) FROM papers GROUP BY 1, 2
  UNION ALL SELECT 'citations', CASE WHEN coalesce(citation_count, 0) >= 30 THEN '30' WHEN coalesce(citation_count, 0) >= 10 THEN '10' ELSE '0' END, count(*) FROM papers GROUP BY 1, 2), e AS ({_ENT}), m AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY n DESC, v) AS rn FROM c)
  SELECT g AS axis, v AS value, entropy FROM e JOIN m USING (g) WHERE rn = 1 AND entropy >= 0.7"""))
def agg12(spark, d):
    p, c = A.papers(spark, d), F.coalesce("citation_count", F.lit(0))
    axes = {"year": F.col("pubyear").cast("string"), "type": F.col("db_code"), "citations": F.when(c >= 30, "30").when(c >= 10, "10").otherwise("0")}
    x = p.select(F.explode(F.create_map(*[y for k, v in axes.items() for y in (F.lit(k), v)])).alias("g", "v")).where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("n"))
    best = x.groupBy("g").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("value"))
    return G.entropy(x, "g", "n").where("entropy >= 0.7").join(best, "g").select(F.col("g").alias("axis"), "value", "entropy")


_CHIP = """CASE WHEN count(*) > 1 THEN round((log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)), 6) END"""


@query("agg12_narrow_chips_by_list", oracle("reads papers", f"""WITH it AS (SELECT user_id AS g, event_id AS seq, pubyear, citation_count AS c, db_code FROM reads JOIN papers ON paper_id = id),
  v AS (SELECT g, 'year' AS axis, CAST(pubyear AS VARCHAR) AS v, count(*) AS n, min(seq) AS f FROM it WHERE pubyear IS NOT NULL GROUP BY ALL UNION ALL SELECT g, 'paper_type', db_code, count(*), min(seq) FROM it WHERE db_code <> '' GROUP BY ALL),
  ls AS (SELECT g, list(c ORDER BY c) AS l FROM it WHERE c IS NOT NULL GROUP BY 1), e AS (SELECT g, list_distinct([l[least(CAST(floor(len(l) / 3) AS INT), len(l) - 1) + 1], l[least(CAST(floor(len(l) * 2 / 3) AS INT), len(l) - 1) + 1]]) AS e FROM ls),
  b AS (SELECT g, len(list_filter(e, lambda x: x <= c)) AS bin, list_max(e) AS top, count(*) AS n FROM it JOIN e USING (g) WHERE c IS NOT NULL GROUP BY ALL),
  s AS (SELECT g, axis, arg_min(v, (-n, f)) AS value, {_CHIP} AS score FROM v GROUP BY 1, 2 UNION ALL SELECT g, 'citation', CAST(max(top) AS VARCHAR), {_CHIP} FROM b GROUP BY 1),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY score DESC, CASE axis WHEN 'year' THEN 1 WHEN 'citation' THEN 2 ELSE 3 END) AS INT) AS rank FROM s WHERE score >= 0.7) SELECT g, rank, axis, value, score FROM r WHERE rank <= 3"""))
def agg12_lists(spark, d):
    """The papers that each user has read, in order, as a result list."""
    p = A.papers(spark, d).select(F.col("id").alias("paper_id"), F.col("pubyear").alias("year"), F.col("citation_count").alias("citations"), F.col("db_code").alias("kind"))
    return G.narrow_chips(A.reads(spark, d).select(F.col("user_id").alias("g"), F.col("event_id").alias("at"), "paper_id").join(p, "paper_id"))


_BINS = """x AS (SELECT id, db_code, citation_count AS v, row_number() OVER (PARTITION BY db_code ORDER BY citation_count, id) - 1 AS i, count(*) OVER (PARTITION BY db_code) AS n FROM papers WHERE citation_count IS NOT NULL),
  e AS (SELECT DISTINCT db_code, v AS edge FROM x WHERE i IN (CAST(floor(n * 1 / 4) AS INT), CAST(floor(n * 2 / 4) AS INT), CAST(floor(n * 3 / 4) AS INT)))"""


@query("agg13_quantile_bins", oracle("papers", f"WITH {_BINS} SELECT x.id, (SELECT count(*) FROM e WHERE e.db_code = x.db_code AND e.edge <= x.v) AS bin FROM x"))
def agg13(spark, d):
    p = A.papers(spark, d).where("citation_count IS NOT NULL").select("id", "db_code", F.col("citation_count").alias("v"))
    return G.assign_bins(p, G.bin_edges(p, ["db_code"], "v", "id", 4), ["db_code"], "v").select("id", F.col("bin").cast("long").alias("bin"))


@query("agg14_index_percentile", oracle("papers", "SELECT db_code, v AS value FROM (SELECT db_code, citation_count AS v, row_number() OVER (PARTITION BY db_code ORDER BY citation_count, id) - 1 AS i, count(*) OVER (PARTITION BY db_code) AS n FROM papers WHERE citation_count IS NOT NULL) WHERE i = least(n - 1, CAST(floor(n * 0.9) AS INT))"))
def agg14(spark, d):
    return G.index_percentile(A.papers(spark, d).where("citation_count IS NOT NULL"), ["db_code"], "citation_count", "id", 0.9)


@query("agg15_median", oracle("papers", "SELECT journal_name, quantile_cont(citation_count, 0.5) AS median FROM papers GROUP BY 1"))
def agg15(spark, d):
    return A.papers(spark, d).groupBy("journal_name").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY citation_count)").alias("median"))


@query("agg16_recount", oracle("links papers", "SELECT rid, count(*) AS papers, sum(coalesce(citation_count, 0))::BIGINT AS cites, min(pubyear) AS first_year, max(pubyear) AS last_year FROM links JOIN papers ON id = paper_id GROUP BY 1"))
def agg16(spark, d):
    return A.links(spark, d).join(A.papers(spark, d), F.col("paper_id") == F.col("id")).groupBy("rid").agg(F.count("*").alias("papers"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("cites"), F.min("pubyear").alias("first_year"), F.max("pubyear").alias("last_year"))


@query("agg17_frequent_pairs", oracle("researchers", "SELECT name, institution, count(*) AS n FROM researchers GROUP BY 1, 2 HAVING count(*) >= 2"))
def agg17(spark, d):
    return A.researchers(spark, d).groupBy("name", "institution").agg(F.count("*").alias("n")).where("n >= 2")


@query("agg18_all_foreign", oracle("links papers", "SELECT rid FROM links JOIN papers ON id = paper_id GROUP BY rid HAVING bool_and(db_code <> 'CFKO' OR id % 2 = 0)"))
def agg18(spark, d):
    return A.links(spark, d).join(A.papers(spark, d), F.col("paper_id") == F.col("id")).groupBy("rid").agg(F.bool_and((F.col("db_code") != "CFKO") | (F.col("id") % 2 == 0)).alias("a")).where("a").select("rid")


@query("agg19_orphans", oracle("links papers", "SELECT rid FROM links LEFT JOIN (SELECT id FROM papers WHERE id % 50 <> 7) t ON t.id = paper_id GROUP BY rid HAVING count(*) FILTER (t.id IS NULL) = 0"))
def agg19(spark, d):
    t = A.papers(spark, d).where("id % 50 <> 7").select("id")
    return A.links(spark, d).join(t, F.col("paper_id") == F.col("id"), "left").groupBy("rid").agg(F.count_if(F.col("id").isNull()).alias("n")).where("n = 0").select("rid")


@query("agg20_prune", oracle("researchers links ext_links", "SELECT r.rid FROM researchers r LEFT JOIN (SELECT rid, count(*) AS n FROM links GROUP BY 1) l USING (rid) LEFT JOIN (SELECT rid, count(*) AS n FROM ext_links WHERE paper_id % 9 = 0 GROUP BY 1) e USING (rid) WHERE coalesce(l.n, 0) >= 32 OR coalesce(e.n, 0) > 0"))
def agg20(spark, d):
    n = lambda x, name: x.groupBy("rid").agg(F.count("*").alias(name))
    r = A.researchers(spark, d).join(n(A.links(spark, d), "l"), "rid", "left").join(n(A.links(spark, d, True).where("paper_id % 9 = 0"), "e"), "rid", "left")
    return r.where("coalesce(l, 0) >= 32 OR coalesce(e, 0) > 0").select("rid")


@query("agg20_prune_promoted", oracle("researchers links ext_links papers", """WITH e AS (SELECT rid, count(*) AS papers FROM ext_links GROUP BY 1), c AS (SELECT DISTINCT rid FROM links JOIN papers ON id = paper_id WHERE db_code = 'CFKO')
  SELECT r.rid, coalesce(papers, 0) AS papers, coalesce(papers, 0) >= 8 OR c.rid IS NOT NULL AS kept FROM researchers r LEFT JOIN e ON e.rid = r.rid LEFT JOIN c ON c.rid = r.rid"""))
def agg20_promoted(spark, d):
    from ..operators.identity import pruned

    corpus = A.links(spark, d).join(A.papers(spark, d).where("db_code = 'CFKO'").select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    return pruned(A.researchers(spark, d), A.links(spark, d, True), corpus)


@query("agg21_candidate_indegree", oracle("cites papers", "SELECT dst, count(*) AS n FROM (SELECT dst % 3000 AS dst FROM cites) WHERE dst NOT IN (SELECT id FROM papers WHERE id % 2 = 0) GROUP BY 1"))
def agg21(spark, d):
    corpus = A.papers(spark, d).where("id % 2 = 0").select(F.col("id").alias("dst"))
    return A.cites(spark, d).select((F.col("dst") % 3000).alias("dst")).join(corpus, "dst", "left_anti").groupBy("dst").agg(F.count("*").alias("n"))


@query("agg22_topic_scores", oracle("vecs", "SELECT d.id, round(max(list_dot_product(d.v, q.v) / sqrt(list_dot_product(d.v, d.v)) / sqrt(list_dot_product(q.v, q.v))), 6) AS score FROM vecs d, (SELECT * FROM vecs WHERE id < 5) q WHERE d.id >= 5 GROUP BY 1"))
def agg22(spark, d):
    from ..operators.vectors import best_cosine

    v = A.vecs(spark, d)
    return best_cosine(v.where("id >= 5"), v.where("id < 5"))


@query("agg23_keyword_tally", oracle("keywords papers", "SELECT replace(name, ' ', '') AS key, max_by(name, paper_id) AS display, count(DISTINCT paper_id) AS papers FROM keywords GROUP BY 1"))
def agg23(spark, d):
    k = A.keywords(spark, d).withColumn("key", F.regexp_replace("name", " ", ""))
    return k.groupBy("key").agg(F.max_by("name", "paper_id").alias("display"), F.countDistinct("paper_id").alias("papers"))


@query("agg24_cluster_keywords", oracle("vecs keywords", "SELECT label, name, n FROM (SELECT label, name, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, min(id * 100 + pos), name) AS rn FROM vecs JOIN keywords ON paper_id = id GROUP BY 1, 2) WHERE rn <= 6"))
def agg24(spark, d):
    x = A.vecs(spark, d).join(A.keywords(spark, d), F.col("id") == F.col("paper_id")).select("label", "name", (F.col("id") * 100 + F.col("pos")).alias("at"))
    return G.top_keywords(x, "label", 6).select("label", "name", "n")


@query("agg25_signature", oracle("links", "SELECT rid, sha1(string_agg(CAST(paper_id AS VARCHAR), '|' ORDER BY CAST(paper_id AS VARCHAR))) AS signature FROM links GROUP BY 1"))
def agg25(spark, d):
    return A.links(spark, d).groupBy("rid").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.col("paper_id").cast("string"))), "|")).alias("signature"))


@query("agg26_array_union", oracle("links keywords", "SELECT rid, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 15), '|') AS keywords FROM links JOIN keywords USING (paper_id) GROUP BY 1"))
def agg26(spark, d):
    return A.links(spark, d).join(A.keywords(spark, d), "paper_id").groupBy("rid").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 15), "|").alias("keywords"))


@query("agg26_merged_people", oracle("researchers links ext_links keywords", """WITH g AS (SELECT *, min(rid) OVER (PARTITION BY name, institution) AS comp, count(*) OVER (PARTITION BY name, institution) AS n, CASE WHEN rank > 25 THEN upper(name) || ' ' || rank END AS eng FROM researchers),
  c AS (SELECT rid, count(*) AS corpus FROM links GROUP BY 1), e AS (SELECT rid, count(*) AS papers FROM ext_links GROUP BY 1), h AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY coalesce(corpus, 0) DESC, coalesce(papers, 0) DESC, rid) AS place, min(eng) OVER (PARTITION BY comp) AS other FROM g LEFT JOIN c USING (rid) LEFT JOIN e USING (rid)),
  k AS (SELECT comp, string_agg(name, '|' ORDER BY name) FILTER (n = 1 OR rn <= 15) AS keywords FROM (SELECT g.comp, g.n, w.name, row_number() OVER (PARTITION BY g.comp ORDER BY w.name) AS rn FROM g JOIN links USING (rid) JOIN keywords w USING (paper_id) GROUP BY 1, 2, 3) GROUP BY 1),
  t AS (SELECT comp, string_agg(DISTINCT dept, '|' ORDER BY dept) AS history FROM g GROUP BY 1) SELECT h.rid, coalesce(eng, other) AS name_eng, history, coalesce(keywords, '') AS keywords, n - 1 AS absorbed FROM h JOIN t USING (comp) LEFT JOIN k USING (comp) WHERE place = 1"""))
def agg26_people(spark, d):
    from ..operators.identity import merged_people

    links, n = A.links(spark, d), lambda x, name: x.groupBy("rid").agg(F.count("*").alias(name))
    tags = links.join(A.keywords(spark, d), "paper_id").groupBy("rid").agg(F.array_sort(F.collect_set("name")).alias("keywords"))
    p = A.researchers(spark, d).join(n(links, "corpus"), "rid", "left").join(n(A.links(spark, d, True), "papers"), "rid", "left").join(tags, "rid", "left")
    p = p.withColumns({"name_eng": F.when(F.col("rank") > 25, F.concat(F.upper("name"), F.lit(" "), F.col("rank"))), "history": F.array("dept")})
    groups = A.researchers(spark, d).select("rid", F.min("rid").over(Window.partitionBy("name", "institution")).alias("comp"))
    return merged_people(p, groups).select("rid", "name_eng", F.array_join("history", "|").alias("history"), F.coalesce(F.array_join("keywords", "|"), F.lit("")).alias("keywords"), "absorbed")


_TOK = "list_filter(string_split_regex(lower(text), '[ \\n\\t\\r]+'), lambda x: x <> '')"


@query("agg27_tfidf_vocabulary", f"""WITH t AS (SELECT doc_id, unnest({_TOK}) AS token FROM documents), tf AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE length(token) >= 2 AND token NOT IN ('the', 'of') GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
  df AS (SELECT token, count(*) AS df, sum(tf) AS freq FROM tf GROUP BY 1), w AS (SELECT doc_id, token, freq, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token), n), m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
  o AS (SELECT token, CAST(max(freq) AS BIGINT) AS freq, sum(w / norm) / (SELECT n FROM n) AS weight FROM w JOIN m USING (doc_id) GROUP BY 1)
  SELECT token, freq, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (ORDER BY freq DESC, token) AS rn, count(*) OVER () AS k FROM o) WHERE rn <= floor(0.8 * k)""")
def agg27(spark, d):
    docs = A.docs(spark, d)
    from ..operators.text import tokens

    return G.tfidf_vocabulary(docs.select(F.col("doc_id").alias("doc"), F.explode(tokens(F.col("text"))).alias("token")), docs.count(), 2, ["the", "of"], 0.8)


@query("agg28_retrieval_metrics", oracle("vecs", """WITH s AS (SELECT q.id AS q, d.id, l.quality, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, d.v), 6) DESC, d.id) AS rank FROM (SELECT * FROM vecs WHERE id < 5) q, vecs d LEFT JOIN labels l ON l.doc_id = d.id WHERE d.id >= 5),
  g AS (SELECT q, coalesce(quality = 1, false) AS rel, rank, count(*) FILTER (quality = 1) OVER (PARTITION BY q) AS n FROM s), i AS (SELECT q, max(n) AS n FROM g GROUP BY q)
  SELECT g.q, round(count(*) FILTER (rel AND rank <= 10) / max(n), 6) AS recall, round(coalesce(1 / min(rank) FILTER (rel), 0), 6) AS mrr,
  round(coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 10), 0) / max((SELECT sum(1 / log2(r + 1)) FROM (SELECT unnest(range(1, 11)) AS r))), 6) AS ndcg FROM g GROUP BY 1"""))
def agg28(spark, d):
    from ..operators.vectors import dot

    v, lab = A.vecs(spark, d), A.read(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    q = F.broadcast(v.where("id < 5").select(F.col("id").alias("q"), F.col("v").alias("qv")))
    s = v.where("id >= 5").join(lab, "id", "left").crossJoin(q).select("q", "id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("rel"), F.round(dot("v", "qv"), 6).alias("s"))
    w = Window.partitionBy("q")
    r = s.withColumn("rank", F.row_number().over(w.orderBy(F.col("s").desc(), "id"))).withColumn("n_rel", F.count_if("rel").over(w))
    return G.retrieval_metrics(r, 10)


@query("agg29_auc", oracle("papers", "WITH s AS (SELECT citation_count AS s, db_code = 'JAKO' AS y FROM papers WHERE citation_count IS NOT NULL), c AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM s GROUP BY 1) SELECT round(sum(p * coalesce(b, 0)) / (sum(p) * sum(n)), 6) AS auc FROM (SELECT *, sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c)"))
def agg29(spark, d):
    return G.auc(A.papers(spark, d).where("citation_count IS NOT NULL").select(F.col("citation_count").alias("score"), (F.col("db_code") == "JAKO").alias("y")))


@query("agg30_domain_table", oracle("researchers", "SELECT dept || rank AS domain, count(DISTINCT institution) AS roots, min(institution) AS root, CASE WHEN count(DISTINCT institution) >= 3 THEN 'generic' WHEN count(DISTINCT institution) = 1 THEN 'promote' ELSE 'hold' END AS verdict FROM researchers WHERE rid % 3 = 0 GROUP BY 1"))
def agg30(spark, d):
    return G.domain_table(A.researchers(spark, d).where("rid % 3 = 0").select(F.concat("dept", "rank").alias("domain"), F.col("institution").alias("root")), 3)


@query("agg31_cost_counters", "SELECT k, v, n, round(cost, 4) AS cost FROM (SELECT 'total' AS k, '' AS v, count(*) AS n, sum(value) AS cost FROM events UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*), sum(value) FROM events GROUP BY 2 UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*), sum(value) FROM events GROUP BY 2)")
def agg31(spark, d):
    e = A.read(spark, d, "events")
    keys = F.create_map(F.lit("total"), F.lit(""), F.lit("month"), F.date_format("ts", "yyyy-MM"), F.lit("day"), F.date_format("ts", "yyyy-MM-dd"))
    return e.select(F.explode(keys).alias("k", "v"), "value").groupBy("k", "v").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"))


_ROWS = "r AS (SELECT author AS rid, journal_name AS institution, pubyear AS year, id AS paper_id, id AS seen FROM papers)"


@query("agg32_researcher_rollup", oracle("papers", f"""WITH {_ROWS.replace('author AS rid', 'author % 500 AS rid')}, i AS (SELECT rid, institution, max(year) AS last, min(seen) AS first FROM r GROUP BY 1, 2), h AS (SELECT rid, list(institution ORDER BY coalesce(last, 0) DESC, first, institution) AS h FROM i GROUP BY 1)
  SELECT rid, h[1] AS current, array_to_string(h, '|') AS history, papers, first_year, last_year FROM h JOIN (SELECT rid, count(DISTINCT paper_id) AS papers, min(year) AS first_year, max(year) AS last_year FROM r GROUP BY 1) USING (rid)"""))
def agg32(spark, d):
    return G.rollup(A.papers(spark, d).select((F.col("author") % 500).alias("rid"), F.col("journal_name").alias("institution"), F.col("pubyear").alias("year"), F.col("id").alias("paper_id"), F.col("id").alias("at")))


@query("agg32_researcher_profiles", oracle("links papers keywords", """WITH a AS (SELECT rid, paper_id, unnest(CASE WHEN paper_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS j FROM links),
  r AS (SELECT rid, paper_id * 2 + j AS seq, CASE paper_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'N' || paper_id END AS name, CASE WHEN (paper_id + j) % 7 = 0 THEN '' ELSE 'I' || ((paper_id + j) % 25) END AS institution, pubyear AS year, paper_id FROM a JOIN papers ON id = paper_id),
  i AS (SELECT rid, institution, max(coalesce(year, 0)) AS last, min(seq) AS first FROM r WHERE institution <> '' GROUP BY 1, 2), h AS (SELECT rid, list(institution ORDER BY last DESC, first) AS h FROM i GROUP BY 1),
  k AS (SELECT rid, k.name, count(*) AS n, min((seq, pos, k.name)) AS first FROM r JOIN keywords k USING (paper_id) GROUP BY 1, 2), w AS (SELECT rid, list(name ORDER BY n DESC, first)[1:10] AS w FROM k GROUP BY 1),
  o AS (SELECT rid, arg_min(name, seq) FILTER (name <> '') AS name, count(DISTINCT paper_id) AS papers FROM r GROUP BY 1)
  SELECT rid, name, h[1] AS current, array_to_string(h, '|') AS history, array_to_string(w, '|') AS keywords, papers FROM o LEFT JOIN h USING (rid) LEFT JOIN w USING (rid)"""))
def agg32_profiles(spark, d):
    """Author rows by links; some papers list a person twice, some without name or institution."""
    p = A.papers(spark, d).select(F.col("id").alias("paper_id"), F.col("pubyear").alias("year"))
    a = A.links(spark, d).select("rid", "paper_id").join(p, "paper_id").withColumn("j", F.explode(F.when(F.col("paper_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    k, of = F.col("paper_id"), F.col("paper_id") + F.col("j")
    rows = a.select("rid", (k * 2 + F.col("j")).alias("at"), F.when(k % 3 == 0, None).when(k % 3 == 1, "").otherwise(F.concat(F.lit("N"), k)).alias("name"),
                    F.when(of % 7 == 0, "").otherwise(F.concat(F.lit("I"), of % 25)).alias("institution"), "year", "paper_id")
    x = G.researcher_profiles(rows, A.keywords(spark, d))
    return x.withColumns({"history": F.array_join("history", "|"), "keywords": F.array_join("keywords", "|")})


@query("agg33_shared_papers", oracle("links", "SELECT paper_id FROM (SELECT paper_id, 'ART' || rid AS r FROM links) GROUP BY 1 HAVING count(DISTINCT r) >= 2 AND max(r) LIKE 'ART9%'"))
def agg33(spark, d):
    x = A.links(spark, d).select("paper_id", F.concat(F.lit("ART"), F.col("rid")).alias("r"))
    return x.groupBy("paper_id").agg(F.countDistinct("r").alias("n"), F.max("r").alias("m")).where("n >= 2 AND m LIKE 'ART9%'").select("paper_id")


@query("agg34_array_counts", oracle("papers keywords", "WITH k AS (SELECT id, list(name) FILTER (name IS NOT NULL) AS a FROM papers LEFT JOIN keywords ON paper_id = id GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (a IS NULL) AS empty, count(*) FILTER (list_contains(a, 'blue bolt')) AS hits FROM k"))
def agg34(spark, d):
    k = A.papers(spark, d).select("id").join(A.keywords(spark, d), F.col("id") == F.col("paper_id"), "left").groupBy("id").agg(F.collect_list("name").alias("a"))
    return k.agg(F.count("*").alias("n"), F.count_if(F.size("a") == 0).alias("empty"), F.count_if(F.array_contains("a", "blue bolt")).alias("hits"))


@query("agg35_profile_counts", oracle("bookmarks reads", "SELECT b.n AS bookmarks, f.n AS folders, r.n AS reads FROM (SELECT count(*) AS n FROM bookmarks) b, (SELECT count(DISTINCT (user_id, folder_id)) AS n FROM bookmarks) f, (SELECT count(*) AS n FROM reads WHERE NOT deleted) r"))
def agg35(spark, d):
    b, r = A.bookmarks(spark, d), A.reads(spark, d)
    return b.agg(F.count("*").alias("bookmarks"), F.countDistinct(F.struct("user_id", "folder_id")).alias("folders")).crossJoin(r.where("NOT deleted").agg(F.count("*").alias("reads")))


@query("agg36_add_pairs", oracle("keywords", f"""SELECT k1, k2, CAST(sum(n) AS BIGINT) AS n FROM (SELECT k1, k2, n FROM ({_PAIRS.replace('GROUP BY', 'WHERE a.paper_id % 2 = 0 GROUP BY')}) UNION ALL SELECT k1, k2, n FROM ({_PAIRS.replace('GROUP BY', 'WHERE a.paper_id % 2 = 1 GROUP BY')})) GROUP BY 1, 2"""))
def agg36(spark, d):
    k = A.keywords(spark, d)
    return G.add_counts(G.cooccurrence(k.where("paper_id % 2 = 0")), G.cooccurrence(k.where("paper_id % 2 = 1")))


@query("agg37_verify_report", oracle("papers journals", "SELECT p.db_code, count(*) AS n, count(j.id) AS matched, round(count(j.id) / count(*), 6) AS rate, count(*) - count(DISTINCT p.title) AS repeated FROM papers p LEFT JOIN journals j ON lower(j.title) = lower(p.journal_name) AND j.sci_indexed GROUP BY 1"))
def agg37(spark, d):
    j = A.journals(spark, d).where("sci_indexed").select(F.lower("title").alias("t"))
    p = A.papers(spark, d).withColumn("t2", F.lower("journal_name")).join(j, F.col("t2") == F.col("t"), "left")
    return p.groupBy("db_code").agg(F.count("*").alias("n"), F.count("t").alias("matched"), F.round(F.count("t") / F.count("*"), 6).alias("rate"), (F.count("*") - F.countDistinct("title")).alias("repeated"))


