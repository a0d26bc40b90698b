"""Queries of sources and sinks. Files are written from the tables first, in the shared folder, and read back."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import adapters as A
from ..adapters import oracle
from ..sources import readers as R
from ..sources import vector_index as I
from ..sources import writers as W
from ..sources.graph_store import GraphStore
from .catalog import query
from .vectors import _COS, query_vector


@query("src01_corpus_json", oracle("papers", "SELECT 'CN' || id AS cn, db_code, title, pubyear FROM papers WHERE id % 10 <> 3"))
def src01(spark, d):
    p = A.papers(spark, d)
    cn = F.when(F.col("id") % 10 != 3, F.concat(F.lit("CN"), F.col("id")))
    item = F.struct(cn.alias("CN"), F.col("db_code").alias("DBCode"), F.col("title").alias("Title"), F.col("pubyear").alias("Pubyear"))
    files = p.groupBy(F.floor(F.col("id") / 500).alias("f")).agg(F.collect_list(item).alias("papers"))
    text = F.when(F.col("f") % 2 == 0, F.to_json(F.struct("papers"))).otherwise(F.to_json("papers"))
    return files.select(F.inline(R.papers_in(text))).select(F.col("CN").alias("cn"), F.col("DBCode").alias("db_code"), F.col("Title").alias("title"), F.col("Pubyear").alias("pubyear"))


@query("src01_corpus_files", oracle("papers", "SELECT 'CN' || id AS cn, db_code, title, pubyear FROM papers WHERE id % 10 <> 3"))
def src01_files(spark, d):
    """The same from files: every second one an object with `papers`, the others bare lists."""
    path, p = W.scratch(spark), A.papers(spark, d)
    cn = F.when(F.col("id") % 10 != 3, F.concat(F.lit("CN"), F.col("id")))
    item = F.struct(cn.alias("CN"), F.col("db_code").alias("DBCode"), F.col("title").alias("Title"), F.col("pubyear").alias("Pubyear"))
    files = p.groupBy(F.floor(F.col("id") / 500).alias("f")).agg(F.collect_list(item).alias("papers"))
    text = F.when(F.col("f") % 2 == 0, F.to_json(F.struct("papers"))).otherwise(F.to_json("papers"))
    files.select("f", text.alias("value")).repartition("f").write.partitionBy("f").text(path)
    return R.read_corpus(spark, path).select(F.col("CN").alias("cn"), F.col("DBCode").alias("db_code"), F.col("Title").alias("title"), F.col("Pubyear").alias("pubyear"))


@query("src02_ranking_csv", oracle("journals", "SELECT title, issn, CAST(sjr_score AS DOUBLE) AS sjr, quartile, CAST(h_index AS INT) AS h_index FROM journals"))
def src02(spark, d):
    path = W.scratch(spark)
    A.journals(spark, d).select(F.col("title").alias("Title"), F.col("issn").alias("Issn"), F.replace(F.col("sjr_score").cast("string"), F.lit("."), F.lit(",")).alias("SJR"), F.col("quartile").alias("SJR Best Quartile"), F.col("h_index").alias("H index")).write.option("sep", ";").option("header", True).csv(path)
    return R.read_ranking(spark, path).select("title", F.get("issn", 0).alias("issn"), "sjr", "quartile", "h_index")


@query("src03_registry_csv", oracle("journals", "SELECT title, issn FROM journals"))
def src03(spark, d):
    paths = [f"{W.scratch(spark)}-{day}" for day in ("20240101", "20250301")]
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    j = A.journals(spark, d)
    j.select(F.col("title").alias("학술지명"), F.col("issn").alias("ISSN")).limit(0).write.option("header", True).csv(paths[0])
    j.select(F.col("title").alias("학술지명 (국문)"), F.col("issn").alias("P-ISSN")).write.option("header", True).option("encoding", "euc-kr").csv(paths[1])
    df = R.read_registry(spark, R.latest_file(paths))
    return df.select(F.col(f"`{R.find_column(df.columns, '학술지명')}`").alias("title"), F.col(f"`{R.find_column(df.columns, 'ISSN')}`").alias("issn"))


def _xml(spark, d):
    k = A.keywords(spark, d).groupBy("paper_id").agg(F.array_sort(F.collect_list("name")).alias("k"))
    xml = F.concat(F.lit("<article><id>ART"), "id", F.lit("</id><title>"), "title", F.lit("</title><year>"), F.coalesce(F.col("pubyear").cast("string"), F.lit("")), F.lit("</year><authors><author order=\"1\"><name>A"), "author",
                   F.lit("</name></author></authors><keywords><keyword>"), F.array_join(F.coalesce("k", F.array(F.lit(""))), "</keyword><keyword>"), F.lit("</keyword></keywords></article>"))
    return A.papers(spark, d).join(k, F.col("id") == F.col("paper_id"), "left").select("id", xml.alias("xml"))


_ARTICLES = """SELECT id, 'ART' || id AS art_id, title, pubyear AS year, 'A' || author AS author, coalesce(k, '') AS keywords FROM papers LEFT JOIN (SELECT paper_id, string_agg(name, '|' ORDER BY name) AS k FROM keywords GROUP BY 1) ON paper_id = id"""


@query("src04_article_files", oracle("papers keywords", f"SELECT art_id, title, year, author, keywords FROM ({_ARTICLES})"))
def src04_files(spark, d):
    """The same from XML files of many articles each."""
    path = W.scratch(spark)
    body = F.concat(F.lit("<articles>"), F.array_join(F.collect_list("xml"), ""), F.lit("</articles>"))
    _xml(spark, d).groupBy(F.floor(F.col("id") / 500).alias("f")).agg(body.alias("value")).repartition("f").write.partitionBy("f").text(path)
    a = spark.read.format("xml").option("rowTag", "article").schema(T.StructType.fromDDL(f"a {R.ARTICLE}")["a"].dataType).load(path)
    return a.select(F.col("id").alias("art_id"), "title", F.col("year").try_cast("int").alias("year"), F.get("authors.author", 0)["name"].alias("author"), F.array_join("keywords.keyword", "|").alias("keywords"))


@query("src04_article_xml", oracle("papers keywords", _ARTICLES))
def src04(spark, d):
    return _xml(spark, d).select("id", R.article(F.col("xml")).alias("a")).select("id", F.col("a.id").alias("art_id"), "a.title", F.col("a.year").try_cast("int").alias("year"), F.get("a.authors.author", 0)["name"].alias("author"), F.array_join("a.keywords.keyword", "|").alias("keywords"))


@query("src05_record_finder", oracle("papers", "SELECT CAST(id AS VARCHAR) AS cn FROM papers"))
def src05(spark, d):
    xml = F.concat(F.lit("<r><records><record><cn>"), "id", F.lit("</cn></record></records></r>"))
    parsed = F.to_json(F.from_xml(xml, "struct<records:struct<record:array<struct<cn:string>>>>"))
    return A.papers(spark, d).select(F.inline(R.records_of(parsed, "struct<cn:string>")))


@query("src05_record_containers", oracle("papers", "SELECT id, 'a' || id AS cn FROM papers WHERE id % 6 < 5 UNION ALL SELECT id, 'b' AS cn FROM papers WHERE id % 6 IN (0, 3)"))
def src05_containers(spark, d):
    """Documents of several shapes: a bare list, known keys, nesting, an unknown key, none."""
    one, two = F.concat(F.lit('{"cn": "a'), "id", F.lit('"}')), F.lit('{"cn": "b"}')
    k, cat = F.col("id") % 6, lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    doc = (F.when(k == 0, cat("[", one, ", ", two, "]")).when(k == 1, cat('{"outputData": [', one, "]}")).when(k == 2, cat('{"h": {"n": 1}, "resultSet": {"x": 1, "Record": [', one, "]}}"))
           .when(k == 3, cat('{"record": "no", "body": {"list": [', one, ", ", two, "]}}")).when(k == 4, cat('{"h": [1, 2], "rows": [', one, "]}")).otherwise("not json"))
    return A.papers(spark, d).select("id", F.inline(R.records_of(doc, "struct<cn:string>")))


#: The pages that the default source makes up: a keyword's records begin at the sum of its bytes modulo 7.
_PAGES = "p AS (SELECT k, CAST(q AS INT) AS page, a + q * 20 + i AS n FROM (VALUES " + ", ".join(f"('{k}', {sum(k.encode()) % 7})" for k in ("alpha", "beta", "gamma")) + ") x(k, a), range(0, 5) y(q), range(0, 20) z(i))"


@query("src06_paged_source", f"""WITH {_PAGES}, r AS (SELECT 'CN' || lpad(CAST(n AS VARCHAR), 5, '0') AS cn, k AS keyword, page, CASE n % 3 WHEN 0 THEN 'JAKO' WHEN 1 THEN 'DIKO' ELSE 'CFKO' END AS db_code, CAST(2000 + n % 25 AS INT) AS year FROM p)
  SELECT cn, keyword, page, db_code, year FROM (SELECT *, row_number() OVER (PARTITION BY cn ORDER BY keyword, page) AS rn FROM r WHERE year >= 2001 AND db_code <> 'CFKO') WHERE rn = 1 ORDER BY cn LIMIT 60""")
def src06(spark, d):
    spark.dataSource.register(R.PagedSource)
    rows = spark.read.format("paged").option("keywords", "alpha,beta,gamma").option("pages", 5).option("size", 20).load()
    return R.collected(rows, exclude=("CFKO",), years=(2001, None), cap=60)


@query("src07_vector_scan", oracle("vecs papers", f"SELECT a.id, round(1 - {_COS}, 6) AS distance FROM vecs a JOIN papers p ON p.id = a.id, (SELECT * FROM vecs WHERE id = 0) b WHERE pubyear >= 1996 AND pubyear <= 2000 AND db_code IN ('JAKO')"))
def src07(spark, d):
    v = A.vecs(spark, d)
    x = v.join(A.papers(spark, d).select("id", F.col("pubyear").alias("year"), F.col("db_code").alias("kind")), "id")
    return R.vector_scan(x, query_vector(v, 0), (1996, 2000), ("JAKO",)).select("id", F.round("distance", 6).alias("distance"))


_TOPS = f"SELECT query, id, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM (SELECT b.id AS query, a.id, round(greatest(0, {_COS}), 9) AS sim FROM vecs a, (SELECT * FROM vecs WHERE id % 20 = 0) b WHERE a.id <> b.id)) WHERE rank <= 10"


def _index(spark, d, **how):
    path = W.scratch(spark)
    v = A.vecs(spark, d)
    I.build(v, path)
    return I.search(spark, path, v.where("id % 20 = 0").select(F.col("id").alias("query"), "v"), 10, **how).withColumn("sim", F.round("sim", 6))


@query("src07_vector_index_exact", oracle("vecs", _TOPS))
def src07_index_exact(spark, d):
    """Ten nearest of every 20th vector from the stored index, all cells read."""
    return _index(spark, d, exact=True)


@query("src07_vector_index")
def src07_index(spark, d):
    """The same from the cells that each query probes."""
    return _index(spark, d, probes=16)


@query("src08_graph_scan", oracle("keywords cites links", "SELECT DISTINCT l.rid AS node FROM keywords k JOIN cites c ON c.src = k.paper_id JOIN links l ON l.paper_id = c.dst WHERE k.name = 'blue bolt'"))
def src08(spark, d):
    start = spark.createDataFrame([("blue bolt",)], "node string")
    return R.traverse(start, (A.keywords(spark, d), "name", "paper_id"), (A.cites(spark, d), "src", "dst"), (A.links(spark, d), "paper_id", "rid"))


@query("snk01_insert_ignore", oracle("links ext_links", "SELECT rid, paper_id, author_order FROM links WHERE author_order = 1 UNION ALL SELECT rid, paper_id, author_order FROM ext_links e WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.author_order = 1 AND l.rid = e.rid AND l.paper_id = e.paper_id)"))
def snk01(spark, d):
    return W.insert_ignore(A.links(spark, d).where("author_order = 1"), A.links(spark, d, True), ["rid", "paper_id"], ["author_order"])


@query("snk02_upsert", oracle("researchers bookmarks", """WITH n AS (SELECT user_id AS rid, max_by(paper_id, id) AS rank FROM bookmarks GROUP BY 1) SELECT coalesce(r.rid, n.rid) AS rid, CASE WHEN n.rid IS NOT NULL THEN n.rank ELSE r.rank END AS rank, name FROM (SELECT rid, CAST(rank AS BIGINT) AS rank, name FROM researchers WHERE institution <> 'Brand#1') r FULL JOIN n ON n.rid = r.rid"""))
def snk02(spark, d):
    old = A.researchers(spark, d).where("institution <> 'Brand#1'").select("rid", F.col("rank").cast("long").alias("rank"), "name")
    new = A.bookmarks(spark, d).select(F.col("user_id").alias("rid"), F.col("paper_id").alias("rank"), F.lit(None).cast("string").alias("name"), F.col("id").alias("seq"))
    return W.upsert(old, new, ["rid"], [F.col("seq").desc()], ["rank"])


@query("snk03_signed_cache", oracle("researchers", "SELECT rid, sig, val, CASE WHEN n.rid IS NULL OR o.sig = n.s THEN oth END AS oth FROM (SELECT rid, dept AS sig, name AS val, institution AS oth FROM researchers) o LEFT JOIN (SELECT rid, CASE WHEN rank > 25 THEN dept ELSE 'NEW' END AS s FROM researchers WHERE rank > 10) n USING (rid)".replace("SELECT rid, sig, val,", "SELECT rid, coalesce(n.s, sig) AS sig, CASE WHEN n.rid IS NOT NULL THEN 'v2' ELSE val END AS val,")))
def snk03(spark, d):
    r = A.researchers(spark, d)
    old = r.select("rid", F.col("dept").alias("sig"), F.col("name").alias("val"), F.col("institution").alias("oth"))
    new = r.where("rank > 10").select("rid", F.when(F.col("rank") > 25, F.col("dept")).otherwise("NEW").alias("sig"), F.lit("v2").alias("val"))
    return W.keep_if_signed(old, new, "rid", "sig", "val", "oth")


@query("snk04_graph_merge", oracle("keywords links", "SELECT kind, count(*) AS n FROM (SELECT 'HAS_KEYWORD' AS kind, paper_id AS a, name AS b FROM keywords UNION SELECT 'AUTHORED', rid, CAST(paper_id AS VARCHAR) FROM links) GROUP BY 1"))
def snk04(spark, d):
    path = W.scratch(spark)
    k, l = A.keywords(spark, d), A.links(spark, d)  # noqa: E741
    s = lambda c: F.col(c).cast("string")
    e = k.select(F.lit("HAS_KEYWORD").alias("kind"), s("paper_id").alias("src"), F.col("name").alias("dst")).union(l.select(F.lit("AUTHORED"), s("rid"), s("paper_id")))
    n = k.select(F.lit("Keyword").alias("kind"), F.col("name").alias("key")).union(l.select(F.lit("Author"), s("rid")))
    W.merge_graph(n, e.union(e), path)
    return GraphStore(spark, path).read("edges").groupBy("kind").agg(F.count("*").alias("n"))


@query("snk04_graph_store", oracle("keywords links", """SELECT 'nodes' AS tbl, kind, count(*) AS n FROM (SELECT 'Keyword' AS kind, name AS k FROM keywords UNION SELECT 'Author', CAST(rid AS VARCHAR) FROM links) GROUP BY 2
  UNION ALL SELECT 'edges', kind, count(*) FROM (SELECT 'HAS_KEYWORD' AS kind, CAST(paper_id AS VARCHAR) AS a, name AS b FROM keywords UNION SELECT 'AUTHORED', CAST(rid AS VARCHAR), CAST(paper_id AS VARCHAR) FROM links) GROUP BY 2"""))
def snk04_store(spark, d):
    """Keywords and authors loaded one after the other into one store, then both again: what it holds."""
    k, l = A.keywords(spark, d), A.links(spark, d)  # noqa: E741
    s = lambda c: F.col(c).cast("string")
    loads = [(k.select(F.lit("Keyword").alias("kind"), F.col("name").alias("key")).distinct(), k.select(F.lit("HAS_KEYWORD").alias("kind"), s("paper_id").alias("src"), F.col("name").alias("dst"), "pos")),
             (l.select(F.lit("Author").alias("kind"), s("rid").alias("key")).distinct(), l.select(F.lit("AUTHORED").alias("kind"), s("rid").alias("src"), s("paper_id").alias("dst"), F.col("author_order").alias("pos")))]
    store = GraphStore(spark, W.scratch(spark))
    for n, e in [*loads, *loads]:
        store.merge(n, e)
    if store.versions() != [1, 2]:
        raise RuntimeError("a repeated load made a version")
    count = lambda t: store.read(t).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "kind", "n")
    return count("nodes").union(count("edges"))


@query("snk05_vector_sync", oracle("vecs docs", "SELECT id, false AS stale FROM (SELECT doc_id AS id FROM docs WHERE lang = 'en') UNION ALL SELECT id, true FROM vecs WHERE id NOT IN (SELECT doc_id FROM docs WHERE lang = 'en')"))
def snk05(spark, d):
    source, stale = W.sync(A.vecs(spark, d).select("id"), A.docs(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("id")), "id")
    return source.withColumn("stale", F.lit(False)).union(stale.withColumn("stale", F.lit(True)))


@query("snk05_vector_store", oracle("vecs docs", "SELECT d.id, v.label AS old, d.label FROM (SELECT doc_id AS id, source AS label FROM docs WHERE lang = 'en') d LEFT JOIN (SELECT id, CAST(label AS VARCHAR) AS label FROM vecs) v ON v.id = d.id"))
def snk05_store(spark, d):
    """The written store after an upsert of the source and the removal of stale ids, with the counts checked."""
    old = A.vecs(spark, d).select("id", F.col("label").cast("string").alias("label"))
    new = A.docs(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("source").alias("label"))
    out = W.sync_store(old, new, "id", W.scratch(spark))
    return out.join(old.withColumnRenamed("label", "old"), "id", "left").select("id", "old", "label")


@query("snk06_backup", oracle("journals cites vecs", "SELECT 'journals' AS store, count(*) AS n FROM journals UNION ALL SELECT 'cites', count(*) FROM cites UNION ALL SELECT 'vectors', count(*) FROM vecs"))
def snk06(spark, d):
    n = W.backup({"journals": A.journals(spark, d), "cites": A.cites(spark, d), "vectors": A.vecs(spark, d)}, W.scratch(spark))
    return spark.createDataFrame(sorted(n.items()), "store string, n long")
