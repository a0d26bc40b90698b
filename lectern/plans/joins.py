"""Queries of joins and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import oracle
from ..operators import joins as J
from ..operators import sets as S
from .catalog import query

_CARD = "SELECT p.id, p.db_code = 'JAKO' OR coalesce(j.kci_indexed, false) AS registered, coalesce(j.sci_indexed, false) AS sci FROM papers p LEFT JOIN journals j ON p.journal_id = j.id"


@query("jon01_journal_by_key", oracle("papers journals", _CARD))
def jon01(spark, d):
    return J.paper_cards(A.papers(spark, d), A.journals(spark, d)).select("id", "registered", "sci")


def _items(spark, d):
    """Papers with the ISSN that their journal number gives."""
    k = F.col("author") % 25
    return A.papers(spark, d).select(F.col("id").alias("item"), F.lpad((k * 37 + 10000000).cast("string"), 8, "0").alias("key"), F.upper("journal_name").alias("title"))


_ITEMS = "items AS (SELECT id AS item, lpad(CAST(10000000 + (author % 25) * 37 AS VARCHAR), 8, '0') AS key, upper(journal_name) AS title FROM papers)"
_BEST = "row_number() OVER (PARTITION BY {k} ORDER BY coalesce(sjr_year, -1) DESC, coalesce(sjr_score, -1) DESC, coalesce(h_index, -1) DESC, id)"


@query("jon02_or_join", oracle("papers journals", f"WITH {_ITEMS} SELECT DISTINCT item, j.id AS journal_id FROM items JOIN journals j ON key = j.issn OR key = j.e_issn"))
def jon02(spark, d):
    return J.or_join(_items(spark, d), A.journals(spark, d))


@query("jon03_best_journal", oracle("papers journals", f"""WITH {_ITEMS}, c AS (SELECT item, j.*, {_BEST.format(k='item')} AS rn FROM items i JOIN journals j ON i.key = j.issn OR i.key = j.e_issn OR lower(trim(i.title)) = lower(trim(j.title)))
  SELECT i.item, c.id AS journal_id FROM items i LEFT JOIN c ON c.item = i.item AND rn = 1"""))
def jon03(spark, d):
    return J.best_journal(_items(spark, d), A.journals(spark, d))


@query("jon04_first_wins", oracle("papers journals", f"""WITH {_ITEMS}, k AS (SELECT DISTINCT key, id, sjr_year, sjr_score, h_index FROM (SELECT issn AS key, * FROM journals UNION ALL SELECT e_issn, * FROM journals) WHERE key IS NOT NULL),
  bk AS (SELECT key, id, {_BEST.format(k='key')} AS rn FROM k), bt AS (SELECT lower(trim(title)) AS t, id, {_BEST.format(k='lower(trim(title))')} AS rn FROM journals)
  SELECT item, coalesce(bk.id, bt.id) AS journal_id FROM items LEFT JOIN bk ON bk.key = items.key AND bk.rn = 1 LEFT JOIN bt ON bt.t = lower(trim(items.title)) AND bt.rn = 1"""))
def jon04(spark, d):
    return J.first_wins(_items(spark, d), A.journals(spark, d))


@query("jon05_lateral_top1", oracle("papers journals", """SELECT p.id, coalesce(p.journal_id, j.id) AS journal_id, j.id IS NOT NULL AS by_title FROM papers p LEFT JOIN LATERAL
  (SELECT id FROM journals jj WHERE lower(trim(jj.title)) = lower(trim(p.journal_name)) AND p.journal_id IS NULL ORDER BY sci_indexed DESC NULLS LAST, id LIMIT 1) j ON true"""))
def jon05(spark, d):
    return J.lateral_journal(A.papers(spark, d), A.journals(spark, d))


@query("jon06_corpus_only", oracle("links ext_links", "SELECT rid, paper_id FROM links l WHERE NOT EXISTS (SELECT 1 FROM ext_links e WHERE e.rid = l.rid AND e.paper_id = l.paper_id)"))
def jon06(spark, d):
    return J.researcher_papers(A.links(spark, d), A.links(spark, d, True)).where("source = 'corpus'").select("rid", "paper_id")


@query("jon07_alternate_anti", oracle("cites papers", "SELECT src, dst FROM cites c WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.id - p.id % 3 = c.dst AND p.id <> c.dst AND p.db_code = 'JAKO')"))
def jon07(spark, d):
    # A paper's alternate id: its id rounded down to a multiple of three.
    alt = A.papers(spark, d).where("db_code = 'JAKO'").select((F.col("id") - F.col("id") % 3).alias("alt"), "id").where("alt <> id")
    return A.cites(spark, d).join(alt, F.col("dst") == F.col("alt"), "left_anti")


_CO = "l AS (SELECT rid, paper_id FROM links UNION SELECT rid, paper_id FROM ext_links)"


@query("jon08_coauthors", oracle("links ext_links", f"WITH {_CO} SELECT a.rid, b.rid AS other, count(DISTINCT a.paper_id) AS shared FROM l a JOIN l b ON a.paper_id = b.paper_id AND a.rid <> b.rid GROUP BY 1, 2"))
def jon08(spark, d):
    return J.coauthors(A.links(spark, d), A.links(spark, d, True))


@query("jon09_undirected_edges", oracle("links ext_links", f"WITH {_CO} SELECT DISTINCT least(a.rid, b.rid) AS a, greatest(a.rid, b.rid) AS b FROM l a JOIN l b ON a.paper_id = b.paper_id AND a.rid <> b.rid"))
def jon09(spark, d):
    return J.undirected_edges(A.links(spark, d), A.links(spark, d, True))


@query("jon10_keyword_overlap", oracle("links", "SELECT a.paper_id AS a, b.paper_id AS b, count(DISTINCT a.rid) AS shared FROM links a JOIN links b ON a.rid = b.rid AND a.paper_id < b.paper_id GROUP BY 1, 2 HAVING count(DISTINCT a.rid) >= 2"))
def jon10(spark, d):
    return J.overlap_pairs(A.links(spark, d).select("paper_id", F.col("rid").alias("name")), 2)


@query("jon10_keyword_overlap_of_keywords", oracle("keywords", "SELECT a.paper_id AS a, b.paper_id AS b, count(DISTINCT a.name) AS shared FROM keywords a JOIN keywords b ON a.name = b.name AND a.paper_id < b.paper_id GROUP BY 1, 2 HAVING count(DISTINCT a.name) >= 4"))
def jon10_keywords(spark, d):
    return J.overlap_pairs(A.keywords(spark, d), 4)


_SET = ("blue bolt", "red bolt", "small ring", "hot gear", "old bolt")


@query("jon11_relations_among", oracle("related", f"SELECT k1, k2, n FROM related WHERE k1 IN {_SET} AND k2 IN {_SET} AND n >= 2"))
def jon11(spark, d):
    return A.related(spark, d).where(F.col("k1").isin(*_SET) & F.col("k2").isin(*_SET) & (F.col("n") >= 2))


@query("jon12_keyword_paper_count", oracle("keywords", "WITH q AS (SELECT unnest(['blue bolt', 'hot gear', 'none such']) AS name) SELECT q.name, count(DISTINCT paper_id) AS papers FROM q LEFT JOIN keywords USING (name) GROUP BY 1"))
def jon12(spark, d):
    q = spark.createDataFrame([("blue bolt",), ("hot gear",), ("none such",)], "name string")
    return q.join(A.keywords(spark, d), "name", "left").groupBy("name").agg(F.countDistinct("paper_id").alias("papers"))


@query("jon13_citation_neighbours", oracle("cites papers", "SELECT src, dst, pubyear, title FROM (SELECT src, dst, pubyear, title, row_number() OVER (PARTITION BY src % 100 ORDER BY pubyear DESC NULLS LAST, title, dst, src) AS rn FROM cites JOIN papers ON id = dst WHERE dst NOT IN (1, 2, 3)) WHERE rn <= 5"))
def jon13(spark, d):
    x = A.cites(spark, d).where(~F.col("dst").isin(1, 2, 3)).join(A.papers(spark, d), F.col("dst") == F.col("id"))
    from ..operators.windows import top_per_group

    return top_per_group(x.withColumn("g", F.col("src") % 100), ["g"], [F.col("pubyear").desc_nulls_last(), "title", "dst", "src"], 5).select("src", "dst", "pubyear", "title")


@query("jon14_has_neighbours", oracle("papers cites", "SELECT id, count(c.dst) > 0 AS has_more FROM papers LEFT JOIN cites c ON c.src = id AND c.dst NOT IN (1, 2, 3) GROUP BY id"))
def jon14(spark, d):
    c = A.cites(spark, d).where(~F.col("dst").isin(1, 2, 3)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return A.papers(spark, d).select("id").join(c, "id", "left").select("id", (F.coalesce("n", F.lit(0)) > 0).alias("has_more"))


@query("jon15_paper_star", oracle("keywords papers", """WITH p AS (SELECT * FROM papers WHERE id % 50 = 0), k AS (SELECT p.id, name, row_number() OVER (PARTITION BY p.id ORDER BY pos, name) AS rn FROM p JOIN keywords ON paper_id = p.id)
  SELECT id, 'keyword' AS kind, name AS node FROM k WHERE rn <= 3 UNION ALL SELECT id, 'author', CAST(author AS VARCHAR) FROM p UNION ALL SELECT id, 'journal', journal_name FROM p UNION ALL SELECT id, 'year', CAST(pubyear AS VARCHAR) FROM p WHERE pubyear IS NOT NULL"""
  .replace(" WHERE id % 50 = 0", "")))
def jon15(spark, d):
    from ..operators.graphs import paper_star

    return paper_star(A.papers(spark, d), A.keywords(spark, d), 3)


@query("jon16_papers_by_keyword", oracle("keywords papers", """WITH m AS (SELECT paper_id FROM keywords WHERE name = 'blue bolt'), p AS (SELECT id, title, pubyear FROM papers JOIN m ON paper_id = id ORDER BY pubyear DESC NULLS LAST, id LIMIT 20 OFFSET 5)
  SELECT p.id, p.title, string_agg(k.name, '|' ORDER BY k.pos, k.name) AS keywords FROM p JOIN keywords k ON k.paper_id = p.id GROUP BY 1, 2"""))
def jon16(spark, d):
    from ..operators.graphs import papers_by_keyword

    return papers_by_keyword(A.papers(spark, d), A.keywords(spark, d), "blue bolt", 20, 5)


def _star(spark, d):
    p = A.papers(spark, d).select("id", "title", F.lit(None).cast("string").alias("title_en"), F.col("journal_name").alias("journal"), F.col("pubyear").alias("year"))
    a = A.links(spark, d).join(A.researchers(spark, d).select("rid", "name"), "rid").select("paper_id", "name", "author_order")
    return p, A.keywords(spark, d), a


#: The rows around each paper, in SQL.
_STAR = """k AS (SELECT paper_id AS center, 'keyword:' || lang || ':' || name AS id, 'Keyword' AS label, name, lang, CAST(NULL AS INT) AS author_order, row_number() OVER (PARTITION BY paper_id ORDER BY lang, name) AS rn FROM keywords),
  s AS (SELECT center, id, label, name, lang, author_order FROM k WHERE rn <= 3 UNION ALL SELECT paper_id, 'author:' || name, 'Author', name, NULL, CAST(author_order AS INT) FROM links JOIN researchers USING (rid)
    UNION ALL SELECT id, 'journal:' || journal_name, 'Journal', journal_name, NULL, NULL FROM papers UNION ALL SELECT id, 'year:' || pubyear, 'Year', CAST(pubyear AS VARCHAR), NULL, NULL FROM papers WHERE pubyear IS NOT NULL)"""


@query("jon15_star_nodes", oracle("keywords papers links researchers", f"WITH {_STAR} SELECT id AS center, 'paper:' || id AS id, 'Paper' AS label, title AS name, true AS is_center FROM papers UNION ALL SELECT DISTINCT center, id, label, name, false FROM s"))
def jon15_nodes(spark, d):
    from ..operators.graphs import star_nodes

    return star_nodes(*_star(spark, d), 3)


@query("jon15_star_edges", oracle("keywords papers links researchers", f"""WITH {_STAR} SELECT center, CASE WHEN label = 'Author' THEN id ELSE 'paper:' || center END AS source, CASE WHEN label = 'Author' THEN 'paper:' || center ELSE id END AS target,
  CASE label WHEN 'Keyword' THEN 'HAS_KEYWORD' WHEN 'Author' THEN 'AUTHORED' WHEN 'Journal' THEN 'PUBLISHED_IN' ELSE 'PUBLISHED_IN_YEAR' END AS type, lang, author_order FROM s"""))
def jon15_edges(spark, d):
    from ..operators.graphs import star_edges

    return star_edges(*_star(spark, d), 3)


@query("jon16_keyword_page", oracle("keywords papers links researchers", """WITH h AS (SELECT id, title, pubyear FROM papers WHERE id IN (SELECT paper_id FROM keywords WHERE name = 'blue bolt' AND lang = (SELECT min(lang) FROM keywords WHERE name = 'blue bolt'))),
  p AS (SELECT *, row_number() OVER (ORDER BY coalesce(pubyear, 0) DESC, title, id) AS place, count(*) OVER () AS total FROM h), a AS (SELECT paper_id AS id, string_agg(name, '|' ORDER BY author_order, name) AS authors FROM links JOIN researchers USING (rid) GROUP BY 1),
  k AS (SELECT paper_id AS id, string_agg(name, '|' ORDER BY lang, name) AS keywords, string_agg(lang || ':' || name, '|' ORDER BY lang, name) AS keyword_keys FROM keywords GROUP BY 1)
  SELECT place, id, title, pubyear, coalesce(authors, '') AS authors, keywords, keyword_keys, total FROM p LEFT JOIN a USING (id) LEFT JOIN k USING (id) WHERE place BETWEEN 6 AND 25"""))
def jon16_page(spark, d):
    from ..operators.graphs import keyword_page

    p, k, a = _star(spark, d)
    key = k.where("name = 'blue bolt'").agg(F.min("lang").alias("lang")).first()["lang"]
    x = keyword_page(A.papers(spark, d).select("id", "title", "pubyear"), k, a, f"{key}:blue bolt", 20, 5)
    return x.select("place", "id", "title", "pubyear", *[F.array_join(c, "|").alias(c) for c in ("authors", "keywords", "keyword_keys")], "total")


@query("jon17_doi_join", oracle("papers", """WITH a AS (SELECT id, CASE id % 5 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'http://dx.doi.org/' WHEN 2 THEN 'HTTPS://DOI.ORG/' WHEN 3 THEN 'http://doi.org/' ELSE '' END || '10.5/P' || id AS doi FROM papers)
  SELECT a.id, b.id AS match FROM a JOIN (SELECT id, '10.5/p' || id AS bare FROM papers WHERE id % 2 = 0) b ON lower(regexp_replace(a.doi, '(?i)^https?://(dx\\.)?doi\\.org/', '')) = b.bare""".replace("\\\\", "\\")))
def jon17(spark, d):
    from ..operators.text import bare_doi

    k = F.col("id") % 5
    p = A.papers(spark, d).select("id", F.concat(F.when(k == 0, "https://doi.org/").when(k == 1, "http://dx.doi.org/").when(k == 2, "HTTPS://DOI.ORG/").when(k == 3, "http://doi.org/").otherwise(""), F.lit("10.5/P"), F.col("id")).alias("doi"))
    b = A.papers(spark, d).where("id % 2 = 0").select(F.col("id").alias("match"), F.concat(F.lit("10.5/p"), F.col("id")).alias("bare"))
    return p.withColumn("bare", F.lower(bare_doi(F.col("doi")))).join(b, "bare").select("id", "match")


@query("jon17_doi_join_whole", oracle("papers", r"""WITH a AS (SELECT id, CASE id % 5 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'http://dx.doi.org/' WHEN 2 THEN 'HTTPS://DOI.ORG/' WHEN 3 THEN 'http://doi.org/' ELSE '' END || '10.5/P' || id AS doi FROM papers)
  SELECT a.id, b.id AS match FROM a JOIN (SELECT id, '10.5/p' || id AS bare FROM papers) b ON lower(regexp_replace(a.doi, '(?i)^https?://(dx\.)?doi\.org/', '')) = b.bare"""))
def jon17_whole(spark, d):
    from ..operators.text import bare_doi

    k = F.col("id") % 5
    p = A.papers(spark, d).select("id", F.concat(F.when(k == 0, "https://doi.org/").when(k == 1, "http://dx.doi.org/").when(k == 2, "HTTPS://DOI.ORG/").when(k == 3, "http://doi.org/").otherwise(""), F.lit("10.5/P"), F.col("id")).alias("doi"))
    b = A.papers(spark, d).select(F.col("id").alias("match"), F.concat(F.lit("10.5/p"), F.col("id")).alias("bare"))
    return p.withColumn("bare", F.lower(bare_doi(F.col("doi")))).join(b, "bare").select("id", "match")


@query("jon18_resolve_two_keys", oracle("papers cites", "WITH q AS (SELECT DISTINCT dst + 7 AS key FROM cites), a AS (SELECT id * 2 AS alt, max(id) AS id FROM papers GROUP BY 1) SELECT key, coalesce(p.id, a.id) AS id FROM q LEFT JOIN (SELECT id FROM papers WHERE id % 3 > 0) p ON p.id = key LEFT JOIN a ON a.alt = key"))
def jon18(spark, d):
    p = A.papers(spark, d)
    return J.resolve_two(A.cites(spark, d).select((F.col("dst") + 7).alias("key")).distinct(), p.where("id % 3 > 0"), p.select((F.col("id") * 2).alias("alt"), "id"))


@query("jon19_reference_priority", oracle("cites papers", """SELECT src, dst, coalesce(p.id, q.id) AS internal FROM cites LEFT JOIN (SELECT id FROM papers WHERE id % 2 = 0) p ON p.id = dst LEFT JOIN (SELECT id FROM papers WHERE id % 3 = 0) q ON '10.5/' || q.id = '10.5/' || dst"""))
def jon19(spark, d):
    p, c = A.papers(spark, d), A.cites(spark, d)
    by_id, by_doi = p.where("id % 2 = 0").select(F.col("id").alias("a")), p.where("id % 3 = 0").select(F.col("id").alias("b"), F.concat(F.lit("10.5/"), F.col("id")).alias("doi"))
    return c.join(by_id, c["dst"] == by_id["a"], "left").withColumn("rdoi", F.concat(F.lit("10.5/"), F.col("dst"))).join(by_doi, F.col("rdoi") == F.col("doi"), "left").select("src", "dst", F.coalesce("a", "b").alias("internal"))


@query("jon20_corpus_citations", oracle("papers", "WITH r AS (SELECT id AS src, unnest([id * 2, id * 3, id]) AS ref FROM papers) SELECT DISTINCT src, p.id AS dst FROM r JOIN papers p ON p.id = ref AND src <> p.id"))
def jon20(spark, d):
    p = A.papers(spark, d)
    r = p.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") * 2, F.col("id") * 3, F.col("id"))).alias("dst"))
    return r.where("src <> dst").join(p.select(F.col("id").alias("dst")), "dst", "left_semi").distinct().select("src", "dst")


@query("jon21_related_researchers", oracle("keywords links researchers", "SELECT DISTINCT l.rid, r.name FROM keywords k JOIN links l ON l.paper_id = k.paper_id JOIN researchers r ON r.rid = l.rid WHERE k.name = 'blue bolt' ORDER BY l.rid LIMIT 20"))
def jon21(spark, d):
    p = A.keywords(spark, d).where("name = 'blue bolt'").select("paper_id")
    return A.links(spark, d).join(p, "paper_id", "left_semi").select("rid").distinct().join(A.researchers(spark, d), "rid").select("rid", "name").orderBy("rid").limit(20)


@query("jon22_similar_papers", oracle("cites papers journals", "SELECT src, dst, p.title, j.title AS journal FROM cites LEFT JOIN papers p ON p.id = dst AND p.id % 2 = 0 LEFT JOIN journals j ON j.id = p.journal_id"))
def jon22(spark, d):
    p = A.papers(spark, d).where("id % 2 = 0").select("id", "title", "journal_id")
    j = A.journals(spark, d).select(F.col("id").alias("jid"), F.col("title").alias("journal"))
    return A.cites(spark, d).join(p, F.col("dst") == F.col("id"), "left").join(j, F.col("journal_id") == F.col("jid"), "left").select("src", "dst", "title", "journal")


@query("jon23_positional_zip", oracle("papers", """SELECT id, pos, CAST(l AS VARCHAR) AS l, r FROM (SELECT id, p - 1 AS pos, [id, id + 1, id + 2][p] AS l, (CASE WHEN id % 2 = 0 THEN [db_code, degree] ELSE [db_code] END)[p] AS r FROM papers, (SELECT unnest([1, 2, 3]) AS p)) WHERE l IS NOT NULL AND r IS NOT NULL"""))
def jon23(spark, d):
    s = lambda n: (F.col("id") + n).cast("string")
    p = A.papers(spark, d).select("id", F.array(s(0), s(1), s(2)).alias("a"), F.when(F.col("id") % 2 == 0, F.array("db_code", "degree")).otherwise(F.array("db_code")).alias("b"))
    return J.positional_pairs(p, "a", "b")


@query("jon24_title_year_match", oracle("papers cites", """WITH r AS (SELECT src AS ref, 'paper ' || (dst % 997) AS t, CASE WHEN dst % 4 = 0 THEN NULL ELSE 1995 + dst % 6 END AS y FROM cites)
  SELECT ref, min(p.id) AS id FROM r JOIN papers p ON lower(p.title) = r.t AND (r.y IS NULL OR p.pubyear IS NULL OR p.pubyear = r.y) GROUP BY ref"""))
def jon24(spark, d):
    c = A.cites(spark, d).select(F.col("src").alias("ref"), F.concat(F.lit("paper "), F.col("dst") % 997).alias("t"), F.when(F.col("dst") % 4 != 0, F.col("dst") % 6 + 1995).alias("y"))
    p = A.papers(spark, d).select("id", F.lower("title").alias("t"), "pubyear")
    return J.title_year_matches(c, p)


@query("jon25_unique_match", oracle("papers", "WITH x AS (SELECT title || coalesce(pubyear, 0) AS t, id FROM papers) SELECT t, min(id) AS id FROM x GROUP BY t HAVING count(DISTINCT id) = 1"))
def jon25(spark, d):
    x = A.papers(spark, d).select(F.concat("title", F.coalesce("pubyear", F.lit(0)).cast("string")).alias("t"), "id")
    return J.unique_matches(x, "t", "id")


@query("jon26_bridge_merge", oracle("ext_links", "WITH b AS (SELECT paper_id AS legacy, rid FROM ext_links) SELECT legacy, min(rid) AS rid FROM b GROUP BY legacy HAVING count(DISTINCT rid) = 1"))
def jon26(spark, d):
    return J.unique_matches(A.links(spark, d, True).select(F.col("paper_id").alias("legacy"), "rid"), "legacy", "rid")


@query("jon27_alias_resolve", oracle("researchers", "WITH q AS (SELECT rid * 2 AS key FROM researchers), a AS (SELECT rid * 2 AS alias, rid FROM researchers WHERE rid % 2 = 1) SELECT key, coalesce(r.rid, a.rid) AS rid FROM q LEFT JOIN researchers r ON r.rid = key LEFT JOIN a ON a.alias = key"))
def jon27(spark, d):
    r = A.researchers(spark, d)
    alias = r.where("rid % 2 = 1").select((F.col("rid") * 2).alias("alt"), F.col("rid").alias("id"))
    return J.resolve_two(r.select((F.col("rid") * 2).alias("key")), r.select(F.col("rid").alias("id")), alias).withColumnRenamed("id", "rid")


@query("jon28_work_list", oracle("papers links", "SELECT id FROM papers p WHERE degree IS NOT NULL AND (id % 2 = 0 OR NOT EXISTS (SELECT 1 FROM links l WHERE l.paper_id = p.id))"))
def jon28(spark, d):
    p = A.papers(spark, d).where("degree IS NOT NULL").select("id")
    return p.where("id % 2 = 0").union(p.join(A.links(spark, d).select(F.col("paper_id").alias("id")), "id", "left_anti")).distinct()


_WORKS = """w AS (SELECT id, degree, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ;; ' ELSE 'A' || author || ';; B' || (author % 7) || ' ;' END AS author, CASE id % 3 WHEN 0 THEN 'X' || journal_name || ';' WHEN 1 THEN ';Y;' || journal_name || '; Z' END AS affiliation,
  CASE WHEN id % 8 = 0 THEN [] WHEN id % 5 = 0 THEN ['C' || author, ' ', NULL, 'D'] END AS names FROM papers WHERE id % 6 <> 0 AND (db_code IN ('DIKO', 'CFKO') OR NOT EXISTS (SELECT 1 FROM links l WHERE l.paper_id = papers.id)))"""


@query("jon28_paired_authors", oracle("papers links", f"""WITH {_WORKS}, p AS (SELECT id, degree, list_filter(list_transform(string_split(coalesce(author, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(list_transform(string_split(coalesce(affiliation, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS f,
  list_filter(list_transform(coalesce(names, []), lambda x: trim(x)), lambda x: x <> '') AS n FROM w), q AS (SELECT id, degree, f, CASE WHEN len(a) > 0 THEN a ELSE n END AS a FROM p), r AS (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM q)
  SELECT id, CAST(i AS INT) AS author_order, a[i] AS author, f[i] AS affiliation, CASE WHEN degree <> '' THEN '단독' END AS role FROM r"""))
def jon28_authors(spark, d):
    """The works of the list: in the corpus with an alternate id (a rule on ids), of two types or without a link."""
    from ..operators.joins import paired_authors

    p, k = A.papers(spark, d).where("id % 6 <> 0"), F.col("id")
    typed = F.coalesce(F.col("db_code").isin("DIKO", "CFKO"), F.lit(False))
    works = p.where(typed).unionByName(p.where(~typed).join(A.links(spark, d).select(F.col("paper_id").alias("id")), "id", "left_anti"))
    author = F.when(k % 4 == 0, None).when(k % 4 == 1, " ;; ").otherwise(F.concat(F.lit("A"), "author", F.lit(";; B"), F.col("author") % 7, F.lit(" ;")))
    at = F.when(k % 3 == 0, F.concat(F.lit("X"), "journal_name", F.lit(";"))).when(k % 3 == 1, F.concat(F.lit(";Y;"), "journal_name", F.lit("; Z")))
    names = F.when(k % 8 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.array(F.concat(F.lit("C"), "author"), F.lit(" "), F.lit(None).cast("string"), F.lit("D")))
    return paired_authors(works.select("id", "degree", author.alias("author"), at.alias("affiliation"), names.alias("names")))


@query("jon29_candidate_match", oracle("researchers", """WITH c AS (SELECT a.rid, b.rid AS cand, row_number() OVER (PARTITION BY a.rid ORDER BY b.rank DESC, b.rid) AS rn, count(*) OVER (PARTITION BY a.rid) AS n, a.dept = b.dept AS same FROM researchers a JOIN researchers b
  ON a.name = b.name AND a.institution = b.institution AND a.rid <> b.rid) SELECT rid, cand, CASE WHEN same THEN 'confirmed' WHEN n = 1 THEN 'inferred' ELSE 'ambiguous' END AS verdict FROM c WHERE rn <= 3"""))
def jon29(spark, d):
    from ..operators.identity import match_candidates

    return match_candidates(A.researchers(spark, d), 3)


_REGISTRY = """c AS (SELECT rid * 10 + x.k AS cand, name, institution, rank + x.k AS articles FROM researchers, (VALUES (1), (2)) x(k) WHERE rid % 4 <> 0 OR x.k = 1), l AS (SELECT rid * 10 + 1 + author_order % 2 AS cand, paper_id FROM links WHERE rid % 3 <> 0)"""


@query("jon29_candidate_choice", oracle("researchers links", f"""WITH {_REGISTRY}, t AS (SELECT *, row_number() OVER (PARTITION BY name, institution ORDER BY articles DESC, cand) AS rn, count(*) OVER (PARTITION BY name, institution) AS n FROM c),
  p AS (SELECT r.rid, t.cand, t.articles, t.n, EXISTS (SELECT 1 FROM links k JOIN l USING (paper_id) WHERE k.rid = r.rid AND l.cand = t.cand) AS ok FROM researchers r JOIN t USING (name, institution) WHERE rn <= 3),
  f AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY ok DESC, articles DESC, cand) AS z FROM p) SELECT rid, cand, CASE WHEN ok OR n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN ok THEN 'confirmed' WHEN n = 1 THEN 'inferred' END AS confidence FROM f WHERE z = 1"""))
def jon29_choice(spark, d):
    """A registry that lists one or two records of everybody, with papers by the parity of the author's place, and none of every third."""
    from ..operators.identity import choose_candidates

    r, l = A.researchers(spark, d), A.links(spark, d)  # noqa: E741
    c = r.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).where("rid % 4 <> 0 OR k = 1").select((F.col("rid") * 10 + F.col("k")).alias("cand"), "name", "institution", (F.col("rank") + F.col("k")).alias("articles"))
    listed = l.where("rid % 3 <> 0").select((F.col("rid") * 10 + 1 + F.col("author_order") % 2).alias("cand"), "paper_id")
    return choose_candidates(r, l, c, listed)


@query("jon30_pending_work", oracle("papers bookmarks", "SELECT DISTINCT 'paper' AS kind, id AS key FROM papers WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM bookmarks b WHERE b.paper_id = papers.id)"))
def jon30(spark, d):
    done = A.bookmarks(spark, d).select(F.lit("paper").alias("kind"), F.col("paper_id").alias("key"))
    return A.papers(spark, d).where("id % 3 = 0").select(F.lit("paper").alias("kind"), F.col("id").alias("key")).distinct().join(done, ["kind", "key"], "left_anti")


@query("jon30_pending_work_whole", oracle("papers bookmarks", "SELECT DISTINCT 'paper' AS kind, id AS key FROM papers WHERE NOT EXISTS (SELECT 1 FROM bookmarks b WHERE b.paper_id = papers.id)"))
def jon30_whole(spark, d):
    done = A.bookmarks(spark, d).select(F.lit("paper").alias("kind"), F.col("paper_id").alias("key"))
    return A.papers(spark, d).select(F.lit("paper").alias("kind"), F.col("id").alias("key")).distinct().join(done, ["kind", "key"], "left_anti")


# Set operations


@query("set01_paper_key_union", oracle("links ext_links", "SELECT paper_id FROM links WHERE rid % 2 = 0 UNION SELECT paper_id FROM ext_links WHERE rid % 3 = 0"))
def set01(spark, d):
    return S.union_distinct(A.links(spark, d).where("rid % 2 = 0").select("paper_id"), A.links(spark, d, True).where("rid % 3 = 0").select("paper_id"))


@query("set02_union_distinct_on", oracle("links ext_links", "SELECT rid, paper_id, src FROM (SELECT *, row_number() OVER (PARTITION BY rid, paper_id ORDER BY src, author_order) AS rn FROM (SELECT *, 1 AS src FROM ext_links UNION ALL SELECT *, 2 AS src FROM links)) WHERE rn = 1"))
def set02(spark, d):
    x = A.links(spark, d, True).withColumn("src", F.lit(1)).unionByName(A.links(spark, d).withColumn("src", F.lit(2)))
    return J.best_by_key(x, ["rid", "paper_id"], [F.col("src").asc(), F.col("author_order").asc()]).select("rid", "paper_id", "src")


@query("set03_reconcile", oracle("links ext_links", "SELECT rid, paper_id, CASE WHEN e IS NULL THEN 'drop' WHEN l IS NULL THEN 'add' ELSE 'keep' END AS action FROM (SELECT rid, paper_id, 1 AS l FROM links WHERE rid % 2 = 0) FULL JOIN (SELECT rid, paper_id, 1 AS e FROM ext_links WHERE rid % 3 = 0) USING (rid, paper_id)"))
def set03(spark, d):
    return S.reconcile(A.links(spark, d).where("rid % 2 = 0").select("rid", "paper_id"), A.links(spark, d, True).where("rid % 3 = 0").select("rid", "paper_id"))


@query("set04_remaining", oracle("cites", "SELECT src % 100 AS g, count(*) AS remaining FROM cites WHERE dst NOT IN (SELECT dst FROM cites WHERE dst % 5 = 0) GROUP BY 1"))
def set04(spark, d):
    c = A.cites(spark, d)
    return S.remaining(c.withColumn("g", F.col("src") % 100), c.where("dst % 5 = 0").select("dst"), "g", "dst")


@query("set05_keyword_union", oracle("keywords", "SELECT paper_id, string_agg(name, '|' ORDER BY CASE lang WHEN 'ko' THEN 0 ELSE 1 END, pos, name) AS keywords FROM keywords GROUP BY 1"))
def set05(spark, d):
    return S.keywords_ko_first(A.keywords(spark, d))


@query("set06_three_way_union", oracle("links cites bookmarks", "SELECT paper_id AS id FROM links WHERE rid % 10 = 0 UNION SELECT dst FROM cites UNION SELECT paper_id FROM bookmarks"))
def set06(spark, d):
    return S.union_distinct(A.links(spark, d).where("rid % 10 = 0").select(F.col("paper_id").alias("id")), A.cites(spark, d).select("dst"), A.bookmarks(spark, d).select("paper_id"))


@query("set06_three_way_union_whole", oracle("links cites bookmarks", "SELECT paper_id AS id FROM links UNION SELECT dst FROM cites UNION SELECT paper_id FROM bookmarks"))
def set06_whole(spark, d):
    return S.union_distinct(A.links(spark, d).select(F.col("paper_id").alias("id")), A.cites(spark, d).select("dst"), A.bookmarks(spark, d).select("paper_id"))


@query("set07_missing_keys", oracle("vecs docs", "SELECT id FROM vecs WHERE id NOT IN (SELECT doc_id FROM docs WHERE doc_id % 2 = 0)"))
def set07(spark, d):
    return A.vecs(spark, d).select("id").join(A.docs(spark, d).where("doc_id % 2 = 0").select(F.col("doc_id").alias("id")), "id", "left_anti")
