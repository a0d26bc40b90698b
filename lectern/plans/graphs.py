"""Queries of graphs, keyword maps, citation graphs and entity resolution."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import oracle
from ..operators import graphs as G
from ..operators import identity as I
from .catalog import query

_COMP = """reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges) e ON e.a = r.b)"""


def _rec(tables: str, body: str) -> str:
    return oracle(tables, body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("grf01_components", _rec("ext_links", f"WITH nodes AS (SELECT DISTINCT rid AS node FROM ext_links), edges AS (SELECT a.rid AS a, b.rid AS b FROM ext_links a JOIN ext_links b ON a.paper_id = b.paper_id AND a.rid < b.rid GROUP BY 1, 2 HAVING count(*) >= 2), {_COMP} SELECT a AS node, min(b) AS comp FROM reach GROUP BY 1"))
def grf01(spark, d):
    l = A.links(spark, d, True).select("rid", "paper_id")  # noqa: E741
    e = l.toDF("a", "paper_id").join(l.toDF("b", "paper_id"), "paper_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2")
    return G.components(l.select("rid").distinct(), e)


@query("grf01_keyword_clusters", _rec("papers keywords", f"""WITH n AS (SELECT author AS session, id AS node, row_number() OVER (PARTITION BY author ORDER BY pubyear DESC NULLS LAST, id) AS place, db_code <> 'CFKO' AS own FROM papers),
  edges AS (SELECT x.node AS a, y.node AS b FROM n x JOIN keywords k ON k.paper_id = x.node JOIN n y ON y.session = x.session AND y.node > x.node JOIN keywords l ON l.paper_id = y.node AND l.name = k.name WHERE x.own AND y.own GROUP BY 1, 2 HAVING count(*) >= 2),
  nodes AS (SELECT node FROM n WHERE own), {_COMP}, c AS (SELECT a AS node, min(b) AS comp FROM reach GROUP BY 1), z AS (SELECT session, comp, row_number() OVER (PARTITION BY session ORDER BY min(place)) AS cluster FROM c JOIN n USING (node) GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT n.session, n.node, z.cluster FROM n LEFT JOIN c ON c.node = n.node LEFT JOIN z ON z.comp = c.comp"""))
def grf01_clusters(spark, d):
    w = Window.partitionBy("author").orderBy(F.col("pubyear").desc_nulls_last(), "id")
    n = A.papers(spark, d).select(F.col("author").alias("session"), F.col("id").alias("node"), F.row_number().over(w).alias("at"), (F.col("db_code") != "CFKO").alias("own"))
    return G.keyword_clusters(n, A.keywords(spark, d))


_DUP = "pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM l a JOIN l b ON a.paper_id = b.paper_id AND a.name = b.name AND a.rid < b.rid GROUP BY 1, 2)"


def _pl(spark, d):
    """Links with papers folded together, so that people share several."""
    return A.links(spark, d).select("rid", (F.col("paper_id") % 400).alias("paper_id")).distinct()


_PL = "l AS (SELECT DISTINCT k.rid, k.paper_id % 400 AS paper_id, r.name FROM links k JOIN researchers r ON r.rid = k.rid)"


@query("grf02_duplicate_groups", _rec("links researchers", f"WITH {_PL}, {_DUP}, nodes AS (SELECT rid AS node FROM researchers), edges AS (SELECT a, b FROM pairs WHERE shared >= 8), {_COMP} SELECT a AS rid, min(b) AS canonical FROM reach GROUP BY 1"))
def grf02(spark, d):
    return I.duplicate_groups(A.researchers(spark, d), _pl(spark, d), 8)


@query("grf03_same_name_merge", _rec("researchers", f"WITH nodes AS (SELECT rid AS node FROM researchers), edges AS (SELECT a.rid AS a, b.rid AS b FROM researchers a JOIN researchers b ON a.name = b.name AND a.rid < b.rid AND (contains(a.institution, b.institution) OR contains(b.institution, a.institution))), {_COMP} SELECT a AS rid, min(b) AS canonical FROM reach GROUP BY 1"))
def grf03(spark, d):
    none = A.researchers(spark, d).limit(0).select("rid", F.col("rid").alias("other"))
    return I.same_name_merge(A.researchers(spark, d), none, 2)


#: Institutions of three kinds and two scripts, and co-authors folded together so that people of one name share some.
_WHO = "w AS (SELECT rid, name, CASE rid % 4 WHEN 0 THEN '가람대학교' WHEN 1 THEN 'Garam University ' || rid % 7 WHEN 2 THEN '나래연구소 ' || rid ELSE '' END AS inst FROM researchers), e AS (SELECT DISTINCT rid, paper_id % 60 AS other FROM links WHERE paper_id % 3 = 0)"
_SHARE = "s AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM e a JOIN e b ON a.other = b.other AND a.rid < b.rid JOIN w x ON x.rid = a.rid JOIN w y ON y.rid = b.rid AND x.name = y.name GROUP BY 1, 2)"


@query("grf03_same_name_merge_evidence", _rec("researchers links", f"""WITH {_WHO}, {_SHARE}, nodes AS (SELECT rid AS node FROM researchers), edges AS (SELECT a.rid AS a, b.rid AS b FROM w a JOIN w b ON a.name = b.name AND a.rid < b.rid LEFT JOIN s ON s.a = a.rid AND s.b = b.rid
  WHERE (a.inst <> '' AND b.inst <> '' AND (contains(a.inst, b.inst) OR contains(b.inst, a.inst))) OR n >= CASE WHEN regexp_matches(a.inst, '[가-힣]') <> regexp_matches(b.inst, '[가-힣]') THEN 3 ELSE 5 END), {_COMP} SELECT a AS rid, min(b) AS canonical FROM reach GROUP BY 1"""))
def grf03_evidence(spark, d):
    k = F.col("rid") % 4
    inst = F.when(k == 0, "가람대학교").when(k == 1, F.concat(F.lit("Garam University "), F.col("rid") % 7)).when(k == 2, F.concat(F.lit("나래연구소 "), "rid")).otherwise("")
    edges = A.links(spark, d).where("paper_id % 3 = 0").select("rid", (F.col("paper_id") % 60).alias("other"))
    return I.same_name_merge(A.researchers(spark, d).withColumn("inst", inst), edges, 5, 3, "inst")


_TWICE = "t AS (SELECT a.rid AS a, b.rid AS b, count(*) AS bad FROM l a JOIN l b ON a.paper_id = b.paper_id AND a.name = b.name AND a.rid < b.rid WHERE a.paper_id % 2 = 0 GROUP BY 1, 2)"


@query("grf02_duplicate_groups_twice", _rec("links researchers", f"WITH {_PL}, {_DUP}, {_TWICE}, nodes AS (SELECT rid AS node FROM researchers), edges AS (SELECT pairs.a, pairs.b FROM pairs LEFT JOIN t ON t.a = pairs.a AND t.b = pairs.b WHERE shared >= 4 AND coalesce(bad, 0) * 2 < shared), {_COMP} SELECT a AS rid, min(b) AS canonical FROM reach GROUP BY 1"))
def grf02_twice(spark, d):
    l = _pl(spark, d)  # noqa: E741
    twice = l.join(A.researchers(spark, d).select("rid", "name"), "rid").where("paper_id % 2 = 0").select("paper_id", "name").distinct()
    return I.duplicate_groups(A.researchers(spark, d), l, 4, twice)


@query("grf04_component_samples")
def grf04_samples(spark, d):
    # As for the components, a test holds the operator against brute force.
    r = A.researchers(spark, d).select("rid", "name")
    x = A.links(spark, d).join(r, "rid").select("name", "paper_id", (F.col("paper_id") % 50 + F.col("rid")).alias("other"))
    return I.component_samples(x)


@query("grf04_name_components")
def grf04(spark, d):
    # The recursive SQL is too slow on the whole table; a test holds the operator against brute force.
    r = A.researchers(spark, d).select("rid", "name")
    x = A.links(spark, d).join(r, "rid").select("name", "paper_id", (F.col("paper_id") % 50 + F.col("rid")).alias("other"))
    return I.name_components(x)


@query("grf05_authorship_judge", oracle("links researchers papers ext_links", """WITH o AS (SELECT a.rid, a.paper_id, b.rid AS other FROM links a JOIN links b ON a.paper_id = b.paper_id AND a.rid <> b.rid), k AS (SELECT DISTINCT a.rid, b.rid AS other FROM ext_links a JOIN ext_links b ON a.paper_id = b.paper_id AND a.rid <> b.rid),
  c AS (SELECT l.rid, l.paper_id, r.institution AS unit, 'Brand#' || p.journal_id AS inst, (SELECT count(DISTINCT other) FROM o WHERE o.rid = l.rid AND o.paper_id = l.paper_id) AS n FROM links l JOIN researchers r ON r.rid = l.rid JOIN papers p ON p.id = l.paper_id),
  s AS (SELECT o.rid, o.paper_id, count(DISTINCT o.other) AS shared FROM o JOIN k ON k.rid = o.rid AND k.other = o.other GROUP BY 1, 2),
  j AS (SELECT c.*, coalesce(contains(inst, unit), false) AS r1, coalesce(shared, 0) >= 2 AS r2 FROM c LEFT JOIN s USING (rid, paper_id)), t AS (SELECT rid, inst FROM j WHERE (r1 OR r2) AND inst IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT paper_id) >= 2)
  SELECT j.rid, paper_id, CASE WHEN n = 0 THEN NULL WHEN r1 THEN 1 WHEN r2 THEN 2 WHEN t.rid IS NOT NULL THEN 3 ELSE 0 END AS rule FROM j LEFT JOIN t ON t.rid = j.rid AND t.inst = j.inst"""))
def grf05(spark, d):
    l, r = A.links(spark, d), A.researchers(spark, d)  # noqa: E741
    others = l.groupBy("paper_id").agg(F.collect_list("rid").alias("all"))
    c = l.join(others, "paper_id").join(r.select("rid", "institution"), "rid").join(A.papers(spark, d).select(F.col("id").alias("paper_id"), "journal_id"), "paper_id")
    c = c.select("rid", F.col("institution").alias("unit"), "paper_id", F.concat(F.lit("Brand#"), F.col("journal_id").cast("string")).alias("institution"), F.array_except("all", F.array("rid")).alias("others"))
    known = A.links(spark, d, True)
    known = known.join(known.select("paper_id", F.col("rid").alias("other")), "paper_id").where("rid <> other").select("rid", "other")
    return I.judged(c, known, 2)


_RENAMES = """s AS (SELECT rid, institution, min(year) AS y0, max(year) AS y1 FROM r GROUP BY 1, 2), m AS (SELECT a.institution AS old, b.institution AS new, count(DISTINCT a.rid) AS people FROM s a JOIN s b ON a.rid = b.rid AND a.institution <> b.institution AND a.y1 <= b.y0 GROUP BY 1, 2 HAVING count(DISTINCT a.rid) >= {least}),
  q AS (SELECT institution AS new, year AS start FROM (SELECT *, row_number() OVER (PARTITION BY institution ORDER BY year, rid) - 1 AS i, count(*) OVER (PARTITION BY institution) AS n FROM r WHERE year IS NOT NULL) WHERE i = floor(n * 0.05))
  SELECT old, new, people FROM m JOIN q USING (new) WHERE (SELECT avg(CASE WHEN year > start + 1 THEN 1.0 ELSE 0.0 END) FROM r WHERE institution = old AND year IS NOT NULL) <= {late}"""


@query("grf06_institution_renames_of_links", oracle("links papers", f"WITH r AS (SELECT rid, 'I' || CASE WHEN pubyear < 1995 THEN rid % 6 ELSE rid % 6 + 3 END AS institution, pubyear AS year FROM links JOIN papers ON id = paper_id), {_RENAMES.format(least=3, late=0.5)}"))
def grf06_links(spark, d):
    """Institutions whose name depends on the year, so that many people move and few old names stay in use."""
    p = A.papers(spark, d).select(F.col("id").alias("paper_id"), F.col("pubyear").alias("year"))
    inst = F.concat(F.lit("I"), (F.when(F.col("year") < 1995, F.col("rid") % 6).otherwise(F.col("rid") % 6 + 3)).cast("string"))
    return I.renamed_institutions(A.links(spark, d).join(p, "paper_id").select("rid", inst.alias("institution"), "year"), 3, 0.5, 0.05)


@query("grf06_institution_renames", oracle("papers", f"WITH r AS (SELECT author AS rid, degree AS institution, pubyear AS year FROM papers WHERE degree IS NOT NULL), {_RENAMES.format(least=3, late=1.0)}"))
def grf06(spark, d):
    return I.renamed_institutions(A.papers(spark, d).select(F.col("author").alias("rid"), F.col("degree").alias("institution"), F.col("pubyear").alias("year")).where("institution IS NOT NULL"), 3, 1.0, 0.05)


_TR = "t AS (SELECT rid, paper_id % 5 AS author_id FROM links WHERE author_order <= 2), o AS (SELECT paper_id % 5 AS author_id, count(*) AS m FROM links GROUP BY 1)"
_MODAL = f"{_TR}, n AS (SELECT rid, author_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY rid) AS t FROM t GROUP BY 1, 2), m AS (SELECT rid, author_id FROM (SELECT n.*, row_number() OVER (PARTITION BY rid ORDER BY n DESC, m DESC, n.author_id DESC) AS rn FROM n JOIN o USING (author_id)) WHERE rn = 1 AND n >= 0.5 * t)"


def _modal(spark, d):
    l = A.links(spark, d).withColumn("author_id", F.col("paper_id") % 5)  # noqa: E741
    return I.modal_id(l.where("author_order <= 2").select("rid", "author_id"), l.select("author_id"), 0.5)


@query("grf07_modal_author_id", oracle("links", f"WITH {_MODAL} SELECT * FROM m"))
def grf07(spark, d):
    return _modal(spark, d)


_KIDS = """e AS (SELECT k1 AS a, k2 AS b, n FROM related UNION ALL SELECT k2, k1, n FROM related), kids AS (SELECT a AS anchor, b AS child, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM e JOIN key_counts ca ON ca.name = a JOIN key_counts cb ON cb.name = b WHERE cb.papers <= ca.papers)"""



@query("grf08_keyword_map", oracle("related key_counts", f"""WITH {_KIDS}, k AS (SELECT * FROM kids WHERE rank <= 6), h AS (SELECT ca.name AS anchor, count(*) FILTER (cb.papers < ca.papers) > 0 AS more FROM key_counts ca JOIN e ON e.a = ca.name JOIN key_counts cb ON cb.name = e.b GROUP BY 1)
  SELECT anchor, child, n, CAST(rank AS INT) AS rank, coalesce(more, false) AS has_more FROM k LEFT JOIN h ON h.anchor = k.child""".replace("SELECT anchor, child", "SELECT k.anchor, k.child")))
def grf08(spark, d):
    r, c = A.related(spark, d), A.key_counts(spark, d)
    kids = G.anchor_children(r, c, c, 6)
    every = G.anchor_children(r, c, c, 1 << 30).where("pb < pa").select(F.col("anchor").alias("child"), F.lit(True).alias("more")).distinct()
    return kids.join(every, "child", "left").select("anchor", "child", "n", "rank", F.coalesce("more", F.lit(False)).alias("has_more"))


@query("grf08_map_with_more", oracle("related key_counts", f"""WITH {_KIDS}, k AS (SELECT * FROM kids WHERE rank <= 6), pl AS (SELECT anchor, child AS b FROM k UNION SELECT anchor, anchor FROM k)
  SELECT k.anchor, k.child, k.n, CAST(k.rank AS INT) AS rank, EXISTS (SELECT 1 FROM kids g WHERE g.anchor = k.child AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.anchor = k.anchor AND pl.b = g.child)) AS has_more,
    EXISTS (SELECT 1 FROM kids g JOIN key_counts x ON x.name = g.anchor JOIN key_counts y ON y.name = g.child WHERE g.anchor = k.anchor AND y.papers < x.papers) AS anchor_more FROM k"""))
def grf08_more(spark, d):
    c = A.key_counts(spark, d)
    return G.map_with_more(A.related(spark, d), c, c, 6)


@query("grf08_hubs", oracle("related key_counts", f"""WITH {_KIDS}, k AS (SELECT * FROM kids WHERE rank <= 6), x AS (SELECT x.anchor, r.k1, r.k2 FROM related r JOIN k x ON x.child = r.k1 JOIN k y ON y.child = r.k2 AND y.anchor = x.anchor)
  SELECT anchor, child, count(*) AS links FROM (SELECT anchor, k1 AS child FROM x UNION ALL SELECT anchor, k2 FROM x) GROUP BY 1, 2 HAVING count(*) >= 3"""))
def grf08_hubs(spark, d):
    r, c = A.related(spark, d), A.key_counts(spark, d)
    return G.cross_links(G.anchor_children(r, c, c, 6), r)[1]


@query("grf08_cross_links", oracle("related key_counts", f"WITH {_KIDS}, k AS (SELECT * FROM kids WHERE rank <= 6) SELECT x.anchor, r.k1, r.k2, r.n FROM related r JOIN k x ON x.child = r.k1 JOIN k y ON y.child = r.k2 AND y.anchor = x.anchor"))
def grf08b(spark, d):
    r, c = A.related(spark, d), A.key_counts(spark, d)
    return G.cross_links(G.anchor_children(r, c, c, 6), r)[0]


_SHOWN = ("blue bolt", "red bolt", "old bolt", "hot gear")


@query("grf09_recenter", oracle("related key_counts", f"WITH {_KIDS} SELECT child AS name, n, rank > 6 AS carried FROM kids WHERE anchor = 'small ring' AND (rank <= 6 OR child IN {_SHOWN}) ORDER BY carried, n DESC, name LIMIT 25"))
def grf09(spark, d):
    return G.recenter(A.related(spark, d), A.key_counts(spark, d), "small ring", list(_SHOWN))


@query("grf10_expand_node", oracle("related key_counts", f"WITH {_KIDS} SELECT child, n FROM kids WHERE anchor = 'small ring' AND child NOT IN {_SHOWN} ORDER BY n DESC, child LIMIT 3"))
def grf10(spark, d):
    return G.expand(A.related(spark, d), A.key_counts(spark, d), "small ring", list(_SHOWN), 3)


_CG = "x AS (SELECT src % 200 AS src, dst, pubyear AS year, title, CASE WHEN db_code = 'JAKO' THEN 0 ELSE 1 END AS o FROM cites JOIN papers ON id = dst), g AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY o, year DESC NULLS LAST, title, dst) AS rank, count(*) OVER (PARTITION BY src) AS t FROM x)"


def _cg(spark, d):
    x = A.cites(spark, d).join(A.papers(spark, d), F.col("dst") == F.col("id")).select((F.col("src") % 200).alias("src"), "dst", F.col("pubyear").alias("year"), "title", "db_code")
    return x.where("db_code = 'JAKO'").drop("db_code"), x.where("db_code <> 'JAKO'").drop("db_code")


@query("grf10_expand_with_links", oracle("related key_counts keywords", f"""WITH {_KIDS}, req AS (SELECT paper_id AS session, arg_min(name, (pos, name)) AS node FROM keywords GROUP BY 1), pl AS (SELECT paper_id AS session, name FROM keywords),
  l AS (SELECT session, node, child, n, row_number() OVER (PARTITION BY session ORDER BY n DESC, child) AS seq, count(*) OVER (PARTITION BY session) > 3 AS pm FROM req JOIN kids ON anchor = node
    WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.session = req.session AND pl.name = child)), new AS (SELECT * FROM l WHERE seq <= 3), every AS (SELECT * FROM pl UNION SELECT session, child FROM new),
  x AS (SELECT DISTINCT session, least(child, name) AS k1, greatest(child, name) AS k2, pm FROM new JOIN every USING (session) WHERE name <> child AND name <> node)
  SELECT session, CASE WHEN child IS NULL THEN 'none' ELSE 'tree' END AS kind, req.node AS source, child AS target, n, CASE WHEN child IS NOT NULL THEN EXISTS (SELECT 1 FROM kids k WHERE k.anchor = new.child
    AND NOT EXISTS (SELECT 1 FROM every v WHERE v.session = new.session AND v.name = k.child)) END AS has_more, coalesce(pm, false) AS parent_has_more FROM req LEFT JOIN new USING (session)
  UNION ALL SELECT session, 'cross_link', k1, k2, n, NULL, pm FROM x JOIN related USING (k1, k2)"""))
def grf10_links(spark, d):
    """Each paper is a session that shows its keywords and opens the first of them."""
    k = A.keywords(spark, d)
    requests = k.groupBy(F.col("paper_id").alias("session")).agg(F.min_by("name", F.struct("pos", "name")).alias("node"))
    return G.expand_with_links(A.related(spark, d), A.key_counts(spark, d), requests, k.select(F.col("paper_id").alias("session"), "name"))


@query("grf11_citation_graph", oracle("cites papers", f"WITH {_CG} SELECT src, dst, CASE o WHEN 0 THEN 'own' ELSE 'external' END AS origin, CAST(rank AS INT) AS rank, t > 12 AS has_more FROM g WHERE rank <= 12"))
def grf11(spark, d):
    return G.citation_graph(*_cg(spark, d), 12)


@query("grf12_citation_expand", oracle("cites papers", f"WITH {_CG} SELECT src, dst, CAST(rank AS INT) AS rank FROM g WHERE rank > 12 AND rank <= 18"))
def grf12(spark, d):
    return G.citation_graph(*_cg(spark, d), 18).where("rank > 12").select("src", "dst", "rank")


@query("grf12_growing_graph")
def grf12_growing(spark, d):
    """Each source opens the 40 papers it cites first, one after the other, then itself six times, in a graph that shows its own node at first."""
    from ..operators.sessions import growing_graph

    inside, outside = _cg(spark, d)
    x = inside.select("src", "dst").union(outside.select("src", "dst")).distinct()
    w = Window.partitionBy("src").orderBy("dst")
    clicks = x.select("src", (F.row_number().over(w) + 6).alias("step"), (F.col("dst") % 200).alias("node")).where("step <= 46")
    own = x.select("src").distinct().select("src", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("step"), F.col("src").alias("node"))
    steps = own.union(clicks.select("src", "step", "node")).withColumnRenamed("src", "session")
    return growing_graph(steps, steps.select("session", F.col("session").alias("node")).distinct(), inside, outside)


@query("grf13_star_graph", oracle("researchers", "SELECT 'field' AS field, rid, round(greatest(0, least(1, price / 1000)), 6) AS weight FROM researchers"))
def grf13(spark, d):
    return G.star_graph("field", A.researchers(spark, d).withColumnRenamed("price", "score"), 1000.0).withColumn("weight", F.round("weight", 6))


@query("grf14_materialise", oracle("cites papers", "WITH a AS (SELECT id * 2 AS external, id FROM papers) SELECT src, a.id AS dst, true AS edge FROM cites JOIN a ON external = dst WHERE src <> a.id UNION SELECT src, dst, false FROM cites WHERE dst NOT IN (SELECT external FROM a)"))
def grf14(spark, d):
    refs = A.cites(spark, d).withColumnRenamed("dst", "external")
    edges, rest = G.materialised(refs, A.papers(spark, d).select((F.col("id") * 2).alias("external"), "id"))
    return edges.withColumn("edge", F.lit(True)).union(rest.select("src", F.col("external").alias("dst"), F.lit(False))).distinct()


@query("grf15_common_keywords", oracle("links keywords", """WITH p AS (SELECT a.rid AS a, b.rid AS b, a.paper_id FROM links a JOIN links b ON a.paper_id = b.paper_id AND a.rid < b.rid), n AS (SELECT a, b, count(*) AS shared FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
  k AS (SELECT a, b, name, count(*) AS c, max(paper_id) AS last FROM p JOIN n USING (a, b) JOIN keywords USING (paper_id) GROUP BY 1, 2, 3) SELECT a, b, name FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY (c >= 2) DESC, CASE WHEN c >= 2 THEN c ELSE 0 END DESC, last DESC, name) AS rn FROM k) WHERE rn <= 3"""))
def grf15(spark, d):
    from ..operators.researchers import common_keywords

    return common_keywords(A.links(spark, d), A.keywords(spark, d), 2, 3)


@query("grf15_keyword_slots")
def grf15_slots(spark, d):
    """Three slots for each pair; keywords that share a first word and differ in script are of one meaning. Every other name is put into Hangul."""
    from ..operators.researchers import keyword_slots

    k = A.keywords(spark, d).withColumn("name", F.when(F.col("lang") == "ko", F.concat(F.lit("가"), F.col("name"))).otherwise(F.col("name"))).select("paper_id", "pos", "name")
    groups = k.select("name").distinct().select("name", F.split(F.ltrim(F.translate("name", "가", "")), " ")[0].alias("meaning"))
    return keyword_slots(A.links(spark, d), k, groups, 3)


@query("grf16_research_flow")
def grf16(spark, d):
    from ..operators.researchers import research_flow

    v = A.vecs(spark, d).select((F.col("id") % 20).alias("g"), "id", "v")
    p = A.papers(spark, d).select("id", F.col("pubyear").alias("year"), "title")
    return research_flow(v.join(p, "id"), A.keywords(spark, d))


@query("grf16_flow_summary")
def grf16_summary(spark, d):
    """The sentence of each person's clusters."""
    from ..operators.clustering import agglomerative
    from ..operators.researchers import flow_summary

    v = A.vecs(spark, d).select((F.col("id") % 20).alias("g"), "id", "v")
    p = A.papers(spark, d).select("id", F.col("pubyear").alias("year"))
    return flow_summary(agglomerative(v, 0.6).join(p, "id").select("g", "label", "id", "year"), A.keywords(spark, d))


_ENDS = ("주로 ", " 관련 연구를 해왔어요.", " 관련 연구가 대부분이에요.")


@query("grf16_label_summary", oracle("vecs papers keywords", f"""WITH p AS (SELECT id % 200 AS g, label, id, pubyear AS year FROM vecs JOIN papers USING (id)), s AS (SELECT g, label, count(*) AS n, max(year) AS y, max(id) AS last, min(id) AS first FROM p GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y DESC NULLS LAST, last DESC, n DESC, first) AS rank FROM s), k AS (SELECT g, label, name, count(*) AS c, min((id, pos)) AS first FROM p JOIN keywords ON paper_id = id GROUP BY 1, 2, 3),
  w AS (SELECT g, label, list(name ORDER BY c DESC, first, name)[1:6] AS names FROM k GROUP BY 1, 2), t AS (SELECT g, count(*) AS clusters, list(names ORDER BY n DESC, rank) AS a, list(names[1] ORDER BY n DESC, rank) FILTER (names IS NOT NULL) AS h FROM o LEFT JOIN w USING (g, label) GROUP BY 1),
  c AS (SELECT g, clusters, list_transform([3, 2, 1], lambda m: CASE WHEN len(h) >= m THEN '{_ENDS[0]}' || array_to_string(h[1:m], ', ') || '{_ENDS[1]}' END) AS many, a[1][1] || CASE WHEN a[1][2] IS NULL THEN '' ELSE ' · ' || a[1][2] END || '{_ENDS[2]}' AS two, a[1][1] || '{_ENDS[2]}' AS one FROM t)
  SELECT g, clusters, CASE WHEN clusters = 1 THEN CASE WHEN length(two) <= 100 THEN two ELSE one END ELSE list_filter(many, lambda x: length(x) <= 100)[1] END AS sentence FROM c"""))
def grf16_labels(spark, d):
    """The same for the given labels."""
    from ..operators.researchers import flow_summary

    p = A.papers(spark, d).select("id", F.col("pubyear").alias("year"))
    return flow_summary(A.vecs(spark, d).select((F.col("id") % 200).alias("g"), "label", "id").join(p, "id"), A.keywords(spark, d))


@query("grf17_weak_pairs", oracle("links researchers", f"WITH {_PL}, {_DUP}, {_MODAL} SELECT p.a, p.b, CASE WHEN x.author_id IS NULL OR y.author_id IS NULL THEN 'undecided' WHEN x.author_id = y.author_id THEN 'same' ELSE 'different' END AS verdict FROM pairs p LEFT JOIN m x ON x.rid = p.a LEFT JOIN m y ON y.rid = p.b WHERE shared < 3"))
def grf17(spark, d):
    return I.weak_pairs(A.researchers(spark, d), _pl(spark, d), _modal(spark, d), 3)


@query("grf18_keyword_graph", oracle("related key_counts", "WITH e AS (SELECT k1 AS a, k2 AS b, n FROM related UNION ALL SELECT k2, k1, n FROM related) SELECT a AS centre, b AS name, n, papers FROM e JOIN key_counts ON name = b WHERE a = 'blue bolt' AND n >= 2 ORDER BY n DESC, b LIMIT 12"))
def grf18(spark, d):
    return G.keyword_graph(A.related(spark, d), A.key_counts(spark, d), "blue bolt", 12, 2)
