"""Queries of the derived columns, with the SQL that checks them."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import oracle
from ..operators import projections as P
from .catalog import query

_DIG = "regexp_replace(coalesce(pubdate, ''), '[^0-9]', '', 'g')"
_DISPLAY = f"CASE WHEN length(g) >= 8 THEN substr(g,1,4)||'-'||substr(g,5,2)||'-'||substr(g,7,2) WHEN length(g) >= 6 THEN substr(g,1,4)||'-'||substr(g,5,2) WHEN length(g) >= 4 THEN substr(g,1,4) ELSE CAST(pubyear AS VARCHAR) END"
_TYPE = "CASE WHEN db_code = 'DIKO' THEN CASE WHEN contains(degree, '박사') THEN 'thesis_phd' WHEN contains(degree, '석사') THEN 'thesis_master' ELSE 'thesis' END WHEN db_code = 'CFKO' THEN 'conference' ELSE 'journal' END"
_LABEL = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in P.LABELS.items()) + " END"


@query("prj01_search_item", oracle("papers", """, x AS (SELECT id, title, CAST(pubyear AS VARCHAR) AS y, db_code || '; ' || coalesce(degree, ' ') || ';k' AS kw, lpad(CAST(id AS VARCHAR), 8, '0') || ';x' AS i, id / 7.0 AS s FROM papers)
  SELECT id, trim(title) AS title, array_to_string(list_filter(list_transform(string_split(kw, ';'), lambda z: trim(z)), lambda z: z <> ''), '|') AS keywords,
  CASE WHEN regexp_matches(y, '^[0-9]+$') THEN CAST(y AS INTEGER) END AS year, string_split(i, ';')[1] AS issn, round(s, 4) AS score FROM x""".replace(", x AS", "WITH x AS", 1)))
def prj01(spark, d):
    p = A.papers(spark, d)
    kw = F.concat(F.col("db_code"), F.lit("; "), F.coalesce("degree", F.lit(" ")), F.lit(";k"))
    item = P.search_item(F.col("title"), kw, F.col("pubyear").cast("string"), F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(";x")), F.col("id") / 7.0)
    return p.select("id", item.alias("i")).select("id", "i.*")


@query("prj02_display_date", oracle("papers", f"SELECT id, {_DISPLAY} AS published_at FROM (SELECT *, {_DIG} AS g FROM papers)"))
def prj02(spark, d):
    return A.papers(spark, d).select("id", P.display_date(F.col("pubdate"), F.col("pubyear")).alias("published_at"))


@query("prj03_strict_date", oracle("papers", f"""SELECT id, CASE WHEN length(g) >= 8 AND substr(g,1,4) BETWEEN '1900' AND '2100' AND substr(g,5,2) BETWEEN '01' AND '12' AND substr(g,7,2) BETWEEN '01' AND '31'
  THEN substr(g,1,4)||'-'||substr(g,5,2)||'-'||substr(g,7,2) END AS day FROM (SELECT *, {_DIG} AS g FROM papers)"""))
def prj03(spark, d):
    return A.papers(spark, d).select("id", P.strict_date(F.col("pubdate")).alias("day"))


@query("prj04_source_date", oracle("papers", """SELECT id, CASE WHEN length(pubdate) >= 10 AND db_code NOT IN ('CFKO') THEN translate(substr(pubdate, 1, 10), '.', '-')
  WHEN pubyear IS NOT NULL AND regexp_matches(pubmonth, '^[0-9]{1,2}$') THEN CAST(pubyear AS VARCHAR) || '-' || lpad(pubmonth, 2, '0') ELSE CAST(pubyear AS VARCHAR) END AS published_at FROM papers"""))
def prj04(spark, d):
    return A.papers(spark, d).select("id", P.source_date(F.col("pubyear"), F.col("pubmonth"), F.col("pubdate"), F.col("db_code"), ("CFKO",)).alias("published_at"))


@query("prj05_loader_date", oracle("papers", """SELECT id, CASE WHEN regexp_matches(pubdate, '^[0-9]{8}$') THEN substr(pubdate,1,4)||'.'||substr(pubdate,5,2)||'.'||substr(pubdate,7,2)
  WHEN regexp_matches(pubdate, '^[0-9]{6}$') THEN substr(pubdate,1,4)||'.'||substr(pubdate,5,2)||'.01' END AS pubdate FROM papers"""))
def prj05(spark, d):
    return A.papers(spark, d).select("id", P.loader_date(F.col("pubdate")).alias("pubdate"))


@query("prj06_deepest_date", oracle("papers", """WITH x AS (SELECT id, year(created) AS y, month(created) AS m, day(created) AS dd FROM papers)
  SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN y||'-'||lpad(CAST(m AS VARCHAR),2,'0')||'-'||lpad(CAST(dd AS VARCHAR),2,'0') WHEN id % 3 = 0 THEN CAST(y AS VARCHAR)
  WHEN id % 3 = 1 THEN y||'-'||lpad(CAST(m AS VARCHAR),2,'0')||CASE WHEN id % 2 = 0 THEN '-'||lpad(CAST(dd AS VARCHAR),2,'0') ELSE '' END
  ELSE CASE WHEN id % 2 = 0 THEN y||'-'||lpad(CAST(m AS VARCHAR),2,'0')||'-'||lpad(CAST(dd AS VARCHAR),2,'0') ELSE (y+1)||'-01-02' END END AS published_at FROM x"""))
def prj06(spark, d):
    # issued: a year, a year and month, or nothing; the other date is full, in the same year (even ids) or a later one.
    y, m, dd, k = F.year("created"), F.month("created"), F.dayofmonth("created"), F.col("id")
    issued = F.when(k % 3 == 0, F.array(y)).when(k % 3 == 1, F.array(y, m))
    other = F.when(k % 2 == 0, F.array(y, m, dd)).otherwise(F.array(y + 1, F.lit(1), F.lit(2)))
    return A.papers(spark, d).select("id", P.deepest_date(issued, [other]).alias("published_at"))


@query("prj07_paper_type", oracle("papers", f"SELECT id, kind, {_LABEL} AS label FROM (SELECT id, {_TYPE} AS kind FROM papers)"))
def prj07(spark, d):
    k = P.paper_type(F.col("db_code"), F.col("degree"))
    return A.papers(spark, d).select("id", k.alias("kind"), P.mapped(P.LABELS, k).alias("label"))


@query("prj08_reclassify", oracle("papers", """WITH x AS (SELECT *, CASE id % 4 WHEN 0 THEN 'thesis_excluded' WHEN 1 THEN 'excluded_non_stem' END AS cur FROM papers)
  SELECT id, CASE WHEN db_code IN ('JAKO','JAFO') AND (cur IS NULL OR cur NOT IN ('journal','excluded_non_stem')) THEN 'journal' WHEN db_code='DIKO' AND degree='국내박사' AND (cur IS NULL OR cur='thesis_excluded') THEN 'doctoral_thesis'
  WHEN db_code='DIKO' AND degree='국내석사' AND (cur IS NULL OR cur='thesis_excluded') THEN 'master_thesis' ELSE cur END AS paper_type FROM x"""))
def prj08(spark, d):
    cur = F.when(F.col("id") % 4 == 0, "thesis_excluded").when(F.col("id") % 4 == 1, "excluded_non_stem")
    return A.papers(spark, d).select("id", P.reclassified(cur, F.col("db_code"), F.col("degree")).alias("paper_type"))


_KIND = "CASE id % 5 WHEN 0 THEN ' Journal-Article ' WHEN 1 THEN 'book' WHEN 2 THEN 'dataset' WHEN 3 THEN 'DISSERTATION' END"


@query("prj09_external_label", oracle("papers", f"SELECT id, CASE lower(trim({_KIND})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.EXTERNAL_LABELS.items()) + " END AS label FROM papers"))
def prj09(spark, d):
    k = F.col("id") % 5
    kind = F.when(k == 0, " Journal-Article ").when(k == 1, "book").when(k == 2, "dataset").when(k == 3, "DISSERTATION")
    return A.papers(spark, d).select("id", P.mapped(P.EXTERNAL_LABELS, F.lower(F.trim(kind))).alias("label"))


_J = "SELECT p.id, p.db_code, p.citation_count AS c, j.title AS jn, upper(j.quartile) AS q, coalesce(j.sci_indexed, false) AS sci, p.db_code = 'JAKO' OR coalesce(j.kci_indexed, false) AS kci FROM papers p LEFT JOIN journals j ON p.journal_id = j.id"


@query("prj10_credibility", oracle("papers journals", f"""WITH x AS ({_J}), a AS (SELECT *, CASE WHEN c >= 50 THEN 'high' WHEN c >= 10 THEN 'medium' WHEN c IS NOT NULL THEN 'low' ELSE 'unknown' END AS b0 FROM x),
  b AS (SELECT *, CASE WHEN q IN ('Q1','Q2') THEN 'high' WHEN q IN ('Q3','Q4') AND b0 <> 'high' THEN 'medium' ELSE b0 END AS b1 FROM a), e AS (SELECT *, (sci OR kci) AND b1 NOT IN ('high','medium') AS ix FROM b),
  f AS (SELECT *, CASE WHEN ix THEN 'medium' ELSE b1 END AS b2 FROM e)
  SELECT id, CASE WHEN b2 = 'unknown' AND jn IS NOT NULL THEN 'medium' ELSE b2 END AS badge,
  coalesce(nullif(concat_ws(' / ', 'citation_count=' || c, CASE WHEN q IN ('Q1','Q2') OR (q IN ('Q3','Q4') AND b0 <> 'high') THEN 'SJR ' || q END, CASE WHEN ix AND sci THEN 'SCI indexed' END, CASE WHEN ix AND kci THEN 'KCI registered' END,
    CASE WHEN b2 = 'unknown' AND jn IS NOT NULL THEN 'journal metadata present' END), ''), 'No citation or journal evidence available.') AS summary FROM f"""))
def prj10(spark, d):
    p, j = A.papers(spark, d), A.journals(spark, d).withColumnsRenamed({"id": "jid", "title": "jtitle"})
    c = P.credibility(F.col("citation_count"), F.col("jtitle"), F.col("quartile"), F.col("sci_indexed"), F.col("kci_indexed"), F.col("db_code") == "JAKO")
    return p.join(j, F.col("journal_id") == F.col("jid"), "left").select("id", c.alias("c")).select("id", "c.*")


@query("prj11_thesis_credibility", oracle("papers", f"""SELECT id, CASE WHEN contains(degree, '박사') THEN 'medium' WHEN contains(degree, '석사') THEN 'low' ELSE 'unknown' END AS badge,
  CASE WHEN contains(degree, '박사') THEN '{P.LABELS["thesis_phd"]}' WHEN contains(degree, '석사') THEN '{P.LABELS["thesis_master"]}' ELSE '{P.LABELS["thesis"]}' END || ' / ' || journal_name AS summary FROM papers WHERE db_code = 'DIKO'"""))
def prj11(spark, d):
    return A.papers(spark, d).where("db_code = 'DIKO'").select("id", P.thesis_credibility(F.col("degree"), F.col("journal_name")).alias("c")).select("id", "c.*")


@query("prj12_trust_badge", oracle("papers journals", f"""WITH x AS (SELECT p.*, j.kci_indexed, j.sci_indexed, j.if_value, {_TYPE} AS kind FROM papers p LEFT JOIN journals j ON p.journal_id = j.id), y AS (SELECT *, kind IN ('thesis_phd','thesis_master') AS th FROM x)
  SELECT id, CASE kind WHEN 'thesis_phd' THEN '박사' WHEN 'thesis_master' THEN '석사' END AS degree_type, CASE WHEN th THEN journal_name END AS institution, CASE WHEN NOT th THEN CASE WHEN db_code = 'JAKO' THEN true ELSE kci_indexed END END AS kci,
  CASE WHEN NOT th THEN sci_indexed END AS sci, CASE WHEN NOT th THEN citation_count END AS citation_count, CASE WHEN NOT th THEN CAST(if_value AS DOUBLE) END AS if_value FROM y"""))
def prj12(spark, d):
    p, j = A.papers(spark, d), A.journals(spark, d).select(F.col("id").alias("jid"), "kci_indexed", "sci_indexed", "if_value")
    b = P.trust_badge(P.paper_type(F.col("db_code"), F.col("degree")), F.col("journal_name"), F.col("kci_indexed"), F.col("sci_indexed"), F.col("citation_count"), F.col("if_value").cast("double"), F.col("db_code") == "JAKO")
    return p.join(j, F.col("journal_id") == F.col("jid"), "left").select("id", b.alias("b")).select("id", "b.*")


@query("prj12_trust_badge_full_text", oracle("papers journals", f"""WITH x AS (SELECT p.*, j.kci_indexed, j.sci_indexed, j.if_value, {_TYPE} AS kind FROM papers p LEFT JOIN journals j ON p.journal_id = j.id), y AS (SELECT *, kind IN ('thesis_phd','thesis_master') AS th FROM x)
  SELECT id, CASE kind WHEN 'thesis_phd' THEN '박사' WHEN 'thesis_master' THEN '석사' END AS degree_type, CASE WHEN th THEN journal_name END AS institution, CASE WHEN NOT th THEN CASE WHEN db_code = 'JAKO' THEN true ELSE kci_indexed END END AS kci,
  CASE WHEN NOT th THEN sci_indexed END AS sci, CASE WHEN NOT th THEN citation_count END AS citation_count, CASE WHEN NOT th THEN CAST(if_value AS DOUBLE) END AS if_value, CASE WHEN th THEN pubdate LIKE '%-%' END AS full_text_available FROM y"""))
def prj12_full_text(spark, d):
    """With full texts: those of papers with a full date, as the test tables have no such column."""
    p, j = A.papers(spark, d), A.journals(spark, d).select(F.col("id").alias("jid"), "kci_indexed", "sci_indexed", "if_value")
    b = P.trust_badge(P.paper_type(F.col("db_code"), F.col("degree")), F.col("journal_name"), F.col("kci_indexed"), F.col("sci_indexed"), F.col("citation_count"), F.col("if_value").cast("double"), F.col("db_code") == "JAKO", F.col("pubdate").contains("-"))
    return p.join(j, F.col("journal_id") == F.col("jid"), "left").select("id", b.alias("b")).select("id", "b.*")


@query("prj13_paper_cards", oracle("papers journals", f"""SELECT p.id, p.title, {_TYPE} AS kind, coalesce(j.title, p.journal_name) AS journal, coalesce(p.citation_count, 0) AS citations, p.db_code = 'JAKO' OR coalesce(j.kci_indexed, false) AS registered,
  coalesce(j.sci_indexed, false) AS sci FROM papers p LEFT JOIN journals j ON p.journal_id = j.id"""))
def prj13(spark, d):
    from ..operators.joins import paper_cards

    return paper_cards(A.papers(spark, d), A.journals(spark, d))


@query("prj14_first_filled", oracle("ext_links papers", """WITH x AS (SELECT l.rid, l.paper_id AS o, p.pubyear, p.citation_count, p.degree FROM ext_links l JOIN papers p ON p.id = l.paper_id)
  SELECT rid, min_by(pubyear, o) FILTER (pubyear IS NOT NULL AND pubyear <> 0) AS pubyear, min_by(citation_count, o) FILTER (citation_count IS NOT NULL AND citation_count <> 0) AS citation_count,
  min_by(degree, o) FILTER (degree IS NOT NULL) AS degree FROM x GROUP BY rid"""))
def prj14(spark, d):
    x = A.links(spark, d, external=True).join(A.papers(spark, d), F.col("paper_id") == F.col("id"))
    return P.first_filled(x, "rid", "paper_id", ["pubyear", "citation_count", "degree"])


@query("prj15_visible_email", oracle("researchers", "SELECT rid, CASE WHEN dept IN ('STANDARD','PROMO') THEN name || '@x' END AS email FROM researchers"))
def prj15(spark, d):
    return A.researchers(spark, d).select("rid", F.when(F.col("dept").isin("STANDARD", "PROMO"), F.concat("name", F.lit("@x"))).alias("email"))


@query("prj16_department", oracle("researchers", """SELECT rid, coalesce(dp, institution) AS text, CASE WHEN dp IS NOT NULL THEN 'department' ELSE 'institution' END AS source
  FROM (SELECT *, CASE WHEN rid % 3 = 0 THEN NULL WHEN rid % 3 = 1 THEN nullif(trim('  '), '') ELSE dept END AS dp FROM researchers)"""))
def prj16(spark, d):
    r = F.col("rid") % 3
    dept = F.when(r == 1, "  ").when(r == 2, F.concat(F.lit(" "), F.col("dept")))
    return A.researchers(spark, d).select("rid", P.department(dept, F.col("institution")).alias("x")).select("rid", "x.*")


@query("prj17_detail_id", oracle("papers", "SELECT id, CASE WHEN id % 3 = 0 THEN 'P' || id WHEN id % 3 = 1 THEN 'ART' || id END AS detail_id FROM papers"))
def prj17(spark, d):
    k = F.col("id")
    ext = F.concat(F.when(k % 3 == 2, "X").otherwise("ART"), k.cast("string"))
    return A.papers(spark, d).select("id", P.detail_id(F.when(k % 3 == 0, F.concat(F.lit("P"), k)), ext).alias("detail_id"))


_MODEL = "CASE user_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'small-fast-2' WHEN 2 THEN 'large-x' ELSE 'other' END"


@query("prj18_llm_cost", f"""SELECT event_id, trunc(CAST(event_id % 900 * p + event_id % 300 * q + event_id % 70 * p * 1.25 + event_id % 50 * p * 0.1 AS DOUBLE))::BIGINT AS micro_usd FROM (
  SELECT *, CASE WHEN starts_with(m, 'small-fast') THEN 0.8::DOUBLE WHEN starts_with(m, 'small') THEN 0.25 WHEN starts_with(m, 'large') THEN 3 END AS p,
  CASE WHEN starts_with(m, 'small-fast') THEN 4::DOUBLE WHEN starts_with(m, 'small') THEN 1.25 WHEN starts_with(m, 'large') THEN 15 END AS q FROM (SELECT *, {_MODEL} AS m FROM events))""")
def prj18(spark, d):
    e, u = A.read(spark, d, "events"), F.col("user_id") % 4
    model = F.when(u == 0, "small").when(u == 1, "small-fast-2").when(u == 2, "large-x").otherwise("other")
    k = F.col("event_id")
    return P.priced(e.select("event_id", model.alias("model"))).select("event_id", P.cost_micro(k % 900, k % 300, k % 70, k % 50, F.col("p"), F.col("q")).alias("micro_usd"))


@query("prj19_completeness", oracle("papers keywords links cites", """WITH k AS (SELECT paper_id, count(*) AS n FROM keywords GROUP BY 1), a AS (SELECT paper_id, count(*) AS n FROM links GROUP BY 1), r AS (SELECT src, count(*) AS n FROM cites GROUP BY 1)
  SELECT id, CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN journal_id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(k.n, 0) >= 3 THEN 1 ELSE 0 END + CASE WHEN coalesce(a.n, 0) >= 1 THEN 1 ELSE 0 END
  + CASE WHEN coalesce(r.n, 0) >= 1 THEN 1 ELSE 0 END AS score FROM papers LEFT JOIN k ON k.paper_id = id LEFT JOIN a ON a.paper_id = id LEFT JOIN r ON r.src = id"""))
def prj19(spark, d):
    n = lambda df, key, name: df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
    x = A.papers(spark, d).join(n(A.keywords(spark, d), "paper_id", "k"), "id", "left").join(n(A.links(spark, d), "paper_id", "a"), "id", "left").join(n(A.cites(spark, d), "src", "r"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select("id", P.completeness(F.when(F.col("id") % 2 == 0, "10.1/x"), F.col("journal_id").cast("string"), zero("k"), zero("a"), zero("r")).alias("score"))


@query("prj20_researcher_id", oracle("researchers", "SELECT rid, 'kci:' || substr(sha1(replace(lower(name), ' ', '') || '|' || lower(institution)), 1, 16) AS researcher_id FROM researchers"))
def prj20(spark, d):
    return A.researchers(spark, d).select("rid", P.researcher_id(F.col("name"), F.col("institution")).alias("researcher_id"))
