"""Queries of string and array functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import oracle
from ..operators import identity as I
from ..operators import text as X
from .catalog import query

_SPLIT = "[ \\n\\t\\r]+"


def _words(spark, d):
    """Distinct words of the documents, with punctuation."""
    return A.docs(spark, d).select(F.explode(F.split("text", "[ \\n]+")).alias("w")).where("w <> ''").distinct()


_WORDS = "w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents) WHERE w <> '')"


@query("str01_clean_term")
def str01(spark, d):
    return _words(spark, d).select("w", X.clean_term("w").alias("term"))


@query("str02_split_terms", r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^[ ;,.]+|[ ;,.]+$', '', 'g'), '\s+[.·|]\s+|\s*/\s+|\s+/\s*|;\s*|,\s+'), lambda x: regexp_replace(trim(x), '^[ ;,.]+|[ ;,.]+$', '', 'g')), lambda x: x <> ''), '|') AS terms FROM documents""")
def str02(spark, d):
    return A.docs(spark, d).select("doc_id", F.array_join(X.split_terms("text"), "|").alias("terms"))


@query("str03_token_language", f"""WITH {_WORDS}, b AS (SELECT w, regexp_replace(w, '[^A-Za-z0-9]', '', 'g') AS b FROM w) SELECT w, CASE WHEN regexp_matches(w, '[가-힣]') THEN 'ko' WHEN regexp_matches(w, '[A-Za-z]') THEN CASE WHEN length(b) <= 3
  OR (regexp_matches(b, '[A-Z]') AND NOT regexp_matches(b, '[a-z]') AND length(b) <= 8) OR regexp_matches(b, '^[0-9]+[A-Za-z]+$') OR regexp_matches(b, '^([A-Z][a-z]?[0-9]*){{1,4}}$') THEN 'neutral' ELSE 'en' END ELSE 'neutral' END AS lang FROM b""")
def str03(spark, d):
    return _words(spark, d).select("w", X.token_language(F.col("w")).alias("lang"))


@query("str04_language_runs")
def str04(spark, d):
    return A.docs(spark, d).select("doc_id", X.language_runs("text").alias("r")).select("doc_id", F.array_join("r.ko", "|").alias("ko"), F.array_join("r.en", "|").alias("en"))


@query("str05_bracketed", """SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(t, '\\([^()]*\\)|\\[[^\\[\\]]*\\]'), lambda x: regexp_replace(trim(regexp_replace(substr(x, 2, length(x) - 2), '\\s+', ' ', 'g')), '^[ ;,.]+|[ ;,.]+$', '', 'g')), lambda x: x <> ''), '|') AS terms
  FROM (SELECT doc_id, text || ' (' || lang || ') [' || source || ']' AS t FROM documents)""")
def str05(spark, d):
    t = F.concat("text", F.lit(" ("), "lang", F.lit(") ["), "source", F.lit("]"))
    return A.docs(spark, d).select("doc_id", F.array_join(X.bracketed(t), "|").alias("terms"))


@query("str06_keywords_by_language")
def str06(spark, d):
    return A.docs(spark, d).select("doc_id", X.keywords_by_language("text").alias("r")).select("doc_id", F.size("r.ko").alias("n_ko"), F.size("r.en").alias("n_en"), F.array_join("r.en", "|").alias("en"))


@query("str07_keyword_key", f"WITH {_WORDS} SELECT w, 'en:' || lower(w) AS key FROM w WHERE regexp_matches(w, '^[\\x21-\\x7E]+$')")
def str07(spark, d):
    return _words(spark, d).where(F.col("w").rlike("^[\\x21-\\x7E]+$")).select("w", X.keyword_key(F.col("w"), F.lit("en")).alias("key"))


@query("str07_keyword_key_whole")
def str07_whole(spark, d):
    return _words(spark, d).select("w", X.keyword_key(F.col("w"), F.when(F.col("w").rlike(X.HANGUL), "ko").otherwise("en")).alias("key"))


@query("str06_paper_keywords", oracle("papers", """SELECT id, coalesce(degree, '') AS ko, lower(title || '|' || journal_name || '|' || db_code) AS en, true AS changed FROM papers"""))
def str06_papers(spark, d):
    first = F.array(F.concat_ws(" / ", "degree", "title"), F.upper("title"))
    second = F.array(F.concat(F.col("journal_name"), F.lit("; "), F.col("title"), F.lit(" . "), F.col("db_code")))
    return A.papers(spark, d).select("id", X.paper_keywords(first, second).alias("r")).select("id", F.array_join("r.ko", "|").alias("ko"), F.array_join("r.en", "|").alias("en"), "r.changed")


@query("str08_display_key", oracle("keywords", "SELECT DISTINCT name, replace(lower(name), ' ', '') AS key FROM keywords"))
def str08(spark, d):
    return A.keywords(spark, d).select("name").distinct().select("name", X.display_key(F.col("name")).alias("key"))


@query("str09_title_keys", """SELECT doc_id, trim(l) AS plain, regexp_replace(l, '[ \\t\\n\\r]+', '', 'g') AS tight, regexp_replace(l, '[^0-9a-z가-힣]', '', 'g') AS bare, trim(regexp_replace(l, '[ \\t\\n\\r]+', ' ', 'g')) AS spaced FROM (SELECT doc_id, lower(text) AS l FROM documents)""")
def str09(spark, d):
    return A.docs(spark, d).select("doc_id", X.title_keys(F.col("text")).alias("k")).select("doc_id", "k.*")


@query("str10_title_similarity")
def str10(spark, d):
    p = A.papers(spark, d)
    x = A.cites(spark, d).join(p.select(F.col("id").alias("src"), F.col("title").alias("a")), "src").join(p.select(F.col("id").alias("dst"), F.col("title").alias("b")), "dst")
    # Lengths bound the ratio before any text reaches Python.
    x = x.where(X.may_be_similar(F.col("a"), F.col("b"), 0.85))
    return x.select("src", "dst", F.round(X.title_similarity_from(0.85)("a", "b"), 6).alias("ratio")).where("ratio >= 0.85")


@query("str11_issn", oracle("papers", """SELECT id, CASE WHEN regexp_matches(b, '^[0-9]{7}[0-9X]$') THEN substr(b, 1, 4) || '-' || substr(b, 5, 4) END AS issn FROM (SELECT id, upper(regexp_replace(r, '[^0-9Xx]', '', 'g')) AS b FROM (SELECT id, CASE id % 4 WHEN 0 THEN ' 1234-567x ' WHEN 1 THEN lpad(CAST(id AS VARCHAR), 8, '0') WHEN 2 THEN '12x' ELSE NULL END AS r FROM papers))"""))
def str11(spark, d):
    k = F.col("id") % 4
    raw = F.when(k == 0, " 1234-567x ").when(k == 1, F.lpad(F.col("id").cast("string"), 8, "0")).when(k == 2, "12x")
    return A.papers(spark, d).select("id", X.issn(raw).alias("issn"))


@query("str12_bare_doi", oracle("papers", r"""SELECT id, regexp_replace(trim(x), '(?i)^https?://(dx\.)?doi\.org/', '') AS doi FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'HTTPS://doi.org/10.1/' WHEN 1 THEN ' http://dx.doi.org/10.2/' ELSE '10.3/' END || id AS x FROM papers)"""))
def str12(spark, d):
    k = F.col("id") % 3
    return A.papers(spark, d).select("id", X.bare_doi(F.concat(F.when(k == 0, "HTTPS://doi.org/10.1/").when(k == 1, " http://dx.doi.org/10.2/").otherwise("10.3/"), F.col("id"))).alias("doi"))


@query("str13_markup_repair")
def str13(spark, d):
    return A.read(spark, d, "pages").select("page_id", F.length(X.repaired("html")).alias("n"))


@query("str13_repaired_text")
def str13_text(spark, d):
    return A.read(spark, d, "pages").select("page_id", X.repaired("html").alias("text"))


@query("str14_parse_fields", oracle("papers", """WITH r AS (SELECT id, CASE WHEN id % 2 = 0 THEN db_code || '; x ;' ELSE 'a. b.' END AS kw, title || '.' AS kw2, CASE WHEN id % 3 = 0 THEN 'https://doi.org/1' ELSE '10.1/1' END AS doi, CASE WHEN id % 5 = 0 THEN 'n/a' ELSE CAST(pubyear AS VARCHAR) END AS y FROM papers)
  SELECT id, array_to_string(list_filter(list_transform(CASE WHEN contains(kw, ';') THEN string_split(kw, ';') ELSE string_split(kw, '.') END, lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords, array_to_string(list_filter(list_transform(string_split(kw2, '.'), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords2,
  CASE WHEN regexp_matches(doi, '^https?://') THEN doi END AS doi, TRY_CAST(y AS INT) AS year FROM r"""))
def str14(spark, d):
    k = F.col("id")
    f = X.parsed_fields(F.when(k % 2 == 0, F.concat("db_code", F.lit("; x ;"))).otherwise("a. b."), F.concat("title", F.lit(".")), F.when(k % 3 == 0, "https://doi.org/1").otherwise("10.1/1"), F.when(k % 5 == 0, "n/a").otherwise(F.col("pubyear").cast("string")), F.col("title"))
    return A.papers(spark, d).select("id", f.alias("f")).select("id", "f.keywords", "f.keywords2", "f.doi", "f.year")


@query("str15_sentences", r"""SELECT doc_id, CAST(len(s) AS INT) AS n, s[1] AS first FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""")
def str15(spark, d):
    return A.docs(spark, d).select("doc_id", X.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.get("s", 0).alias("first"))


@query("str16_bm25_tokens", "SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text || ' ' || source || ' ' || source), '[ \\n\\t\\r]+')) AS token FROM documents) WHERE token <> '' GROUP BY 1")
def str16(spark, d):
    return A.docs(spark, d).select(F.explode(X.bm25_text(F.col("source"), F.col("text"), F.lit(""))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("str17_noun_tokens")
def str17(spark, d):
    return A.docs(spark, d).select("doc_id", F.array_join(X.noun_tokens(F.col("text")), " ").alias("nouns"))


@query("str17_topic_nouns", oracle("papers", """WITH t AS (SELECT id, title || '연구 ' || db_code || id || ' ' || db_code AS x FROM papers), w AS (SELECT id, regexp_extract_all(x, '[가-힣]+|[A-Za-z]+|[0-9]+') AS w, x FROM t),
  n AS (SELECT id, x, list_filter(w, lambda k: length(k) > 1 AND k <> '연구') AS n, regexp_extract_all(x, '[0-9A-Za-z가-힣]+') AS runs FROM w),
  c AS (SELECT id, x, list_distinct(list_concat(n, list_filter(runs, lambda r: NOT contains(r, '연구') AND len(regexp_extract_all(r, '[가-힣]+|[A-Za-z]+|[0-9]+')) > 1))) AS c FROM n)
  SELECT id, array_to_string(list_transform(list_sort(list_transform(c, lambda k: {'n': -length(k), 'at': strpos(x, k), 'k': k})), lambda s: s.k), ' ') AS nouns FROM c"""))
def str17_topics(spark, d):
    t = F.concat("title", F.lit("연구 "), "db_code", F.col("id").cast("string"), F.lit(" "), "db_code")
    return A.papers(spark, d).select("id", F.array_join(X.topic_nouns()(t), " ").alias("nouns"))


_INST = "CASE rid % 6 WHEN 0 THEN '가람대학교 컴퓨터학과' WHEN 1 THEN '가람대학교병원, 서울' WHEN 2 THEN 'Garam University, Seoul' WHEN 3 THEN '나래연구소' WHEN 4 THEN '농촌청 다솜과학원 토양과' ELSE institution END"


def _inst(spark, d):
    k = F.col("rid") % 6
    i = F.when(k == 0, "가람대학교 컴퓨터학과").when(k == 1, "가람대학교병원, 서울").when(k == 2, "Garam University, Seoul").when(k == 3, "나래연구소").when(k == 4, "농촌청 다솜과학원 토양과").otherwise(F.col("institution"))
    return A.researchers(spark, d).select("rid", i.alias("inst"))


_SUFFIXES = "[" + ", ".join(f"'{x}'" for x in X.INSTITUTION_SUFFIXES) + "]"
_NO_DEPT = ", ".join(f"'{x}'" for x in X.NOT_A_DEPARTMENT)
#: The suffix that starts first, the longest one there; without one the whole (not Korean) or the first word.
_ROOTED = f"""i AS (SELECT rid, {_INST} AS inst FROM researchers), f AS (SELECT rid, inst, trim(string_split_regex(inst, '[,/]')[1]) AS f FROM i),
  e AS (SELECT *, list_sort(list_transform(list_filter({_SUFFIXES}, lambda x: contains(f, x)), lambda x: strpos(f, x) * 1000 - length(x)))[1] AS e FROM f),
  r AS (SELECT rid, inst, f, CASE WHEN f = '' THEN NULL WHEN e IS NOT NULL THEN trim(substr(f, 1, CAST(ceil(e / 1000) AS INT) - 1 + CAST(ceil(e / 1000) * 1000 - e AS INT)))
    WHEN NOT regexp_matches(f, '[가-힣]') THEN f ELSE string_split_regex(f, '[ ]+')[1] END AS root FROM e)"""


@query("str18_institution_root", oracle("researchers", f"WITH {_ROOTED} SELECT rid, root FROM r"))
def str18(spark, d):
    return _inst(spark, d).select("rid", X.institution_root(F.col("inst")).alias("root"))


@query("str19_institution_dept", oracle("researchers", f"""WITH {_ROOTED}, q AS (SELECT rid, trim(CASE WHEN starts_with(f, root) THEN substr(f, length(root) + 1) ELSE replace(f, root, '') END) AS rest FROM r)
  SELECT rid, CASE WHEN rest <> '' AND rest NOT IN ({_NO_DEPT}) THEN rest END AS dept FROM q"""))
def str19(spark, d):
    return _inst(spark, d).select("rid", X.institution_dept(F.col("inst")).alias("dept"))


_MATCHED = f"""c AS (SELECT inst, trim(regexp_replace(inst, '{X.COMPANY}', ' ', 'g')) AS s FROM n), w AS (SELECT inst, lower(regexp_replace(s, '\\s+', '', 'g')) AS n, list_filter(string_split_regex(s, '[\\s,/·()]+'), lambda x: x <> '') AS w FROM c),
  t AS (SELECT inst, n, regexp_replace(n, '^국립', '') AS stem, list_transform(range(1, len(w) + 1), lambda k: lower(array_to_string(list_slice(w, k, len(w)), ''))) AS tails FROM w)"""
_SAME = "a.n <> '' AND b.n <> '' AND (a.n = b.n OR " + " OR ".join(
    f"len(list_filter({y}.tails, lambda t: starts_with(t, {x}.stem) OR starts_with(regexp_replace(t, '^(국립|농촌진흥청)', ''), {x}.stem))) > 0" for x, y in ("ab", "ba")) + ")"


@query("str20_institution_match", oracle("researchers", f"WITH i AS (SELECT rid, {_INST} AS inst FROM researchers), n AS (SELECT DISTINCT inst FROM i UNION SELECT '가람대학교'), {_MATCHED} SELECT rid, {_SAME} AS same FROM i JOIN t a USING (inst), t b WHERE b.inst = '가람대학교'"))
def str20(spark, d):
    return _inst(spark, d).select("rid", X.same_institution(F.col("inst"), F.lit("가람대학교")).alias("same"))


_NAMES = ("㈔가람", "가람", "(주)가람 연구소", "유한회사 가람", "국립가람대학교", "가람대학교", "나래 가람대학교병원", "남가람대학교", "농촌진흥청 국립다솜과학원", "국립다솜과학원", "농촌진흥청다솜과학원", "(학)다솜")


@query("str20_institution_pairs", oracle("researchers", f"WITH i AS (SELECT {_INST} AS inst FROM researchers), n AS (SELECT DISTINCT inst FROM i UNION SELECT unnest({list(_NAMES)})), {_MATCHED} SELECT a.inst AS a, b.inst AS b, {_SAME} AS same FROM t a, t b WHERE a.inst < b.inst"))
def str20_pairs(spark, d):
    """Every pair of a short list of names and the distinct institutions (a stated list against few distinct values)."""
    names = _inst(spark, d).select("inst").union(spark.createDataFrame([(x,) for x in _NAMES], "inst string")).distinct()
    a, b = names.withColumnRenamed("inst", "a"), names.withColumnRenamed("inst", "b")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", X.same_institution(F.col("a"), F.col("b")).alias("same"))


@query("str21_polished_institution")
def str21(spark, d):
    return _inst(spark, d).select("rid", X.polished_institution(F.concat(F.lit("Department of X, "), F.col("inst"), F.lit(", 12345 Road"))).alias("institution"))


@query("str22_institution_units")
def str22(spark, d):
    return _inst(spark, d).select("rid", F.array_join(X.institution_units(F.col("inst")), "|").alias("units"))


@query("str22_specific_unit", oracle("researchers", f"""WITH {_ROOTED}, u AS (SELECT rid, inst, root, nullif(regexp_extract(trim(inst), '^[가-힣]+(?:청|부|처)\\s+(\\S.*)$', 1), '') AS sub FROM r),
  v AS (SELECT rid, root, sub, list_sort(list_transform(list_filter({_SUFFIXES}, lambda x: contains(sub, x)), lambda x: strpos(sub, x) * 1000 - length(x)))[1] AS e FROM u),
  x AS (SELECT rid, root, sub, CASE WHEN e IS NOT NULL THEN trim(substr(sub, 1, CAST(ceil(e / 1000) AS INT) - 1 + CAST(ceil(e / 1000) * 1000 - e AS INT))) ELSE string_split_regex(sub, '[ ]+')[1] END AS own FROM v)
  SELECT rid, CASE WHEN sub IS NOT NULL THEN CASE WHEN own <> root THEN own END WHEN NOT regexp_matches(root, '^[가-힣]+(청|부|처)$') THEN root END AS unit FROM x"""))
def str22_specific(spark, d):
    return _inst(spark, d).select("rid", X.specific_unit(F.col("inst")).alias("unit"))


_ROLED = _INST + " || CASE rid % 4 WHEN 0 THEN ' 박사과정생' WHEN 1 THEN ' 자연과학부 조교수' WHEN 2 THEN ' 연구원' ELSE '' END"


@query("str19_department", oracle("researchers", f"""WITH {_ROOTED.replace(_INST, _ROLED)}, u AS (SELECT rid, inst, f, root, nullif(regexp_extract(trim(inst), '^[가-힣]+(?:청|부|처)\\s+(\\S.*)$', 1), '') AS sub FROM r),
  v AS (SELECT *, list_sort(list_transform(list_filter({_SUFFIXES}, lambda x: contains(sub, x)), lambda x: strpos(sub, x) * 1000 - length(x)))[1] AS e FROM u),
  x AS (SELECT *, CASE WHEN e IS NOT NULL THEN trim(substr(sub, 1, CAST(ceil(e / 1000) AS INT) - 1 + CAST(ceil(e / 1000) * 1000 - e AS INT))) ELSE string_split_regex(sub, '[ ]+')[1] END AS own FROM v),
  y AS (SELECT rid, CASE WHEN sub IS NOT NULL THEN CASE WHEN own <> root THEN own END WHEN NOT regexp_matches(root, '^[가-힣]+(청|부|처)$') THEN root END AS unit, trim(CASE WHEN starts_with(f, root) THEN substr(f, length(root) + 1) ELSE replace(f, root, '') END) AS rest FROM x),
  z AS (SELECT rid, unit, trim(regexp_replace(trim(CASE WHEN starts_with(rest, unit) THEN substr(rest, length(unit) + 1) ELSE rest END), '\\s*({'|'.join(X.ROLE_SUFFIXES)})\\s*$', '')) AS dept FROM y WHERE rest <> '' AND rest NOT IN ({_NO_DEPT}))
  SELECT rid, o.dept FROM researchers LEFT JOIN (SELECT rid, dept FROM z WHERE dept <> '' AND coalesce(replace(dept, ' ', '') <> replace(unit, ' ', ''), true)) o USING (rid)"""))
def str19_department(spark, d):
    k = F.col("rid") % 4
    role = F.when(k == 0, " 박사과정생").when(k == 1, " 자연과학부 조교수").when(k == 2, " 연구원").otherwise("")
    return _inst(spark, d).select("rid", X.department_from(F.concat("inst", role)).alias("dept"))


_MAILS = f"""m AS (SELECT rid, inst, root, CASE WHEN rid % 9 = 0 THEN NULL WHEN rid % 7 = 0 THEN 'r' || rid || '@Gmail.com' WHEN rid % 5 = 0 THEN 'r@agency.kr' WHEN rid % 11 = 0 THEN 'none'
  ELSE 'r' || rid || '@u' || ((rid + CASE WHEN rid % 13 = 0 AND (rid // 6) % 2 = 1 THEN 1 ELSE 0 END) % 6) || '.ac.kr' END AS email, CASE WHEN (rid // 6) % 2 = 0 THEN 'confirmed' ELSE 'inferred' END AS confidence FROM r)"""


@query("agg30_domain_verdicts", oracle("researchers", f"""WITH {_ROOTED}, {_MAILS}, q AS (SELECT *, CASE WHEN contains(email, '@') THEN nullif(lower(trim(regexp_extract(email, '([^@]*)$', 1))), '') END AS domain FROM m WHERE email IS NOT NULL AND inst IS NOT NULL),
  p AS (SELECT *, domain IS NULL OR regexp_matches(domain, '{"|".join(I.PERSONAL_MAIL).replace(".", "[.]")}') AS personal FROM q),
  t AS (SELECT domain, list(DISTINCT coalesce(root, '')) AS roots FROM p WHERE confidence = 'confirmed' AND NOT personal GROUP BY 1 HAVING count(DISTINCT coalesce(root, '')) < 3),
  n AS (SELECT p.*, unnest(coalesce(roots, [NULL])) AS b FROM p LEFT JOIN t USING (domain) WHERE confidence = 'inferred'), w AS (SELECT *, regexp_replace(root, '[\\s·,.-]', '', 'g') AS x, regexp_replace(b, '[\\s·,.-]', '', 'g') AS y FROM n),
  s AS (SELECT rid, domain, email, personal, b, CASE WHEN root IS NULL OR b = '' THEN 'unknown' WHEN contains(x, y) OR contains(y, x) THEN 'match' WHEN regexp_matches(root, '[가-힣]') <> regexp_matches(b, '[가-힣]') THEN 'unknown' ELSE 'conflict' END AS said FROM w),
  v AS (SELECT rid, any_value(domain) AS domain, any_value(email) AS email, CASE WHEN bool_or(personal) THEN 'personal' WHEN bool_and(b IS NULL) THEN 'unlisted' WHEN bool_or(said = 'match') THEN 'promote' WHEN bool_and(said = 'conflict') THEN 'revoke' ELSE 'hold' END AS verdict FROM s GROUP BY 1)
  SELECT rid, domain, verdict, CASE verdict WHEN 'promote' THEN 'domain_verified' WHEN 'revoke' THEN 'disputed' ELSE 'inferred' END AS confidence, CASE WHEN verdict <> 'revoke' THEN email END AS email FROM v"""))
def agg30_verdicts(spark, d):
    """All researchers; addresses and confidence go by id, as the test tables have none."""
    k, odd = F.col("rid"), F.floor(F.col("rid") / 6) % 2 == 1
    own = (k + F.when((k % 13 == 0) & odd, 1).otherwise(0)) % 6
    email = F.when(k % 9 == 0, None).when(k % 7 == 0, F.concat(F.lit("r"), k, F.lit("@Gmail.com"))).when(k % 5 == 0, "r@agency.kr").when(k % 11 == 0, "none").otherwise(F.concat(F.lit("r"), k, F.lit("@u"), own, F.lit(".ac.kr")))
    return I.domain_verdicts(_inst(spark, d).select("rid", email.alias("email"), F.col("inst").alias("institution"), F.when(odd, "inferred").otherwise("confirmed").alias("confidence")))


_WORDY = "[\\p{L}\\p{N}_]"
_TERMS = "[upper(title) || ' 관련 논문', db_code || '!', '「' || title || '」 연구', title || ' 연구자료', '자료', '-' || db_code || '-논문-']"


@query("str23_query_key_rules", oracle("papers", f"""WITH x AS (SELECT id, unnest({_TERMS}) AS t FROM papers), a AS (SELECT id, regexp_replace(trim(lower(t)), '(관련|관한|대한)\\s*', ' ', 'g') AS t FROM x),
  b AS (SELECT id, array_to_string(list_transform(regexp_extract_all(t, '{_WORDY}+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: CASE WHEN w IN ('논문', '연구', '자료', '문헌') THEN ' ' ELSE w END), '') AS t FROM a),
  c AS (SELECT DISTINCT id, trim(regexp_replace(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM b)
  SELECT id, substr(string_agg(t, '|' ORDER BY t) FILTER (t <> ''), 1, 500) AS key FROM c GROUP BY 1"""))
def str23_rules(spark, d):
    c = lambda *x: F.concat(*[F.col(y) if y in ("title", "db_code") else F.lit(y) for y in x])
    terms = F.array(F.concat(F.upper("title"), F.lit(" 관련 논문")), c("db_code", "!"), c("「", "title", "」 연구"), c("title", " 연구자료"), F.lit("자료"), c("-", "db_code", "-논문-"))
    return A.papers(spark, d).select("id", X.query_key(terms).alias("key"))


@query("str23_query_key", oracle("papers", "SELECT id, CASE WHEN lower(title) < lower(db_code) THEN lower(title) || '|' || lower(db_code) ELSE lower(db_code) || '|' || lower(title) END AS key FROM papers"))
def str23(spark, d):
    return A.papers(spark, d).select("id", X.query_key(F.array(F.upper("title"), "db_code", F.col("title"))).alias("key"))


@query("str24_markers", oracle("papers", "SELECT id, 'on ' || title || ' and more' AS text, 3 AS start, 3 + CAST(length(title) AS INT) AS \"end\" FROM papers"))
def str24(spark, d):
    return A.papers(spark, d).select("id", X.markers(F.concat(F.lit(" on **"), F.col("title"), F.lit("** and more"))).alias("m")).select("id", "m.*")


@query("str25_from_inverted", oracle("keywords", "SELECT paper_id, string_agg(name, ' ' ORDER BY pos, name) AS text FROM (SELECT paper_id, name, pos FROM keywords UNION ALL SELECT paper_id, name, pos + 100 FROM keywords) GROUP BY 1"))
def str25(spark, d):
    k = A.keywords(spark, d).groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.array("pos", F.col("pos") + 100)))).alias("m"))
    return k.select("paper_id", X.from_inverted(F.col("m")).alias("text"))


@query("str26_first_year", "SELECT event_id, TRY_CAST(nullif(regexp_extract(r, '(1[89][0-9]{2}|20[0-9]{2})', 1), '') AS INT) AS year FROM (SELECT event_id, 'v' || event_id || ' c' || strftime(ts, '%Y') AS r FROM events)")
def str26(spark, d):
    return A.read(spark, d, "events").select("event_id", X.first_year(F.concat(F.lit("v"), "event_id", F.lit(" c"), F.date_format("ts", "yyyy"))).alias("year"))


@query("str27_short_query", "SELECT doc_id FROM documents WHERE length(trim(text)) BETWEEN 1 AND 24 AND NOT regexp_matches(trim(text), '[.!?].') AND NOT contains(trim(text), chr(10))")
def str27(spark, d):
    return A.docs(spark, d).where(X.short_query(F.col("text"))).select("doc_id")


@query("str28_keyword_cascade", oracle("keywords", """WITH n AS (SELECT DISTINCT name FROM keywords) SELECT name, CASE WHEN name = 'blue bolt' THEN 1 WHEN contains(name, 'blue') AND contains(name, 'bolt') THEN 2 ELSE 3 END AS stage FROM n WHERE contains(name, 'blue') OR contains(name, 'bolt')"""))
def str28(spark, d):
    from ..operators.search import keyword_cascade

    return keyword_cascade(A.keywords(spark, d).select("name").distinct(), "blue bolt")


_STAGED = """k AS (SELECT name, count(DISTINCT paper_id) AS paper_count, min(lang) AS lang FROM keywords GROUP BY 1), w AS (SELECT *, string_split(name, ' ') AS w FROM k WHERE paper_count > 1)"""


@query("str28_keyword_search", oracle("keywords", f"""WITH {_STAGED}, s AS (SELECT name, paper_count, CASE WHEN contains(' ' || name || ' ', ' bolt blue ') THEN 1 WHEN list_contains(w, 'blue') AND list_contains(w, 'bolt') THEN 2 END AS stage, round(2 / len(w), 6) AS score FROM w)
  SELECT name, stage, score, paper_count FROM s WHERE stage = (SELECT min(stage) FROM s) ORDER BY score DESC, paper_count DESC, name LIMIT 5"""))
def str28_search(spark, d):
    from ..operators.search import keyword_search

    k = A.keywords(spark, d).groupBy("name").agg(F.countDistinct("paper_id").alias("paper_count"), F.min("lang").alias("lang"))
    return keyword_search(k, "bolt (blue)", accept=F.col("paper_count") > 1)


_KEYED = """k AS (SELECT name, count(DISTINCT paper_id) AS paper_count, row_number() OVER (ORDER BY name) AS id FROM keywords GROUP BY 1)"""


@query("str28_keyword_search_by_vector", oracle("keywords vecs", f"""WITH {_KEYED}, q AS (SELECT v FROM vecs WHERE id = 0), s AS (SELECT name, paper_count, round(list_dot_product(a.v, q.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(q.v, q.v))), 9) AS sim FROM k JOIN vecs a USING (id), q)
  SELECT name, 3 AS stage, round(sim, 6) AS score, paper_count FROM s WHERE sim >= 0.05 ORDER BY round(sim, 6) DESC, paper_count DESC, name LIMIT 5"""))
def str28_vector(spark, d):
    from ..operators.search import keyword_search
    from ..operators.windows import global_rank
    from .vectors import query_vector

    v = A.vecs(spark, d)
    # The vocabulary is small: a place for each of its words pairs it with a vector.
    k = A.keywords(spark, d).groupBy("name").agg(F.countDistinct("paper_id").alias("paper_count"))
    k = global_rank(k, [F.col("name")], "id", k.count())
    return keyword_search(k.join(v.select("id", "v"), "id").withColumn("lang", F.lit("en")), "nothing like it", query_vector(v, 0), least=0.05)


@query("str29_assembly")
def str29(spark, d):
    return A.docs(spark, d).select("doc_id", X.assembled(X.sentences(F.col("text"))).alias("a")).select("doc_id", F.length("a.text").alias("n"), "a.complete")


_REASONS = r"""p AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
  q AS (SELECT *, trim(replace(array_to_string(s, ' '), '**', '')) AS whole, len(list_filter(range(1, len(s) + 1), lambda i: length(trim(replace(array_to_string(s[1:i], ' '), '**', ''))) <= 200)) AS n FROM p),
  c AS (SELECT doc_id, lang, source, CASE WHEN length(whole) <= 220 OR n = 0 THEN whole ELSE trim(replace(array_to_string(s[1:n], ' '), '**', '')) END AS text, length(whole) <= 220 AS complete FROM q)"""


def _reasons(spark, d):
    """Each document as a candidate for its language and source."""
    x = A.docs(spark, d).where("text IS NOT NULL").select(F.concat_ws("/", "lang", "source").alias("id"), F.col("doc_id").alias("at"), X.sentences(F.col("text")).alias("s"))
    return x.select("id", "at", X.reason(F.col("s")).alias("r")).select("id", "at", "r.text", "r.complete")


@query("str29_best_center", f'''WITH {_REASONS} SELECT id, "at", text, complete FROM (SELECT concat_ws('/', lang, source) AS id, doc_id AS "at", text, complete, row_number() OVER (PARTITION BY concat_ws('/', lang, source) ORDER BY complete DESC, abs(length(text) - 175), doc_id) AS rn FROM c WHERE text <> '') WHERE rn = 1''')
def str29_center(spark, d):
    return X.best_reasons(_reasons(spark, d))


@query("str29_best_under_max", f'''WITH {_REASONS} SELECT id, "at", text, complete FROM (SELECT concat_ws('/', lang, source) AS id, doc_id AS "at", text, complete, row_number() OVER (PARTITION BY concat_ws('/', lang, source) ORDER BY length(text) > 200, complete DESC, CASE WHEN length(text) <= 200 THEN -length(text) ELSE length(text) END, doc_id) AS rn FROM c WHERE text <> '') WHERE rn = 1''')
def str29_under(spark, d):
    return X.best_reasons(_reasons(spark, d), "under_max")


# Arrays


@query("arr01_issn_overlap", oracle("journals", "SELECT a.id AS a, b.id AS b FROM journals a JOIN journals b ON a.id < b.id AND (a.issn = b.issn OR a.issn = b.e_issn OR a.e_issn = b.issn OR a.e_issn = b.e_issn)"))
def arr01(spark, d):
    from ..operators.joins import journal_keys

    k = journal_keys(A.journals(spark, d)).select("key", "id")
    return k.withColumnRenamed("id", "a").join(k.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b").distinct()


@query("arr02_author_place", oracle("links researchers", """WITH n AS (SELECT paper_id, list(name ORDER BY author_order, l.rid) AS names, list(institution ORDER BY author_order, l.rid) AS insts FROM links l JOIN researchers r ON r.rid = l.rid GROUP BY 1),
  x AS (SELECT l.rid, l.paper_id, r.institution AS i, insts, list_filter(range(0, len(names)), lambda k: names[k + 1] = r.name) AS hits FROM links l JOIN researchers r ON r.rid = l.rid JOIN n ON n.paper_id = l.paper_id),
  y AS (SELECT *, list_filter(hits, lambda k: contains(insts[k + 1], i)) AS near FROM x) SELECT rid, paper_id, CAST(CASE WHEN len(hits) = 1 THEN hits[1] WHEN len(near) = 1 THEN near[1] END AS INT) AS place FROM y"""))
def arr02(spark, d):
    l, r = A.links(spark, d), A.researchers(spark, d).select("rid", "name", "institution")  # noqa: E741
    x = l.join(r, "rid")
    n = x.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("author_order", "rid", "name", "institution"))).alias("a"))
    n = n.select("paper_id", F.transform("a", lambda s: s["name"]).alias("names"), F.transform("a", lambda s: s["institution"]).alias("insts"))
    return x.join(n, "paper_id").select("rid", "paper_id", X.author_place(F.col("name"), F.col("institution"), F.col("names"), F.col("insts")).alias("place"))


_PART = "CASE WHEN author_order = 1 THEN '제1' WHEN (rid + paper_id) % 3 = 0 THEN '교신' WHEN (rid + paper_id) % 3 = 1 THEN '참여' END"


@query("arr03_author_roles", oracle("links", f"""WITH p AS (SELECT *, {_PART} AS part, CASE WHEN author_order = 1 THEN '1' ELSE '2' END AS div FROM links), q AS (SELECT *, count(*) FILTER (part = '교신') OVER (PARTITION BY paper_id) AS n FROM p)
  SELECT rid, paper_id, concat_ws(',', CASE WHEN div = '1' THEN 'first' END, CASE WHEN part = '교신' THEN CASE WHEN n > 1 THEN 'co_corresponding' ELSE 'corresponding' END END, CASE WHEN div <> '1' AND part IS DISTINCT FROM '교신' AND (part = '참여' OR n > 0) THEN 'participant' END) AS roles FROM q"""))
def arr03(spark, d):
    k = (F.col("rid") + F.col("paper_id")) % 3
    p = A.links(spark, d).withColumn("part", F.when(F.col("author_order") == 1, "제1").when(k == 0, "교신").when(k == 1, "참여")).withColumn("division", F.when(F.col("author_order") == 1, "1").otherwise("2"))
    parts = p.groupBy("paper_id").agg(F.collect_list("part").alias("parts"))
    return p.join(parts, "paper_id").select("rid", "paper_id", F.array_join(X.author_roles(F.col("division"), F.col("part"), F.col("parts")), ",").alias("roles"))


@query("arr04_nested_papers", oracle("papers keywords", "SELECT id, title, coalesce(string_agg(name, '|' ORDER BY pos, name), '') AS keywords FROM papers LEFT JOIN keywords ON paper_id = id GROUP BY 1, 2"))
def arr04(spark, d):
    k = A.keywords(spark, d).groupBy(F.col("paper_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("k"))
    return A.papers(spark, d).join(k, "id", "left").select("id", "title", F.coalesce(F.array_join(F.transform("k", lambda x: x["name"]), "|"), F.lit("")).alias("keywords"))


@query("arr05_json_recordset", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'x' AS tag FROM events")
def arr05(spark, d):
    j = F.from_json(F.concat(F.lit("["), F.col("props"), F.lit("]")), "array<struct<k:int,tag:string>>")
    return A.read(spark, d, "events").select("event_id", F.inline(j)).select("event_id", "k", F.coalesce("tag", F.lit("x")).alias("tag"))


@query("arr06_first_json")
def arr06(spark, d):
    t = F.concat(F.lit("note {broken "), "props", F.lit(" tail"))
    return A.read(spark, d, "events").select("event_id", F.get_json_object(X.first_json(t), "$.k").alias("k"))


@query("arr07_valid_numbers", oracle("papers", "SELECT id, array_to_string(list_filter([id % 7, 3, id % 3, 9], lambda x: x >= 1 AND x <= 5), ',') AS raw_in_range FROM papers"))
def arr07(spark, d):
    v = F.array(F.col("id") % 7, F.lit(3).cast("long"), F.col("id") % 3, F.lit(9).cast("long"))
    # In range, and separately without repeats (the order kept); the check compares what is in range.
    return A.papers(spark, d).select("id", F.array_join(X.in_range(v, F.lit(5)), ",").alias("raw_in_range"))


_PAIRS = "[[(id % 4 + 1)::VARCHAR, (id % 3 + 1)::VARCHAR], ['no. ' || (id % 2 + 1), 'x'], ['no. ' || (id % 5), (id % 6)::VARCHAR], ['2', '3'], ['3'], [(id % 4 + 1)::VARCHAR, '4'], ['9', '1'], ['4', '1']]"
_PLACE = "list_transform(p, lambda v: TRY_CAST(nullif(regexp_extract(v, '[0-9]+'), '') AS INT) - 1)"


@query("arr07_one_to_one_pairs", oracle("papers", f"""WITH q AS (SELECT id, list_filter(list_transform({_PAIRS}, lambda p: {_PLACE}), lambda p: len(p) = 2 AND p[1] BETWEEN 0 AND 3 AND p[2] BETWEEN 0 AND 3) AS q FROM papers),
  r AS (SELECT id, list_reduce(list_prepend(CAST([] AS INT[][]), list_transform(q, lambda p: [p])), lambda a, p: CASE WHEN len(list_filter(a, lambda o: o[1] = p[1][1] OR o[2] = p[1][2])) = 0 THEN list_concat(a, p) ELSE a END) AS r FROM q)
  SELECT id, array_to_string(list_transform(r, lambda p: p[1] || '-' || p[2]), ',') AS pairs FROM r"""))
def arr07_pairs(spark, d):
    i = F.col("id")
    n = lambda m, more=0: (i % m + more).cast("string")
    two = lambda a, b: F.array(a if not isinstance(a, str) else F.lit(a), b if not isinstance(b, str) else F.lit(b))
    no = lambda x: F.concat(F.lit("no. "), x)
    pairs = F.array(two(n(4, 1), n(3, 1)), two(no(n(2, 1)), "x"), two(no(n(5)), n(6)), two("2", "3"), F.array(F.lit("3")), two(n(4, 1), "4"), two("9", "1"), two("4", "1"))
    p = X.one_to_one(pairs, F.lit(4), F.lit(4))
    return A.papers(spark, d).select("id", F.array_join(F.transform(p, lambda x: F.concat_ws("-", x["left"], x["right"])), ",").alias("pairs"))


@query("arr07_distinct_numbers", oracle("papers", "SELECT id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') AS numbers FROM (SELECT id, list_filter([id % 7, 3, id % 3, 9], lambda x: x >= 1 AND x <= 5) AS v FROM papers)"))
def arr07b(spark, d):
    v = F.array(F.col("id") % 7, F.lit(3).cast("long"), F.col("id") % 3, F.lit(9).cast("long"))
    return A.papers(spark, d).select("id", F.array_join(X.valid_numbers(v, F.lit(5)), ",").alias("numbers"))


@query("arr08_filter_state", """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CAST(1990 + conv_id % 20 AS INT) END AS y0, CASE WHEN turn % 3 = 1 THEN 2020 END AS y1, CASE WHEN turn % 2 = 1 THEN 'journal' END AS p FROM conversations)
  SELECT a.conv_id, a.turn, (SELECT y0 FROM t b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND (y0 IS NOT NULL OR y1 IS NOT NULL) ORDER BY b.turn DESC LIMIT 1) AS year_start,
    (SELECT y1 FROM t b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND (y0 IS NOT NULL OR y1 IS NOT NULL) ORDER BY b.turn DESC LIMIT 1) AS year_end,
    (SELECT p FROM t b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND p IS NOT NULL ORDER BY b.turn DESC LIMIT 1) AS paper_type FROM t a""")
def arr08(spark, d):
    from ..operators.search import replay_filters

    turns = A.read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, 1990 + F.col("conv_id") % 20).cast("int").alias("year_start"), F.when(F.col("turn") % 3 == 1, 2020).cast("int").alias("year_end"), F.when(F.col("turn") % 2 == 1, "journal").alias("paper_type"))
    return replay_filters(turns)


_TURNS = """t AS (SELECT conv_id, turn, (conv_id + turn) % 3 <> 0 AS panel, CASE WHEN (conv_id + turn * 7) % 5 < 3 THEN CAST(2000 + (conv_id * 3 + turn * 5) % 20 AS INT) END AS y0, CASE WHEN (conv_id + turn) % 4 = 1 THEN CAST(2005 + (turn * 3) % 10 AS INT) END AS y1,
  CASE WHEN (conv_id * 2 + turn) % 3 = 1 THEN 'journal' END AS p, (conv_id + turn) % 4 <> 2 AS ty, (conv_id + turn) % 2 = 0 AS tp FROM conversations)"""


@query("arr08_owned_filters", f"""WITH {_TURNS}, e AS (SELECT *, CASE WHEN panel THEN CASE WHEN ty THEN y0 IS NOT NULL OR y1 IS NOT NULL END WHEN y0 IS NOT NULL OR y1 IS NOT NULL THEN false END AS my, CASE WHEN panel THEN CASE WHEN tp THEN p IS NOT NULL END WHEN p IS NOT NULL THEN false END AS mp FROM t),
  o AS (SELECT *, coalesce(last_value(my IGNORE NULLS) OVER w, false) AS oy, coalesce(last_value(mp IGNORE NULLS) OVER w, false) AS op, coalesce(last_value(my IGNORE NULLS) OVER b, false) AS by_, coalesce(last_value(mp IGNORE NULLS) OVER b, false) AS bp FROM e
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT *, CASE WHEN my IS NULL THEN NULL WHEN y0 IS NOT NULL OR y1 IS NOT NULL THEN [CASE WHEN y0 > y1 THEN y1 ELSE y0 END, CASE WHEN y0 > y1 THEN y0 ELSE y1 END] WHEN by_ THEN [NULL, NULL]::INT[] END AS sy, CASE WHEN mp IS NULL THEN NULL WHEN p IS NOT NULL THEN [p] WHEN bp THEN [NULL]::VARCHAR[] END AS sp FROM o),
  r AS (SELECT conv_id, turn, oy, op, last_value(sy IGNORE NULLS) OVER w AS y, last_value(sp IGNORE NULLS) OVER w AS p FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT conv_id, turn, y[1] AS year_start, y[2] AS year_end, p[1] AS paper_type, concat_ws(',', CASE WHEN op THEN 'paper_type' END, CASE WHEN oy THEN 'year_end,year_start' END) AS owned FROM r""")
def arr08_owned(spark, d):
    """Turns by rule on their numbers: two of three from the panel, which sends both years or none of them, and the type at every other turn."""
    from ..operators.sessions import owned_filters

    c, t = F.col("conv_id"), F.col("turn")
    touched = F.array_compact(F.array(F.when((c + t) % 4 != 2, "year_start"), F.when((c + t) % 4 != 2, "year_end"), F.when((c + t) % 2 == 0, "paper_type")))
    turns = A.read(spark, d, "conversations").select("conv_id", "turn", ((c + t) % 3 != 0).alias("panel"), F.when((c + t * 7) % 5 < 3, 2000 + (c * 3 + t * 5) % 20).cast("int").alias("year_start"),
                                                     F.when((c + t) % 4 == 1, 2005 + (t * 3) % 10).cast("int").alias("year_end"), F.when((c * 2 + t) % 3 == 1, "journal").alias("paper_type"), touched.alias("touched"))
    return owned_filters(turns, ("paper_type",)).withColumn("owned", F.array_join("owned", ","))
