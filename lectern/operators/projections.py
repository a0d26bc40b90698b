"""Derived columns: dates, paper types, credibility, badges, identifiers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type codes and their labels; external type names and labels; ISO-like year bounds.
LABELS = {"thesis_phd": "박사학위 논문", "thesis_master": "석사학위 논문", "thesis": "학위논문", "journal": "학술 저널", "conference": "학술 저널"}
EXTERNAL_LABELS = {
    "journal-article": "학술 저널", "proceedings-article": "학술 대회", "proceedings": "학술 대회", "dissertation": "학위논문", "book": "단행본", "book-chapter": "단행본",
    "edited-book": "단행본", "monograph": "단행본", "reference-book": "단행본", "book-series": "단행본", "book-part": "단행본", "book-section": "단행본", "book-set": "단행본", "book-track": "단행본"}
#: Price in micro-USD per token by model name (input, output).
PRICES = {"small": (0.25, 1.25), "small-fast": (0.8, 4.0), "large": (3.0, 15.0)}


def mapped(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def display_date(pubdate: Column, pubyear: Column) -> Column:
    """As precise as the digits allow; parts are never made up."""
    g = digits(pubdate)
    part = lambda a, n: F.substring(g, a, n)
    return (F.when(F.length(g) >= 8, F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))).when(F.length(g) >= 6, F.concat_ws("-", part(1, 4), part(5, 2)))
            .when(F.length(g) >= 4, part(1, 4)).otherwise(pubyear.cast("string")))


def strict_date(raw: Column) -> Column:
    """Y-M-D of the first 8 digits, bounds compared as text (so February 30 passes), else NULL."""
    g = digits(raw)
    y, m, d = F.substring(g, 1, 4), F.substring(g, 5, 2), F.substring(g, 7, 2)
    return F.when((F.length(g) >= 8) & y.between("1900", "2100") & m.between("01", "12") & d.between("01", "31"), F.concat_ws("-", y, m, d))


def source_date(pubyear: Column, pubmonth: Column, pubdate: Column, source: Column, vague: tuple) -> Column:
    """The day only from sources that know it, then the month, then the year."""
    day = (F.length(pubdate) >= 10) & ~F.coalesce(source, F.lit("")).isin(*vague)
    return (F.when(day, F.translate(F.substring(pubdate, 1, 10), ".", "-")).when(pubyear.isNotNull() & pubmonth.rlike("^[0-9]{1,2}$"), F.concat_ws("-", pubyear.cast("string"), F.lpad(pubmonth, 2, "0")))
            .otherwise(pubyear.cast("string")))


def loader_date(v: Column) -> Column:
    s = F.trim(v)
    return (F.when(s.rlike("^[0-9]{8}$"), F.concat_ws(".", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))
            .when(s.rlike("^[0-9]{6}$"), F.concat_ws(".", F.substring(s, 1, 4), F.substring(s, 5, 2), F.lit("01"))))


def deepest_date(issued: Column, others: list[Column]) -> Column:
    """issued, an array of year, month, day; a deeper one of the others replaces it only within the same year (or without issued)."""
    depth = lambda a: F.coalesce(F.size(F.filter(F.slice(a, 1, 3), lambda x: x.isNotNull())), F.lit(0))
    year = F.get(issued, 0)

    def step(best, c):
        fits = (depth(c) > depth(best)) & (year.isNull() | (F.get(c, 0) == year))
        return F.when(fits, c).otherwise(best)

    best = F.aggregate(F.array(*[F.coalesce(o, F.array().cast("array<int>")) for o in others]), F.coalesce(issued, F.array().cast("array<int>")), step)
    text = F.array_join(F.transform(F.filter(F.slice(best, 1, 3), lambda x: x.isNotNull()), lambda x, i: F.lpad(x.cast("string"), F.when(i == 0, 4).otherwise(2), "0")), "-")
    return F.nullif(text, F.lit(""))


def paper_type(db_code: Column, degree: Column) -> Column:
    return (F.when(db_code == "DIKO", F.when(degree.contains("박사"), "thesis_phd").when(degree.contains("석사"), "thesis_master").otherwise("thesis"))
            .when(db_code == "CFKO", "conference").otherwise("journal"))


def reclassified(current: Column, db_code: Column, degree: Column) -> Column:
    """The batch rule: excluded rows keep their type."""
    free = current.isNull() | (current == "thesis_excluded")
    return (F.when(db_code.isin("JAKO", "JAFO") & (current.isNull() | ~current.isin("journal", "excluded_non_stem")), "journal")
            .when((db_code == "DIKO") & (degree == "국내박사") & free, "doctoral_thesis").when((db_code == "DIKO") & (degree == "국내석사") & free, "master_thesis").otherwise(current))


def credibility(citations: Column, name: Column, quartile: Column, sci: Column, kci: Column, hint: Column) -> Column:
    """struct badge, summary. A hint can only turn the registry flag true."""
    q, kci = F.upper(quartile), F.coalesce(hint, F.lit(False)) | kci
    by_count = F.when(citations >= 50, "high").when(citations >= 10, "medium").when(citations.isNotNull(), "low").otherwise("unknown")
    by_q = F.when(q.isin("Q1", "Q2"), "high").when(q.isin("Q3", "Q4") & (by_count != "high"), "medium").otherwise(by_count)
    sci, kci = F.coalesce(sci, F.lit(False)), F.coalesce(kci, F.lit(False))
    index = (sci | kci) & ~by_q.isin("high", "medium")
    by_index = F.when(index, "medium").otherwise(by_q)
    bare = name.isNotNull() & (name != "") & (by_index == "unknown")
    q_said = q.isin("Q1", "Q2") | (q.isin("Q3", "Q4") & (by_count != "high"))
    reasons = F.array_compact(F.array(
        F.concat(F.lit("citation_count="), citations.cast("string")), F.when(q_said, F.concat(F.lit("SJR "), q)), F.when(index & sci, F.lit("SCI indexed")), F.when(index & kci, F.lit("KCI registered")), F.when(bare, F.lit("journal metadata present"))))
    summary = F.when(F.size(reasons) == 0, "No citation or journal evidence available.").otherwise(F.array_join(reasons, " / "))
    return F.struct(F.when(bare, "medium").otherwise(by_index).alias("badge"), summary.alias("summary"))


def thesis_credibility(degree: Column, affiliation: Column) -> Column:
    d, a = F.coalesce(degree, F.lit("")), F.trim(F.coalesce(affiliation, F.lit("")))
    label = F.when(d.contains("박사"), LABELS["thesis_phd"]).when(d.contains("석사"), LABELS["thesis_master"]).otherwise(LABELS["thesis"])
    return F.struct(F.when(d.contains("박사"), "medium").when(d.contains("석사"), "low").otherwise("unknown").alias("badge"), F.concat_ws(" / ", label, F.nullif(a, F.lit(""))).alias("summary"))


def trust_badge(kind: Column, degree_inst: Column, kci: Column, sci: Column, citations: Column, if_value: Column, hint: Column, full_text: Column | None = None) -> Column:
    """What a thesis or another paper shows as evidence; full_text adds whether a thesis's text is to be had, NULL if unknown and for other papers."""
    thesis = kind.isin("thesis_phd", "thesis_master")
    no = lambda c: F.when(~thesis, c)
    return F.struct(
        F.when(kind == "thesis_phd", "박사").when(kind == "thesis_master", "석사").alias("degree_type"), F.when(thesis, degree_inst).alias("institution"),
        no(F.when(hint, True).otherwise(kci)).alias("kci"), no(sci).alias("sci"), no(citations).alias("citation_count"), no(if_value).alias("if_value"),
        *([] if full_text is None else [F.when(thesis, full_text).alias("full_text_available")]))


def first_filled(rows: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row per key; each column's first value that is not NULL, empty or 0, by order."""
    filled = lambda c: F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0", "0.0", "false")
    return rows.groupBy(key).agg(*[F.min_by(F.col(c), F.when(filled(c), F.col(order))).alias(c) for c in cols])


def department(dept: Column, inst: Column) -> Column:
    own = F.nullif(F.trim(dept), F.lit(""))
    return F.struct(F.coalesce(own, F.nullif(F.trim(inst), F.lit(""))).alias("text"), F.when(own.isNotNull(), "department").when(F.nullif(F.trim(inst), F.lit("")).isNotNull(), "institution").alias("source"))


def detail_id(internal: Column, external: Column) -> Column:
    return F.coalesce(internal, F.when(external.rlike("^ART[0-9]+$"), external))


def cost_micro(tin: Column, tout: Column, write: Column, read: Column, p: Column, q: Column) -> Column:
    return (tin * p + tout * q + write * p * 1.25 + read * p * 0.1).cast("long")


def priced(calls: DataFrame, prices: dict = PRICES) -> DataFrame:
    """calls with p and q of their model: the exact name, else the longest name that starts the model's."""
    p, q = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name in sorted(prices, key=len):
        hit = F.col("model").startswith(name)
        p, q = F.when(hit, prices[name][0]).otherwise(p), F.when(hit, prices[name][1]).otherwise(q)
    return calls.withColumns({"p": p, "q": q})


def completeness(doi: Column, issn: Column, keywords: Column, authors: Column, refs: Column) -> Column:
    one = lambda c, k: F.when(c, k).otherwise(0)
    return one(F.coalesce(doi, F.lit("")) != "", 2) + one(F.coalesce(issn, F.lit("")) != "", 1) + one(keywords >= 3, 1) + one(authors >= 1, 1) + one(refs >= 1, 1)


def researcher_id(name: Column, root: Column) -> Column:
    key = F.concat_ws("|", F.regexp_replace(F.lower(name), r"[ \t\r\n]+", ""), F.regexp_replace(F.lower(root), r"[ \t\r\n]+", ""))
    return F.concat(F.lit("kci:"), F.substring(F.sha1(key), 1, 16))


def search_item(text: Column, keywords: Column, year: Column, issn: Column, score: Column) -> Column:
    """A list field from a `;` string or a list, a year of digits only, the first ISSN and four decimals."""
    items = F.filter(F.transform(F.split(keywords, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.trim(text).alias("title"), F.array_join(items, "|").alias("keywords"), F.when(year.rlike("^[0-9]+$"), year.try_cast("int")).alias("year"), F.get(F.split(issn, ";"), 0).alias("issn"), F.round(score, 4).alias("score"))
