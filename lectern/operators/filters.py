"""Predicates and orders."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .projections import paper_type
from .windows import global_rank

#: Codes of each listed type.
CODES = {"journal": ("JAKO", "JAFO"), "conference": ("CFKO",), "thesis": ("DIKO",)}
#: Codes of papers in foreign citation indexes.
SCI_CODES = ("SCIE", "SSCI", "AHCI")


def year_range(year: int | None, start: int | None, end: int | None) -> tuple[int | None, int | None]:
    """A range beats the single year; reversed bounds are swapped."""
    if start is None and end is None:
        return year, year
    return (end, start) if start is not None and end is not None and start > end else (start, end)


def normal_years(start: Column, end: Column) -> tuple[Column, Column]:
    """The same for columns: reversed bounds are swapped."""
    swap = F.coalesce(start > end, F.lit(False))
    return F.when(swap, end).otherwise(start), F.when(swap, start).otherwise(end)


def year_in_range(year: Column, lo: int | None, hi: int | None) -> Column:
    """Inclusive; an unknown year fails as soon as a side is set."""
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (year >= lo)
    return ok & (year <= hi) if hi is not None else ok


def list_filter(items: DataFrame, year=(None, None), kind: str | None = None, kci: bool | None = None, sci: bool | None = None) -> DataFrame:
    """The list's filter: sci works only when true."""
    ok = year_in_range(F.col("pubyear"), *year)
    if kind not in (None, "all"):
        ok = ok & F.col("db_code").isin(*CODES[kind])
    if kci is not None:
        ok = ok & ((F.col("db_code") == "JAKO") == kci)
    if sci:
        ok = ok & F.col("db_code").isin(*SCI_CODES)
    return items.where(ok)


def type_postfilter(cards: DataFrame, kind: str | None) -> DataFrame:
    return cards if kind in (None, "all") else cards.where(paper_type(F.col("db_code"), F.col("degree")) == kind)


def researcher_filter(rows: DataFrame, year=(None, None), kci: bool | None = None, sci: bool | None = None) -> DataFrame:
    """The researcher's filter: registered through an external id or the code; sci works both ways."""
    ok = year_in_range(F.col("pubyear"), *year)
    if kci is not None:
        ok = ok & ((F.col("external_id").isNotNull() | (F.col("db_code") == "JAKO")) == kci)
    if sci is not None:
        ok = ok & (F.coalesce("sci_indexed", F.lit(False)) == sci)
    return rows.where(ok)


def relevance_floor(rows: DataFrame, share: float) -> DataFrame:
    """Rows within share of the best similarity of all rows: a scalar aggregate, so later filters cannot move it."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max("sim").alias("__top")))).where(F.col("sim") >= share * F.col("__top")).drop("__top")


def distance_cut(rows: DataFrame, most: float, beyond: float, limit: int) -> DataFrame:
    best = rows.agg(F.min("dist").alias("__min"))
    return rows.crossJoin(F.broadcast(best)).where((F.col("dist") <= most) & (F.col("dist") <= F.col("__min") + beyond)).orderBy("dist", "id").limit(limit).drop("__min")


def usable_anchor(name: Column) -> Column:
    return (F.length(name) <= 120) & (F.size(F.split(F.trim(name), "[ \\n\\t\\r]+")) <= 8)


def displayable(external_id: Column, title: Column, domestic: str = "ART%") -> Column:
    return external_id.like(domestic) | (title.isNotNull() & ~title.rlike("[가-힣]"))


def valid_record(abstract: Column, n_keywords: Column, code: Column) -> Column:
    return abstract.isNotNull() & ((code == "CFKO") | (F.coalesce(n_keywords, F.lit(0)) > 0))


def bookmark_search(rows: DataFrame, title: str, keyword: str, codes: tuple, years: tuple, sci: bool | None = None) -> DataFrame:
    """Title or keywords hold the text, codes and a half-open year window; sci false means false or unknown."""
    hit = F.col("title").ilike(f"%{title}%") | F.coalesce(F.col("kw").ilike(f"%{keyword}%"), F.lit(False))
    ok = hit & (F.col("pubyear") >= years[0]) & (F.col("pubyear") < years[1]) & F.col("db_code").isin(*codes)
    if sci is not None:
        ok = ok & (F.coalesce("sci_indexed", F.lit(False)) == sci)
    return rows.where(ok)


def result_order(mode: str, tie: str) -> list:
    first = {"year_asc": [F.col("pubyear").asc_nulls_last()], "year_desc": [F.col("pubyear").desc_nulls_last()], "citation": [F.coalesce("citation_count", F.lit(0)).desc()], "relevance": []}[mode]
    return [*first, F.col(tie)]


def list_sorted(items: DataFrame, mode: str) -> DataFrame:
    """Every item with its place rn in the list's order; an unknown year is 0, so first when oldest. Ties go by id."""
    y = F.coalesce("pubyear", F.lit(0))
    first = {"latest": y.desc(), "oldest": y.asc(), "citation": F.coalesce("citation_count", F.lit(0)).desc()}[mode]
    return global_rank(items, [first, F.col("id").asc()], "rn", items.count())


def researcher_order(mode: str) -> list:
    y, m = F.coalesce("pubyear", F.lit(0)).desc(), F.coalesce(F.col("pubmonth").try_cast("int"), F.lit(0)).desc()
    return [y, m, F.col("title").desc()] if mode == "recent" else [F.coalesce("citation_count", F.lit(-1)).desc(), y, m]


def downgraded(rows: DataFrame, group: str, cited: Column, least: int) -> DataFrame:
    """Every row with its place rn in its group: by citations if `least` of the group's rows are cited, else by year."""
    x = rows.withColumn("ok", F.count_if(cited).over(Window.partitionBy(group)) >= least)
    w = Window.partitionBy(group).orderBy(F.when(F.col("ok"), F.coalesce("citation_count", F.lit(-1))).otherwise(0).desc(), F.coalesce("pubyear", F.lit(0)).desc(), "paper_id")
    return x.withColumn("rn", F.row_number().over(w))
