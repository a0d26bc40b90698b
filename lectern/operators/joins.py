"""Joins, anti-joins and key resolution."""
from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from .projections import paper_type
from .windows import global_rank


def paper_cards(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """Papers with their journal by key: registered by code or registry, sci false where unknown."""
    j = journals.select(F.col("id").alias("jid"), F.col("title").alias("jtitle"), "kci_indexed", "sci_indexed")
    x = papers.join(j, F.col("journal_id") == F.col("jid"), "left")
    return x.select(
        "id", "title", paper_type(F.col("db_code"), F.col("degree")).alias("kind"), F.coalesce("jtitle", "journal_name").alias("journal"), F.coalesce("citation_count", F.lit(0)).cast("long").alias("citations"),
        ((F.col("db_code") == "JAKO") | F.coalesce("kci_indexed", F.lit(False))).alias("registered"), F.coalesce("sci_indexed", F.lit(False)).alias("sci"))


def issn_forms(raw: Column) -> Column:
    """The bare eight characters and the hyphenated form; both must be looked up."""
    bare = F.upper(F.regexp_replace(raw, "[^0-9Xx]", ""))
    return F.when(F.length(bare) == 8, F.array(bare, F.concat_ws("-", F.substring(bare, 1, 4), F.substring(bare, 5, 4)))).otherwise(F.array().cast("array<string>"))


def best_by_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the order must be total."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def journal_keys(journals: DataFrame) -> DataFrame:
    """One row per journal and distinct bare ISSN: turns an OR of two columns into one equi-join key."""
    return journals.select(F.explode(F.array_distinct(F.array_compact(F.array("issn", "e_issn")))).alias("key"), "*")




def quality_order() -> list[Column]:
    """Best journal first: latest ranking year, score, h-index, unknown as -1, then id."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).desc() for c in ("sjr_year", "sjr_score", "h_index")] + [F.col("id").asc()]


def or_join(items: DataFrame, journals: DataFrame) -> DataFrame:
    """item key, id of every journal with the key in either column, each once."""
    return items.join(journal_keys(journals).select("key", F.col("id").alias("journal_id")), "key").select("item", "journal_id").distinct()


def best_journal(items: DataFrame, journals: DataFrame) -> DataFrame:
    """item (item, key, title): the best journal that shares an ISSN or the case-folded title; NULL without one."""
    j = journals.withColumn("t", F.lower(F.trim("title")))
    cols = ["id", "sjr_year", "sjr_score", "h_index"]
    by_key = items.join(journal_keys(journals).select("key", *cols), "key")
    by_title = items.withColumn("t", F.lower(F.trim("title"))).join(j.select("t", *cols), "t")
    best = best_by_key(by_key.select("item", *cols).union(by_title.select("item", *cols)), ["item"], quality_order())
    return items.select("item").join(best.select("item", F.col("id").alias("journal_id")), "item", "left")


def first_wins(items: DataFrame, journals: DataFrame) -> DataFrame:
    """As best_journal, but any ISSN match beats any title match."""
    j = journals.withColumn("t", F.lower(F.trim("title")))
    by_key = best_by_key(journal_keys(journals), ["key"], quality_order()).select("key", F.col("id").alias("k_id"))
    by_title = best_by_key(j, ["t"], quality_order()).select("t", F.col("id").alias("t_id"))
    x = items.withColumn("t", F.lower(F.trim("title"))).join(by_key, "key", "left").join(by_title, "t", "left")
    return x.select("item", F.coalesce("k_id", "t_id").alias("journal_id"))


def lateral_journal(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """The paper's own journal, else the one of its title (indexed ones first), ranked once instead of per row."""
    ranked = best_by_key(journals.withColumn("t", F.lower(F.trim("title"))), ["t"], [F.col("sci_indexed").desc_nulls_last(), F.col("id").asc()]).select("t", F.col("id").alias("t_id"))
    x = papers.withColumn("t", F.when(F.col("journal_id").isNull(), F.lower(F.trim("journal_name")))).join(ranked, "t", "left")
    return x.select("id", F.coalesce("journal_id", "t_id").alias("journal_id"), F.col("t_id").isNotNull().alias("by_title"))


def researcher_papers(corpus: DataFrame, external: DataFrame) -> DataFrame:
    """rid, paper_id, source: external rows win over corpus rows of the same paper."""
    only = corpus.join(external, ["rid", "paper_id"], "left_anti")
    return external.select("rid", "paper_id", F.lit("external").alias("source")).unionByName(only.select("rid", "paper_id", F.lit("corpus").alias("source")))


def coauthors(*link_tables: DataFrame) -> DataFrame:
    """rid, other, shared: distinct papers in common over the union of link tables, for every ordered pair."""
    links = link_tables[0].select("rid", "paper_id")
    for t in link_tables[1:]:
        links = links.union(t.select("rid", "paper_id"))
    links = links.distinct()
    return links.join(links.withColumnRenamed("rid", "other"), "paper_id").where("rid <> other").groupBy("rid", "other").agg(F.count("*").alias("shared"))


def undirected_edges(*link_tables: DataFrame) -> DataFrame:
    links = link_tables[0].select("rid", "paper_id")
    for t in link_tables[1:]:
        links = links.union(t.select("rid", "paper_id"))
    links = links.distinct()
    return links.join(links.withColumnRenamed("rid", "b"), "paper_id").where("rid < b").select(F.col("rid").alias("a"), "b").distinct()


#: Papers take part with all sets of `least` of their keywords up to the size at which the sets are MOST_SETS a paper, or in all MOST_TIMES the keywords; `least` is no
#: more than DEEPEST.
MOST_SETS, MOST_TIMES, DEEPEST = 20_000, 16, 6


def _sets_of(names: Column, k: int) -> Column:
    """All sets of k elements of a sorted array, each sorted."""
    if k == 1:
        return F.transform(names, lambda x: F.array(x))
    return F.flatten(F.transform(names, lambda x, i: F.transform(_sets_of(F.slice(names, i + 2, F.size(names)), k - 1), lambda rest: F.concat(F.array(x), rest))))


def overlap_pairs(tags: DataFrame, least: int) -> DataFrame:
    """Pairs a < b of papers with at least `least` keywords in common (rows paper_id, name), and how many.

    A pair meets in every set of `least` keywords that both have and is taken in the first one, so there are no candidates beside the result, and pairs are
    not shuffled. Papers of too many such sets (MOST_SETS, MOST_TIMES) meet all others otherwise: with a paper's n keywords in order of rarity, a pair has a common one among
    the first n - least + 1 of each, and the candidates' lists decide."""
    from ..llm.common import stage

    tags = tags.select("paper_id", "name").where("paper_id IS NOT NULL AND name IS NOT NULL")
    if tags.schema["name"].dataType not in (IntegerType(), LongType()):  # numbers in place of names
        names = tags.select("name").distinct()
        tags = tags.join(global_rank(names, ["name"], "code", names.count()), "name").select("paper_id", F.col("code").cast("int").alias("name"))
    papers = stage(tags.groupBy("paper_id").agg(F.array_sort(F.collect_set("name")).alias("names")))  # a table, so that both sides of the join are one shuffle
    sizes = sorted(map(tuple, papers.groupBy(F.size("names")).count().collect()))  # a row for each size of a list
    room, longest = MOST_TIMES * sum(n * k for n, k in sizes), 0
    for n, k in sizes if least <= DEEPEST else ():
        if comb(n, least) > MOST_SETS or (room := room - comb(n, least) * k) < 0:
            break
        longest = n
    size = F.size("names")
    keys = [f"k{i}" for i in range(least)] if longest else []
    found = None
    if longest:
        x = papers.where((size >= least) & (size <= longest)).select("paper_id", "names", F.explode(_sets_of(F.col("names"), least)).alias("set"))
        x = x.select("paper_id", *[F.col("set")[i].alias(k) for i, k in enumerate(keys)], F.array_except("names", "set").alias("rest"))
        kinds = papers.select(F.explode("names").alias("name")).distinct().count()
        if comb(kinds, least) > sum(comb(n, least) * k for n, k in sizes if n <= longest):  # most sets are of one paper, which goes before the join
            x = stage(x.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1").drop("n"))
        both = F.array_intersect("rest", "rest2")
        found = x.join(x.select(F.col("paper_id").alias("b"), *keys, F.col("rest").alias("rest2")), keys).where("paper_id < b")
        found = found.where(F.coalesce(F.array_min(both) > F.col(keys[-1]), F.lit(True))).select(F.col("paper_id").alias("a"), "b", (F.size(both) + least).cast("long").alias("shared"))
        if longest == sizes[-1][0]:
            return found
    often = papers.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("often"))
    held = papers.where(size >= least).select("paper_id", (size > longest).alias("long"), F.explode("names").alias("name"))
    rare = held.join(often, "name").groupBy("paper_id", "long").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "name"))), lambda x: x["name"]).alias("names"))
    first = rare.select("paper_id", "long", F.explode(F.slice("names", F.lit(1), size - (least - 1))).alias("name"))
    meets = first.where("long").select(F.col("paper_id").alias("a"), "name").join(first.select(F.col("paper_id").alias("b"), F.col("long").alias("too"), "name"), "name").where("a < b OR (a > b AND NOT too)")
    pairs = meets.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = pairs.join(papers.toDF("a", "na"), "a").join(papers.toDF("b", "nb"), "b")
    rest = x.select("a", "b", F.size(F.array_intersect("na", "nb")).cast("long").alias("shared")).where(F.col("shared") >= least)
    return rest if found is None else found.union(rest)


def positional_pairs(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Rows id, pos, left, right of two arrays by place; places that one lacks go."""
    z = rows.select("id", F.posexplode(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))).alias("pos", "z"))
    return z.select("id", "pos", F.col("z.l").alias("l"), F.col("z.r").alias("r")).where("l IS NOT NULL AND r IS NOT NULL")


def resolve_two(keys: DataFrame, by_id: DataFrame, by_alt: DataFrame) -> DataFrame:
    """key -> id: the row whose id is the key beats the one whose alternate is."""
    x = keys.join(by_id.select(F.col("id").alias("key"), F.col("id").alias("direct")), "key", "left").join(by_alt.select(F.col("alt").alias("key"), F.col("id").alias("other")), "key", "left")
    return x.select("key", F.coalesce("direct", "other").alias("id"))


def title_year_matches(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """ref, id: the least id of the papers of a reference's title whose year is its own, or unknown on either side.

    Rows refs ref, t, y; papers id, t, pubyear. Papers are cut down to the least id of each title and year first, so a common title makes no pairs."""
    per = papers.groupBy("t", "pubyear").agg(F.min("id").alias("id"))
    title = per.groupBy("t").agg(F.min("id").alias("every"), F.min(F.when(F.col("pubyear").isNull(), F.col("id"))).alias("undated"))
    x = refs.join(title, "t").join(per.where("pubyear IS NOT NULL").withColumnRenamed("pubyear", "y"), ["t", "y"], "left")
    best = F.when(F.col("y").isNull(), F.col("every")).otherwise(F.least("undated", "id"))
    return x.select("ref", best.alias("id")).where("id IS NOT NULL").groupBy("ref").agg(F.min("id").alias("id"))


def unique_matches(rows: DataFrame, key: str, target: str) -> DataFrame:
    """key, target where a key has exactly one distinct target; counted without gathering a key's rows."""
    return rows.groupBy(key).agg(F.count_distinct(target).alias("n"), F.min(target).alias(target)).where("n = 1").drop("n")


def paired_authors(works: DataFrame) -> DataFrame:
    """id, author_order (from 1), author, affiliation, role of works id, author and affiliation (lists with semicolons), names (an array, used where no
    author is given) and degree.

    Empty parts are dropped, then parts pair by place; what lacks a partner has none. A thesis (a degree that is not empty) has a sole author's role. Works
    without authors give no row."""
    from .text import SOLE_AUTHOR

    filled = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    parts = lambda c: filled(F.split(F.coalesce(F.col(c), F.lit("")), ";"))
    given = parts("author")
    authors = F.when(F.size(given) > 0, given).otherwise(filled(F.coalesce("names", F.array().cast("array<string>"))))
    x = works.select("id", "degree", parts("affiliation").alias("at"), F.posexplode(authors).alias("i", "author"))
    role = F.when(F.col("degree") != "", SOLE_AUTHOR)
    return x.select("id", (F.col("i") + 1).alias("author_order"), "author", F.get("at", F.col("i")).alias("affiliation"), role.alias("role"))
