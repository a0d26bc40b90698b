"""Property-graph patterns as joins, keyword maps, citation graphs, connected components."""
from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ensure_checkpoint_dir, top_per_group


def both_ways(related: DataFrame) -> DataFrame:
    """Stored once in key order, queried as undirected."""
    return related.select(F.col("k1").alias("a"), F.col("k2").alias("b"), "n").union(related.select("k2", "k1", "n"))


def paper_star(papers: DataFrame, tags: DataFrame, limit: int) -> DataFrame:
    """id, kind, node: a paper's first keywords, author, journal and year."""
    k = top_per_group(tags, ["paper_id"], ["pos", "name"], limit).select(F.col("paper_id").alias("id"), F.lit("keyword").alias("kind"), F.col("name").alias("node"))
    own = F.create_map(F.lit("author"), F.col("author").cast("string"), F.lit("journal"), F.col("journal_name"), F.lit("year"), F.col("pubyear").cast("string"))
    return k.join(papers.select("id"), "id", "left_semi").union(papers.select("id", F.explode(own).alias("kind", "node")).where("node IS NOT NULL"))


def star_nodes(papers: DataFrame, tags: DataFrame, authors: DataFrame, limit: int) -> DataFrame:
    """center, id, label, name, is_center: each paper and what it meets, every id once.

    Rows papers id, title, title_en, journal, year; tags paper_id, lang, name, of which the first `limit` by language and name count; authors paper_id,
    name, author_order. Spellings of one keyword key are one node, under the last name; authors are told apart by name. Empty titles give way to the
    English one and then to the id; a paper without journal or year has no such node."""
    title = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("title", "title_en")], F.col("id").cast("string"))
    own = papers.select(F.col("id").alias("center"), _node("paper", F.col("id")).alias("id"), F.lit("Paper").alias("label"), title.alias("name"), F.lit(True).alias("is_center"))
    near = _star_rows(papers, tags, authors, limit).groupBy("center", "id", "label").agg(F.max("name").alias("name"))
    return own.union(near.select("center", "id", "label", "name", F.lit(False)))


def star_edges(papers: DataFrame, tags: DataFrame, authors: DataFrame, limit: int) -> DataFrame:
    """center, source, target, type, lang, author_order: the relations of the nodes of `star_nodes`, one for each row that they come from; authors point to the paper, it
    to the rest."""
    x = _star_rows(papers, tags, authors, limit)
    here, author = _node("paper", F.col("center")), F.col("label") == "Author"
    kind = F.create_map(*[F.lit(v) for pair in (("Keyword", "HAS_KEYWORD"), ("Author", "AUTHORED"), ("Journal", "PUBLISHED_IN"), ("Year", "PUBLISHED_IN_YEAR")) for v in pair])
    return x.select("center", F.when(author, F.col("id")).otherwise(here).alias("source"), F.when(author, here).otherwise(F.col("id")).alias("target"), kind[F.col("label")].alias("type"), "lang", "author_order")


def _node(kind: str, key) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def _star_rows(papers: DataFrame, tags: DataFrame, authors: DataFrame, limit: int) -> DataFrame:
    from .text import keyword_key

    none = lambda kind: F.lit(None).cast(kind)
    row = lambda x, center, label, key, name, lang=none("string"), order=none("int"): x.select(
        F.col(center).alias("center"), _node(label.lower(), key).alias("id"), F.lit(label).alias("label"), name.cast("string").alias("name"), lang.alias("lang"), order.cast("int").alias("author_order"))
    known = papers.select(F.col("id").alias("paper_id"))
    k = top_per_group(tags, ["paper_id"], ["lang", "name"], limit).join(known, "paper_id", "left_semi")
    a = authors.where("name IS NOT NULL").join(known, "paper_id", "left_semi")
    name, journal, year = F.col("name"), F.col("journal"), F.col("year")
    return (row(k, "paper_id", "Keyword", keyword_key(name, F.col("lang")), name, lang=F.col("lang")).union(row(a, "paper_id", "Author", name, name, order=F.col("author_order")))
            .union(row(papers.where("journal IS NOT NULL"), "id", "Journal", journal, journal)).union(row(papers.where("year IS NOT NULL"), "id", "Year", year, year)))


def keyword_page(papers: DataFrame, tags: DataFrame, authors: DataFrame, key: str, limit: int, offset: int) -> DataFrame:
    """place, id, title, pubyear, authors, keywords, keyword_keys, total: a page of the papers that have the keyword of that key.

    Rows papers id, title, pubyear; tags paper_id, lang, name; authors paper_id, name, author_order. Latest papers first (no year: 0), then by title and id; authors by
    order, nameless ones left out; keywords by language and name; total counts all papers with the keyword. Lists are made for the page alone."""
    from .text import keyword_key

    of = keyword_key(F.col("name"), F.col("lang"))
    held = papers.join(tags.where(of == key).select(F.col("paper_id").alias("id")), "id", "left_semi")
    order = [F.coalesce("pubyear", F.lit(0)).desc(), F.col("title").asc_nulls_last(), F.col("id").asc()]
    page = held.orderBy(*order).offset(offset).limit(limit)
    page = page.select("id", "title", "pubyear", F.row_number().over(Window.orderBy(*order)).alias("place"))
    ids = F.broadcast(page.select(F.col("id").alias("paper_id")))  # at most `limit` rows
    lists = lambda rows, by, **out: rows.join(ids, "paper_id").groupBy(F.col("paper_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*by))).alias("x")).select(
        "id", *[F.col(f"x.{c}").alias(n) for n, c in out.items()])
    a = lists(authors.where("name IS NOT NULL"), ["author_order", "name"], authors="name")
    k = lists(tags.withColumn("key", of), ["lang", "name", "key"], keywords="name", keyword_keys="key")
    empty = F.array().cast("array<string>")
    x = page.join(a, "id", "left").join(k, "id", "left").crossJoin(held.agg(F.count("*").alias("total")))
    return x.select((F.col("place") + offset).alias("place"), "id", "title", "pubyear", *[F.coalesce(c, empty).alias(c) for c in ("authors", "keywords", "keyword_keys")], "total")


def papers_by_keyword(papers: DataFrame, tags: DataFrame, name: str, limit: int, offset: int) -> DataFrame:
    """A page of the papers that have the keyword, with all their keywords in order."""
    page = papers.join(tags.where(F.col("name") == name).select(F.col("paper_id").alias("id")), "id", "left_semi").orderBy(F.col("pubyear").desc_nulls_last(), "id").offset(offset).limit(limit)
    k = tags.join(F.broadcast(page.select(F.col("id").alias("paper_id"), "title")), "paper_id").groupBy(F.col("paper_id").alias("id"), "title").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("k"))
    return k.select("id", "title", F.array_join(F.transform("k", lambda x: x["name"]), "|").alias("keywords"))


def anchor_children(related: DataFrame, counts: DataFrame, anchors: DataFrame, k: int, least: int = 1) -> DataFrame:
    """anchor, child, n, rank: the k most co-occurring keywords that are not commoner than the anchor (ties included)."""
    c = counts.select(F.col("name").alias("b"), F.col("papers").alias("pb"))
    a = counts.select(F.col("name").alias("a"), F.col("papers").alias("pa"))
    e = both_ways(related).join(anchors.select(F.col("name").alias("a")), "a", "left_semi").where(F.col("n") >= least)
    e = e.join(a, "a").join(c, "b").where("pb <= pa")
    rn = F.row_number().over(Window.partitionBy("a").orderBy(F.col("n").desc(), "b"))
    return e.withColumn("rank", rn).where(F.col("rank") <= k).select(F.col("a").alias("anchor"), F.col("b").alias("child"), "n", "rank", "pa", "pb")


def map_with_more(related: DataFrame, counts: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """anchor, child, n, rank, has_more (whether the child has a keyword below it, ties included, that is not placed yet) and anchor_more
    (whether the anchor has one that is strictly rarer). Placed are the anchor and its k children."""
    kids = anchor_children(related, counts, anchors, k)
    below = anchor_children(related, counts, counts, 1 << 30).select(F.col("anchor").alias("a"), F.col("child").alias("b"), (F.col("pb") < F.col("pa")).alias("rarer"))
    sizes = below.groupBy("a").agg(F.count("*").alias("below"), F.max("rarer").alias("rarer"))
    placed = kids.select("anchor", F.col("child").alias("b")).union(kids.select("anchor", F.col("anchor").alias("b")).distinct())
    # A child meets the few placed keywords of its map, not all of its neighbours.
    near = kids.select("anchor", F.col("child").alias("a")).join(placed, "anchor").join(below.select("a", "b"), ["a", "b"]).groupBy("anchor", F.col("a").alias("child")).agg(F.count("*").alias("taken"))
    x = kids.join(near, ["anchor", "child"], "left").join(sizes.select(F.col("a").alias("child"), "below"), "child", "left").join(sizes.select(F.col("a").alias("anchor"), "rarer"), "anchor", "left")
    more = F.coalesce("below", F.lit(0)) > F.coalesce("taken", F.lit(0))
    return x.select("anchor", "child", "n", "rank", more.alias("has_more"), F.coalesce("rarer", F.lit(False)).alias("anchor_more"))


def cross_links(children: DataFrame, related: DataFrame, hub: int = 3) -> tuple[DataFrame, DataFrame]:
    """Links among the children of one anchor, and the children that `hub` or more of them meet."""
    c = children.select("anchor", "child")
    e = related.join(c.select("anchor", F.col("child").alias("k1")), "k1").join(c.select("anchor", F.col("child").alias("k2")), ["anchor", "k2"]).select("anchor", "k1", "k2", "n")
    ends = e.select("anchor", F.col("k1").alias("child")).union(e.select("anchor", "k2"))
    return e, ends.groupBy("anchor", "child").agg(F.count("*").alias("links")).where(F.col("links") >= hub)


def expand(related: DataFrame, counts: DataFrame, node: str, shown: list[str], k: int) -> DataFrame:
    one = counts.where(F.col("name") == node)
    return anchor_children(related, counts, one, 1 << 30).where(~F.col("child").isin(node, *shown)).orderBy(F.col("n").desc(), "child").limit(k).select("child", "n")


#: Keyword tables of so many rows at most are sent to every task.
LITTLE_MAP = 100_000


def expand_with_links(related: DataFrame, counts: DataFrame, requests: DataFrame, shown: DataFrame, k: int = 3) -> DataFrame:
    """session, kind, source, target, n, has_more, parent_has_more: what opening a node adds to each session's map.

    Rows requests session, node (one a session); shown session, name. `tree` rows lead to the first k keywords below the node, ties included, that are not
    shown; `cross_link` rows join a new keyword and any placed one, once a pair and never along a tree row. has_more: whether a new keyword has one
    below it that is not placed; parent_has_more: whether the node has more than k to add. A session without a new keyword has one row of kind
    `none`. A session holds few keywords: they are gathered once, in one row, and p of them hide p of a node's keywords at most, so the first p + k + 1 decide.
    The map is checked in size and sent to all tasks where it is little, so that sessions are not shuffled again."""
    from ..llm.common import stage

    related = stage(related.select("k1", "k2", "n"))
    of = F.broadcast if related.count() <= LITTLE_MAP else lambda x: x
    below = stage(anchor_children(related, counts, counts, 1 << 30).select("anchor", "child", "n", "rank"))
    held = shown.where("name IS NOT NULL").groupBy("session").agg(F.collect_set("name").alias("placed"))
    x = requests.select("session", F.col("node").alias("anchor")).join(held, "session", "left")
    x = x.withColumn("placed", F.array_union(F.coalesce("placed", F.array().cast("array<string>")), F.array("anchor")))
    left = x.join(of(below), "anchor").where((F.col("rank") <= F.size("placed") + k + 1) & ~F.array_contains("placed", F.col("child")))
    left = left.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("rank", "child", "n"))).alias("new"))
    t = x.join(left, "session", "left").withColumn("parent_has_more", F.coalesce(F.size("new") > k, F.lit(False)) & F.col("new").isNotNull())
    t = t.withColumn("new", F.slice(F.coalesce("new", F.array().cast("array<struct<rank:int,child:string,n:bigint>>")), 1, k))
    t = stage(t.withColumn("every", F.array_union("placed", F.transform("new", lambda c: c["child"]))))
    # A keyword with more below it than a session has in all has more; of the others the lists are short.
    longest = t.agg(F.max(F.size("every"))).first()[0] or 0
    sizes = below.groupBy(F.col("anchor").alias("child")).agg(F.count("*").alias("below"), F.collect_list(F.when(F.col("rank") <= longest, F.col("child"))).alias("first"))
    tree = t.select("session", "anchor", "every", "parent_has_more", F.explode_outer("new").alias("c")).select("session", "anchor", "every", "parent_has_more", "c.child", "c.n").join(of(sizes), "child", "left")
    more = F.coalesce((F.col("below") > F.size("every")) | (F.size(F.array_except("first", "every")) > 0), F.lit(False))
    tree = tree.select("session", F.when(F.col("child").isNull(), "none").otherwise("tree").alias("kind"), F.col("anchor").alias("source"), F.col("child").alias("target"), "n",
                       F.when(F.col("child").isNotNull(), more).alias("has_more"), "parent_has_more")
    met = lambda c, names: F.transform(names, lambda e: F.struct(F.least(c["child"], e).alias("k1"), F.greatest(c["child"], e).alias("k2")))
    pairs = F.array_distinct(F.flatten(F.transform("new", lambda c: met(c, F.filter("every", lambda e: (e != c["child"]) & (e != F.col("anchor")))))))
    links = t.select("session", "parent_has_more", F.explode(pairs).alias("p")).select("session", "parent_has_more", "p.k1", "p.k2").join(of(related), ["k1", "k2"])
    return tree.union(links.select("session", F.lit("cross_link"), "k1", "k2", "n", F.lit(None).cast("boolean"), "parent_has_more"))


def recenter(related: DataFrame, counts: DataFrame, anchor: str, shown: list[str], k: int = 6, cap: int = 25) -> DataFrame:
    """name, n, carried: the new anchor's children, then shown nodes that it meets and that are not commoner, up to the cap."""
    every = anchor_children(related, counts, counts.where(F.col("name") == anchor), 1 << 30)
    kept = (F.col("rank") <= k) | F.col("child").isin(*shown)
    x = every.where(kept).select(F.col("child").alias("name"), "n", (F.col("rank") > k).alias("carried"))
    return x.orderBy("carried", F.col("n").desc(), "name").limit(cap)


def keyword_graph(related: DataFrame, counts: DataFrame, name: str, limit: int, least: int) -> DataFrame:
    e = both_ways(related).where((F.col("a") == name) & (F.col("n") >= least)).orderBy(F.col("n").desc(), "b").limit(limit)
    return e.join(counts.select(F.col("name").alias("b"), "papers"), "b").select(F.col("a").alias("centre"), F.col("b").alias("name"), "n", "papers")


def citation_graph(inside: DataFrame, outside: DataFrame, limit: int) -> DataFrame:
    """src, dst, origin, rank: own papers first, then external ones, up to the limit. Rows src, dst, year, title."""
    x = inside.withColumn("o", F.lit(0)).unionByName(outside.withColumn("o", F.lit(1)))
    rn = F.row_number().over(Window.partitionBy("src").orderBy("o", F.col("year").desc_nulls_last(), "title", "dst"))
    n = F.count("*").over(Window.partitionBy("src"))
    return x.withColumns({"rank": rn, "total": n}).where(F.col("rank") <= limit).select("src", "dst", F.when(F.col("o") == 0, "own").otherwise("external").alias("origin"), "rank", (F.col("total") > limit).alias("has_more"))


def star_graph(query: str, items: DataFrame, top: float) -> DataFrame:
    return items.select(F.lit(query).alias("field"), "rid", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / top)).alias("weight"))


def materialised(refs: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of references that an alias (external, id) resolves, and the rows that stay unresolved. Rows src, external."""
    a = alias.select("external", "id")
    return refs.join(a, "external").where("src <> id").select("src", F.col("id").alias("dst")).distinct(), refs.join(a, "external", "left_anti")


def keyword_clusters(nodes: DataFrame, tags: DataFrame, least: int = 2) -> DataFrame:
    """session, node, cluster: own papers of a shown graph that hang together by `least` or more keywords in common.

    Rows nodes session, node, at (place in the graph), own; tags paper_id, name. Clusters of two or more are numbered from 1 in each session, in the order of
    their first nodes; all other nodes have none. Pairs come from a paper's rarest keywords within its session (`overlap_pairs`)."""
    from .joins import overlap_pairs

    own = nodes.where("own").select(F.struct("session", "node").alias("key"), "session", "node", "at")
    held = own.join(tags.select(F.col("paper_id").alias("node"), "name"), "node")
    pairs = overlap_pairs(held.select(F.col("key").alias("paper_id"), F.struct("session", "name").alias("name")), least)
    comp = components(own.select("key").distinct(), pairs.select("a", "b")).withColumnRenamed("node", "key")
    sizes = own.join(comp, "key").groupBy("session", "comp").agg(F.count_distinct("key").alias("n"), F.min(F.struct("at", "node")).alias("first")).where("n > 1")
    number = sizes.select("session", "comp", F.row_number().over(Window.partitionBy("session").orderBy("first")).alias("cluster"))
    found = comp.join(number, "comp").select(F.col("key.session").alias("session"), F.col("key.node").alias("node"), "cluster")
    return nodes.select("session", "node").distinct().join(found, ["session", "node"], "left").select("session", "node", "cluster")


def components(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, comp (least node of the component; alone: itself), of edges a, b.

    Large-star and small-star steps on written tables; stops when a round changes nothing. Where `rounds` are given and do not
    suffice, it raises."""
    ensure_checkpoint_dir(nodes.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    last = None
    for n in count():
        if n == rounds:
            raise RuntimeError(f"components have not converged in {rounds} rounds")
        both = e.union(e.select("v", "u")).toDF("u", "v")
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", "m")).where("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    comp = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.toDF("node").join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
