"""Aggregations: co-occurrence, entropy, bins, percentiles, retrieval metrics, roll-ups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import global_before, global_rank


def cooccurrence(tags: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """Rows paper_id, name, lang -> k1 < k2, lang_pair, n. translations: pairs k1, k2 that do not count."""
    a = tags.select("paper_id", F.col("name").alias("k1"), F.col("lang").alias("l1"))
    b = tags.select("paper_id", F.col("name").alias("k2"), F.col("lang").alias("l2"))
    pairs = a.join(b, "paper_id").where("k1 < k2")
    if translations is not None:
        pairs = pairs.join(translations.select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")), ["k1", "k2"], "left_anti")
    # Languages of a pair may differ from paper to paper: the pair's label is the least, so that a pair is stored once.
    return pairs.groupBy("k1", "k2").agg(F.min(F.concat_ws("-", F.least("l1", "l2"), F.greatest("l1", "l2"))).alias("lang_pair"), F.count("*").alias("n"))


def subtract_counts(counts: DataFrame, gone: DataFrame) -> DataFrame:
    d = gone.select("k1", "k2", F.col("n").alias("d"))
    return counts.join(d, ["k1", "k2"], "left").withColumn("n", F.col("n") - F.coalesce("d", F.lit(0))).where("n > 0").drop("d")


def add_counts(counts: DataFrame, more: DataFrame) -> DataFrame:
    return counts.select("k1", "k2", "n").union(more.select("k1", "k2", "n")).groupBy("k1", "k2").agg(F.sum("n").alias("n"))


def field_search(internal: DataFrame, external: DataFrame, tags: DataFrame, terms: list[str]) -> DataFrame:
    """rid, counts of distinct papers by source and of distinct matched keywords."""
    hits = tags.where(F.col("name").isin(*terms)).select("paper_id", "name")
    rows = internal.select("rid", "paper_id", F.lit(False).alias("ext")).union(external.select("rid", "paper_id", F.lit(True)))
    return rows.join(hits, "paper_id").groupBy("rid").agg(
        F.countDistinct("name").alias("kw_matches"), F.countDistinct(F.when(~F.col("ext"), F.col("paper_id"))).alias("internal"), F.countDistinct(F.when(F.col("ext"), F.col("paper_id"))).alias("external"),
        F.array_join(F.array_sort(F.collect_set("name")), "|").alias("matched"))


def relevance(kw: Column, internal: Column, external: Column, cites: Column) -> Column:
    return 10 * kw + internal + external + F.least(cites, F.lit(1000)) / 1000


def top_keywords(rows: DataFrame, group: str, k: int) -> DataFrame:
    """Rows group, name, at: each group's k commonest names, ties by the first seen."""
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col("first"), F.col("name"))
    return rows.groupBy(group, "name").agg(F.count("*").alias("n"), F.min("at").alias("first")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def entropy(counts: DataFrame, group: str, n: str) -> DataFrame:
    """Normalised Shannon entropy of each group's positive buckets, 0 for one bucket."""
    live = counts.where(F.col(n) > 0)
    total = live.groupBy(group).agg(F.sum(n).alias("__t"), F.count("*").alias("__k"))
    p = F.col(n) / F.col("__t")
    h = live.join(total, group).groupBy(group).agg(-F.sum(p * F.log2(p)) / F.log2(F.max("__k").cast("double")), F.max("__k").alias("__k")).toDF(group, "h", "__k")
    return h.select(group, F.when(F.col("__k") > 1, F.round("h", 6)).otherwise(0.0).alias("entropy"))


def positions(values: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    w = Window.partitionBy(*group)
    return values.withColumns({"__i": F.row_number().over(w.orderBy(value, key)) - 1, "__n": F.count("*").over(w)})


def bin_edges(values: DataFrame, group: list[str], value: str, key: str, bins: int) -> DataFrame:
    """group, b, edge: the value at index int(n * b / bins) of the sorted values, b from 1; equal edges once."""
    x = positions(values, group, value, key)
    wanted = F.array(*[F.floor(F.col("__n") * b / bins).cast("int") for b in range(1, bins)])
    x = x.where(F.array_contains(wanted, F.col("__i")))
    return x.select(*group, F.col(value).alias("edge")).distinct()


def assign_bins(values: DataFrame, edges: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each row's bin: how many edges its value reaches (an equal value goes to the right)."""
    e = edges.groupBy(*group).agg(F.array_sort(F.collect_set("edge")).alias("__e"))
    return values.join(e, group, "left").withColumn("bin", F.coalesce(F.size(F.filter("__e", lambda x: x <= F.col(value))), F.lit(0))).drop("__e")


def index_percentile(values: DataFrame, group: list[str], value: str, key: str, p: float) -> DataFrame:
    """sorted[min(n - 1, int(n * p))] of each group."""
    x = positions(values, group, value, key)
    return x.where(F.col("__i") == F.least(F.col("__n") - 1, F.floor(F.col("__n") * p))).select(*group, F.col(value).alias("value"))


def retrieval_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """Rows q, rank (from 1), rel, n_rel -> recall, mrr, ndcg of each query; -1 without relevant rows."""
    gain = 1 / F.log2(F.col("rank") + 1.0)
    x = ranked.groupBy("q").agg(
        F.sum(F.when((F.col("rank") <= k) & F.col("rel"), 1).otherwise(0)).alias("hits"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("rank") <= k) & F.col("rel"), gain).otherwise(0.0)).alias("dcg"), F.max("n_rel").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n"), F.lit(k))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    none = lambda c: F.when(F.col("n") == 0, -1.0).otherwise(F.round(c, 6))
    return x.select("q", none(F.col("hits") / F.col("n")).alias("recall"), none(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), none(F.col("dcg") / ideal).alias("ndcg"))


def auc(scores: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in which the positive's score is greater; ties count nothing. Rows score, y.

    Counts by score are cumulated, so no pairs are made."""
    c = scores.groupBy("score").agg(F.sum(F.when(F.col("y"), 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y"), 0).otherwise(1)).alias("n"))
    c = global_before(c, [F.col("score")], "n", "below", scores.agg(F.approx_count_distinct("score", 0.02)).first()[0])
    return c.withColumn("w", F.col("p") * F.col("below")).agg(F.round(F.sum("w") / (F.sum("p") * F.sum("n")), 6).alias("auc"))


def tfidf_vocabulary(tokens: DataFrame, n_docs: int, least_len: int, stop: list[str], share: float) -> DataFrame:
    """Rows doc, token -> token, freq, weight: mean L2-normalised tf-idf over documents, the commonest `share` of tokens."""
    t = tokens.where((F.length("token") >= least_len) & ~F.col("token").isin(*stop)).groupBy("doc", "token").agg(F.count("*").alias("tf"))
    # Counts and weights are used several times each: computed once, as tables in the checkpoint folder; a document's tokens lie side by side there.
    from ..llm.common import stage

    t = stage(t)
    df = t.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("freq"))
    # A token's documents bring its weight to each of them as one number, which both the norm and the mean use.
    x = stage(t.join(df, "token").select("doc", "token", (F.col("tf") * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)).alias("w")))
    norm = x.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weight = x.join(norm, "doc").groupBy("token").agg((F.sum(F.col("w") / F.col("norm")) / n_docs).alias("weight"))
    out = stage(weight.join(df.select("token", "freq"), "token"))
    # The cut by rank is a cut by frequency, but for ties at the edge: only the rows of one frequency need an order.
    per = out.groupBy("freq").agg(F.count("*").alias("k"))  # a row per frequency: few beside the tokens
    run = Window.orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("k").over(run), F.lit(0))).crossJoin(per.agg(F.floor(F.sum("k") * share).alias("keep")))
    x = out.join(per, "freq").where("before < keep")
    whole, edge = x.where("before + k <= keep"), x.where("before + k > keep")
    edge = global_rank(edge, [F.col("token")], "rn", edge.count()).where("before + rn <= keep").drop("rn")
    return whole.union(edge).select("token", "freq", F.round("weight", 6).alias("weight"))


def rollup(rows: DataFrame) -> DataFrame:
    """Rows rid, institution, year, paper_id, at -> rid, current institution (latest year, ties: first seen), history (latest first), papers."""
    per = rows.groupBy("rid", "institution").agg(F.max("year").alias("last"), F.min("at").alias("first"))
    hist = F.array_sort(F.collect_list(F.struct((-F.coalesce("last", F.lit(0))).alias("y"), "first", "institution")))
    h = per.groupBy("rid").agg(hist.alias("h")).select("rid", F.col("h")[0]["institution"].alias("current"), F.array_join(F.transform("h", lambda x: x["institution"]), "|").alias("history"))
    return h.join(rows.groupBy("rid").agg(F.countDistinct("paper_id").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year")), "rid")


def domain_table(rows: DataFrame, generic: int) -> DataFrame:
    """Rows domain, root -> domain, roots, verdict: a domain of one institution, or generic from `generic` institutions on."""
    return rows.groupBy("domain").agg(F.countDistinct("root").alias("roots"), F.min("root").alias("root")).withColumn(
        "verdict", F.when(F.col("roots") >= generic, "generic").when(F.col("roots") == 1, "promote").otherwise("hold"))


def narrow_chips(items: DataFrame, bins: int = 3, least: float = 0.7, top: int = 3) -> DataFrame:
    """g, rank, axis, value, score: what narrows each result list best. Rows g, at (place in the list), year, citations, kind.

    An axis counts if its values spread over two buckets or more with a normalised entropy of `least` or more. Year and kind offer their commonest value
    (ties: the first in the list), citations the lower edge of the highest of `bins` bins of equal numbers. Ranks are by entropy; ties go to year,
    then citations, then kind. Lists are counted by value first, so that only distinct values are sorted."""
    value = F.create_map(F.lit("year"), F.col("year").cast("string"), F.lit("citation"), F.col("citations").cast("string"), F.lit("paper_type"), F.nullif("kind", F.lit("")))
    c = items.select("g", "at", F.explode(value).alias("axis", "v")).where("v IS NOT NULL").groupBy("g", "axis", "v").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    axes = ["g", "axis"]
    plain = c.where("axis <> 'citation'").select(*axes, "v", "n", F.struct(-F.col("n"), "first").alias("o"))
    cited = c.where("axis = 'citation'").withColumn("x", F.col("v").cast("long"))
    run = Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cited = cited.withColumns({"upto": F.sum("n").over(run), "total": F.sum("n").over(Window.partitionBy("g"))})
    # The value at an index is the first whose cumulated count passes it.
    edges = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * i / bins), F.col("total") - 1), F.col("x"))).over(Window.partitionBy("g")) for i in range(1, bins)]
    edges = F.array_distinct(F.array(*edges)) if bins > 1 else F.array(F.min("x").over(Window.partitionBy("g")))
    cited = cited.withColumn("edges", edges).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("x"))))
    cited = cited.groupBy(*axes, "bin", F.array_max("edges").cast("string").alias("v")).agg(F.sum("n").alias("n")).select(*axes, "v", "n", F.struct(F.lit(0).cast("long"), F.lit(0).cast("long")).alias("o"))
    x = plain.withColumn("o", F.col("o").cast("struct<a:bigint,b:bigint>")).unionByName(cited.withColumn("o", F.col("o").cast("struct<a:bigint,b:bigint>")))
    x = x.groupBy(*axes).agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"), F.min_by("v", "o").alias("value"))
    # -sum(n/t log2(n/t)) is log2(t) - sum(n log2 n) / t.
    x = x.where("k > 1").withColumn("score", F.round((F.log2(F.col("t").cast("double")) - F.col("s") / F.col("t")) / F.log2(F.col("k").cast("double")), 6)).where(F.col("score") >= least)
    order = F.array_position(F.array(F.lit("year"), F.lit("citation"), F.lit("paper_type")), F.col("axis"))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("score").desc(), order)))
    return x.where(F.col("rank") <= top).select("g", "rank", "axis", "value", "score")


def researcher_profiles(rows: DataFrame, tags: DataFrame, k: int = 10) -> DataFrame:
    """rid, name, current, history, keywords, papers of each researcher, from author rows rid, at (order of arrival), name, institution, year, paper_id and tags
    paper_id, pos, name.

    The first non-empty name; the institution of the latest year (ties: first seen; empty ones do not count), all of them in that order; the k keywords that
    come most often, an author row's paper each time (ties: first seen); distinct papers. NULL arrays where there is nothing."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    own = rows.groupBy("rid").agg(F.min_by(filled("name"), F.when(filled("name").isNotNull(), F.col("at"))).alias("name"), F.countDistinct("paper_id").alias("papers"))
    inst = rows.where("institution <> ''").groupBy("rid", "institution").agg(F.max(F.coalesce("year", F.lit(0))).alias("last"), F.min("at").alias("first"))
    inst = inst.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct((-F.col("last")).alias("y"), "first", "institution"))).alias("h"))
    inst = inst.select("rid", F.transform("h", lambda x: x["institution"]).alias("history"))
    per = rows.groupBy("rid", "paper_id").agg(F.count("*").alias("times"), F.min("at").alias("at"))
    words = per.join(tags.select("paper_id", "pos", F.col("name").alias("keyword")), "paper_id").groupBy("rid", "keyword").agg(F.sum("times").alias("n"), F.min(F.struct("at", "pos", "keyword")).alias("first"))
    w = Window.partitionBy("rid").orderBy(F.col("n").desc(), "first")
    words = words.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    out = own.join(inst, "rid", "left").join(words, "rid", "left")
    return out.select("rid", "name", F.get("history", 0).alias("current"), "history", "keywords", "papers")
