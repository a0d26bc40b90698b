"""Mixing sources to target weights, by an exact block quota tree, in Spark SQL alone.

Each source's target is its weighted share of `share` times all words, stopped at `most` times its own words; what is
cut off is reshared by weight until no source is above. A source is dealt into blocks of about BLOCK_WORDS words by a hash
of id and text. A target of more than the source's words takes every block whole as often as it fits; the
rest is drawn from a permutation of the blocks until the words are reached, the last block document by document and the
last document in part, so that a source's taken words equal its target, rounded.

Output shards: the block draws of all sources are the urn of a splitting tree, which has as many levels as shards of about SHARD_WORDS words
need. Each node deals half of its draws, taken without replacement, to its left child: source by source, a hypergeometric
number of draws by inversion of its distribution from the mode outward (about the square root of the quota in steps), so the numbers by
source are multivariate hypergeometric and add up exactly. A source's shards then take disjoint runs of its permuted draws, and rows are
shuffled within their shard.

Places in a source's permutation are running sums over ranges of a hash, so no task holds a source. Tables with a row per source
are small beside the documents; a node of the tree has a list of the sources with draws in it.

Defined results: a null text has size 0 and is never taken; a source of size 0 gets target 0; a null source is a source of its own, last; a very long
text is one document like others, cut in part where the target falls inside it; repeated rows count each, and rows equal in id
and text stand side by side in the order, so which of them is cut is immaterial; null and repeated ids are told apart by the text;
an empty table gives no rows. Other columns pass through mix, whatever their names.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, col, free_name, let, stage, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 20_000
#: A shard has about so many words.
SHARD_WORDS = 16_000_000
#: A source's blocks are placed in so many ranges of their hash.
RANGES = 1 << 10
#: Tables of up to so many rows, which have a few numbers each, are broadcast.
FEW = 200_000
SEED = "mix"
_LOG_2PI = math.log(2 * math.pi)


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, src (its number), source_size, n_blocks, target of rows source and size."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = stage(per)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", F.row_number().over(order).alias("src"), w.alias("w"))
    cap = most * F.col("source_size").cast("double")
    # Sources that reach their cap are those with the least cap to weight, so two running sums find them.
    by = Window.orderBy(cap / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = share * F.sum("source_size").over(every)
    left = (t - F.coalesce(F.sum(cap).over(by), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by), F.lit(0.0)))
    per = per.withColumn("full", cap / F.col("w") <= left).withColumn("cap", cap).withColumn("t", t)
    rate = (F.col("t") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)) / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("long")
    return per.select("source", "src", "source_size", n_blocks.alias("n_blocks"), F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * rate).alias("target"))


def _unit(*parts) -> Column:
    """A reproducible number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / float(1 << 53)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, moved up by eight places, where it is exact to double precision."""
    x = n.cast("double") + 9.0
    lifted = F.ln((x - 1) * (x - 2) * (x - 3) * (x - 4)) + F.ln((x - 5) * (x - 6) * (x - 7) * (x - 8))
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return (x - 0.5) * F.ln(x) - x + _LOG_2PI / 2 + series - lifted


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items, taken without replacement from `total` of which `marked` are marked, are marked: the number at
    which the probabilities, added from the mode outward by turns, exceed u."""
    choose = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    least, most = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(drawn, marked)
    mode = F.least(most, F.greatest(least, F.floor((drawn + 1) * (marked + 1).cast("double") / (total + 2)).cast("long")))
    # Fourteen standard deviations to either side, by turns.
    share = marked / total.cast("double")
    sd = F.sqrt(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    turns = F.least(2 * (most - least) + 2, F.ceil(28 * sd).cast("long") + 64)

    def of(v):
        n, k, d, lo, hi, m, u = (v[x] for x in ("n", "k", "d", "lo", "hi", "m", "u"))
        p = F.exp(choose(k, m) + choose(n - k, d - m) - choose(n, d))
        none = F.lit(-1).cast("long")
        start = F.struct(F.when(p > u, m).otherwise(none).alias("x"), p.alias("sum"), m.alias("a"), p.alias("pa"), m.alias("b"), p.alias("pb"))

        def step(s, turn):
            up = turn % 2 == 1
            a, b = s["a"], s["b"]
            pa = F.when(a < hi, s["pa"] * (k - a).cast("double") * (d - a) / ((a + 1).cast("double") * (n - k - d + a + 1))).otherwise(0.0)
            pb = F.when(b > lo, s["pb"] * b.cast("double") * (n - k - d + b) / ((k - b + 1).cast("double") * (d - b + 1))).otherwise(0.0)
            p = F.when(up, pa).otherwise(pb)
            new = F.struct(
                F.when((s["sum"] + p > u) & (p > 0), F.when(up, a + 1).otherwise(b - 1)).otherwise(none).alias("x"), (s["sum"] + p).alias("sum"),
                F.when(up, a + 1).otherwise(a).alias("a"), F.when(up, pa).otherwise(s["pa"]).alias("pa"),
                F.when(up, b).otherwise(b - 1).alias("b"), F.when(up, s["pb"]).otherwise(pb).alias("pb"))
            return F.when(s["x"] >= 0, s).otherwise(new)

        return F.aggregate(F.sequence(F.lit(1).cast("long"), v["turns"]), start, step, lambda s: F.when(s["x"] >= 0, s["x"]).otherwise(m))

    packed = F.struct(total.alias("n"), marked.alias("k"), drawn.alias("d"), least.alias("lo"), most.alias("hi"), mode.alias("m"), turns.alias("turns"), u.alias("u"))
    return F.when(least >= most, least).otherwise(let(packed, of))


_QUOTA = "array<struct<src:int,q:bigint,at:bigint>>"


def split_quotas(quotas: DataFrame, levels: int) -> DataFrame:
    """shard, src, q, at: the draws of each source (src, q) dealt to 2**levels shards by the splitting tree; a shard's draws of
    a source are q from its turn `at` on."""
    zero = F.lit(0).cast("long")
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("src", "q", zero.alias("at")))).alias("q")).select(zero.alias("node"), "q")
    total = F.aggregate("q", zero, lambda a, x: a + x["q"])
    for level in range(levels):
        half = F.floor((F.col("tot") + F.when(_unit(F.lit(level), F.col("node")) < 0.5, 1).otherwise(0)) / 2).cast("long")

        at_level = F.lit(level)

        def deal_source(acc, x):
            n = hypergeometric(acc["rest"], x["q"], acc["wanted"], _unit(at_level, F.col("node"), x["src"]))
            return let(n, lambda n: F.struct(
                (acc["wanted"] - n).alias("wanted"), (acc["rest"] - x["q"]).alias("rest"), F.concat(acc["out"], F.array(n)).alias("out")))

        node = node.withColumn("tot", total).withColumn("want", half)
        begin = F.struct(F.col("want").alias("wanted"), F.col("tot").alias("rest"), F.array().cast("array<bigint>").alias("out"))
        node = node.withColumn("left", F.aggregate("q", begin, deal_source, lambda a: a["out"]))
        has = lambda a: F.filter(a, lambda x: x["q"] > 0)
        left = F.zip_with("q", "left", lambda a, n: F.struct(a["src"].alias("src"), n.alias("q"), a["at"].alias("at")))
        right = F.zip_with("q", "left", lambda a, n: F.struct(a["src"].alias("src"), (a["q"] - n).alias("q"), (a["at"] + n).alias("at")))
        both = F.array(F.struct((F.col("node") * 2).alias("node"), has(left).cast(_QUOTA).alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), has(right).cast(_QUOTA).alias("q")))
        node = stage(node.select(F.inline(both)))
    return node.select(F.col("node").alias("shard"), F.inline("q"))


def _order(*parts) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13), 16, 10).cast("long")


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _key(id_: Column, text: Column) -> Column:
    """A row's place in its source: a digest of id and text."""
    return _order(id_, F.xxhash64(text))


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    size = _size(col(text_col))
    return docs.select(col(id_col).alias("id"), col(source_col).alias("source"), size.alias("size"), _key(col(id_col), col(text_col)).alias("key"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def running(df: DataFrame, key: str, place: Column, ties: tuple, value: Column, name: str) -> DataFrame:
    """df (written) with one more column: the sum of value over the rows of its key that come earlier by place, a number from 0 to
    2**52, and ties. The sums of ranges of places are added up first, so that no task holds more than a range of a key."""
    d = df.withColumn("__place", place).withColumn("__value", value).withColumn("__range", F.floor(F.col("__place") / ((1 << 52) / RANGES)).cast("int"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    upto = d.groupBy(key, "__range").agg(F.sum("__value").alias("__sum"))
    upto = upto.select(key, "__range", F.coalesce(F.sum("__sum").over(before(Window.partitionBy(key).orderBy("__range"))), zero).alias("__upto"))
    inside = F.coalesce(F.sum("__value").over(before(Window.partitionBy(key, "__range").orderBy("__place", *ties))), zero)
    d = d.withColumn("__inside", inside).join(upto, [key, "__range"])
    return d.withColumn(name, F.col("__upto") + F.col("__inside")).drop("__place", "__value", "__range", "__upto", "__inside")


def _plan(sized: DataFrame, **opts) -> tuple[DataFrame, DataFrame]:
    """The written tables of sources (source, src, source_size, target, n_blocks, whole: times taken whole, extra: words of one time
    more) and of blocks (src, block, words, whole, room: words that the time more takes)."""
    per = targets(sized, **opts)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    per = per.withColumn("whole", whole).withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    per = stage(per)
    rows = _placed(sized, per)
    blocks = stage(rows.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("extra").alias("extra"), F.first("whole").alias("whole")))
    blocks = running(blocks, "src", _order(F.col("src"), F.col("block")), ("block",), F.col("words"), "before")
    room = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("extra") - F.col("before")))
    return per, stage(blocks.select("src", "block", "words", "whole", room.alias("room")))


def _placed(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Rows with source and key, with their source's figures and their block."""
    per = _small(per).withColumnRenamed("source", "__source")
    return rows.join(per, rows["source"].eqNullSafe(per["__source"])).drop("__source").withColumn("block", F.col("key") % F.col("n_blocks"))


def _parted(rows: DataFrame, blocks: DataFrame, *order: str) -> DataFrame:
    """Rows (src, block, size, key, ...) of the one block of each source that is taken in part, with the words taken of each."""
    cut = _small(blocks.where("room > 0 AND room < words").select("src", "block", "room"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("src").orderBy("key", *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("room") - before))
    return rows.join(cut, ["src", "block"]).withColumn("part", part).drop("room")


def plan_mix(sized: DataFrame, **opts) -> tuple[DataFrame, DataFrame]:
    """Rows id, size, src, source_size, target, whole (times taken whole), part (words of one more, partial or whole), block;
    and the draws src, block, pass, words, turn. sized: id, source, size, key, written."""
    per, blocks = _plan(sized, **opts)
    rows = _placed(sized, per)
    state = blocks.select("src", "block", F.when(F.col("room") == 0, 0).when(F.col("room") == F.col("words"), 1).otherwise(2).alias("state"))
    rows = rows.join(_small(state), ["src", "block"])
    rest = rows.where("state < 2").withColumn("part", F.when(F.col("state") == 1, F.col("size")).otherwise(F.lit(0).cast("long")))
    out = _parted(rows.where("state = 2"), blocks, "id", "size").unionByName(rest)
    return out.select("id", "size", "src", "source_size", "target", "whole", "part", "block"), _draws(blocks)


def _draws(blocks: DataFrame) -> DataFrame:
    """src, block, pass, words, turn: a draw is one block in one pass; pass 0 takes the drawn blocks once more. Turns count from 0."""
    draws = blocks.select("src", "block", "words", F.explode(F.concat(
        F.when(F.col("whole") > 0, F.sequence(F.lit(1), F.greatest(F.col("whole"), F.lit(1)))).otherwise(F.array().cast("array<int>")),
        F.when(F.col("room") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))).alias("pass"))
    return running(stage(draws), "src", _order(F.col("src"), F.col("block"), F.col("pass")), ("block", "pass"), F.lit(1).cast("long"), "turn")


def deal(draws: DataFrame, levels: int | None = None) -> tuple[DataFrame, int]:
    """draws with their shard (disjoint runs of each source's permuted draws, as long as the tree's quotas), and how many shards."""
    draws = stage(draws)
    if levels is None:
        words = draws.agg(F.sum("words").alias("n")).first()["n"] or 0
        levels = max(1, math.ceil(math.log2(max(words, 1) / SHARD_WORDS)))
    quota = split_quotas(draws.groupBy("src").agg(F.count("*").alias("q")).select(F.col("src").cast("int").alias("src"), "q"), levels)
    turns = quota.select("src", "shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("q") - 1)).alias("turn"))
    return draws.join(turns, ["src", "turn"]).select("src", "block", "pass", "shard"), 1 << levels


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int | None = None, **opts) -> DataFrame:
    """The mixture: docs' columns, once for each time that a document is taken (the partial text cut after its words), by shard.

    docs is read twice and must give the same rows each time."""
    cols = docs.columns
    shard, take = free_name(docs, "shard"), free_name(docs, "take")
    per, blocks = _plan(stage(sized_rows(docs, id_col, text_col, source_col)), **opts)
    drawn, n_shards = deal(_draws(blocks), levels)
    drawn = stage(drawn.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
                  .join(blocks.select("src", "block", F.expr("room > 0 AND room < words").alias("cut")), ["src", "block"]))
    # The documents' own columns travel as one struct, whatever their names. Only the blocks taken in part need counting again.
    own = docs.where(col(text_col).rlike(SPACE_WORD)).select(
        F.struct(*[col(c) for c in cols]).alias("row"), col(id_col).alias("id"), col(source_col).alias("source"), _key(col(id_col), col(text_col)).alias("key"))
    rows = _placed(own, per).select("row", "id", "key", "src", "block").join(_small(drawn), ["src", "block"])
    t = F.col("row").getField(text_col)
    some = _parted(rows.where("cut").withColumn("size", _size(t)), blocks, "id", "size").select("row", "id", "size", "part", F.inline("draws"))
    some = some.withColumn("n", F.when(F.col("pass") > 0, F.col("size")).otherwise(F.col("part"))).where("n > 0")
    words = F.slice(F.regexp_extract_all(t, F.lit(SPACE_WORD), F.lit(0)), 1, F.col("n").cast("int"))
    some = some.select("row", "id", F.when(F.col("n") < F.col("size"), F.array_join(words, " ")).otherwise(t).alias("text"), "pass", "shard")
    out = some.unionByName(rows.where("NOT cut").select("row", "id", t.alias("text"), F.inline("draws")))
    place = F.xxhash64(F.lit(SEED), F.col("id"), F.col("pass"), F.col("text"))
    out = out.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in cols], F.col("shard").alias(shard), F.col("pass").alias(take), place.alias("__place"))
    # One task for each shard: a hash of so few numbers would put several in one task.
    out = out.repartitionById(n_shards, F.col(shard).cast("int")).sortWithinPartitions(shard, "__place")
    return out.select(*[col(c) for c in cols], shard, take)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    rows, draws = plan_mix(stage(sized_rows(table(spark, sf_dir, "documents"))))
    drawn, _ = deal(draws)
    shards = stage(drawn.groupBy("src", "block").agg(F.array_join(F.array_sort(F.collect_list("shard")), ",").alias("shards")))
    taken = F.col("whole") * F.col("size") + F.col("part")
    return rows.join(_small(shards), ["src", "block"], "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), taken.alias("taken"),
        F.when(taken > 0, F.col("shards")).otherwise("").alias("shards"))
