"""Entity resolution of researchers."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .graphs import components
from .windows import top_per_group


def match_candidates(people: DataFrame, most: int) -> DataFrame:
    """rid, cand, verdict for pairs of one name and institution: the `most` best; confirmed by department, else inferred if alone.

    A group's best `most` + 1 hold everybody's best `most` others, so a group is joined with so many, not with itself."""
    key = ["name", "institution"]
    size = people.groupBy(*key).agg((F.count("*") - 1).alias("n"))
    b = top_per_group(people.select("rid", *key, "dept", "rank"), key, [F.col("rank").desc(), "rid"], most + 1)
    b = b.select(F.col("rid").alias("cand"), *key, F.col("dept").alias("d2"), F.col("rank").alias("r2"))
    x = people.join(b, key).where("rid <> cand").join(size, key)
    x = top_per_group(x, ["rid"], [F.col("r2").desc(), "cand"], most)
    return x.select("rid", "cand", F.when(F.col("dept") == F.col("d2"), "confirmed").when(F.col("n") == 1, "inferred").otherwise("ambiguous").alias("verdict"))


def choose_candidates(people: DataFrame, links: DataFrame, candidates: DataFrame, listed: DataFrame, most: int = 3) -> DataFrame:
    """rid, cand, status, confidence: the registry's candidate that is taken for each person who has any.

    Rows people rid, name, institution; links rid, paper_id; candidates cand, name, institution, articles; listed cand, paper_id. Of the `most`
    candidates of one's name and institution with most articles, the first that lists one of one's papers is confirmed; without such a one the
    first is taken, inferred if it is the only candidate at all, else ambiguous. Pairs are compared by joined papers, not by arrays of them."""
    key = ["name", "institution"]
    size = candidates.groupBy(*key).agg(F.count("*").alias("n"))
    best = top_per_group(candidates, key, [F.coalesce("articles", F.lit(0)).desc(), "cand"], most)
    x = people.select("rid", *key).join(best, key).join(size, key).select("rid", "cand", "articles", "n")
    mine = x.select("rid", "cand").join(links.select("rid", "paper_id"), "rid").join(listed.select("cand", "paper_id"), ["cand", "paper_id"]).select("rid", "cand").distinct()
    x = x.join(mine.withColumn("ok", F.lit(True)), ["rid", "cand"], "left")
    x = top_per_group(x, ["rid"], [F.coalesce("ok", F.lit(False)).desc(), F.coalesce("articles", F.lit(0)).desc(), "cand"], 1)
    confidence = F.when(F.col("ok"), "confirmed").when(F.col("n") == 1, "inferred")
    return x.select("rid", "cand", F.when(confidence.isNull(), "ambiguous").otherwise("matched").alias("status"), confidence.alias("confidence"))


def _holders(people: DataFrame, links: DataFrame, twice: DataFrame | None = None) -> DataFrame:
    """People of a name with their papers, of which those that list the name twice are flagged."""
    p = people.select("rid", "name")
    if twice is None:
        return blocks.members(p, links.select("rid", "paper_id"), "name", "paper_id")
    l = links.select("rid", "paper_id").join(p, "rid").join(twice.select("paper_id", "name").distinct().withColumn("bad", F.lit(True)), ["paper_id", "name"], "left")  # noqa: E741
    return blocks.members(p, l.select("rid", "paper_id", F.coalesce("bad", F.lit(False)).alias("bad")), "name", "paper_id", "bad")


def shared_papers(people: DataFrame, links: DataFrame) -> DataFrame:
    """a < b of one name with how many papers they share."""
    return blocks.pairs(_holders(people, links), 1)


def duplicate_groups(people: DataFrame, links: DataFrame, least: int, twice: DataFrame | None = None) -> DataFrame:
    """rid, canonical: components of same-name pairs with `least` shared papers, unless in half of them the name appears twice.

    twice: rows paper_id, name of papers that list the name twice."""
    known = twice is not None
    linked = lambda n, bad, *_: (n >= least) & (bad * 2 < n) if known else n >= least
    return components(people.select("rid"), blocks.forest(_holders(people, links, twice), linked, flagged=known)).toDF("rid", "canonical")


def same_name_merge(people: DataFrame, edges: DataFrame, least: int, cross_script: int | None = None, institution: str = "institution") -> DataFrame:
    """rid, canonical: same-name people whose institution contains the other's, or with `least` shared co-authors (edges rid, other);
    where one institution is written in Hangul and the other is not, `cross_script` shared ones suffice.

    People of one name and institution are a star, and only a name's distinct institutions meet; shared co-authors are counted in
    blocks of a name's people, which give a forest, not pairs."""
    p = people.select("rid", "name", F.col(institution).alias("inst"))
    hub = p.where("inst <> ''").groupBy("name", "inst").agg(F.min("rid").alias("hub"))
    star = p.join(hub, ["name", "inst"]).where("rid <> hub").select("rid", "hub")
    held = hub.toDF("name", "inst1", "a").join(hub.toDF("name", "inst2", "b"), "name").where("a <> b").where(F.contains("inst1", "inst2")).select("a", "b")
    cross = least if cross_script is None else cross_script
    who = p.select("rid", "name", F.coalesce(F.col("inst").rlike("[가-힣]"), F.lit(False)).cast("int").alias("ko"))
    both = blocks.forest(blocks.members(who, edges, "name", "other"), lambda n, _, ka, kb: n >= np.where(ka == kb, least, cross), "ko")
    return components(people.select("rid"), star.union(held).union(both.select("a", "b")).toDF("a", "b")).toDF("rid", "canonical")


def name_components(papers: DataFrame) -> DataFrame:
    """Rows name, paper_id, other: papers of one name linked by any other author; name, paper_id, comp.

    Papers meet their group's first paper, so a co-author of many papers makes a star, not all pairs."""
    key = F.concat_ws("/", "name", "paper_id")
    x = papers.select("name", "paper_id", "other", key.alias("k"))
    hub = x.groupBy("name", "other").agg(F.min("k").alias("hub"))
    edges = x.join(hub, ["name", "other"]).where("k <> hub").select(F.col("k").alias("a"), F.col("hub").alias("b"))
    c = components(x.select("k").distinct(), edges)
    return x.select("name", "paper_id", F.col("k").alias("node")).distinct().join(c, "node").select("name", "paper_id", "comp")


def component_samples(papers: DataFrame, most: int = 3) -> DataFrame:
    """name, comp, paper_id: of each of a name's components the first `most` papers, or all where it has fewer."""
    return top_per_group(name_components(papers), ["name", "comp"], ["paper_id"], most)


def modal_id(trusted: DataFrame, overall: DataFrame, share: float) -> DataFrame:
    """rid, author_id: the commonest id on trusted papers (ties: overall count, then the greater id) if it has the share."""
    n = trusted.groupBy("rid", "author_id").agg(F.count("*").alias("n"))
    tot = trusted.groupBy("rid").agg(F.count("*").alias("t"))
    best = top_per_group(n.join(overall.groupBy("author_id").agg(F.count("*").alias("m")), "author_id", "left"), ["rid"], [F.col("n").desc(), F.col("m").desc_nulls_last(), F.col("author_id").desc()], 1)
    return best.join(tot, "rid").where(F.col("n") >= share * F.col("t")).select("rid", "author_id")


def weak_pairs(people: DataFrame, links: DataFrame, ids: DataFrame, below: int) -> DataFrame:
    """a < b, verdict on pairs of one name with shared papers, but fewer than `below`: same, different or undecided by both sides' modal id.

    Ids go into the blocks with the people, so no table of pairs is joined. The pairs themselves are the result and may be the square of a name's people."""
    who = _holders(people, links).join(ids.select(F.col("rid").alias("id"), F.col("author_id").alias("mark")), "id", "left")
    x = blocks.pairs(who, 1, below, "mark")
    return x.select("a", "b", F.when(F.col("same").isNull(), "undecided").when(F.col("same"), "same").otherwise("different").alias("verdict"))


def judged(candidates: DataFrame, confirmed: DataFrame, least: int = 2) -> DataFrame:
    """rid, paper_id, rule for candidate papers: 1 institution, 2 `least` co-authors in common with confirmed papers, 3 an institution
    learned from accepted papers in `least` papers; 0 rejected, NULL without authors.

    candidates: rid, unit, paper_id, institution, others (array). confirmed: rid, other."""
    c = candidates.withColumn("r1", F.coalesce(F.contains("institution", "unit"), F.lit(False)))
    known = confirmed.groupBy("rid").agg(F.collect_set("other").alias("known"))
    c = c.join(known, "rid", "left").withColumn("r2", F.coalesce(F.size(F.array_intersect("others", "known")) >= least, F.lit(False)))
    learned = c.where("r1 OR r2").where("institution IS NOT NULL").groupBy("rid", "institution").agg(F.countDistinct("paper_id").alias("n")).where(F.col("n") >= least).select("rid", "institution", F.lit(True).alias("r3"))
    c = c.join(learned, ["rid", "institution"], "left")
    rule = F.when(F.size("others") == 0, None).when(F.col("r1"), 1).when(F.col("r2"), 2).when(F.col("r3"), 3).otherwise(0)
    return c.select("rid", "paper_id", rule.alias("rule"))


def renamed_institutions(rows: DataFrame, least: int, most_late: float, quantile: float) -> DataFrame:
    """old, new, people: institutions that `least` people moved from, the old name hardly used after the new one's first years.

    rows: rid, institution, year."""
    span = rows.groupBy("rid", "institution").agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    moves = span.toDF("rid", "old", "o0", "o1").join(span.toDF("rid", "new", "n0", "n1"), "rid").where("old <> new AND o1 <= n0").groupBy("old", "new").agg(F.countDistinct("rid").alias("people")).where(F.col("people") >= least)
    w = Window.partitionBy("institution")
    q = rows.where("year IS NOT NULL").withColumns({"i": F.row_number().over(w.orderBy("year", "rid")) - 1, "n": F.count("*").over(w)}).where(F.col("i") == F.floor(F.col("n") * quantile)).select(F.col("institution").alias("new"), F.col("year").alias("start"))
    m = moves.join(q, "new")
    use = rows.where("year IS NOT NULL").select(F.col("institution").alias("old"), "year")
    return m.join(use, "old").groupBy("old", "new", "people").agg(F.avg(F.when(F.col("year") > F.col("start") + 1, 1.0).otherwise(0.0)).alias("late")).where(F.col("late") <= most_late).select("old", "new", "people")


def canonical_pick(people: DataFrame, group: str) -> DataFrame:
    return top_per_group(people, [group], [F.col("anchored").desc(), "source", F.col("papers").desc(), "created", "rid"], 1).select(group, "rid")


#: Providers of personal mail.
PERSONAL_MAIL = ("gmail", "naver", "hanmail", "daum", "hotmail", "nate", "yahoo", "outlook", "kakao", "empal", "chol.com", "korea.com", "dreamwiz", "paran", "freechal", "lycos", "hanmir", "netian")


def domain_verdicts(people: DataFrame, generic: int = 3) -> DataFrame:
    """rid, domain, verdict, confidence, email of the people whose match is inferred, judged by whose institution their mail domain is.

    Rows rid, email, institution, confidence. Confirmed people give each domain's institutions by root; a domain of `generic` roots or more says nothing, nor
    does personal mail. `promote` if a root equals or holds the person's, or the other way round (confidence domain_verified); `revoke` if every one
    contradicts it (disputed, the address goes); `hold` if a root is unknown or of another script; `unlisted`, `personal` else. People without an address
    or an institution are left out. A domain's row holds fewer than `generic` roots."""
    from .text import HANGUL, institution_root

    domain = F.nullif(F.lower(F.trim(F.element_at(F.split("email", "@"), -1))), F.lit(""))
    x = people.where("email IS NOT NULL AND institution IS NOT NULL").withColumn("domain", F.when(F.col("email").contains("@"), domain)).withColumn("root", institution_root(F.col("institution")))
    personal = F.col("domain").isNull() | F.exists(F.array(*map(F.lit, PERSONAL_MAIL)), lambda p: F.col("domain").contains(p))
    x = x.withColumn("personal", personal)
    # Roots are aggregated by domain and root first, so a crowded domain is a few rows before its array is made.
    roots = x.where("confidence = 'confirmed' AND NOT personal").groupBy("domain", F.coalesce("root", F.lit("")).alias("r")).agg(F.count("*").alias("n"))
    table = roots.groupBy("domain").agg(F.count("*").alias("k"), F.collect_list("r").alias("roots")).where(F.col("k") < generic).drop("k")
    plain = lambda c: F.trim(F.regexp_replace(c, r"[\s·,.\-]", ""))

    def says(r):
        a, b = plain(F.col("root")), plain(r)
        known = F.col("root").isNotNull() & (r != "")
        return F.when(~known, "unknown").when(a.contains(b) | b.contains(a), "match").when(F.col("root").rlike(HANGUL) != r.rlike(HANGUL), "unknown").otherwise("conflict")

    y = x.where("confidence = 'inferred'").join(table, "domain", "left").withColumn("said", F.transform("roots", says))
    verdict = F.when(F.col("personal"), "personal").when(F.col("roots").isNull(), "unlisted").when(F.array_contains("said", "match"), "promote").when(F.forall("said", lambda v: v == "conflict"), "revoke").otherwise("hold")
    y = y.withColumn("verdict", verdict)
    confidence = F.when(F.col("verdict") == "promote", "domain_verified").when(F.col("verdict") == "revoke", "disputed").otherwise(F.col("confidence"))
    return y.select("rid", "domain", "verdict", confidence.alias("confidence"), F.when(F.col("verdict") != "revoke", F.col("email")).alias("email"))


def merged_people(people: DataFrame, groups: DataFrame, most: int = 15) -> DataFrame:
    """rid, name_eng, history, keywords, absorbed: one row for each group of people who are one.

    Rows people rid, name_eng, history, keywords (arrays), corpus, papers; groups rid, comp. The person with most corpus papers, then most papers, then the least rid
    stands for the group, keeps its English name and else takes the least of the others'; histories are united, keywords too, the first `most` by name. A person
    alone stays as is. Values are made distinct before they are gathered, so a group's lists are no longer than its results."""
    x = people.join(groups.select("rid", "comp"), "rid")
    best = F.struct(-F.coalesce("corpus", F.lit(0)), -F.coalesce("papers", F.lit(0)), "rid")
    head = x.groupBy("comp").agg(F.min_by(F.struct("rid", "name_eng", "history", "keywords"), best).alias("h"), F.min("name_eng").alias("other"), F.count("*").alias("n"))
    held = lambda c: x.select("comp", F.explode(c).alias("v")).where("v IS NOT NULL").distinct()
    united = lambda rows, name: rows.groupBy("comp").agg(F.array_sort(F.collect_list("v")).alias(name))
    y = head.join(united(held("history"), "hs"), "comp", "left").join(united(top_per_group(held("keywords"), ["comp"], ["v"], most), "ks"), "comp", "left")
    of = lambda whole, one: F.when(F.col("n") == 1, F.col("h")[one]).otherwise(F.coalesce(whole, F.array().cast("array<string>"))).alias(one)
    return y.select(F.col("h.rid").alias("rid"), F.coalesce("h.name_eng", "other").alias("name_eng"), of("hs", "history"), of("ks", "keywords"), (F.col("n") - 1).alias("absorbed"))


def pruned(promoted: DataFrame, external: DataFrame, corpus: DataFrame, least: int = 8) -> DataFrame:
    """rid, papers, kept of people that were promoted (rows rid): kept are those with `least` or more external papers (rows rid, paper_id) or any corpus paper."""
    count = lambda x, name: x.groupBy("rid").agg(F.count("*").alias(name))
    x = promoted.select("rid").distinct().join(count(external, "papers"), "rid", "left").join(corpus.select("rid", F.lit(True).alias("ours")).distinct(), "rid", "left")
    papers = F.coalesce("papers", F.lit(0))
    return x.select("rid", papers.alias("papers"), ((papers >= least) | F.col("ours").isNotNull()).alias("kept"))
