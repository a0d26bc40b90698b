"""Chips of result lists, verdicts by mail domain, profiles, summaries, expansions, departments and paired authors against plain versions or literal rows."""
from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lectern.operators import aggregations as G
from lectern.operators import graphs as K
from lectern.operators import identity as I
from lectern.operators import joins as J
from lectern.operators import researchers as R
from lectern.operators import text as X


def _evenness(counts):
    counts = [c for c in counts if c]
    t = sum(counts)
    return -sum(c / t * math.log2(c / t) for c in counts) / math.log2(len(counts)) if len(counts) > 1 else 0.0


def _chips(rows):
    """The offers of one list, by sorting it whole."""
    out = []
    years, kinds, cites = [r[0] for r in rows if r[0] is not None], [r[2] for r in rows if r[2]], sorted(r[1] for r in rows if r[1] is not None)
    for place, axis, values in ((0, "year", years), (2, "paper_type", kinds)):
        if values:
            out.append((-round(_evenness(Counter(values).values()), 6), place, axis, str(Counter(values).most_common(1)[0][0])))
    if cites:
        edges = sorted({cites[min(int(len(cites) * i / 3), len(cites) - 1)] for i in (1, 2)})
        out.append((-round(_evenness(Counter(sum(e <= c for e in edges) for c in cites).values()), 6), 1, "citation", str(edges[-1])))
    return [(i, axis, value, -score) for i, (score, _, axis, value) in enumerate(sorted(x for x in out if x[0] <= -0.7), 1)]


def test_chips_of_random_lists(spark):
    rng = random.Random(3)
    lists = {g: [(rng.choice([None, 2001, 2002, 2003][: rng.randint(1, 4)]), rng.choice([None, 0, 1, 5, rng.randint(0, 40)]), rng.choice(["", None, "a", "b"])) for _ in range(rng.randint(1, 12))] for g in range(120)}
    rows = [(g, i, *r) for g, rs in lists.items() for i, r in enumerate(rs)]
    rng.shuffle(rows)
    got = {}
    for r in G.narrow_chips(spark.createDataFrame(rows, "g int, at int, year int, citations int, kind string")).orderBy("g", "rank").collect():
        got.setdefault(r["g"], []).append((r["rank"], r["axis"], r["value"], r["score"]))
    want = {g: c for g, rs in lists.items() if (c := _chips(rs))}
    assert got == want and {len(c) for c in want.values()} == {1, 2, 3}


def test_verdicts_by_mail_domain(spark):
    a, b = "가람대학교", "나래대학교"
    people = [
        (1, "x@ga.ac.kr", a, "confirmed"), (2, "x@ga.ac.kr", a + " 수학과", "confirmed"), (3, "x@GA.ac.kr ", a + " 물리학과", "inferred"), (4, "x@ga.ac.kr", b, "inferred"),
        (5, "x@ga.ac.kr", "Garam University", "inferred"), (6, "x@gmail.com", a, "inferred"), (7, "x", a, "inferred"), (8, "x@other.kr", a, "inferred"),
        (9, "x@all.kr", a, "confirmed"), (10, "x@all.kr", b, "confirmed"), (11, "x@all.kr", "다솜대학교", "confirmed"), (12, "x@all.kr", a, "inferred"),
        (13, None, a, "inferred"), (14, "x@ga.ac.kr", None, "inferred"), (15, "x@ga.ac.kr", a + "병원", "inferred"), (16, "x@ga.ac.kr", "", "inferred")]
    got = {r["rid"]: (r["verdict"], r["confidence"], r["email"]) for r in I.domain_verdicts(spark.createDataFrame(people, "rid int, email string, institution string, confidence string")).collect()}
    assert got == {
        3: ("promote", "domain_verified", "x@GA.ac.kr "), 4: ("revoke", "disputed", None), 5: ("hold", "inferred", "x@ga.ac.kr"), 6: ("personal", "inferred", "x@gmail.com"), 7: ("personal", "inferred", "x"),
        8: ("unlisted", "inferred", "x@other.kr"), 12: ("unlisted", "inferred", "x@all.kr"), 15: ("promote", "domain_verified", "x@ga.ac.kr"), 16: ("hold", "inferred", "x@ga.ac.kr")}


def test_profiles_of_researchers(spark):
    rows = [(1, 1, "", "P", 2001, 10), (1, 2, "Ann", "Q", 2003, 11), (1, 3, "Anne", "P", 2003, 12), (1, 4, None, "", 2009, 12), (2, 5, None, None, None, 13), (2, 6, None, "R", None, 14), (3, 7, "Cy", None, 2000, 15)]
    tags = [(10, 1, "b"), (10, 2, "a"), (11, 1, "a"), (12, 1, "c"), (14, 1, "z")]
    x = G.researcher_profiles(spark.createDataFrame(rows, "rid int, at int, name string, institution string, year int, paper_id int"), spark.createDataFrame(tags, "paper_id int, pos int, name string"), 2)
    assert {r["rid"]: (r["name"], r["current"], r["history"], r["keywords"], r["papers"]) for r in x.collect()} == {
        1: ("Ann", "P", ["P", "Q"], ["a", "c"], 3), 2: (None, "R", ["R"], ["z"], 2), 3: ("Cy", None, None, None, 1)}


def test_summaries_of_topics(spark):
    long = "가" * 60
    papers = [(1, 0, 1, 2000), (2, 0, 2, 2000), (3, 0, 3, 2000), (3, 1, 4, 2001), (3, 1, 5, 2002), (3, 2, 6, 1999), (4, 0, 7, 2000), (4, 1, 8, 2001), (5, 0, 9, 2000), (6, 0, 10, 2000), (6, 1, 11, 2001), (6, 2, 12, 2002)]
    tags = [(1, 1, "n1"), (1, 2, "n2"), (1, 3, "n3"), (2, 1, long), (2, 2, long + "나"), (3, 1, "old"), (4, 1, "x"), (5, 1, "y"), (5, 2, "x"), (7, 1, long), (8, 1, "나" * 90), (10, 1, "a"), (12, 1, "c")]
    got = R.flow_summary(spark.createDataFrame(papers, "g int, label int, id int, year int"), spark.createDataFrame(tags, "paper_id int, pos int, name string"))
    assert {r["g"]: (r["clusters"], r["sentence"]) for r in got.collect()} == {
        1: (1, "n1 · n2 관련 연구가 대부분이에요."), 2: (1, f"{long} 관련 연구가 대부분이에요."), 3: (3, "주로 x, old 관련 연구를 해왔어요."),
        4: (2, None), 5: (1, None), 6: (3, "주로 c, a 관련 연구를 해왔어요.")}


def test_expansion_of_random_maps(spark):
    rng = random.Random(8)
    names = [f"k{i:02}" for i in range(25)]
    counts = {n: rng.randint(1, 6) for n in names}
    near = {(a, b): rng.randint(1, 4) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.25}
    weight = lambda a, b: near.get((min(a, b), max(a, b)))
    below = lambda a: sorted((b for b in names if b != a and weight(a, b) and counts[b] <= counts[a]), key=lambda b: (-weight(a, b), b))
    requests = [(s, rng.choice(names)) for s in range(40)]
    shown = {s: set(rng.sample(names, rng.randint(0, 15))) for s in range(39)}
    want = set()
    for s, node in requests:
        placed = shown.get(s, set()) | {node}
        left = [b for b in below(node) if b not in placed]
        new = left[:3]
        every = placed | set(new)
        more = len(left) > 3
        want |= {(s, "tree", node, b, weight(node, b), any(c not in every for c in below(b)), more) for b in new} or {(s, "none", node, None, None, None, False)}
        want |= {(s, "cross_link", a, b, n, None, more) for (a, b), n in near.items() if {a, b} <= every and {a, b} & set(new) and not (node in (a, b) and {a, b} - {node} <= set(new))}
    got = K.expand_with_links(
        spark.createDataFrame([(a, b, n) for (a, b), n in near.items()], "k1 string, k2 string, n int"), spark.createDataFrame(list(counts.items()), "name string, papers int"),
        spark.createDataFrame(requests, "session int, node string"), spark.createDataFrame([(s, n) for s, ns in shown.items() for n in ns], "session int, name string"))
    rows = [tuple(r[c] for c in ("session", "kind", "source", "target", "n", "has_more", "parent_has_more")) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and {r[1] for r in want} == {"tree", "cross_link", "none"}


def test_departments(spark):
    cases = {"가람대학교 심리학과 석사과정생": "심리학과", "가람대학교 교수": None, "가람대학교 대학원": None, "가람대학교 수학과 연구교수": "수학과", "농촌청 다솜과학원 토양과": None, "가람대학교": None, "": None, None: None,
             "가람대학교 수학과, 서울": "수학과", "가람대학교 수학과 교수 교수": "수학과 교수"}
    got = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", X.department_from(F.col("raw")).alias("d"), X.institution_dept(F.col("raw")).alias("w"), X.specific_unit(F.col("raw")).alias("u")).collect()
    found = {r["raw"]: r["d"] for r in got}
    assert {k: v for k, v in found.items() if k is None or "농촌청" not in k} == {k: v for k, v in cases.items() if k is None or "농촌청" not in k}
    # Under an agency the root is the first word, and the unit that starts the rest goes.
    agency = next(r for r in got if r["raw"] and "농촌청" in r["raw"])
    assert agency["d"] == (agency["w"][len(agency["u"]) :].strip() or None if agency["u"] and agency["w"].startswith(agency["u"]) else agency["w"])


def test_authors_pair_with_affiliations(spark):
    works = [(1, "A;;B ;C;", "X;Y", None, ""), (2, None, "X", ["N", " ", None, "M"], "박사"), (3, " ; ", None, ["N"], None), (4, "", "X", [], None), (5, None, None, None, "석사")]
    got = J.paired_authors(spark.createDataFrame(works, "id int, author string, affiliation string, names array<string>, degree string"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 1, "A", "X", None), (1, 2, "B", "Y", None), (1, 3, "C", None, None), (2, 1, "N", "X", "단독"), (2, 2, "M", None, "단독"), (3, 1, "N", None, None)]


def test_expanding_shuffles_sessions_once_and_reads_no_whole_neighbourhood(spark):
    from lectern.operators import graphs as K

    names = [f"k{i:02d}" for i in range(40)]
    related = spark.createDataFrame([(a, b, 1 + (i + j) % 5) for i, a in enumerate(names) for j, b in enumerate(names) if a < b], "k1 string, k2 string, n int")
    counts = spark.createDataFrame([(n, 5) for n in names], "name string, papers int")
    x = K.expand_with_links(related, counts, spark.createDataFrame([(s, names[s % 40]) for s in range(100)], "session int, node string"), spark.createDataFrame([(s, names[s % 7]) for s in range(100)], "session int, name string"))
    assert x.where("kind = 'tree'").count() == 300
    assert "Exchange hashpartitioning(session" not in x._jdf.queryExecution().executedPlan().toString()
