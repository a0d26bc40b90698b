"""Stars, keyword pages, clusters of shown papers, merged people, reasons, keys and SQL functions against plain versions or literal rows."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.functions.register import register
from lectern.operators import graphs as K
from lectern.operators import identity as I
from lectern.operators import text as X

PAPERS = "id int, title string, title_en string, journal string, year int"


def test_star_of_a_paper(spark):
    papers = spark.createDataFrame([(1, "T", None, "J", 2001), (2, "", "E", None, None), (3, None, "", "J", None)], PAPERS)
    tags = spark.createDataFrame([(1, "ko", "나"), (1, "ko", "가"), (1, "en", "Abc"), (1, "en", "ABC"), (1, "en", "z"), (9, "en", "lost"), (2, "en", "z")], "paper_id int, lang string, name string")
    authors = spark.createDataFrame([(1, "Kim", 1), (1, "Lee", 2), (1, "Kim", 3), (1, None, 4), (9, "Lost", 1)], "paper_id int, name string, author_order int")
    nodes = {(r["center"], r["id"], r["label"], r["name"], r["is_center"]) for r in K.star_nodes(papers, tags, authors, 4).collect()}
    assert nodes == {
        (1, "paper:1", "Paper", "T", True), (2, "paper:2", "Paper", "E", True), (3, "paper:3", "Paper", "3", True), (1, "keyword:en:abc", "Keyword", "Abc", False), (1, "keyword:en:z", "Keyword", "z", False),
        (1, "keyword:ko:가", "Keyword", "가", False), (2, "keyword:en:z", "Keyword", "z", False), (1, "author:Kim", "Author", "Kim", False), (1, "author:Lee", "Author", "Lee", False),
        (1, "journal:J", "Journal", "J", False), (3, "journal:J", "Journal", "J", False), (1, "year:2001", "Year", "2001", False)}
    edges = {tuple(r) for r in K.star_edges(papers, tags, authors, 4).where("center = 1 AND type <> 'HAS_KEYWORD'").drop("lang").collect()}
    assert edges == {(1, "author:Kim", "paper:1", "AUTHORED", 1), (1, "author:Lee", "paper:1", "AUTHORED", 2), (1, "author:Kim", "paper:1", "AUTHORED", 3), (1, "paper:1", "journal:J", "PUBLISHED_IN", None), (1, "paper:1", "year:2001", "PUBLISHED_IN_YEAR", None)}


def test_page_of_a_keyword(spark):
    papers = spark.createDataFrame([(1, "B", 2001), (2, "A", 2001), (3, "C", None), (4, "D", 2009), (5, "A", 2001), (6, "X", 2020)], "id int, title string, pubyear int")
    tags = spark.createDataFrame([(i, "en", "Deep  Sea" if i % 2 else "deep sea") for i in range(1, 6)] + [(2, "ko", "바다"), (2, "en", "ash"), (6, "ko", "deep sea")], "paper_id int, lang string, name string")
    authors = spark.createDataFrame([(2, "Z", 1), (2, None, 2), (2, "Y", 3)], "paper_id int, name string, author_order int")
    got = [tuple(r) for r in K.keyword_page(papers, tags, authors, "en:deep sea", 3, 1).orderBy("place").collect()]
    assert got == [
        (2, 2, "A", 2001, ["Z", "Y"], ["ash", "deep sea", "바다"], ["en:ash", "en:deep sea", "ko:바다"], 5), (3, 5, "A", 2001, [], ["Deep  Sea"], ["en:deep sea"], 5), (4, 1, "B", 2001, [], ["Deep  Sea"], ["en:deep sea"], 5)]
    assert K.keyword_page(papers, tags, authors, "en:none", 3, 0).count() == 0


def test_clusters_of_shown_papers(spark):
    rng = random.Random(5)
    tags = {p: set(rng.sample(range(14), rng.randint(0, 5))) for p in range(40)}
    shown = {s: [(p, rng.random() < 0.8) for p in rng.sample(range(40), rng.randint(0, 12))] for s in range(30)}
    want = set()
    for s, nodes in shown.items():
        own, number, count = [p for p, mine in nodes if mine], {}, 0
        near = {p: {q for q in own if q != p and len(tags[p] & tags[q]) >= 2} for p in own}
        for p in own:
            if p not in number and near[p]:
                count, todo = count + 1, [p]
                while todo:
                    q = todo.pop()
                    if q not in number:
                        number[q] = count
                        todo.extend(near[q])
        want |= {(s, p, number.get(p)) for p, _ in nodes}
    nodes = spark.createDataFrame([(s, p, i, mine) for s, ns in shown.items() for i, (p, mine) in enumerate(ns)], "session int, node int, at int, own boolean")
    got = [tuple(r) for r in K.keyword_clusters(nodes, spark.createDataFrame([(p, f"k{t}") for p, ts in tags.items() for t in ts], "paper_id int, name string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {c for _, _, c in want} >= {None, 1, 2}


def test_merged_people(spark):
    people = [
        (1, None, ["P", "Q"], ["b", "a"], 2, 5), (2, "Zed", ["Q", None, "R"], [f"k{i:02}" for i in range(20)], 3, 1), (3, "Ann", None, None, None, None),
        (4, None, ["S"], ["z", "y"], 0, 9), (5, "Bo", None, ["c"], 0, None), (6, None, None, None, 0, 0), (7, "Cy", [], [], 1, 1), (8, "Al", [], [], 1, 1)]
    x = spark.createDataFrame(people, "rid int, name_eng string, history array<string>, keywords array<string>, corpus int, papers int")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7), (8, 7)], "rid int, comp int")
    assert {tuple(map(lambda v: tuple(v) if isinstance(v, list) else v, r)) for r in I.merged_people(x, groups).collect()} == {
        (2, "Zed", ("P", "Q", "R"), ("a", "b", *[f"k{i:02}" for i in range(13)]), 2), (4, None, ("S",), ("z", "y"), 0), (5, "Bo", (), ("c",), 1), (7, "Cy", (), (), 1)}


def test_pruned_people(spark):
    who = lambda *rows: spark.createDataFrame(rows, "rid int, paper_id int")
    got = I.pruned(spark.createDataFrame([(1,), (2,), (3,), (3,), (4,)], "rid int"), who(*[(1, i) for i in range(8)], *[(2, i) for i in range(7)]), who((3, 1), (3, 2), (9, 1)))
    assert {tuple(r) for r in got.collect()} == {(1, 8, True), (2, 7, False), (3, 0, True), (4, 0, False)}


def _reason(sentences):
    bare = lambda ss: " ".join(ss).replace("**", "").strip()
    if len(bare(sentences)) <= 220:
        return bare(sentences), True
    n = max((i for i in range(1, len(sentences) + 1) if all(len(bare(sentences[:j])) <= 200 for j in range(1, i + 1))), default=0)
    return bare(sentences[:n] if n else sentences), False


def test_reasons_and_the_choice_among_them(spark):
    rng = random.Random(2)
    rows = [(g, i, ["**가**" * rng.randint(0, 1) + "나" * rng.randint(1, 150) + "." for _ in range(rng.randint(0, 4))]) for g in range(40) for i in range(rng.randint(1, 5))]
    rows += [(99, 0, []), (98, 0, ["x" * 230]), (98, 1, ["x" * 230]), (97, 0, ["x" * 170]), (97, 1, ["x" * 180]), (96, 0, ["x" * 201]), (96, 1, ["x" * 190, "y" * 100])]
    rng.shuffle(rows)
    x = spark.createDataFrame(rows, "id int, at int, s array<string>").select("id", "at", X.reason(F.col("s")).alias("r")).select("id", "at", "r.*")
    made = {(g, i): _reason(s) for g, i, s in rows}
    assert {(r["id"], r["at"]): (r["text"], r["complete"]) for r in x.collect()} == made
    for policy in ("center", "under_max"):
        want = {}
        for g in {g for g, _ in made}:
            live = [(i, *made[g, i]) for i in sorted(i for h, i in made if h == g) if made[g, i][0]]
            under = [c for c in live if len(c[1]) <= 200]
            if policy == "center":
                best = min(live, key=lambda c: (not c[2], abs(len(c[1]) - 175)), default=None)
            else:
                best = max(under, key=lambda c: (c[2], len(c[1]))) if under else min(live, key=lambda c: (not c[2], len(c[1])), default=None)
            if best:
                want[g] = best
        assert {r["id"]: (r["at"], r["text"], r["complete"]) for r in X.best_reasons(x, policy).collect()} == want
    first = spark.range(1).select(X.reason(F.array(F.lit("on **deep sea** life."), F.lit("more."))).alias("r")).first()["r"]
    assert tuple(first) == ("on deep sea life. more.", 3, 11, True)


def test_keys_of_keywords(spark):
    names = {" Deep\t\nSea ": "deep sea", "ＡＢＣ\u3000x ": "abc x", "\u3000가 나\u00a0": "가 나", "Straße": "strasse", "a\x1fb": "a b", "": "", "\x0b": ""}
    got = {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", X.keyword_key(F.col("n"), F.lit("en")).alias("k")).collect()}
    assert got == {n: "en:" + k for n, k in names.items()} == {n: "en:" + X.words_casefold_py(n) for n in names}


def test_keyword_fields_of_a_paper(spark):
    rows = [(1, ["심층 학습 (Deep Learning)", "STRASSE"], ["Straße; deep learning", "심층  학습"]), (2, None, None), (3, ["가"], ["a"]), (4, ["가", None, ""], None)]
    got = {r["id"]: tuple(r["r"]) for r in spark.createDataFrame(rows, "id int, a array<string>, b array<string>").select("id", X.paper_keywords("a", "b").alias("r")).collect()}
    assert got == {1: (["심층 학습"], ["deep learning", "strasse"], True), 2: ([], None, True), 3: (["가"], ["a"], False), 4: (["가"], None, True)}


def test_sql_functions(spark):
    assert set(register(spark)) >= {"bare_doi", "keyword_key", "vector_cosine"}
    r = spark.sql("""SELECT bare_doi(' http://dx.doi.org/10.1/A') AS doi, first_year('c1899, 2001') AS year, hyphenated_issn('1234-567x') AS issn, hyphenated_issn('12') AS short, keyword_key('\u3000Ａ  b', 'en') AS key,
      lexical_tokens(' A  b') AS words, vector_cosine(array(1D, 0D), array(1D, 1D)) AS near, vector_cosine(array(0D), array(1D)) AS none""").first()
    assert (r["doi"], r["year"], r["issn"], r["short"], r["key"], r["words"], round(r["near"], 6), r["none"]) == ("10.1/A", 1899, "1234-567X", None, "en:a b", ["a", "b"], 0.707107, None)
    plan = spark.range(1).selectExpr("bare_doi(CAST(id AS STRING)) AS d")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_pairs_within_sessions_only(spark):
    nodes = spark.createDataFrame([(s, p, i, True) for s in ("a", "b") for i, p in enumerate([1, 2, 3] if s == "a" else [3, 4])], "session string, node int, at int, own boolean")
    tags = spark.createDataFrame([(1, "x"), (1, "y"), (3, "x"), (3, "y"), (2, "u"), (2, "v"), (4, "u"), (4, "v")], "paper_id int, name string")
    assert {tuple(r) for r in K.keyword_clusters(nodes, tags).collect()} == {("a", 1, 1), ("a", 2, None), ("a", 3, 1), ("b", 3, None), ("b", 4, None)}
