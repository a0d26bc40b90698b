"""Rules on small literal rows, with NULLs and ties."""
from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import aggregations as G
from lectern.operators import clustering as C
from lectern.operators import dates as T
from lectern.operators import filters as P
from lectern.operators import graphs as R
from lectern.operators import identity as I
from lectern.operators import joins as J
from lectern.operators import projections as D
from lectern.operators import text as X
from lectern.operators import vectors as V
from lectern.operators import windows as W


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize("raw,year,want", [("20240315", 2020, "2024-03-15"), ("2024.03", None, "2024-03"), ("2024", None, "2024"), (None, 2019, "2019"), ("x", None, None)])
def test_display_date(spark, raw, year, want):
    assert values(spark, [(raw, year)], "d string, y int", D.display_date(F.col("d"), F.col("y"))) == [(want,)]


@pytest.mark.parametrize("raw,want", [("20240230", "2024-02-30"), ("18991231", None), ("20241301", None), ("2024-01-32", None), (None, None), ("202401", None)])
def test_strict_date_checks_bounds_only(spark, raw, want):
    assert values(spark, [(raw,)], "d string", D.strict_date(F.col("d"))) == [(want,)]


def test_deepest_date_stays_in_its_year(spark):
    rows = [([1994, 3], [2007, 4, 3]), ([2007], [2007, 4, 3]), (None, [2007, 4]), (None, None)]
    got = values(spark, rows, "a array<int>, b array<int>", D.deepest_date(F.col("a"), [F.col("b")]))
    assert got == [("1994-03",), ("2007-04-03",), ("2007-04",), (None,)]


@pytest.mark.parametrize("c,q,sci,kci,hint,badge", [(50, None, None, None, False, "high"), (9, "q3", None, None, False, "medium"), (60, "Q4", None, None, False, "high"), (1, None, None, None, True, "medium"), (None, None, None, False, None, "unknown"), (0, "Q1", False, False, False, "high")])
def test_credibility(spark, c, q, sci, kci, hint, badge):
    col = D.credibility(F.col("c"), F.lit(None).cast("string"), F.col("q"), F.col("s"), F.col("k"), F.col("h"))
    got = values(spark, [(c, q, sci, kci, hint)], "c int, q string, s boolean, k boolean, h boolean", col.alias("x"))
    assert got[0][0]["badge"] == badge


def test_first_filled_skips_empty_values(spark):
    rows = [("a", 1, None, ""), ("a", 2, 0, "x"), ("a", 3, 7, "y"), ("b", 1, None, None)]
    got = {r["k"]: (r["n"], r["t"]) for r in D.first_filled(spark.createDataFrame(rows, "k string, o int, n int, t string"), "k", "o", ["n", "t"]).collect()}
    assert got == {"a": (7, "x"), "b": (None, None)}


def test_year_range():
    assert P.year_range(2001, None, None) == (2001, 2001)
    assert P.year_range(2001, 2010, 2005) == (2005, 2010)
    assert P.year_range(None, 2010, None) == (2010, None)


def test_unknown_year_fails_once_a_side_is_set(spark):
    df = spark.createDataFrame([(1, None), (2, 2000)], "i int, y int")
    assert df.where(P.year_in_range(F.col("y"), None, 2005)).count() == 1
    assert df.where(P.year_in_range(F.col("y"), None, None)).count() == 2


def test_relevance_floor_on_empty_and_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.7), (3, 0.69)], "id int, sim double")
    assert sorted(r["id"] for r in P.relevance_floor(df, 0.7).collect()) == [1, 2]
    assert P.relevance_floor(df.limit(0), 0.7).count() == 0


JOURNALS = "id int, title string, issn string, e_issn string, sjr_year int, sjr_score double, h_index int"


def test_best_journal_prefers_known_quality_and_either_key(spark):
    j = spark.createDataFrame([(1, "A", "1", None, None, 9.0, 1), (2, "B", "1", "2", 2020, None, 1), (3, "c ", "9", None, 2020, None, 1)], JOURNALS)
    items = spark.createDataFrame([(10, "1", "x"), (11, "7", "C"), (12, None, None), (13, "2", "c")], "item int, key string, title string")
    assert dict((r[0], r[1]) for r in J.best_journal(items, j).collect()) == {10: 2, 11: 3, 12: None, 13: 2}
    assert dict((r[0], r[1]) for r in J.first_wins(items, j).collect())[13] == 2
    assert sorted(map(tuple, J.or_join(items, j).collect())) == [(10, 1), (10, 2), (13, 2)]


def test_entropy_and_bins(spark):
    c = spark.createDataFrame([("a", 5), ("a", 5), ("b", 3), ("c", 0), ("c", 4)], "g string, n int")
    assert {r["g"]: r["entropy"] for r in G.entropy(c, "g", "n").collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}
    v = spark.createDataFrame([("g", i, x) for i, x in enumerate([1, 1, 1, 1, 9])], "g string, id int, v int")
    e = G.bin_edges(v, ["g"], "v", "id", 4)
    assert [r["edge"] for r in e.collect()] == [1]
    assert sorted(r["bin"] for r in G.assign_bins(v, e, ["g"], "v").collect()) == [1, 1, 1, 1, 1]


def test_auc_counts_no_ties(spark):
    rows = [(3.0, True), (2.0, True), (2.0, False), (1.0, False)]
    assert G.auc(spark.createDataFrame(rows, "score double, y boolean")).first()["auc"] == 0.75


def test_retrieval_metrics(spark):
    rows = [(1, 1, False, 2), (1, 2, True, 2), (1, 3, True, 2), (2, 1, False, 0)]
    got = {r["q"]: r for r in G.retrieval_metrics(spark.createDataFrame(rows, "q int, rank int, rel boolean, n_rel int"), 2).collect()}
    assert got[1]["recall"] == 0.5 and got[1]["mrr"] == 0.5 and got[2]["ndcg"] == -1.0


def test_cooccurrence_without_translations(spark):
    t = spark.createDataFrame([(1, "a", "ko"), (1, "b", "en"), (1, "c", "en"), (2, "a", "ko"), (2, "b", "en")], "paper_id int, name string, lang string")
    skip = spark.createDataFrame([("b", "a")], "k1 string, k2 string")
    assert {(r["k1"], r["k2"]): r["n"] for r in G.cooccurrence(t, skip).collect()} == {("a", "c"): 1, ("b", "c"): 1}
    both = G.cooccurrence(t)
    assert G.subtract_counts(both, both).count() == 0


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    assert sorted(map(tuple, W.rrf(a, b).collect())) == sorted(map(tuple, W.rrf(b, a).collect()))


def test_spread_uses_half_even_places(spark):
    df = spark.createDataFrame([("g", i) for i in range(6)], "g string, i int")
    assert sorted(r["i"] for r in W.spread(df, "g", ["i"], 3).collect()) == [0, 2, 5]
    assert W.spread(df.where("i < 2"), "g", ["i"], 3).count() == 2


def test_relabel_puts_undated_last(spark):
    rows = [("g", 0, None, 1), ("g", 1, 2020, 2), ("g", 2, 2021, 3)]
    assert {r["label"]: r["rank"] for r in W.relabel(spark.createDataFrame(rows, "g string, label int, year int, at int")).collect()} == {2: 0, 1: 1, 0: 2}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"])], "id int, toks array<string>")
    got = {r["id"]: r["score"] for r in V.bm25(docs, ["b", "a"]).collect()}
    idf = {t: np.log(3 - n + 0.5) - np.log(n + 0.5) for t, n in {"a": 2, "b": 1, "c": 1, "d": 1}.items()}
    mean = np.mean(list(idf.values()))
    part = lambda i, f, size: i * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / 2))
    assert got[1] == pytest.approx(part(idf["b"], 1, 2) + part(0.25 * mean, 1, 2))
    assert got[2] == pytest.approx(part(0.25 * mean, 2, 3)) and got[3] == 0


def test_cosine_of_a_zero_vector_is_zero(spark):
    assert values(spark, [([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>", V.cosine("a", "b")) == [(0.0,)]


def test_blend_needs_every_graph_vector(spark):
    rows = [(1, [1.0, 0.0], [1.0]), (2, [0.0, 1.0], None)]
    got = {r["id"]: r["sim"] for r in V.blended(spark.createDataFrame(rows, "id int, v array<double>, g array<double>"), {"v": [1.0, 0.0], "g": [-1.0]}).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_average_linkage():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0, 0.9]], float)
    assert C.average_linkage(x, 0.6) == [0, 0, 1, 1]
    assert C.average_linkage(x[:1], 0.6) == [0]


def _components(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    nodes, edges = list(range(120)), [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(90, 110)]
    got = R.components(spark.createDataFrame([(n,) for n in nodes], "n long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["comp"] for r in got.collect()} == _components(nodes, edges)


def test_components_that_have_not_converged_raise(spark):
    nodes, edges = list(range(40)), [(i, i + 1) for i in range(39)]
    n, e = spark.createDataFrame([(n,) for n in nodes], "n long"), spark.createDataFrame(edges, "a long, b long")
    with pytest.raises(RuntimeError):
        R.components(n, e, rounds=1)
    assert {r["comp"] for r in R.components(n, e).collect()} == {0}


def test_name_components_against_union_find(spark):
    rng = random.Random(5)
    rows = sorted({(f"n{rng.randrange(3)}", rng.randrange(40), rng.randrange(60)) for _ in range(90)})
    got = I.name_components(spark.createDataFrame(rows, "name string, paper_id long, other long")).collect()
    nodes = {f"{n}/{p}" for n, p, _ in rows}
    edges = [(f"{a}/{p}", f"{a}/{q}") for a, p, o in rows for b, q, u in rows if a == b and o == u]
    want = _components(nodes, edges)
    assert {f"{r['name']}/{r['paper_id']}": r["comp"] for r in got} == want


def test_judge_rules(spark):
    rows = [(1, "U", 10, "U dept", [5]), (1, "U", 11, "V", [5, 6]), (1, "U", 12, "W", [9]), (1, "U", 13, None, []), (1, "U", 14, "V", [6, 5, 7]), (1, "U", 15, "V", [9])]
    c = spark.createDataFrame(rows, "rid int, unit string, paper_id int, institution string, others array<int>")
    known = spark.createDataFrame([(1, 5), (1, 6)], "rid int, other int")
    assert {r["paper_id"]: r["rule"] for r in I.judged(c, known).collect()} == {10: 1, 11: 2, 12: 0, 13: None, 14: 2, 15: 3}


def test_modal_id_needs_its_share(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], "rid int, author_id string")
    assert [(r["rid"], r["author_id"]) for r in I.modal_id(t, t.select("author_id"), 0.5).collect()] == [(1, "a")]


def test_local_days_and_weeks(spark):
    at = dt.datetime(2024, 1, 7, 15, 0)  # Sunday in UTC, Monday 00:00 locally
    got = values(spark, [(at,), (at - dt.timedelta(seconds=1),)], "t timestamp_ntz", T.local_day(F.col("t")), T.period_start(F.col("t"), "week"))
    assert got[0][0] == dt.date(2024, 1, 8) and got[1][0] == dt.date(2024, 1, 7)
    assert got[0][1] == at and got[1][1] == at - dt.timedelta(days=7)


@pytest.mark.parametrize("raw,root,dept", [("청운대학교 식품영양학과", "청운대학교", "식품영양학과"), ("한서대학교 문화재보존과학연구센터", "한서대학교", "문화재보존과학연구센터"), ("연세대학교", "연세대학교", None), ("Yonsei University, Seoul", "Yonsei University", None), ("", None, None), (None, None, None), ("어딘가 부서", "어딘가", "부서")])
def test_institution_root(spark, raw, root, dept):
    assert values(spark, [(raw,)], "i string", X.institution_root(F.col("i")), X.institution_dept(F.col("i"))) == [(root, dept)]


@pytest.mark.parametrize("a,b,same", [("서울대학교", "서울대학교병원", True), ("국립식량과학원", "농촌진흥청 국립식량과학원", True), ("서울대학교", "남서울대학교", False), ("(주)가람", "가람", True), (None, "가람", False)])
def test_same_institution(spark, a, b, same):
    assert values(spark, [(a, b)], "a string, b string", X.same_institution(F.col("a"), F.col("b"))) == [(same,)]


def test_terms_by_language():
    assert X.by_language_py("인공지능(Artificial Intelligence); deep learning, 딥러닝") == (["인공지능", "딥러닝"], ["artificial intelligence", "deep learning"])
    assert X.by_language_py(None) == ([], [])
    assert X.language_runs_py("딥러닝 CNN 모델 image segmentation") == (["딥러닝 CNN 모델"], ["image segmentation"])


def test_markup():
    assert X.repaired_py("H<SUB>2</SUB>O") == "H₂O" and X.repaired_py("a<SUP>xyz</SUP>") == "axyz" and X.repaired_py(None) is None
    assert X.repaired_py("<P>one</P><P>two") == "one\n\ntwo"
    assert X.repaired_py("<I>y <B>z</B></I> &amp;lt; <Parasite>") == "*y **z*** < <Parasite>"


@pytest.mark.parametrize("raw,want", [("a **b** c", ("a b c", 2, 3)), ("**all**", ("all", None, None)), ("a **b", ("a b", None, None)), ("**x** and **y** z", ("x and y z", 0, 1)), ("a **" + "b" * 41 + "** c", ("a " + "b" * 41 + " c", None, None)), (None, ("", None, None))])
def test_markers(spark, raw, want):
    assert tuple(values(spark, [(raw,)], "r string", X.markers(F.col("r")).alias("m"))[0][0]) == want


def test_author_roles(spark):
    rows = [("1", "제1", ["제1", "교신"]), ("2", "교신", ["교신", "교신"]), ("2", None, ["교신", None]), ("2", None, [None, None]), ("1", "교신", ["교신"])]
    got = values(spark, rows, "d string, p string, ps array<string>", X.author_roles(F.col("d"), F.col("p"), F.col("ps")))
    assert got == [(["first"],), (["co_corresponding"],), (["participant"],), ([],), (["first", "corresponding"],)]


def test_author_place(spark):
    rows = [("김 가", "U", ["김가", "이나"], ["U", "V"]), ("김가", "U", ["김가", "김가"], ["U x", "V"]), ("김가", None, ["김가", "김가"], ["U", "V"]), ("김가", "U", [], [])]
    assert values(spark, rows, "n string, r string, ns array<string>, ins array<string>", X.author_place(*[F.col(c) for c in ("n", "r", "ns", "ins")])) == [(0,), (0,), (None,), (None,)]


def test_assembled(spark):
    rows = [(["a" * 100, "b" * 90],), (["a" * 150, "b" * 90],), (["a" * 300],), ([],)]
    got = [(len(r[0]["text"]), r[0]["complete"]) for r in values(spark, rows, "s array<string>", X.assembled(F.col("s")).alias("a"))]
    assert got == [(191, True), (150, False), (300, False), (0, True)]


def test_rank_in_ranges_equals_one_window(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "id long, s double")
    order = [F.col("s").desc(), F.col("id").asc()]
    one = sorted(map(tuple, W.global_rank(df, order, "rank", 200).collect()))
    monkeypatch.setattr(W, "ONE_TASK", 30)
    assert sorted(map(tuple, W.global_rank(df, order, "rank", 200).collect())) == one


def test_list_sort_returns_every_row(spark):
    p = spark.createDataFrame([(i, None if i % 5 == 0 else 1990 + i % 7, i % 3) for i in range(120)], "id long, pubyear int, citation_count long")
    got = {r["id"]: r["rn"] for r in P.list_sorted(p, "oldest").collect()}
    order = sorted(range(120), key=lambda i: (0 if i % 5 == 0 else 1990 + i % 7, i))
    assert [got[i] for i in order] == list(range(1, 121))


def test_sort_downgrade_returns_every_row(spark):
    rows = [(1, 10, 5, 2000), (1, 11, 9, 1999), (1, 12, 7, 2001), (2, 20, 9, 1990), (2, 21, 0, 2005), (2, 22, None, 2001)]
    x = spark.createDataFrame(rows, "rid int, paper_id int, citation_count int, pubyear int")
    got = P.downgraded(x, "rid", F.col("citation_count") > 0, 3).select("rid", "paper_id", "ok", "rn").collect()
    assert sorted(map(tuple, got)) == [(1, 10, True, 3), (1, 11, True, 1), (1, 12, True, 2), (2, 20, False, 3), (2, 21, False, 1), (2, 22, False, 2)]


# Rules that the catalogue's SQL cannot express, or only in part


def test_query_keys_drop_noise_and_width(spark):
    rows = [(["딥러닝 관련 논문", "Ｄｅｅｐ learning 연구"],), (["learning deep", "Ünï-code_x 자료!", "연구자"],), ([None, "  ", "논문"],), (None,)]
    assert values(spark, rows, "t array<string>", X.query_key(F.col("t"))) == [("deep learning|딥러닝",), ("learning deep|ünï-code_x|연구자",), ("",), (None,)]


def test_display_keys_lower_and_narrow(spark):
    assert values(spark, [("Deep  Learning",), ("ＤＥＥＰ　Learning",), ("Straße",), (None,)], "w string", X.display_key(F.col("w"))) == [("deeplearning",), ("deeplearning",), ("straße",), (None,)]


def test_split_terms_are_cleaned_first(spark):
    rows = [("a &amp; b; Ｃ, d / e . f ·g",), ("  ;., ",), (None,)]
    assert values(spark, rows, "t string", X.split_terms("t")) == [(["a & b", "C", "d", "e", "f ·g"],), ([],), ([],)]


def test_institutions_without_company_markers(spark):
    rows = [("㈔가람", "가람", True), ("(학)가람", "유한회사 가람", True), ("㈐나래", "가람", False), ("서울대학교", "남서울대학교", False), ("국립식량과학원", "농촌진흥청 국립식량과학원", True), ("(주)", "가람", False)]
    assert [r[0] for r in values(spark, rows, "a string, b string, c boolean", X.same_institution(F.col("a"), F.col("b")))] == [r[2] for r in rows]


def test_specific_units(spark):
    rows = {"농촌진흥청 국립식량과학원 중부작물부": "국립식량과학원", "농촌진흥청": None, "연세대학교 의과대학": "연세대학교", "농촌진흥청농업과학기술원": "농업과학기술원", "환경부 ": None, "(주)가람연구소": "가람연구소", "": None}
    assert {k: v for k, v in values(spark, [(k,) for k in rows], "r string", "r", X.specific_unit(F.col("r")))} == rows
    units = values(spark, [("농촌진흥청 국립농업과학원 유기농업과",), ("연세대학교 의과대학",)], "r string", X.institution_units(F.col("r")))
    assert units == [(["농촌진흥청", "국립농업과학원"],), (["연세대학교"],)]


def test_polished_institution(spark):
    rows = {"Dept. of X, Garam University, Seoul": "Garam University", "School of Y, Nara Institute, 12345 Road": "Nara Institute", "School of Y, Seoul": "School of Y", "Bora Co., Ltd., Busan": "Bora Co., Ltd.", "가람대학교, 서울": "가람대학교, 서울", "Plain name": "Plain name", "": None}
    assert {k: v for k, v in values(spark, [(k,) for k in rows], "r string", "r", X.polished_institution(F.col("r")))} == rows


def test_raised_and_lowered_characters():
    assert X.repaired_py("e<SUP>i</SUP> x<SUB>2</SUB> y<SUP>q</SUP>") == "eⁱ x₂ yq"


def test_title_ratio():
    assert X.title_ratio("Deep Learning!", "deep learning") == 1.0 and X.title_ratio("abcd", "abxx") == 0.5 and X.title_ratio(None, "x") == 0.0


def test_topic_nouns(spark):
    text = "노화 조기진단 관련논문 DNA분석 분석"
    assert values(spark, [(text,)], "t string", X.topic_nouns()(F.col("t"))) == [(["DNA분석", "조기진단", "관련논문", "DNA", "노화", "분석"],)]
    split = lambda t: [("조기", 3), ("진단", 5), ("관련", 8), ("논문", 10), ("노화", 0)] if t else []
    nouns = lambda t: sorted(split(t), key=lambda x: x[1])
    assert values(spark, [(text,), (None,)], "t string", X.topic_nouns(nouns)(F.col("t"))) == [(["조기진단", "노화", "조기", "진단"],), ([],)]


def test_list_places_and_one_to_one_pairs(spark):
    assert values(spark, [(["3번", "x", "1", "3", "9", "0"],)], "v array<string>", X.list_places(F.col("v"), F.lit(4))) == [([2, 0],)]
    pairs = [["1", "2"], ["1", "3"], ["2", "2"], ["2", "3"], ["9", "1"], ["3"], [None, "1"], ["no. 4", "1"]]
    got = values(spark, [(pairs,), ([],)], "p array<array<string>>", X.one_to_one(F.col("p"), F.lit(4), F.lit(4)))
    assert [[tuple(x) for x in r[0]] for r in got] == [[(0, 1), (1, 2), (3, 0)], []]


def test_author_place_by_second_name_and_width(spark):
    rows = [("가람", "Garam Kim", ["ＧＡＲＡＭ　ＫＩＭ", "x"]), ("x", "y", ["X"]), (None, "y", ["a", "Y."]), ("z", None, ["a"]), ("a", "b", ["a", "a", "b"])]
    c = X.author_place(F.col("n"), F.lit("가람"), F.col("ns"), F.transform("ns", lambda x: F.lit("")), F.col("m"))
    assert values(spark, rows, "n string, m string, ns array<string>", c) == [(0,), (0,), (1,), (None,), (None,)]


def test_first_json(spark):
    rows = ['so {broken {"k": 1, "n": {"x": [1]}} tail {"k": 2}', "none", None, '{"가": "}"}']
    assert values(spark, [(r,) for r in rows], "t string", X.first_json("t")) == [('{"k": 1, "n": {"x": [1]}}',), (None,), (None,), ('{"가": "}"}',)]


def test_similar_titles_pass_their_bounds(spark):
    rng = random.Random(5)
    pairs = [(t := "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14))), t[: rng.randint(0, 14)] + rng.choice(["", "a", "xyz"])) for _ in range(300)] + [(None, "a"), ("", "")]
    got = values(spark, pairs, "a string, b string", "a", "b", X.may_be_similar(F.col("a"), F.col("b"), 0.8), X.title_similarity_from(0.8)("a", "b"))
    for a, b, may, r in got:
        want = X.title_ratio(a, b)
        assert (r == pytest.approx(want)) if want >= 0.8 else r is None
        assert may or want < 0.8


def test_keyword_search_stages(spark):
    from operator import itemgetter

    from lectern.operators.search import keyword_search

    rows = [("deep learning", "en", 5, [1.0, 0.0]), ("Learning: deep nets", "en", 9, [0.0, 1.0]), ("deep learning nets", "en", 1, [1.0, 1.0]), ("유전체", "ko", 3, [1.0, 0.1]), ("aging", "en", 2, [0.9, 0.1])]
    k = spark.createDataFrame(rows, "name string, lang string, paper_count int, v array<double>")
    names = lambda *a, **b: [itemgetter("name", "stage")(r.asDict()) for r in keyword_search(k, *a, **b).collect()]
    assert names("Deep-learning") == [("deep learning", 1), ("deep learning nets", 1)]
    assert names("nets deep") == [("Learning: deep nets", 2), ("deep learning nets", 2)]
    assert names("게놈") == [("유전체", 3)] and names("게놈", lang="en") == [] and names("(!)") == []
    assert names("ageing", [1.0, 0.0], least=0.95) == [("deep learning", 3), ("유전체", 3), ("aging", 3)]
    assert names("deep learning", [1.0, 0.0], accept=F.col("name") == "aging") == [("aging", 3)]


def test_encoder_hook(spark):
    made = V.embedded(spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id int, t string"), "t", lambda: lambda texts: np.array([[len(t), 1] for t in texts]))
    assert [(r["id"], r["v"]) for r in made.orderBy("id").collect()] == [(1, [2.0, 1.0]), (2, None), (3, [3.0, 1.0])]
    assert values(spark, [("T", None, ["a", "b"]), (None, "x", None)], "t string, a string, k array<string>", V.passage_text(F.col("t"), F.col("a"), F.col("k"))) == [("passage: T T a b",), ("passage: x",)]


def test_component_samples_are_the_first_of_each(spark):
    rng = random.Random(4)
    rows = [(f"n{rng.randrange(3)}", rng.randrange(40), rng.randrange(60)) for _ in range(90)]
    got = I.component_samples(spark.createDataFrame(rows, "name string, paper_id long, other long"), 3).collect()
    want = set()
    for name in {r[0] for r in rows}:
        of = {p: {o for n, q, o in rows if (n, q) == (name, p)} for p in {r[1] for r in rows if r[0] == name}}
        left = set(of)
        while left:
            comp, todo = set(), [min(left)]
            while todo:
                p = todo.pop()
                if p not in comp:
                    comp.add(p)
                    todo += [q for q in of if of[p] & of[q]]
            left -= comp
            want |= {(name, p) for p in sorted(comp)[:3]}
    assert {(r["name"], r["paper_id"]) for r in got} == want and len(got) == len(want)


def test_merge_evidence_by_script(spark):
    people = [(1, "a", "가람대학교"), (2, "a", "Garam"), (3, "a", "나래대학교"), (4, "a", "가람대학교병원"), (5, "b", "가람대학교"), (6, "a", ""), (7, "a", "")]
    edges = [(1, 9), (2, 9), (3, 9), (1, 8), (3, 7), (6, 3)]
    p, e = spark.createDataFrame(people, "rid long, name string, institution string"), spark.createDataFrame(edges, "rid long, other long")
    got = {r["rid"]: r["canonical"] for r in I.same_name_merge(p, e, 2, 1).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}  # 2 joins 1 and 3 across scripts; 1 and 3 share one only
    assert {r["rid"]: r["canonical"] for r in I.same_name_merge(p, e, 2).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 6, 7: 7}


def test_names_twice_in_half_of_the_papers_block(spark):
    people = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "rid long, name string")
    links = spark.createDataFrame([(r, p) for r in (1, 2, 3, 4) for p in range(4)], "rid long, paper_id long")
    twice = spark.createDataFrame([(0, "a"), (1, "a"), (0, "b")], "paper_id long, name string")
    assert {r["rid"]: r["canonical"] for r in I.duplicate_groups(people, links, 3, twice).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_neighbour_means_of_a_path(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [3.0, 4.0])], "id int, v array<double>")
    got = {r["id"]: r["v"] for r in C.neighbour_means(v, spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"), 1).collect()}
    half = [2**-0.5, 2**-0.5]
    assert got[1] == pytest.approx(half) and got[2] == pytest.approx(half) and got[3] == pytest.approx(half) and got[4] == pytest.approx([0.6, 0.8])


def test_reduced_vectors_equal_a_decomposition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (40, 6)) * [5, 3, 2, 1, 0.1, 0.1]
    got = C.reduced(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>"), 3).orderBy("id").collect()
    y = np.array([r["v"] for r in got])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ axes[:3].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    # Signs of axes are free, so angles are compared.
    assert np.allclose(y @ y.T, want @ want.T, atol=1e-6) and np.allclose(np.linalg.norm(y, axis=1), 1)


def test_research_flow_of_one_person(spark):
    from lectern.operators.researchers import research_flow

    rows = [(1, 10, [1.0, 0.0], 2001, "a"), (1, 11, [1.0, 0.05], 2003, "b"), (1, 12, [0.0, 1.0], 2010, "c"), (1, 13, [0.02, 1.0], None, "d")]
    tags = [(10, "x"), (11, "x"), (11, "y"), (12, "z")]
    got = research_flow(spark.createDataFrame(rows, "g long, id long, v array<double>, year int, title string"), spark.createDataFrame(tags, "paper_id long, name string")).orderBy("rank").collect()
    assert [(r["rank"], r["first"], r["last"], r["papers"], r["sentence"]) for r in got] == [(0, 2010, 2010, 2, "z (2010-2010)"), (1, 2001, 2003, 2, "x, y (2001-2003)")]


def test_institution_renames(spark):
    rows = [(r, "old", y) for r in (1, 2, 3) for y in (1990, 1991)] + [(r, "new", y) for r in (1, 2, 3) for y in (1992, 1993)] + [(9, "kept", y) for y in (1990, 2000)] + [(1, "kept", 1989)]
    got = I.renamed_institutions(spark.createDataFrame(rows, "rid int, institution string, year int"), 3, 0.1, 0.05).collect()
    assert [tuple(r) for r in got] == [("old", "new", 3)]


def test_sync_store_checks_its_count(spark, tmp_path):
    from lectern.sources import writers as O

    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, label string")
    new = spark.createDataFrame([(2, "B"), (4, "d"), (4, "d")], "id int, label string")
    assert sorted(map(tuple, O.sync_store(old, new, "id", str(tmp_path / "store")).collect())) == [(2, "B"), (4, "d")]


def test_keywords_by_language_show_their_terms(spark):
    rows = [("딥러닝(Deep Learning); 영상 처리, CNN",), ("machine learning / 기계 학습",), (None,)]
    got = values(spark, rows, "t string", X.keywords_by_language("t"))
    assert [(r[0]["ko"], r[0]["en"]) for r in got] == [(["딥러닝", "영상 처리"], ["deep learning", "cnn"]), (["기계 학습"], ["machine learning"]), ([], [])]


def test_assembled_sentences(spark):
    s = ["a" * 99 + ".", "b" * 99 + ".", "c" * 99 + "."]
    got = values(spark, [(s,), (s[:2],), (["d" * 300],), ([],)], "s array<string>", X.assembled(F.col("s")).alias("x"))
    assert [(r[0]["text"], r[0]["complete"]) for r in got] == [(s[0], False), (" ".join(s[:2]), True), ("d" * 300, False), ("", True)]


def test_token_kinds_agree_with_the_expression(spark):
    rows = [(t,) for t in ("DNA", "ABCDEFGH", "ABCDEFGHI", "word", "abc", "H2SO4", "12mm", "1234", "--", "딥", "Na", "NaCl", "Deep", "a-b-c", "A1b2", "CamelCaseWord", "x1y2z3")]
    assert all(a == b for a, b in [(X._kind(t), lang) for t, lang in values(spark, rows, "t string", "t", X.token_language(F.col("t")))])


@pytest.mark.parametrize("longest", [10, 2, 0])
def test_similarity_by_shared_keywords_equals_all_pairs(spark, longest):
    rng = np.random.default_rng(8)
    x = {i: rng.normal(0, 1, 3) if i else np.zeros(3) for i in range(40)}
    names = {i: {f"k{j}" for j in rng.integers(0, 7, rng.integers(0, 6))} for i in x}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id int, v array<double>")
    got = C.similarity_diagnostics(rows, spark.createDataFrame([(i, n) for i, ns in names.items() for n in ns] + [(99, "k1")], "id int, name string"), 3, longest).collect()
    want = {}
    for i in x:
        for j in x:
            if i < j and (n := min(3, len(names[i] & names[j]))):
                norm = np.linalg.norm(x[i]) * np.linalg.norm(x[j])
                want.setdefault(n, []).append(x[i] @ x[j] / norm if norm else 0.0)
    assert {r["shared"]: (r["n"], r["mean"]) for r in got} == {n: (len(s), pytest.approx(np.mean(s), abs=2e-6)) for n, s in want.items()}
