"""Queries of vector similarity, BM25, hybrid search and clustering."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import oracle
from ..operators import clustering as C
from ..operators import vectors as V
from ..operators.text import bm25_text, tokens
from .catalog import query

TERMS = ("the", "and", "tion", "the")


def query_vector(vecs, i: int) -> list[float]:
    """One vector, by its id."""
    rows = vecs.where(F.col("id") == i).select("v").take(1)
    return list(rows[0]["v"]) if rows else [0.0]


_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
#: Similarity of every vector but 0 to vector 0.
SIM = f"SELECT a.id, round(greatest(0, {_COS}), 9) AS sim FROM vecs a, (SELECT * FROM vecs WHERE id = 0) b WHERE a.id <> 0"
_TOKS = "list_filter(string_split_regex(lower(text), '[ \\n\\t\\r]+'), lambda x: x <> '')"
_BM25 = f"""tk AS MATERIALIZED (SELECT doc_id AS id, {_TOKS} AS t FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avg FROM tk),
  df AS MATERIALIZED (SELECT w, count(*) AS d FROM (SELECT id, unnest(list_distinct(t)) AS w FROM tk) GROUP BY 1), idf AS (SELECT w, ln(n - d + 0.5) - ln(d + 0.5) AS i FROM df, st), mean AS (SELECT avg(i) AS m FROM idf),
  q AS (SELECT unnest({list(TERMS)}) AS w), qi AS (SELECT q.w, CASE WHEN i >= 0 THEN i ELSE 0.25 * m END AS i FROM q JOIN idf USING (w), mean),
  bm AS MATERIALIZED (SELECT tk.id, coalesce(sum(i * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))), 0) AS score FROM tk, st, (SELECT w, i FROM qi) z, LATERAL (SELECT len(list_filter(t, lambda x: x = z.w)) AS f) GROUP BY 1)"""


def _lex(spark, d):
    return A.docs(spark, d).select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("toks"))


@query("vec01_cosine", oracle("vecs", f"SELECT a.id AS a, b.id AS b, round(greatest(0, {_COS}), 6) AS sim FROM vecs a, (SELECT * FROM vecs WHERE id < 5) b WHERE a.id >= 5"))
def vec01(spark, d):
    v = A.vecs(spark, d)
    q = F.broadcast(v.where("id < 5").select(F.col("id").alias("b"), F.col("v").alias("w")))
    return v.where("id >= 5").crossJoin(q).select(F.col("id").alias("a"), "b", F.round(F.greatest(F.lit(0.0), V.cosine("v", "w")), 6).alias("sim"))




@query("vec02_best_sentence", oracle("vecs", f"""WITH x AS (SELECT id % 50 AS id, id AS pos, 's' || id AS sentence, v FROM vecs WHERE id <> 0), y AS (SELECT a.id, a.pos, a.sentence, round({_COS}, 9) AS s FROM x a, (SELECT v FROM vecs WHERE id = 0) b)
  SELECT id, arg_max(sentence, (s, -pos)) AS sentence, round(max(s), 6) AS sim FROM y GROUP BY 1"""))
def vec02(spark, d):
    v = A.vecs(spark, d)
    x = v.where("id <> 0").select((F.col("id") % 50).alias("id"), F.col("id").alias("pos"), F.concat(F.lit("s"), F.col("id")).alias("sentence"), "v")
    return V.best_sentence(x, query_vector(v, 0))


@query("vec03_bm25", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm")
def vec03(spark, d):
    return V.bm25(_lex(spark, d), list(TERMS)).select("id", F.round("score", 6).alias("score"))


def _text_index(spark, rows):
    from ..sources import text_index as I
    from ..sources.writers import scratch

    path = scratch(spark)
    I.build(rows, path)
    return I, path


@query("vec03_indexed_bm25", f"""WITH tk AS MATERIALIZED (SELECT doc_id AS id, {_TOKS} AS t FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avg FROM tk),
  df AS MATERIALIZED (SELECT w, count(*) AS d FROM (SELECT id, unnest(list_distinct(t)) AS w FROM tk) GROUP BY 1), idf AS (SELECT w, ln(n - d + 0.5) - ln(d + 0.5) AS i FROM df, st), mean AS (SELECT avg(i) AS m FROM idf),
  q AS (SELECT query, w, count(*) AS times FROM (SELECT id AS query, unnest(t[1:4]) AS w FROM tk WHERE id % 20 = 0) GROUP BY ALL), qi AS (SELECT query, w, times * CASE WHEN i >= 0 THEN i ELSE 0.25 * m END AS i FROM q JOIN idf USING (w), mean),
  p AS MATERIALIZED (SELECT id, w, n AS len, count(*) AS f FROM (SELECT id, len(t) AS n, unnest(t) AS w FROM tk) GROUP BY ALL)
  SELECT query, id, round(sum(i * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avg))), 6) AS score FROM qi JOIN p USING (w), st GROUP BY ALL""")
def vec03_indexed(spark, d):
    """The first four terms of every 20th document against the stored index of all."""
    docs = _lex(spark, d)
    I, path = _text_index(spark, docs)
    return I.bm25(spark, path, docs.where("id % 20 = 0").select(F.col("id").alias("query"), F.slice("toks", 1, 4).alias("terms"))).withColumn("score", F.round("score", 6))


@query("str28_indexed_names", oracle("keywords", """WITH k AS (SELECT DISTINCT name, string_split(name, ' ') AS w FROM keywords), q AS (SELECT DISTINCT w[2] || ' ' || w[1] AS query, [w[2], w[1]] AS t FROM k),
  p AS (SELECT query, name FROM q JOIN k ON contains(' ' || name || ' ', ' ' || query || ' ')), a AS (SELECT query, name FROM q JOIN k ON list_has_all(w, t) WHERE query NOT IN (SELECT query FROM p))
  SELECT query, name, 'phrase' AS step FROM p UNION ALL SELECT query, name, 'all' FROM a"""))
def str28_indexed(spark, d):
    """Two words of every name, turned round, as queries: phrases, else names with both, from the stored index of names."""
    names = A.keywords(spark, d).select("name").distinct().select(F.col("name").alias("id"), F.split("name", " ").alias("toks"))
    I, path = _text_index(spark, names)
    q = names.select(F.concat_ws(" ", F.col("toks")[1], F.col("toks")[0]).alias("query"), F.array(F.col("toks")[1], F.col("toks")[0]).alias("terms")).distinct()
    return I.cascade(spark, path, q).select("query", F.col("id").alias("name"), "step")


@query("vec04_hybrid_search", oracle("vecs", f"""WITH {_BM25}, sim AS MATERIALIZED ({SIM}), rs AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS r FROM sim), rl AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM bm)
  SELECT id, round(coalesce(1 / (60 + rs.r), 0) + coalesce(1 / (60 + rl.r), 0), 6) AS score, round(sim, 6) AS sim FROM rs FULL JOIN rl USING (id) JOIN sim USING (id) WHERE sim >= 0.7 * (SELECT max(sim) FROM sim)"""))
def vec04(spark, d):
    v = A.vecs(spark, d)
    return V.hybrid_search(_lex(spark, d), v.where("id <> 0"), list(TERMS), query_vector(v, 0), 0.7)


@query("vec05_blended", oracle("vecs", f"SELECT a.id, round(0.7 * ({_COS}) + 0.3 * list_dot_product(list_slice(a.v, 1, 16), list_slice(b.v, 1, 16)) / (sqrt(list_dot_product(list_slice(a.v, 1, 16), list_slice(a.v, 1, 16))) * sqrt(list_dot_product(list_slice(b.v, 1, 16), list_slice(b.v, 1, 16)))), 6) AS sim FROM vecs a, (SELECT * FROM vecs WHERE id = 0) b WHERE a.id <> 0"))
def vec05(spark, d):
    v = A.vecs(spark, d)
    q = query_vector(v, 0)
    return V.blended(v.where("id <> 0").select("id", "v", F.slice("v", 1, 16).alias("g")), {"v": q, "g": q[:16]})


@query("vec05_pairwise", oracle("vecs", "WITH u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v, list_transform(v[1:16], lambda x: x / sqrt(list_dot_product(v[1:16], v[1:16]))) AS g FROM vecs WHERE id % 4 = 0) SELECT a.id AS a, b.id AS b, CASE WHEN a.id = b.id THEN 1.0 ELSE round(0.7 * list_dot_product(a.v, b.v) + 0.3 * list_dot_product(a.g, b.g), 6) END AS sim FROM u a JOIN u b ON a.id <= b.id"))
def vec05_pairs(spark, d):
    """All pairs of a stated set, every fourth researcher."""
    v = A.vecs(spark, d).where("id % 4 = 0")
    return V.pairwise(v.select("id", "v", F.slice("v", 1, 16).alias("g"))).withColumn("sim", F.round("sim", 6))


@query("vec06_field_affinity", oracle("vecs", "SELECT a.id, round(list_dot_product(a.v, b.v), 4) AS affinity FROM vecs a, (SELECT * FROM vecs WHERE id = 1) b"))
def vec06(spark, d):
    v = A.vecs(spark, d)
    q = F.array(*[F.lit(x) for x in query_vector(v, 1)])
    return v.select("id", F.round(V.dot(F.col("v"), q), 4).alias("affinity"))


@query("vec07_agglomerative")
def vec07(spark, d):
    return C.agglomerative(A.vecs(spark, d).select((F.col("id") % 25).alias("g"), "id", "v"), 0.6)


@query("vec08_graph_means")
def vec08(spark, d):
    from ..operators.joins import undirected_edges

    v = A.vecs(spark, d).select("id", "v")
    known = A.links(spark, d).join(v.select(F.col("id").alias("rid")), "rid", "left_semi")  # who has no vector adds to nobody's mean
    return C.neighbour_means(v, undirected_edges(known), hops=2).select("id", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


@query("vec08_graph_embedding")
def vec08_trained(spark, d):
    """The trained embedding: neighbourhoods of 25 and 10 drawn by seed, two epochs."""
    from ..operators import graph_embedding as E
    from ..operators.joins import undirected_edges

    out, _ = E.train(A.vecs(spark, d).select("id", "v"), undirected_edges(A.links(spark, d)), E.Config(hidden=32, size=16, epochs=2, steps=2))
    return out.select("id", F.transform("v", lambda x: F.round(x, 4)).alias("v"))


@query("vec09_pca")
def vec09(spark, d):
    return C.reduced(A.vecs(spark, d).select("id", "v"), 16)


@query("vec10_translation_pairs", oracle("related vecs keywords", f"""WITH k AS (SELECT name, row_number() OVER (ORDER BY name) AS id, CASE WHEN min(paper_id) % 2 = 0 THEN 'ko' ELSE 'en' END AS lang FROM keywords GROUP BY 1), e AS (SELECT r.k1, r.k2, round({_COS}, 9) AS s FROM related r JOIN k ka ON ka.name = r.k1 JOIN k kb ON kb.name = r.k2 JOIN vecs a ON a.id = ka.id JOIN vecs b ON b.id = kb.id WHERE ka.lang <> kb.lang)
  SELECT k1, k2 FROM e WHERE s >= 0.2"""))
def vec10(spark, d):
    from ..operators.windows import global_rank

    k = A.keywords(spark, d).groupBy("name").agg(F.min("paper_id").alias("p"))
    k = global_rank(k, [F.col("name")], "id", k.count()).select("name", "id", F.when(F.col("p") % 2 == 0, "ko").otherwise("en").alias("lang"))
    return C.translation_pairs(A.related(spark, d), k.join(A.vecs(spark, d), "id").select("name", "lang", "v"), 0.2)


@query("vec11_weighted_text", "SELECT doc_id, len(t) AS n FROM (SELECT doc_id, list_filter(string_split_regex(lower(source || ' ' || source || ' ' || text || ' ' || lang), '[ \\n\\t\\r]+'), lambda x: x <> '') AS t FROM documents)")
def vec11(spark, d):
    return A.docs(spark, d).select("doc_id", F.size(bm25_text(F.col("source"), F.col("text"), F.col("lang"))).cast("long").alias("n"))


@query("vec11_passage_text", "SELECT doc_id, 'passage: ' || CASE WHEN source IS NULL OR source = '' THEN '' ELSE source || ' ' || source || ' ' END || text || ' ' || lang || ' ' || doc_id AS passage, 'query: ' || lang AS query FROM documents WHERE text <> ''")
def vec11_passage(spark, d):
    docs = A.docs(spark, d).where("text <> ''")
    p = V.passage_text(F.col("source"), F.col("text"), F.array(F.col("lang"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", p.alias("passage"), V.query_text(F.col("lang")).alias("query"))


@query("vec12_similarity_diagnostics", oracle("vecs keywords", f"""WITH t AS (SELECT paper_id AS id, name FROM keywords WHERE paper_id IN (SELECT id FROM vecs)), p AS (SELECT x.id AS i, y.id AS j, count(*) AS n FROM t x JOIN t y ON x.name = y.name AND x.id < y.id GROUP BY 1, 2)
  SELECT least(3, n) AS shared, count(*) AS n, round(avg({_COS}), 6) AS mean FROM p JOIN vecs a ON a.id = i JOIN vecs b ON b.id = j GROUP BY 1"""))
def vec12(spark, d):
    return C.similarity_diagnostics(A.vecs(spark, d).select("id", "v"), A.keywords(spark, d).select(F.col("paper_id").alias("id"), "name"), 3)


@query("srt09_bm25_top", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, id LIMIT 20")
def srt09(spark, d):
    x = V.bm25(_lex(spark, d), list(TERMS)).withColumn("s", F.round("score", 9))
    return x.orderBy(F.col("s").desc(), "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query("srt10_vector_top", oracle("vecs", f"SELECT id, round(sim, 6) AS sim FROM ({SIM}) ORDER BY sim DESC, id LIMIT 20"))
def srt10(spark, d):
    v = A.vecs(spark, d)
    x = V.query_similarity(v.where("id <> 0"), query_vector(v, 0)).withColumn("sim", F.round("sim", 9))
    return x.orderBy(F.col("sim").desc(), "id").limit(20).select("id", F.round("sim", 6).alias("sim"))


