"""Queries of stateful behaviour and of the registered functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import oracle
from ..functions.register import register
from ..operators.dates import local_day
from ..streaming import state as S
from .catalog import query


def _starts(rows: str, keys: str, seconds: int) -> str:
    """SQL for the window starts of rows with ts: recursion from each key's first hit to the first one `seconds` or more later."""
    on = " AND ".join(f"e.{k} IS NOT DISTINCT FROM r.{k}" for k in keys.split(", "))
    return f"st AS (SELECT {keys}, min(ts) AS s FROM {rows} GROUP BY ALL UNION ALL SELECT {', '.join('r.' + k for k in keys.split(', '))}, min(e.ts) FROM st r JOIN {rows} e ON {on} AND e.ts >= r.s + INTERVAL {seconds} SECOND GROUP BY {', '.join('r.' + k for k in keys.split(', '))}, r.s)"


@query("stm01_rate_limit", f"""WITH RECURSIVE {_starts("events", "user_id", 86_400)}, x AS (SELECT e.user_id, event_id, ts, s FROM events e ASOF JOIN st ON e.user_id = st.user_id AND e.ts >= st.s),
  n AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS INT) AS n FROM x) SELECT user_id, event_id, n, n <= 2 AS allowed, round((epoch_us(s) + 86400000000 - epoch_us(ts)) / 1000000, 3) AS left FROM n""")
def stm01(spark, d):
    return S.fixed_windows(A.read(spark, d, "events"), "user_id", "ts", "event_id", 86_400, 2).select("user_id", "event_id", "n", "allowed", F.round("left", 3).alias("left"))


@query("stm02_usage_quota", """SELECT event_id, least(b, 3) AS used, b < 3 AS allowed FROM (SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM events)""")
def stm02(spark, d):
    e = A.read(spark, d, "events").withColumn("session", F.to_date("ts"))
    return S.quota(e, "user_id", "session", ["ts", "event_id"], 3, F.col("event_type") == "error").select("event_id", "used", "allowed")


_USES = "u AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, ts, event_id % 3 = 0 AS opens, event_type = 'error' AS failed, CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS c FROM events)"


@query("stm02_usage_limits", f"""WITH RECURSIVE {_USES}, {_starts("u", "user_id, c, opens", 172_800)}, x AS (SELECT u.*, st.s FROM u JOIN st ON u.user_id = st.user_id AND u.opens = st.opens AND u.c IS NOT DISTINCT FROM st.c AND u.ts >= st.s AND u.ts < st.s + INTERVAL 172800 SECOND),
  b AS (SELECT *, CASE WHEN opens THEN 2 ELSE 3 END AS most, coalesce(sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, c, opens, s ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x)
  SELECT event_id, opens, CAST(least(b + 1, most) AS INT) AS used, b < most AS allowed, CAST(most - least(b + 1, most) AS INT) AS left FROM b""")
def stm02_limits(spark, d):
    e = A.read(spark, d, "events").withColumn("day", F.to_date("ts"))
    x = S.usage_limits(e, "user_id", "day", "ts", "event_id", F.col("event_id") % 3 == 0, F.col("event_type") == "error", 172_800, 2, 3)
    return x.select("event_id", "opens", "used", "allowed", "left")


@query("stm03_verification_codes", """WITH c AS (SELECT *, event_type = 'signup' AS issued, event_type = 'purchase' AS ok, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS code FROM events),
  l AS (SELECT *, NOT issued AND coalesce(ts - max(CASE WHEN issued THEN ts END) OVER (PARTITION BY user_id, code) < INTERVAL 20 DAY, false) AS live FROM c),
  b AS (SELECT *, coalesce(sum(CASE WHEN live AND ok THEN 1 ELSE 0 END) OVER w, 0) AS oks, coalesce(sum(CASE WHEN live AND NOT ok THEN 1 ELSE 0 END) OVER w, 0) AS fails FROM l WINDOW w AS (PARTITION BY user_id, code ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT user_id, event_id, CASE WHEN NOT live OR oks > 0 OR fails >= 3 THEN 'expired' WHEN ok THEN 'verified' WHEN fails + 1 >= 3 THEN 'blocked' ELSE 'wrong' END AS verdict FROM b WHERE NOT issued""")
def stm03(spark, d):
    return S.verifications(A.read(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase", 20 * 86_400, 3)


@query("stm05_cache_hits", f"WITH RECURSIVE {_starts('events', 'user_id', 86_400)}, x AS (SELECT e.user_id, event_id, ts, s FROM events e ASOF JOIN st ON e.user_id = st.user_id AND e.ts >= st.s) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) > 1 AS hit FROM x")
def stm05(spark, d):
    return S.cached(A.read(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", ["event_id"], 86_400).select("user_id", "event_id", "hit")


@query("stm04_negative_cache", f"WITH RECURSIVE f AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), {_starts('f', 'user_id', 86_400)} SELECT user_id, s AS tried FROM st")
def stm04(spark, d):
    return S.negative_cache(A.read(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", 86_400)


@query("stm07_daily_budget", "SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, CAST(row_number() OVER (PARTITION BY CAST(ts + INTERVAL 9 HOUR AS DATE) ORDER BY ts, event_id) AS INT) AS n, row_number() OVER (PARTITION BY CAST(ts + INTERVAL 9 HOUR AS DATE) ORDER BY ts, event_id) <= 100 AS allowed FROM events")
def stm07(spark, d):
    return S.daily_budget(A.read(spark, d, "events"), local_day(F.col("ts")), ["ts", "event_id"], 100).select("event_id", "day", "n", "allowed")


@query("udf01_sql_functions", oracle("papers", """SELECT id, '10.' || id || '/a' AS doi, pubyear AS year, CASE WHEN id >= 10000000 AND id < 100000000 THEN substr(CAST(id AS VARCHAR), 1, 4) || '-' || substr(CAST(id AS VARCHAR), 5, 4) END AS issn, 'en:' || lower(title) AS key, len(string_split(title, ' ')) AS words FROM papers"""))
def udf01_sql(spark, d):
    register(spark)
    return spark.sql("""SELECT id, bare_doi(' HTTPS://doi.org/10.' || id || '/a ') AS doi, first_year(pubdate_of) AS year, hyphenated_issn(CAST(id AS STRING)) AS issn, keyword_key('  ' || title || ' ', 'en') AS key, size(lexical_tokens(title)) AS words
      FROM (SELECT *, 'c' || pubyear AS pubdate_of FROM {papers})""", papers=A.papers(spark, d))


@query("udf01_registered_functions")
def udf01(spark, d):
    register(spark)
    A.researchers(spark, d).createOrReplaceTempView("lectern_researchers")
    return spark.sql("SELECT r.rid, clean_term(r.name) AS term, title_similarity(r.institution, 'Brand#1') AS ratio, t.lang, t.term AS part FROM lectern_researchers r, LATERAL split_terms(concat(r.name, '; ', r.dept)) t")
