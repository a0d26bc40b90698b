"""URL filtering by listed rules and, where none fits, by an empirical-Bayes reputation of the host.

A rule is a host with a path prefix; it fits the host and its subdomains, and the longest rule that fits wins. Pages that a rule decides
are labelled outcomes (1: block). A host's block rate has a beta prior around its registered domain's rate, that one
around its public suffix's, and that around the rate of all. Each level's prior strength is the beta-binomial moment
estimate over its groups. A page without a rule is blocked if the lower bound of its host's posterior (mean less Z standard
deviations) is above LINE.

The public suffix is the longest of `suffixes` (a parameter; SUFFIXES by default, two or three labels each) that ends the host, else its last label; the
registered domain has one label more. Ports are not part of either. A host that is an IP address is its own domain, and all
such hosts share the suffix `ip`.

All is DataFrame functions: outcomes are summed before any shuffle, hot hosts are joined as rows of a few bytes that AQE may split.
Defined results: a null url or one without `://` has an empty host and path, fits no rule and keeps the uniform prior, so it is allowed;
without labelled pages all is allowed; repeated rows count each; an empty table gives no
rows. Only id and url are read, so other columns may have any names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, col, stage, table

#: host, path prefix, verdict
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
Z, LINE = 1.645, 0.5
#: Common public suffixes of more than one label, as the public list of suffixes has them.
SUFFIXES = (
    "ac.at", "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "asn.au", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz",
    "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph",
    "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.br", "edu.cn", "edu.hk", "edu.mx", "edu.tr", "edu.tw",
    "go.jp", "go.kr", "gob.mx", "gouv.fr", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "gov.za", "govt.nz", "ltd.uk", "me.uk", "ne.jp", "net.au",
    "net.br", "net.cn", "net.in", "net.nz", "net.uk", "nhs.uk", "or.at", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.mx", "org.nz",
    "org.uk", "org.za", "plc.uk", "re.kr", "sch.uk")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, _PARTS, 1)), F.regexp_extract(u, _PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null where none does. rules: a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


_PORT, _IP = r":[0-9]*$", r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"


def domains(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host."""
    name = F.regexp_replace(host, _PORT, "")
    last = lambda n: F.substring_index(name, ".", -n)
    known = [n for n in (3, 2) if any(s.count(".") == n - 1 for s in suffixes)]
    dom, suf = last(2), last(1)
    for n in reversed(known):
        here = last(n).isin([s for s in suffixes if s.count(".") == n - 1])
        dom, suf = F.when(here, last(n + 1)).otherwise(dom), F.when(here, last(n)).otherwise(suf)
    ip = name.rlike(_IP)
    return F.when(ip, name).otherwise(dom), F.when(ip, F.lit("ip")).otherwise(suf)


def _strength(groups: DataFrame) -> Column:
    """Prior strength from rows n, y of groups, as one aggregate."""
    n, y = F.col("n").cast("double"), F.col("y").cast("double")
    N, g = F.sum(n), F.count("*")
    p = F.sum(y) / N
    s = F.sum(y * y / n) - N * p * p
    v = p * (1 - p)
    rho = (s - v * (g - 1)) / (v * (N - F.sum(n * n) / N - (g - 1)))
    return 1 / F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.coalesce(F.when((v > 0) & (N - F.sum(n * n) / N - (g - 1) > 0), rho), F.lit(0.001)))) - 1


def reputation(labelled: DataFrame, suffixes=SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """From rows host and y: hosts (host, rate, k), domains (dom, rate, k), suffixes (suf, rate, k), and the overall rate.

    rate and k: mean and strength of the posterior, the sum of both beta parameters."""
    hosts = stage(labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("y").alias("y")))
    dom, suf = domains(F.col("host"), suffixes)
    hosts = hosts.withColumn("dom", dom).withColumn("suf", suf)
    doms = stage(hosts.groupBy("dom", "suf").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    sufs = stage(doms.groupBy("suf").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    total = sufs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y"), _strength(sufs).alias("k")).first()
    rate = (total["y"] + 0.5) / (total["n"] + 1)
    k = {"suf": total["k"] or 0.0, "dom": doms.agg(_strength(doms).alias("k")).first()["k"] or 0.0, "host": hosts.agg(_strength(hosts).alias("k")).first()["k"] or 0.0}
    post = lambda up, s: (F.col("y") + s * up) / (F.col("n") + s)
    sufs = sufs.select("suf", post(F.lit(rate), k["suf"]).alias("rate"), (F.col("n") + k["suf"]).alias("k"))
    doms = doms.join(sufs.select("suf", F.col("rate").alias("up")), "suf").select("dom", post(F.col("up"), k["dom"]).alias("rate"), (F.col("n") + k["dom"]).alias("k"))
    hosts = hosts.join(doms.select("dom", F.col("rate").alias("up")), "dom").select("host", post(F.col("up"), k["host"]).alias("rate"), (F.col("n") + k["host"]).alias("k"))
    return stage(hosts), stage(doms), stage(sufs), {"rate": rate, **k}


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, suffixes=SUFFIXES, z: float = Z, line: float = LINE) -> DataFrame:
    """id, host, path, rule, verdict and the block rate (of the host's posterior) for every row."""
    host, path = parts(col(url_col))
    d = pages.select(col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": rule, "verdict": verdict})
    hosts, doms, sufs, top = reputation(d.where("rule IS NOT NULL").select("host", (F.col("verdict") == "block").cast("long").alias("y")), suffixes)
    # Only hosts, not pages, meet the three tables; a level without labels passes on the one above.
    dom, suf = domains(F.col("host"), suffixes)
    names = d.groupBy("host").count().select("host", dom.alias("dom"), suf.alias("suf"))
    names = names.join(hosts, "host", "left").join(doms.select("dom", F.col("rate").alias("dr")), "dom", "left").join(sufs.select("suf", F.col("rate").alias("sr")), "suf", "left")
    rate = F.coalesce("rate", "dr", "sr", F.lit(0.5))
    # A host without labels is as uncertain as the levels between it and the nearest one with labels are spread; without
    # labels at any level it keeps the uniform prior.
    k = F.coalesce("k", F.when(F.col("dr").isNotNull(), top["host"]).when(F.col("sr").isNotNull(), min(top["host"], top["dom"])).otherwise(2.0))
    bound = rate - z * F.sqrt(rate * (1 - rate) / (k + 1))
    names = stage(names.select("host", F.round(rate, 9).alias("rate"), F.when(bound > line, "block").otherwise("allow").alias("own")))
    return d.join(names, "host", "left").select("id", "host", "path", "rule", F.coalesce("verdict", "own").alias("verdict"), F.col("rate").alias("block_rate"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).withColumnRenamed("id", "page_id")


def _sql() -> str:
    label = lambda a, b: f"array_to_string(list_slice(string_split(name, '.'), -{a}, -{b}), '.')"
    listed = ", ".join(f"'{s}'" for s in SUFFIXES)
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in order]
    case = lambda i: "CASE " + " ".join(f"WHEN {f} THEN '{r[2] if i else r[0] + r[1]}'" for f, r in zip(fits, order)) + " END"
    k = """1 / least(0.999, greatest(0.001, coalesce(CASE WHEN sum(y) / sum(n) * (1 - sum(y) / sum(n)) > 0 AND sum(n) - sum(n * n) / sum(n) - (count(*) - 1) > 0 THEN
      (sum(y * y / n) - sum(y) * sum(y) / sum(n) - sum(y) / sum(n) * (1 - sum(y) / sum(n)) * (count(*) - 1))
      / (sum(y) / sum(n) * (1 - sum(y) / sum(n)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1))) END, 0.001))) - 1 AS k"""
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path FROM pages),
d AS MATERIALIZED (SELECT *, {case(0)} AS rule, {case(1)} AS verdict,
  CASE WHEN regexp_matches(name, '{_IP}') THEN name WHEN {label(2, 1)} IN ({listed}) THEN {label(3, 1)} ELSE {label(2, 1)} END AS dom,
  CASE WHEN regexp_matches(name, '{_IP}') THEN 'ip' WHEN {label(2, 1)} IN ({listed}) THEN {label(2, 1)} ELSE {label(1, 1)} END AS suf
  FROM (SELECT *, regexp_replace(host, '{_PORT}', '') AS name FROM u)),
h AS MATERIALIZED (SELECT host, dom, suf, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (verdict = 'block') AS DOUBLE) AS y FROM d WHERE rule IS NOT NULL GROUP BY ALL),
o AS MATERIALIZED (SELECT dom, suf, sum(n) AS n, sum(y) AS y FROM h GROUP BY ALL),
s AS MATERIALIZED (SELECT suf, sum(n) AS n, sum(y) AS y FROM o GROUP BY ALL),
t AS (SELECT (coalesce(sum(y), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS rate FROM s),
ks AS (SELECT {k} FROM s), ko AS (SELECT {k} FROM o), kh AS (SELECT {k} FROM h),
sr AS (SELECT suf, (y + k * rate) / (n + k) AS rate FROM s, ks, t),
dr AS (SELECT o.dom, (y + k * sr.rate) / (n + k) AS rate FROM o JOIN sr USING (suf), ko),
hr AS (SELECT h.host, (y + k * dr.rate) / (n + k) AS rate, n + k AS k FROM h JOIN dr USING (dom), kh),
p AS (SELECT d.*, coalesce(hr.rate, dr.rate, sr.rate, 0.5) AS r, coalesce(hr.k, CASE WHEN dr.rate IS NOT NULL THEN kh.k WHEN sr.rate IS NOT NULL THEN least(kh.k, ko.k) ELSE 2.0 END) AS kk
  FROM d LEFT JOIN hr USING (host) LEFT JOIN dr USING (dom) LEFT JOIN sr USING (suf), kh, ko)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN r - {Z} * sqrt(r * (1 - r) / (kk + 1)) > {LINE} THEN 'block' ELSE 'allow' END) AS verdict, round(r, 9) AS block_rate FROM p
"""


SQL = _sql()
