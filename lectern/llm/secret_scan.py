"""Secret scans with an incremental ledger of blobs.

Every text is a blob named by its SHA-256. A blob is scanned once for each rule version: only (blob, version) pairs that
the ledger lacks are scanned, and findings are joined back to every row that holds the blob. The ledger is a Parquet table in a
folder (read_ledger, extend_ledger), partitioned by version; a rerun on old texts scans nothing. All of it is Spark SQL.

A finding is a stretch in code points, end exclusive; its places in bytes stand beside, so that pieces are cut without
counting through the text. Base kinds are assign, access and hex; jwt, github and pem are additional. Matches of a kind are
leftmost and do not overlap; those that are too short are dropped after matching.

Defined results: a null text is scanned as an empty one and has no findings; a very long text is scanned whole, and its findings are added up
in chunks; findings of several kinds at one place stand in the order of the kinds; repeated rows share one scan and each get a
row; an empty table gives no rows; an empty ledger means that all is scanned. Only id and text are read; redact keeps all
columns, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, free_name, let, prefix, stage, table

VERSION = "3"
#: kind, pattern, group whose length counts (0: the match), least length, and a cheap test that a text must pass.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, r"(?i)passw|secret|token|api_?key"),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, None),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, "eyJ"),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh[pousr]_"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20, "PRIVATE KEY-----"),
)
KINDS = tuple(r[0] for r in RULES)
BASE = KINDS[:3]
_SPAN = "array<struct<start:int,rank:int,end:int,first:int,last:int>>"
LEDGER = f"blob binary, version string, spans {_SPAN}"


def _spans(text: Column, rank: int) -> Column:
    """The matches of a rule: what split() leaves between matches and the matches themselves add up to the places."""
    kind, pattern, group, least, first = RULES[rank]

    def of(parts):
        ends = prefix(F.transform(parts, lambda r: (r["gap"] + r["hit"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        bytes_ = prefix(F.transform(parts, lambda r: (r["gapb"] + r["hitb"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

        def place(r, at):
            start, begin = (at["c"] + r["gap"]).cast("int"), (at["b"] + r["gapb"]).cast("int")
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + r["hit"]).alias("end"), begin.alias("first"), (begin + r["hitb"]).alias("last"), r["size"].alias("size"))

        all_ = F.zip_with(parts, F.arrays_zip(ends.alias("c"), bytes_.alias("b")), place)
        kept = F.filter(all_, lambda x: x["size"] >= least)
        return F.transform(kept, lambda x: F.struct(*[x[k].alias(k) for k in ("start", "rank", "end", "first", "last")]))

    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), sizes.alias("size"))
    # The last gap has no match behind it.
    parts = F.transform(F.filter(rows, lambda r: r["hit"].isNotNull()), lambda r: F.struct(
        F.length(r["gap"]).alias("gap"), F.length(r["hit"]).alias("hit"), F.octet_length(r["gap"]).alias("gapb"), F.octet_length(r["hit"]).alias("hitb"), F.length(r["size"]).alias("size")))
    return F.when(text.rlike(first or pattern), let(parts, of)).otherwise(F.array()).cast(_SPAN)


def scan(blobs: DataFrame, version: str = VERSION) -> DataFrame:
    """blob, version and spans (start, rank of the kind, end; sorted) of rows blob and text."""
    spans = F.array_sort(F.concat(*[_spans(F.col("text"), k) for k in range(len(RULES))]))
    return blobs.select("blob", F.lit(version).alias("version"), spans.alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in a folder; an empty one where nothing has been written yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def extend_ledger(fresh: DataFrame, path: str) -> None:
    """Append the rows that find_secrets or update_ledger gave; readers see whole commits only."""
    fresh.select("blob", "spans", "version").write.mode("append").partitionBy("version").parquet(path)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", version: str = VERSION) -> DataFrame:
    """The ledger's new rows: each blob of docs that it lacks under this version, scanned once."""
    named = docs.select(F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    if ledger is not None:
        named = named.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    return scan(named.groupBy("blob").agg(F.first("text").alias("text")), version)


def _known(fresh: DataFrame, ledger: DataFrame | None, version: str) -> DataFrame:
    """blob and spans of all blobs with findings. Two runs at once may both have written a blob: one of its rows counts."""
    if ledger is not None:
        fresh = fresh.unionByName(ledger.where(F.col("version") == version).dropDuplicates(["blob"]))
    return fresh.where(F.size("spans") > 0).select("blob", "spans")


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """(id, blob, spans) for every row of docs, and the ledger's new rows."""
    fresh = stage(update_ledger(docs, ledger, text_col, version))
    paths = docs.select(col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(col(text_col), F.lit("")), 256)).alias("blob"))
    out = paths.join(_known(fresh, ledger, version), "blob", "left")
    return out.select("id", "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans")), fresh


def _text_of(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, mark: str = "[secret]", version: str = VERSION) -> DataFrame:
    """docs with each finding's characters replaced by a mark; findings that overlap or touch in text get one for each stretch."""
    key, spans = free_name(docs, "blob"), free_name(docs, "spans")
    fresh = stage(update_ledger(docs, ledger, text_col, version))
    found = _known(fresh, ledger, version).toDF(key, spans)
    t = col(text_col)
    joined = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(t, F.lit("")), 256))).join(found, key, "left")
    raw = t.cast("binary")

    def of(s):
        # Up to where the text is dealt with before each finding; one that starts before that lengthens the last stretch.
        tops = prefix(F.transform(s, lambda x: x["last"].cast("long")), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
        pieces = F.zip_with(s, tops, lambda x, top: F.when((x["first"] < top) & (top > 0), F.lit("")).otherwise(
            F.concat(F.substring(raw, (top + 1).cast("int"), (x["first"] - top).cast("int")).cast("string"), F.lit(mark))))
        end = F.array_max(F.transform(s, lambda x: x["last"]))
        return F.concat(F.array_join(pieces, ""), F.substring(raw, end + 1, F.octet_length(t)).cast("string"))

    new = F.when(F.col(spans).isNull(), t).otherwise(let(F.col(spans), of))
    return joined.select(*[(new if c == text_col else col(c)).alias(c) for c in docs.columns])


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found, _ = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    n = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(F.col("id").alias("doc_id"), n(0), n(1), n(2), F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))


def _sql() -> str:
    """DuckDB SQL: the same places from the pieces between matches."""
    parts = []
    for rank, (kind, pattern, group, least, _) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, ends[i] - lens[i] AS s, ends[i] AS e FROM (
    SELECT doc_id, lens, sizes, list_transform(range(1, len(lens) + 1), lambda i: CAST(list_sum(list_slice(gaps, 1, i)) + list_sum(list_slice(lens, 1, i)) AS BIGINT)) AS ends, unnest(range(1, len(lens) + 1)) AS i FROM (
      SELECT doc_id, list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x)) AS gaps,
        list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS lens,
        list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: length(x)) AS sizes
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{p}'))) WHERE sizes[i] >= {least}""")
    base = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    names = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)
    return f"""
WITH f AS MATERIALIZED ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {base},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
