"""What the operators of this subpackage share."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators of words: these bytes become spaces, so that bytes.split() yields the words.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cases A-Z and blanks every ASCII byte that is not a letter or digit; bytes from 0x80 on stay.
ALNUM_TABLE = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
LITTLE = 24 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader, so that any store will do.

    Documents of less than LITTLE bytes (they may lie in one row group) are dealt out to all cores; more stay where they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents" and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < LITTLE:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session names none, a local session
    gets a folder of its own, and any other an error, because its executors would not see the driver's folders."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or _OWN.get(sc.applicationId)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: start the session with it, naming a folder that driver and executors share")
        d = _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="lectern-")
    return d.rstrip("/")


_WRITTEN: list[str] = []


def written() -> int:
    """How many tables stage() has written in this process and not deleted; for cleanup(since=)."""
    return len(_WRITTEN)


def cleanup(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables that stage() wrote after the first `since`, but for the last `keep`; results that still read them
    must be written first."""
    jvm, n = spark.sparkContext._jvm, 0
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def let(value, body):
    """body(value) with value evaluated once, also where body uses it inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with Arrow batches of at most `rows` rows for its session: texts are long, so 10,000 of them are too much for one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, run, more: str = "", rows: int = 1000) -> DataFrame:
    """df.mapInArrow(run) for run that passes df's columns on and adds those of the schema `more`; any column names will do.

    In run the columns are named by their places, "0" and so on; the new ones follow."""
    new = T.StructType.fromDDL(more) if more else T.StructType()
    fields = [*df.schema.fields, *new.fields]
    plain = T.StructType([T.StructField(str(i), f.dataType, True) for i, f in enumerate(fields)])
    return small_batches(df.toDF(*map(str, range(len(df.columns)))), rows).mapInArrow(run, plain).toDF(*[f.name for f in fields])


def batch_of(columns) -> "pa.RecordBatch":
    """A batch for map_rows."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(columns, names=list(map(str, range(len(columns)))))


def col(name: str):
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def prefix(values, zero, op, chunk: int = 128):
    """For an array, the array of op over all earlier items (zero for the first). Chunks keep the copying near linear."""

    def of_values(v):
        last = F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / chunk).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(v, c * chunk + 1, F.lit(chunk)))
        return F.when(F.size(v) > 0, let(chunks, of_chunks)).otherwise(F.array().cast("array<bigint>"))

    def of_chunks(parts):
        return let(F.transform(parts, lambda p: F.aggregate(p, zero, op)), lambda totals: F.flatten(F.transform(parts, lambda p, c: one(p, c, totals))))

    def one(part, c, totals):
        start = F.struct(F.aggregate(F.slice(totals, F.lit(1), c), zero, op).alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    return let(values, of_values)
