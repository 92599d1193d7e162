"""The stored request log with its primary key, and its newest rows (K1, Q2, A5).

``append_once`` is an append that may be repeated.  The key of a row is its id
within its day (a replayed request carries the time it was made at).  Beside the
log, ``<path>_ids`` keeps Bloom filters: per day and bucket of ids one bitmap of
32,768 bits, written by every append.  An append

1. takes one row per key of the batch and cuts it from its lineage (a table in
   ``spark.checkpoint.dir``), so a retried task appends the same rows;
2. looks its keys up in the filters of the batch's days.  Most new ids miss and
   need nothing else;
3. compares the hits exactly with the ids of those days in the log, by an anti
   join that reads the day folders of the batch only;
4. writes filters first and rows second.  A job that ends between the two is
   run again: its ids hit, are not found in the log, and are appended then.

One writer at a time is assumed, as for any Parquet folder.

``newest_rows`` walks the day folders from the newest one back, a growing group
of days at a time, until it has counted enough rows (from Parquet footers), and
sorts only the rows of those days.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import state_path
from . import sinks

BITS = 32_768        # of one bitmap: what bitmap_construct_agg makes
PROBES = 3           # positions of an id
BUCKETS = 256        # bitmaps of a day: about 3 million ids at one false hit in a hundred
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def ids_path(path: str) -> str:
    return path.rstrip("/") + "_ids"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(buckets)).cast("int")


def _places(key: Column) -> Column:
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(BITS)) for i in range(PROBES)))


def filters(rows: DataFrame, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """day, bucket, buckets, bits: the Bloom filters of ``rows``; partial bitmaps are merged, hot days included."""
    at = rows.select("day", _bucket(F.col(key), buckets).alias("bucket"), F.explode(_places(F.col(key))).alias("place"))
    return (at.groupBy("day", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
            .withColumn("buckets", F.lit(buckets)).select("bucket", "buckets", "bits", "day"))


def _set(bits: Column, place: Column) -> Column:
    """Whether the bit at ``place`` is set: its byte, as two hex digits, shifted."""
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def maybe_known(rows: DataFrame, known: DataFrame, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """The distinct (day, key) of ``rows`` that the filters do not rule out."""
    asked = rows.select("day", key, _bucket(F.col(key), buckets).alias("bucket"), _places(F.col(key)).alias("places"))
    merged = known.groupBy("day", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = asked.join(merged, ["day", "bucket"])
    every = reduce(Column.__and__, (_set(F.col("bits"), F.col("places")[i]) for i in range(PROBES)))
    return both.where(every).select("day", key).distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def days_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the day folders, newest first; one listing of the top folder, no file is opened."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = [m[1] for s in found if (m := re.fullmatch(r"day=(.+)", s.getPath().getName()))]
    return sorted((d for d in names if d != NO_DAY), reverse=True) + [d for d in names if d == NO_DAY]


def of_days(spark: SparkSession, path: str, days: list[str], schema=None) -> DataFrame:
    """The rows of some day folders, with the column ``day``; other folders are not listed."""
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema is not None else reader).parquet(*(f"{path.rstrip('/')}/day={d}" for d in days))


def _one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """Of several rows of one key in a batch, the least (so a repeated job takes the same one)."""
    others = [c for c in rows.columns if c not in ("day", key)]
    return (rows.groupBy("day", key).agg(F.min(F.struct(*others)).alias("__r"))
            .select(*(F.col(c) if c in ("day", key) else F.col(f"__r.{c}").alias(c) for c in rows.columns)))


def append_once(rows: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """Append the rows whose key is new to the day-partitioned log at ``path``; returns the appended rows.

    Rows with a null key cannot be told apart and are refused."""
    spark = rows.sparkSession
    staged_path = state_path(spark, "staged")
    _one_per_key(rows, key).write.parquet(staged_path)
    staged = spark.read.schema(rows.schema).parquet(staged_path)
    asked = staged.groupBy("day").agg(F.count_if(F.col(key).isNull()).alias("nulls")).collect()  # one row per day of the batch
    if any(r["nulls"] for r in asked):
        raise ValueError(f"a row of the batch has no {key}")
    wanted = {NO_DAY if r["day"] is None else r["day"].isoformat() for r in asked}
    new = staged
    if _exists(spark, ids_path(path)):
        stored = [d for d in days_of(spark, ids_path(path)) if d in wanted]
        if stored:
            known = of_days(spark, ids_path(path), stored)
            if known.where(F.col("buckets") != buckets).limit(1).count():
                raise ValueError(f"the filters of {path} have another number of buckets than {buckets}")
            hits = maybe_known(staged, known, key, buckets)
            in_log = [d for d in days_of(spark, path) if d in stored] if _exists(spark, path) else []
            if in_log:
                twice = of_days(spark, path, in_log).select("day", key).join(hits, ["day", key], "left_semi").distinct()
                fresh_path = state_path(spark, "fresh")
                staged.join(twice, ["day", key], "left_anti").select(*rows.columns).write.parquet(fresh_path)
                new = spark.read.schema(rows.schema).parquet(fresh_path)
    # few files per day folder; a day that is large is split over tasks
    filters(new, key, buckets).hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(ids_path(path))
    new.hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)
    return new


def append_requests_once(df: DataFrame, path: str) -> DataFrame:
    """K1 with the primary key: a batch that is appended again adds no row."""
    return append_once(sinks.request_rows(df), path)


def compact_filters(spark: SparkSession, path: str, days: list[str]) -> None:
    """One filter row per bucket for the given days, after many small appends; only their folders are rewritten."""
    known = of_days(spark, ids_path(path), days)
    merged_path = state_path(spark, "filters")
    known.groupBy("day", "bucket", "buckets").agg(F.bitmap_or_agg("bits").alias("bits")).write.parquet(merged_path)
    (spark.read.parquet(merged_path).select("bucket", "buckets", "bits", "day").repartition("day").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(ids_path(path)))


def newest_rows(spark: SparkSession, path: str, limit: int, at: str = "ts", key: str = "id") -> DataFrame:
    """A5: the newest ``limit`` rows of the stored log (ties by id), without opening older days.

    A row's day is that of its time, so all rows of a day are newer than those
    of the days before; rows without a time come last."""
    days = days_of(spark, path)
    taken, step, found = 0, 1, 0
    while taken < len(days) and found < limit:
        found += of_days(spark, path, days[taken: taken + step]).count()
        taken, step = taken + step, step * 2
    if not taken:
        return spark.read.parquet(path).limit(0)
    return of_days(spark, path, days[:taken]).orderBy(F.desc_nulls_last(at), F.desc(key)).limit(limit)
