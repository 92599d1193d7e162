"""Bitmaps of consumed failures, compacted from the ledger (J9, W2, ST5).

The ledger stays append-only, one folder per run (``run_id=...``).  A version
of the bitmaps holds, per 32,768 ids, one bitmap of those consumed by the runs
that it names; a new version is the last one together with the runs that came
since.  It is written to a folder of its own, so a compaction that is cut short
is simply run again: a version counts once its folder is whole (its ``_SUCCESS``
file is there), and the same runs give the same bits.

The check for pending failures joins them with the bitmaps by range of ids, an
eighth of a byte per id of history, and with the rows of the runs that no
version names yet.  The ledger's history is neither read nor shuffled.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .request_store import _set

BITMAPS = "range long, bits binary"


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Values of the ``prefix=`` sub-folders of ``path`` (none if there is no such folder)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    return sorted(m[1] for s in files.listStatus(where) if (m := re.fullmatch(f"{prefix}=(.+)", s.getPath().getName())))


def _whole(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def consume(ids: DataFrame, ledger_path: str, run_id: str) -> None:
    """Mark the failures of ``ids(failure_id)`` as used by a run; a repeated call rewrites the same folder."""
    ids.select("failure_id").distinct().write.mode("overwrite").parquet(f"{ledger_path}/run_id={run_id}")


def _version(spark: SparkSession, bitmap_path: str) -> tuple[str | None, set[str]]:
    """Folder of the newest whole version and the runs that it holds."""
    for v in reversed(_folders(spark, bitmap_path, "version")):
        at = f"{bitmap_path}/version={v}"
        if _whole(spark, f"{at}/bits") and _whole(spark, f"{at}/runs"):
            return at, {r["run_id"] for r in spark.read.schema("run_id string").parquet(f"{at}/runs").collect()}
    return None, set()


def bitmaps(ids: DataFrame) -> DataFrame:
    """range, bits of the consumed ids."""
    return (ids.groupBy(F.bitmap_bucket_number("failure_id").alias("range"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("failure_id")).alias("bits")))


def _rows(spark: SparkSession, ledger_path: str, runs: list[str]) -> DataFrame:
    schema = "failure_id long"
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{ledger_path}/run_id={r}" for r in runs))


def compact(spark: SparkSession, ledger_path: str, bitmap_path: str) -> int:
    """Write a version with the runs that the last one lacks; returns how many these were."""
    last, held = _version(spark, bitmap_path)
    new = [r for r in _folders(spark, ledger_path, "run_id") if r not in held and _whole(spark, f"{ledger_path}/run_id={r}")]
    if not new:
        return 0
    bits = bitmaps(_rows(spark, ledger_path, new))
    if last:
        bits = bits.unionByName(spark.read.schema(BITMAPS).parquet(f"{last}/bits")).groupBy("range").agg(F.bitmap_or_agg("bits").alias("bits"))
    number = len(_folders(spark, bitmap_path, "version"))
    at = f"{bitmap_path}/version={number:08d}-{uuid.uuid4().hex[:8]}"
    bits.write.parquet(f"{at}/bits")
    spark.createDataFrame([(r,) for r in sorted(held | set(new))], "run_id string").coalesce(1).write.parquet(f"{at}/runs")
    return len(new)


def pending(failures: DataFrame, ledger_path: str, bitmap_path: str) -> DataFrame:
    """The failures that no run has consumed."""
    spark = failures.sparkSession
    last, held = _version(spark, bitmap_path)
    left = failures
    if last:
        known = spark.read.schema(BITMAPS).parquet(f"{last}/bits").withColumnsRenamed({"range": "__range", "bits": "__bits"})
        used = F.coalesce(_set(F.col("__bits"), F.bitmap_bit_position("id")), F.lit(False))
        left = left.join(known, F.bitmap_bucket_number("id") == F.col("__range"), "left").where(~used).select(*failures.columns)
    since = [r for r in _folders(spark, ledger_path, "run_id") if r not in held]
    if since:
        left = left.join(_rows(spark, ledger_path, since).select(F.col("failure_id").alias("id")), "id", "left_anti").select(*failures.columns)
    return left
