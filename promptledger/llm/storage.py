"""Intermediate tables and files in the shared folder of ``spark.checkpoint.dir``.

Tables written here cut lineage: a lost executor costs the tasks after the
table, not the ones before it.  Files are written and read with ``pyarrow.fs``
by URI, under a name of their own per attempt and then moved into place, so a
repeated or speculative task leaves the same file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.session import state_path

# A broadcast is asked for only below this many rows of a counted table.
BROADCAST_ROWS = 200_000
MAX_BUCKETS = 100_000  # Spark's own limit of a bucketed table


BATCH_BYTES = 2_000_000  # of an Arrow batch that a Python worker gets from ``bounded_batches``
MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside give their shuffle files back when they end: a written table needs none of them."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers of queries run inside get Arrow batches of about ``BATCH_BYTES``, not up to 64 MB on either side (a longer row is one)."""
    before = spark.conf.get(MOST_BYTES)
    spark.conf.set(MOST_BYTES, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(MOST_BYTES, before)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder (at ``path`` if given) and read back."""
    path = path or state_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared storage that no table in use is read from."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, n: int, column: str, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as a table (at ``path`` if given) with ``n`` buckets by ``column``: grouping by it moves no rows."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    with shuffles_freed(spark):
        df.write.bucketBy(min(n, MAX_BUCKETS), column).sortBy(column).option("path", path or state_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; paths without a scheme are local (``folder`` gives none)."""
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def in_place(files: fs.FileSystem, own: str, path: str) -> None:
    """Give a finished file its name; a file that an earlier attempt left there (with the same bytes) is replaced."""
    if files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_file(path)
    files.move(own, path)


def put(uri: str, parts: list[bytes]) -> None:
    """Write ``parts`` as one file that appears whole or not at all."""
    files, path = open_fs(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    in_place(files, own, path)


def get(uri: str) -> bytes:
    files, path = open_fs(uri)
    with files.open_input_stream(path) as f:
        return f.read()


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder as a full URI: a path without a scheme is one of Spark's default file system, in tasks too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(state_path(spark, name))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows are few; else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id and text hash are in ``bad(doc_id, key)``; nulls match nulls."""
    bad = small(written(bad.select("doc_id", "key").distinct(), "rejected"))
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("b.key"))
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")
