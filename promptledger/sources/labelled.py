"""Labelled and golden prompt files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S

LABELLED_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType(), True),
    T.StructField("tier", T.IntegerType(), True),
    T.StructField("domain", T.StringType(), True),
])

GOLDEN_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType(), True),
    T.StructField("expected_tier", T.IntegerType(), True),
])


def read_labelled(spark: SparkSession, path: str, min_rows: int = S.MIN_LABELLED_ROWS,
                  check: bool = True) -> DataFrame:
    """CSV with a header, quoted fields with commas / newlines; requires
    ``prompt`` and ``tier`` and at least ``min_rows`` rows.

    Columns are taken by name, in any order; a missing ``domain`` is null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = {"prompt", "tier"} - set(raw.columns)
    if missing:
        raise ValueError(f"labelled data lacks columns {sorted(missing)}")
    df = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in LABELLED_SCHEMA.fields])
    if check:
        n = df.count()
        if n < min_rows:
            raise ValueError(f"only {n} labelled rows, need at least {min_rows}")
    return df


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``{prompt, expected_tier}`` objects."""
    return spark.read.option("multiLine", True).schema(GOLDEN_SCHEMA).json(path).select(
        "prompt", F.col("expected_tier").alias("label"))
