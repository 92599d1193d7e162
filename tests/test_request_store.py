"""Keyed append (K1, Q2) and the newest rows of a stored log (A5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from promptledger.operators import request_store as rs

T0 = dt.datetime(2024, 3, 1)
KIND = "id long, ts timestamp, day date, model string"


def _rows(spark, ids, model="m", every=dt.timedelta(minutes=20)):
    out = [(i, T0 + every * i, (T0 + every * i).date(), model) for i in ids]
    return spark.createDataFrame(out, KIND)


def _ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).select("id").collect())


def test_a_replay_adds_no_row_and_the_first_row_stays(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    first = _rows(spark, range(300)).unionByName(_rows(spark, range(50)))  # 50 ids twice in one batch
    assert rs.append_once(first, path).count() == 300
    assert rs.append_once(first, path).count() == 0
    assert rs.append_once(_rows(spark, range(200, 500), model="other"), path).count() == 200
    assert _ids(spark, path) == list(range(500))
    assert spark.read.parquet(path).where("model = 'other'").agg(F.min("id")).first()[0] == 300


def test_a_job_that_ended_between_filters_and_rows_is_run_again(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    rs.append_once(_rows(spark, range(100)), path)
    lost = _rows(spark, range(100, 160))
    rs.filters(lost).write.mode("append").partitionBy("day").parquet(rs.ids_path(path))
    assert rs.append_once(lost, path).count() == 60
    assert _ids(spark, path) == list(range(160))


def test_filters_let_no_known_id_pass_and_few_others(spark, tmp_dir):
    known = spark.range(200_000).select("id", F.lit(dt.date(2024, 3, 1)).alias("day"))
    f = rs.filters(known)
    assert rs.maybe_known(known, f).count() == 200_000
    other = spark.range(200_000, 400_000).select("id", F.lit(dt.date(2024, 3, 1)).alias("day"))
    assert rs.maybe_known(other, f).count() < 2_000
    assert rs.maybe_known(other.withColumn("day", F.lit(dt.date(2024, 3, 2))), f).count() == 0


def test_only_days_of_the_batch_are_read(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    rs.append_once(_rows(spark, range(600)), path)
    days = rs.days_of(spark, path)
    assert len(days) == 9 and days == sorted(days, reverse=True)
    # folders of other days are broken: a job that opened them would fail
    for d in days[1:]:
        spark.createDataFrame([("x",)], "id string").write.mode("overwrite").parquet(f"{path}/day={d}")
        spark.createDataFrame([("x",)], "bucket string").write.mode("overwrite").parquet(f"{rs.ids_path(path)}/day={d}")
    last = _rows(spark, range(590, 640))
    assert rs.append_once(last.where(F.col("day") == F.lit(days[0]).cast("date")), path).count() == 40
    files = rs.newest_rows(spark, path, 5).inputFiles()
    assert files and all(f"day={days[0]}" in f for f in files)


def test_null_ids_and_other_buckets_are_refused(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    with pytest.raises(ValueError, match="no id"):
        rs.append_once(spark.createDataFrame([(None, T0, T0.date(), "m")], KIND), path)
    rs.append_once(_rows(spark, range(10)), path)
    with pytest.raises(ValueError, match="buckets"):
        rs.append_once(_rows(spark, range(10)), path, buckets=64)


def test_compacted_filters_answer_alike(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    for k in range(4):
        rs.append_once(_rows(spark, range(k * 30, k * 30 + 60)), path)
    days = rs.days_of(spark, rs.ids_path(path))
    rs.compact_filters(spark, path, days)
    f = spark.read.parquet(rs.ids_path(path))
    assert f.count() == f.select("day", "bucket").distinct().count()
    assert rs.append_once(_rows(spark, range(150)), path).count() == 0


@pytest.mark.parametrize("limit", [1, 50, 73, 400, 10_000])
def test_newest_rows_equal_a_full_sort(spark, tmp_dir, limit):
    path = f"{tmp_dir}/log"
    rows = _rows(spark, range(300)).where("id < 72 or id > 230")  # days without rows in between
    ties = spark.createDataFrame([(1000 + i, T0 + dt.timedelta(days=4), (T0 + dt.timedelta(days=4)).date(), "t") for i in range(5)]
                                 + [(2000, None, None, "n")], KIND)
    rs.append_once(rows.unionByName(ties), path)
    whole = spark.read.parquet(path).orderBy(F.desc_nulls_last("ts"), F.desc("id")).limit(limit)
    got = rs.newest_rows(spark, path, limit)
    assert [r.id for r in got.collect()] == [r.id for r in whole.collect()]
    if limit <= 50:
        assert len(got.inputFiles()) < len(spark.read.parquet(path).inputFiles())


def test_newest_of_an_empty_log(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    rs.append_once(_rows(spark, range(3)).where("id < 0"), path)
    if rs._exists(spark, path) and rs.days_of(spark, path):
        raise AssertionError("an empty batch made a day")
