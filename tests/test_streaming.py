"""Structured Streaming jobs ST1-ST6 against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from promptledger import settings as S
from promptledger.operators import reports as rep
from promptledger.sources import config_tables as ct
from promptledger.sources import fixtures as fx
from promptledger.sources.tables import read_table
from promptledger.streaming import jobs as st


def _events(spark, tmp_dir, parts=3):
    ev = read_table(spark, SF_SMALL, "events", *fx.EVENT_COLUMNS)
    n = ev.count()
    for i in range(parts):
        ev.where((F.col("event_id") * parts / n).cast("int") == i).write.parquet(f"{tmp_dir}/in/p{i}")
    return ev.schema


def test_ingest_equals_batch(spark, tmp_dir):
    schema = _events(spark, tmp_dir)
    s = st.event_stream(spark, f"{tmp_dir}/in", schema, max_files=1)
    st.ingest(fx.requests_from_events(s), f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/out")
    want = fx.request_log(spark, SF_SMALL)
    assert got.count() == want.count()
    cols = ["id", "routed_model", "cost_usd", "cost_if_highest_quality", "decision"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    # replaying a file of already-seen ids adds nothing
    read_table(spark, SF_SMALL, "events", *fx.EVENT_COLUMNS).limit(20).write.parquet(f"{tmp_dir}/in/replay")
    st.ingest(fx.requests_from_events(st.event_stream(spark, f"{tmp_dir}/in", schema)), f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/out").count() == want.count()


def test_daily_cost_equals_batch_for_closed_days(spark, tmp_dir):
    schema = _events(spark, tmp_dir)
    req = fx.requests_from_events(st.event_stream(spark, f"{tmp_dir}/in", schema, max_files=1))
    st.daily_cost(req, f"{tmp_dir}/daily", f"{tmp_dir}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/daily")
    batch = rep.daily_cost(fx.request_log(spark, SF_SMALL))
    assert got.count() >= 1
    assert got.exceptAll(batch.select(*got.columns)).count() == 0   # every emitted day equals batch


def test_verdict_join_left_outer(spark, tmp_dir):
    t0 = dt.datetime(2024, 1, 1)
    reqs = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=10 * i), "small", 1.0) for i in range(20)],
                                 "id long, ts timestamp, routed_model string, cost_usd double")
    ver = spark.createDataFrame([(i, 4.0, t0 + dt.timedelta(minutes=10 * i + 5)) for i in range(0, 20, 2)],
                                "id long, quality_score double, verified_at timestamp")
    reqs.write.parquet(f"{tmp_dir}/r")
    ver.write.parquet(f"{tmp_dir}/v")
    rs = spark.readStream.schema(reqs.schema).parquet(f"{tmp_dir}/r")
    vs = spark.readStream.schema(ver.schema).parquet(f"{tmp_dir}/v")
    st.verdict_join(rs, vs, f"{tmp_dir}/j", f"{tmp_dir}/ck", lateness="0 seconds",
                    max_delay="30 minutes").awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/j")
    matched = out.where(F.col("quality_score").isNotNull()).count()
    assert matched == 10
    assert out.select("id").distinct().count() == out.count()


def test_rolling_alert(spark, tmp_dir):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), i >= 170) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, escalated boolean")
    for k in range(4):
        df.where((F.col("id") / 50).cast("int") == k).write.parquet(f"{tmp_dir}/in/b{k}")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{tmp_dir}/in")
    st.rolling_alert(s, f"{tmp_dir}/state", f"{tmp_dir}/alerts", f"{tmp_dir}/ck").awaitTermination()
    alerts = spark.read.parquet(f"{tmp_dir}/alerts").orderBy("epoch").collect()
    assert alerts[-1].n == 100 and alerts[-1].rate_pct == 30.0 and alerts[-1].status == "alert"
    assert spark.read.parquet(f"{tmp_dir}/state/latest").count() == 100


def test_hot_reload_next_batch(spark, tmp_dir):
    schema = _events(spark, tmp_dir, parts=2)
    settings_path = f"{tmp_dir}/settings"
    ct.routing_settings(spark).write.parquet(settings_path)
    s = st.event_stream(spark, f"{tmp_dir}/in/p0", schema)
    routed = lambda batch, settings: fx.requests_from_events(batch, settings=settings)
    st.hot_reload_routing(s, routed, settings_path, f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    new = dict(S.ROUTING, tier_3_model="mid")
    ct.routing_settings(spark, new).write.mode("overwrite").parquet(settings_path)
    s2 = st.event_stream(spark, f"{tmp_dir}/in", schema)
    st.hot_reload_routing(s2, routed, settings_path, f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/out")
    first = out.where("epoch = 0 AND complexity_tier = 3 AND NOT low_confidence")
    later = out.where("epoch > 0 AND complexity_tier = 3 AND NOT low_confidence")
    assert first.count() > 0 and later.count() > 0
    assert {r.routed_model for r in first.collect()} == {"large"}
    assert {r.routed_model for r in later.collect()} == {"mid"}


def test_incremental_export_once(spark, tmp_dir):
    f = fx.with_prompts(spark, SF_SMALL, fx.failure_log(spark, SF_SMALL), "request_id")
    f.write.parquet(f"{tmp_dir}/failures/b0")
    q = st.incremental_export(spark, f"{tmp_dir}/failures", f.schema, f"{tmp_dir}/exp", f"{tmp_dir}/ck")
    q.awaitTermination()
    n1 = spark.read.parquet(f"{tmp_dir}/exp").count()
    assert n1 == f.count()
    st.incremental_export(spark, f"{tmp_dir}/failures", f.schema, f"{tmp_dir}/exp", f"{tmp_dir}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/exp").count() == n1     # second run: nothing new


def test_rolling_alert_step_is_idempotent_per_epoch(spark, tmp_dir):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), i % 4 == 0) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, escalated boolean")
    step = st.alert_step(f"{tmp_dir}/state", f"{tmp_dir}/alerts")
    step(df.where("id < 80"), 0)
    step(df.where("id >= 80"), 1)
    first = spark.read.parquet(f"{tmp_dir}/alerts/epoch=1").collect()
    step(df.where("id >= 80"), 1)                      # the same batch again (retry)
    again = spark.read.parquet(f"{tmp_dir}/alerts/epoch=1").collect()
    state = spark.read.parquet(f"{tmp_dir}/state/epoch=1")
    assert first == again and again[0].n == 100 and again[0].rate_pct == 25.0
    assert state.count() == 100 and state.select("id").distinct().count() == 100


def test_event_stream_refuses_a_non_utc_session(spark, tmp_dir):
    import pytest
    schema = read_table(spark, SF_SMALL, "events", *fx.EVENT_COLUMNS).schema
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError):
            st.event_stream(spark, f"{tmp_dir}/in", schema)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_alert_state_keeps_two_versions(spark, tmp_dir):
    import os
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=i), i % 4 == 0) for i in range(50)], "id long, ts timestamp, escalated boolean")
    step = st.alert_step(f"{tmp_dir}/state", f"{tmp_dir}/alerts")
    for n in range(5):
        step(df.where(F.col("id") % 5 == n), n)
    step(df.where(F.col("id") % 5 == 4), 4)            # a batch run again still finds the state before it
    assert sorted(os.listdir(f"{tmp_dir}/state")) == ["epoch=3", "epoch=4", "latest"]
    assert spark.read.parquet(f"{tmp_dir}/state/epoch=4").count() == 50
    assert spark.read.parquet(f"{tmp_dir}/alerts").select("epoch").distinct().count() == 5


def test_lost_alert_state_is_an_error(spark, tmp_dir):
    import pytest
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0, False) for i in range(5)], "id long, ts timestamp, escalated boolean")
    step = st.alert_step(f"{tmp_dir}/state", f"{tmp_dir}/alerts")
    step(df, 0)
    with pytest.raises(Exception):
        step(df, 7)                                    # epoch 6 left no state


def test_chat_ingest_equals_batch(spark, tmp_dir):
    """ST6 on real transforms: messages in, log rows out, as the batch chain gives them."""
    from promptledger.operators import completion as cpl
    t0 = dt.datetime(2024, 1, 1)
    chats = [(i, t0 + dt.timedelta(minutes=i), [("system", "s"), ("user", "analyze and compare " * (i % 9)), ("assistant", "a")],
              None if i % 2 else 100, 0.5, None) for i in range(40)]
    chats += [(100, t0, [], None, None, None), (101, t0, [("user", "")], None, None, None), (102, t0, [("user", "x")], 9000, None, "u"),
              (103, t0, [("system", "only")], None, 3.0, "u"), (104, t0, [("assistant", "last")], None, None, "u"), (105, t0, None, None, None, None)]
    df = spark.createDataFrame(chats, "id long, ts timestamp, messages array<struct<role:string,content:string>>, max_tokens int, temperature double, user_id string")
    checked = {r.id: r for r in cpl.from_messages(df).collect()}
    assert [checked[i].reject_reason for i in (100, 101, 102, 103, 105)] == ["no_messages", "empty_content", "max_tokens_out_of_range", "temperature_out_of_range", "no_messages"]
    assert checked[104].prompt == "last" and checked[0].reject_reason == "empty_content" and checked[1].prompt.startswith("analyze") and checked[1].max_tokens == 1024
    df.write.parquet(f"{tmp_dir}/in")
    reg, settings = ct.model_registry(spark), ct.routing_settings(spark)
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_dir}/in")
    st.ingest_chats(stream, fx.fixed_scores, reg, settings, f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/out")
    valid = cpl.from_messages(df).where("status = 'valid'")
    want = cpl.request_rows(cpl.complete(valid, fx.fixed_scores, reg, settings).withColumn("latency_ms", F.lit(None).cast("double")), reg)
    assert got.count() == want.count() == 36
    cols = ["id", "prompt_hash", "complexity_tier", "routed_model", "provider", "input_tokens", "output_tokens", "cost_usd"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
