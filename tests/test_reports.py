"""Reports, percentiles and data-quality rules."""

import datetime as dt
import random


from promptledger.operators import quality as dq
from promptledger.operators import reports as rep
from promptledger.operators.percentiles import exact_percentiles
from promptledger.settings import Thresholds


def _brute(vals, p):
    s = sorted(vals)
    return s[int(len(s) * p)]


def test_exact_percentiles_match_sorted_index(spark):
    rnd = random.Random(7)
    vals = [round(rnd.random() * 1000, 1) for _ in range(2000)]
    vals += [42.0] * 1500           # one hot value holding a large share of all rows
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = exact_percentiles(df, "v", [0.5, 0.95, 0.99, 0.0], ["p50", "p95", "p99", "p0"], most=100, accuracy=100).first()
    assert r.n == len(vals)
    for p, name in [(0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.0, "p0")]:
        assert getattr(r, name) == _brute(vals, p)


def test_percentile_index_is_zero_based(spark):
    vals = list(range(1, 201))
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    r = exact_percentiles(df, "v", [0.95], ["p95"]).first()
    assert r.p95 == 191.0    # sorted[int(200 * 0.95)] = sorted[190]


def _log(spark, esc_flags):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), e) for i, e in enumerate(esc_flags)]
    return spark.createDataFrame(rows, "id long, ts timestamp, escalated boolean")


def test_alert_boundaries(spark):
    t = Thresholds()
    assert rep.escalation_alert(_log(spark, [True] * 9), t).first().status == "silent"
    exactly = [True] * 20 + [False] * 80
    assert rep.escalation_alert(_log(spark, exactly), t).first().status == "ok"      # 20 % is not > 20 %
    above = [True] * 21 + [False] * 79
    assert rep.escalation_alert(_log(spark, above), t).first().status == "alert"
    # only the newest 100 count: 50 old escalations are outside the window
    old_then_new = [True] * 50 + [False] * 100
    assert rep.escalation_alert(_log(spark, old_then_new), t).first().rate_pct == 0.0


def test_limit_then_filter(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), 1 if i < 95 else 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, complexity_tier int")
    out = rep.recent_with_tier_filter(df, [1], limit=10)
    assert out.count() == 5   # newest 10 first, then the tier filter


def test_histogram_sentinel_bucket(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (5.5,), (3.0,), (None,)], "quality_score double")
    got = {r.bin: r.n for r in rep.quality_histogram(df).collect()}
    assert got == {-1: 1, 0: 1, 19: 1, 10: 1}


def test_summary_nulls_and_sentinel(spark):
    empty = spark.createDataFrame([], "cost_usd decimal(18,8), cost_if_highest_quality decimal(18,8), "
                                      "quality_score double, latency_ms double")
    r = rep.savings_summary(empty).first()
    assert (r.total_requests, r.total_cost_usd, r.savings_pct, r.avg_latency_ms) == (0, 0.0, 0.0, 0.0)
    assert r.avg_quality_score is None


def test_summary_maps(spark):
    df = spark.createDataFrame([(1, "a", 4.0), (1, "b", 2.0), (None, "a", None)],
                               "complexity_tier int, routed_model string, quality_score double")
    r = rep.summary_maps(df).first()
    assert r.requests_by_tier == {"1": 2}
    assert r.requests_by_model["a"]["count"] == 2


def test_row_flags(spark):
    df = spark.createDataFrame([(True, 5.0), (False, 2.9), (False, -1.0), (False, 3.0), (False, None)],
                               "escalated boolean, quality_score double")
    assert [r.f for r in df.select(rep.row_flag().alias("f")).collect()] == [
        "escalated", "low_quality", "low_quality", "none", "none"]


def test_quality_rules(spark):
    log = spark.createDataFrame([(1, 4, 0.5, 3.0, 10, 10, 1.0), (2, 2, 1.5, 7.0, -1, 3, None),
                                 (2, 2, 0.5, 3.0, 1, 1, 1.0)],
                                "id long, complexity_tier int, classifier_conf double, quality_score double, "
                                "input_tokens long, output_tokens long, cost_if_highest_quality double")
    rules = {(r.id, r.rule) for r in dq.range_violations(log).collect()}
    assert rules == {(1, "tier_out_of_range"), (2, "confidence_out_of_range"), (2, "score_out_of_range"),
                     (2, "negative_tokens")}
    assert [r.id for r in dq.duplicate_ids(log).collect()] == [2]
    assert dq.null_baseline(log).first().null_baseline == 1
    kids = spark.createDataFrame([(10, 1), (11, 99)], "id long, request_id long")
    assert [r.id for r in dq.orphans(kids, log).collect()] == [11]
    assert [r.id for r in dq.with_parent(kids, log).collect()] == [10]


def test_escalation_rate_window_includes_boundary_day(spark):
    t0 = dt.datetime(2024, 1, 10, 12)
    rows = [(1, t0, t0.date(), True), (2, t0 - dt.timedelta(days=7, hours=10), (t0 - dt.timedelta(days=7)).date(),
                                        False),
            (3, t0 - dt.timedelta(days=8), (t0 - dt.timedelta(days=8)).date(), True)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, day date, escalated boolean")
    r = rep.escalation_rate(df, 7).first()
    assert r.num_requests == 2 and r.escalation_rate_pct == 50.0
