"""Verdict parsing and escalation decisions."""

from decimal import Decimal

from pyspark.sql import functions as F

from promptledger.operators import escalation as esc
from promptledger.operators import verdicts as vd
from promptledger.sources import config_tables as ct

CLEAN = '{"cheap_score": 3.0, "expensive_score": 5.0, "quality_gap": 99, "routing_correct": false}'


def _parse(spark, raws):
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    return {r.id: r for r in vd.parse_verdicts(df).collect()}


def test_parse_shapes(spark):
    out = _parse(spark, [
        CLEAN,
        "```json\n" + CLEAN + "\n```",
        "Sure! Here it is:\n" + CLEAN + "\nDone.",
        '{"cheap_score": 3.0, "quality_gap": 1, "routing_correct": true}',
        "not json at all",
        '{"cheap_score": "4", "expensive_score": 4.5, "quality_gap": 0, "routing_correct": true}',
        '{"cheap_score": "abc", "expensive_score": 4.5, "quality_gap": 0, "routing_correct": true}',
    ])
    for i in (0, 1, 2):
        assert out[i].parse_error is None
        assert out[i].quality_gap == 2.0          # recomputed, stated 99 ignored
        assert out[i].quality_score == 3.0
    assert out[3].parse_error == "missing_keys" and out[3].quality_score == -1.0 and out[3].quality_gap == 0.0
    assert out[4].parse_error == "not_json" and out[4].judge_routing_correct is False
    assert out[5].parse_error is None and out[5].quality_score == 4.0   # numeric string accepted
    assert out[6].parse_error == "bad_value"


def _decide(spark, rows):
    df = spark.createDataFrame(rows, "id long, complexity_tier int, quality_score double, "
                                     "quality_gap double, latency_ms double")
    return {r.id: r.decision for r in esc.decide(df).collect()}


def test_decision_boundaries(spark):
    d = _decide(spark, [
        (1, 1, 3.0, 1.5, 100.0),    # gap at threshold: not a failure
        (2, 1, 2.5, 0.5, 100.0),    # low score, small gap: failure
        (3, 1, 2.0, 2.0, 9000.0),   # remaining 1000 < reserve 2000
        (4, 1, 2.0, 2.0, 8000.0),   # remaining == reserve: escalate
        (5, 1, None, None, 1.0),
        (6, 1, -1.0, 0.0, 1.0),
    ])
    assert d == {1: "routing_correct", 2: "escalate", 3: "latency_budget_exhausted", 4: "escalate",
                 5: "unverified", 6: "unverified"}


def test_tier_bump(spark):
    df = spark.createDataFrame([(1, 3.3), (2, 2.5), (3, 1.6)], "complexity_tier int, quality_gap double")
    df = df.withColumn("complexity_tier", F.when(F.col("quality_gap") > 3, 1).otherwise(2))
    got = [r.c for r in df.select(esc.corrected_tier().alias("c")).collect()]
    assert got == [3, 3, 3]
    one = spark.createDataFrame([(1, 2.5)], "complexity_tier int, quality_gap double")
    assert one.select(esc.corrected_tier().alias("c")).first().c == 2   # 2.5 bumps one tier


def test_budget_exhausted_still_logs_failure(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 2.0, 9000.0)], "id long, complexity_tier int, quality_score double, "
                                                           "quality_gap double, latency_ms double")
    df = esc.decide(df).withColumn("ts", F.current_timestamp()).withColumn("judge_reason", F.lit("misses a step"))
    assert df.first().decision == "latency_budget_exhausted"
    f = esc.routing_failures(df).first()
    assert f.failure_reason == "misses a step" and f.correct_tier == 2


def test_null_gap_with_a_good_score_is_unverified(spark):
    df = spark.createDataFrame([(1, 4.0, None, 10.0), (2, 2.0, None, 10.0), (3, None, None, 10.0)],
                               "id long, quality_score double, quality_gap double, latency_ms double")
    got = {r.id: r.decision for r in esc.decide(df).collect()}
    assert got == {1: "unverified", 2: "escalate", 3: "unverified"}


def test_replayed_reruns_and_outcomes_do_not_multiply_requests(spark):
    import datetime as dt
    reg = ct.model_registry(spark)
    dec = spark.createDataFrame([(i, "escalate" if i % 2 else "routing_correct", 2.0, 2.0) for i in range(20)],
                                "id long, decision string, quality_score double, quality_gap double")
    comps = spark.createDataFrame([(i, "large", 1000, 1000 - again) for i in range(20) for again in (0, 1)],
                                  "prompt_id long, model_key string, input_tokens long, output_tokens long")
    out = esc.escalation_outcomes(dec, comps, reg).collect()
    assert sorted(r.id for r in out) == list(range(20))
    assert {r.cost_delta_usd for r in out if r.escalated} == {Decimal("0.00111000")}
    t = dt.datetime(2024, 1, 1)
    late = spark.createDataFrame([(1, True, "m", Decimal("0.5"), t), (1, False, None, Decimal("0"), t + dt.timedelta(1)), (2, True, "m", Decimal("1"), t),
                                  (2, True, "m", Decimal("1"), t)],
                                 "id long, escalated boolean, escalated_model string, cost_delta_usd decimal(18,8), escalated_at timestamp")
    merged = {r.id: (r.escalated, r.escalated_model) for r in esc.merge_escalations(dec.select("id"), late).collect()}
    assert len(merged) == 20 and merged[1] == (False, None) and merged[2] == (True, "m")


def test_escalation_outcomes_and_merge(spark):
    reg = ct.model_registry(spark)
    dec = spark.createDataFrame(
        [(1, "escalate", 3.0, 1.6), (2, "escalate", 2.0, 2.0), (3, "routing_correct", 4.0, 0.5)],
        "id long, decision string, quality_score double, quality_gap double")
    comps = spark.createDataFrame([(1, "large", 1000, 1000)],
                                  "prompt_id long, model_key string, input_tokens long, output_tokens long")
    out = {r.id: r for r in esc.escalation_outcomes(dec, comps, reg).collect()}
    assert out[1].escalated and out[1].cost_delta_usd == Decimal("0.00111000")
    assert out[1].reason == "quality_gap=1.6 cheap_score=3.0"
    assert not out[2].escalated and out[2].reason == "escalation_api_failed"
    assert not out[3].escalated and out[3].cost_delta_usd == 0
    reqs = spark.createDataFrame([(1,), (3,), (4,)], "id long")
    merged = {r.id: (r.escalated, r.cost_delta_usd) for r in
              esc.merge_escalations(reqs, esc.escalation_outcomes(dec, comps, reg)).collect()}
    assert merged[4] == (False, 0)


def test_latest_verdict_wins(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    v = spark.createDataFrame([(1, 5.0, t0), (1, 3.0, t0 + dt.timedelta(minutes=1)), (2, 4.0, t0)],
                              "id long, quality_score double, verified_at timestamp")
    reqs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r.id: r.quality_score for r in vd.merge_verdicts(reqs, v).collect()}
    assert got == {1: 3.0, 2: 4.0, 3: None}


def test_judge_input_text(spark):
    df = spark.createDataFrame([("P", "A", "B")], "prompt string, cheap_output string, reference_output string")
    assert all(k in vd.judge_inputs(df).first().judge_instructions for k in vd.REQUIRED_KEYS)
    assert vd.judge_inputs(df).first().judge_input == (  # labels: fixed values
        "ORIGINAL_PROMPT:\nP\n\nRESPONSE_A (cheap model):\nA\n\nRESPONSE_B (reference model):\nB")
