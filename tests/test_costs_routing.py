"""Pricing, routing and config tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from promptledger.operators import costs as cst
from promptledger.operators import routing as rt
from promptledger.sources import config_tables as ct


def _reqs(spark, rows):
    return spark.createDataFrame(rows, "id long, routed_model string, input_tokens long, output_tokens long")


def test_known_value_best_model_price(spark):
    reg = ct.model_registry(spark)
    out = cst.price_requests(_reqs(spark, [(1, "large", 1000, 1000)]), reg).first()
    assert out.cost_usd == Decimal("0.00111000")
    assert out.cost_if_highest_quality == Decimal("0.00111000")


def test_small_model_saves_over_ninety_percent(spark):
    reg = ct.model_registry(spark)
    p = cst.price_requests(_reqs(spark, [(1, "small", 1000, 1000)]), reg)
    r = p.select(*cst.savings_columns()).first()
    assert r.savings_pct > 90


def test_rounding_half_up_at_eighth_place(spark):
    reg = ct.model_registry(spark)
    # 1 input token on small: 0.000000035 -> 0.00000004 (half-up)
    r = cst.price_requests(_reqs(spark, [(1, "small", 1, 0)]), reg).first()
    assert r.cost_usd == Decimal("0.00000004")


def test_unknown_model_priced_as_cheapest(spark):
    reg = ct.model_registry(spark)
    known = rt.resolve_model(_reqs(spark, [(1, "retired", 1000, 0), (2, None, 1000, 0), (3, "mid", 1000, 0)]), reg)
    got = {r.id: (r.routed_model, r.cost_usd) for r in cst.price_requests(known, reg).collect()}
    assert got[1] == got[2] == ("small", Decimal("0.00003500")) and got[3][0] == "mid"


def test_best_model_is_dearest_high_quality(spark):
    assert cst.best_model(ct.model_registry(spark)).first().model_key == "large"


def test_low_confidence_uses_fallback(spark):
    df = spark.createDataFrame([(1, 1, 0.45), (2, 1, 0.60), (3, 3, 0.99), (4, None, 0.9)],
                               "id long, complexity_tier int, classifier_conf double")
    out = {r.id: (r.low_confidence, r.routed_model) for r in rt.route(df, ct.routing_settings(spark)).collect()}
    assert out[1] == (True, "mid")
    assert out[2] == (False, "small")     # 0.60 is not low (strict)
    assert out[3] == (False, "large")
    assert out[4] == (False, None)        # unmapped tier: priced later as cheapest


def test_patch_validation_and_application(spark):
    reg = ct.model_registry(spark)
    patch = spark.createDataFrame([("tier_2_model", "large"), ("tier_1_model", "nope"),
                                   ("low_confidence_threshold", "1.5")], ct.SETTINGS_SCHEMA)
    bad = {(r.key, r.reason) for r in rt.patch_violations(patch, reg).collect()}
    assert bad == {("tier_1_model", "unknown_model"), ("low_confidence_threshold", "threshold_out_of_range")}
    empty = spark.createDataFrame([], ct.SETTINGS_SCHEMA)
    assert [r.reason for r in rt.patch_violations(empty, reg).collect()] == ["empty_patch"]
    good = spark.createDataFrame([("tier_2_model", "large")], ct.SETTINGS_SCHEMA)
    applied = dict(rt.apply_patch(ct.routing_settings(spark), good).collect())
    assert applied["tier_2_model"] == "large" and applied["tier_1_model"] == "small"
    assert applied["fallback_model"] == "mid"


def test_default_rules_reference_registry_keys(spark):
    rules = ct.routing_rules(ct.routing_settings(spark)).withColumnRenamed("model_key", "value")
    assert rt.patch_violations(rules.select(F.concat(F.lit("tier_"), F.col("tier").cast("string"),
                                                     F.lit("_model")).alias("key"), "value"),
                               ct.model_registry(spark)).count() == 0


def test_tier_definitions(spark):
    t = {r.tier: (r.name, r.routed_to) for r in ct.tier_definitions(spark).collect()}
    assert t == {1: ("simple", "small"), 2: ("moderate", "mid"), 3: ("complex", "large")}
    assert all(len(r.examples) == 2 for r in ct.tier_definitions(spark).collect())


def test_judge_cost(spark):
    v = spark.createDataFrame([(1, 1000, 1000)], "id long, judge_input_tokens long, judge_output_tokens long")
    assert cst.judge_costs(v, ct.model_registry(spark)).first().judge_cost_usd == Decimal("0.00111000")
