"""Plan-shape properties: fresh plans, pruning, single scans, config values
folded as literals."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from promptledger.plans import jobs
from promptledger.sources import config_tables as ct
from promptledger.sources import fixtures as fx
from promptledger.sources.tables import read_table


def test_reports_see_appended_rows(spark, tmp_dir):
    """Plans are not kept between calls: new files and new settings count."""
    from promptledger.plans import catalog
    events = read_table(spark, SF_SMALL, "events")
    folder = f"{tmp_dir}/events.parquet"
    events.write.parquet(folder)
    before = catalog.QUERIES["savings_summary"](spark, tmp_dir).first().total_requests
    events.withColumn("event_id", F.col("event_id") + 1_000_000).write.mode("append").parquet(folder)
    assert catalog.QUERIES["savings_summary"](spark, tmp_dir).first().total_requests == 2 * before


def test_config_row_is_one_row_or_none(spark):
    assert ct.config_row(spark.range(1)).id == 0
    assert ct.config_row(spark.range(0)) is None
    with pytest.raises(ValueError):
        ct.config_row(spark.range(2))


def test_request_log_plan_has_no_config_subquery(spark, capsys):
    fx.request_log(spark, SF_SMALL).explain("formatted")
    out = capsys.readouterr().out
    assert "Subquery" not in out and "CartesianProduct" not in out


def test_training_table_is_written_once_with_weights(spark):
    p = fx.prompts(spark, SF_SMALL)
    data = jobs.prepared(p, keep=("doc_id",))
    assert data.count() == p.count()
    assert data.where(F.col("weight").isNull()).count() == 0


def test_oversized_config_is_not_broadcast(spark):
    from promptledger.operators import costs as cst
    from promptledger.operators import routing as rt
    big_settings = spark.range(ct.MAX_CONFIG_ROWS + 1).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("x").alias("value"))
    reqs = spark.createDataFrame([(1, 1, 0.9)], "id long, complexity_tier int, classifier_conf double")
    with pytest.raises(ValueError):
        rt.route(reqs, big_settings)
    reg = ct.model_registry(spark)
    big_reg = reg.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(ct.MAX_REGISTRY_ROWS // 3)))).drop("copy")
    priced = spark.createDataFrame([(1, "small", 10, 10)], "id long, routed_model string, input_tokens long, "
                                   "output_tokens long")
    with pytest.raises(ValueError):
        cst.price_requests(priced, big_reg)
    assert ct.registry_facts(reg)[0] == "small"


def test_reports_prune_the_scan(spark, capsys):
    from promptledger.plans import catalog
    catalog.QUERIES["requests_by_tier"](spark, SF_SMALL).explain("formatted")
    plan = capsys.readouterr().out
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert schemas and all("props" in s for s in schemas)
    assert not any(c in s for s in schemas for c in ("user_id", "value", "event_type", "ts:"))
    catalog.QUERIES["escalation_rate_7d"](spark, SF_SMALL).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(ts)" in plan


def test_recent_window_prunes_day_folders(spark, tmp_dir, capsys):
    from promptledger.operators import reports as rep
    from promptledger.operators import sinks
    log = fx.request_log(spark, SF_SMALL).withColumn("prompt", F.lit("p"))
    sinks.append_requests(log, tmp_dir + "/log")
    kept = spark.read.parquet(tmp_dir + "/log")
    rep.daily_cost(kept, days=7).explain("formatted")
    plan = capsys.readouterr().out
    assert any("day" in line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert rep.daily_cost(kept, days=7).count() == 8


@pytest.mark.parametrize("name", ["tier_distribution", "routing_distribution", "reroute_savings", "class_weights"])
def test_shares_read_their_table_once(spark, capsys, name):
    from promptledger.plans import catalog
    catalog.QUERIES[name](spark, SF_SMALL).explain("formatted")
    plan = capsys.readouterr().out
    tree = plan.split("\n\n\n")[0]
    assert tree.count("Scan parquet") == 1, tree


@pytest.mark.parametrize("name", ["recent_requests", "audit_view", "escalation_alert"])
def test_newest_rows_are_cut_before_the_join(spark, capsys, name):
    from promptledger.plans import catalog
    catalog.QUERIES[name](spark, SF_SMALL).explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join" in line]
    cuts = [i for i, line in enumerate(plan.splitlines()) if "TakeOrderedAndProject" in line or "GlobalLimit" in line]
    assert cuts and max(cuts) > min(joins), plan


def test_percentiles_do_not_rest_on_exchange_reuse(spark):
    from promptledger.operators.percentiles import exact_percentiles
    df = spark.range(1_000_000).select(((F.col("id") * 7919) % 250_007).cast("double").alias("v"))
    values = sorted((i * 7919) % 250_007 for i in range(1_000_000))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        r = exact_percentiles(df, "v", [0.5, 0.95, 0.99], ["a", "b", "c"], most=5_000).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert (r.n, r.a, r.b, r.c) == (1_000_000, *(float(values[int(1_000_000 * p)]) for p in (0.5, 0.95, 0.99)))


def test_percentiles_of_ties_nulls_and_nothing(spark):
    from promptledger.operators.percentiles import exact_percentiles
    tied = spark.createDataFrame([(float(x),) for x in [1] * 40 + [2] * 3 + [9] * 57] + [(None,)], "v double")
    r = exact_percentiles(tied, "v", [0.0, 0.39, 0.4, 0.43, 0.99, 1.0], list("abcdef"), most=2, accuracy=10).first()
    assert (r.n, r.a, r.b, r.c, r.d, r.e, r.f) == (100, 1.0, 1.0, 2.0, 9.0, 9.0, None)
    r = exact_percentiles(tied.where("v > 100"), "v", [0.5], ["a"]).first()
    assert (r.n, r.a) == (0, None)


FITS = ("latency_percentiles", "classify_prompts", "candidate_results", "cross_validation", "calibrated_scores", "golden_gate")
WRITES = ("request_store", "newest_from_store", "colocated_requests", "rollup_report", "consumed_bitmaps")  # queries whose job is to write first


def test_no_job_runs_while_a_report_is_built(spark):
    from promptledger.plans import catalog
    tracker = spark.sparkContext.statusTracker()
    ran = {}
    for name, build in catalog.QUERIES.items():
        if name in FITS + WRITES:
            continue
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        build(spark, SF_SMALL)
        ran[name] = len(tracker.getJobIdsForGroup(f"build-{name}"))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert {n: k for n, k in ran.items() if k} == {}


def test_declared_schemas_are_those_of_the_files(spark):
    from promptledger.sources.tables import SCHEMAS, table_path
    for name, ddl in SCHEMAS.items():
        found = spark.read.parquet(table_path(SF_SMALL, name))
        assert found.schema.simpleString() == spark.createDataFrame([], ddl).schema.simpleString(), name
        assert read_table(spark, SF_SMALL, name, *found.columns).count() == found.count()
