"""Scans and sinks: labelled CSV (S1), golden JSON (S2), request rows (K1),
CSV reports (K5 / K6), response documents (P9), model persistence (M13)."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from promptledger.operators import prompts as pr
from promptledger.operators import sinks
from promptledger.sources import fixtures as fx
from promptledger.sources import labelled


def test_labelled_csv_quoted_commas_and_min_rows(spark, tmp_dir):
    path = f"{tmp_dir}/labels.csv"
    with open(path, "w") as fh:
        fh.write("prompt,tier,domain\n")
        for i in range(61):
            fh.write(f'"Summarize, briefly: item {i}\nsecond line",{1 + i % 3},ops\n')
    df = labelled.read_labelled(spark, path)
    assert df.count() == 61
    assert df.first().prompt.startswith("Summarize, briefly")
    with pytest.raises(ValueError):
        labelled.read_labelled(spark, path, min_rows=100)


def test_golden_json_array(spark, tmp_dir):
    path = f"{tmp_dir}/golden.json"
    with open(path, "w") as fh:
        json.dump([{"prompt": "Extract emails", "expected_tier": 1},
                   {"prompt": "Design a system", "expected_tier": 3}], fh)
    rows = labelled.read_golden(spark, path).collect()
    assert [(r.prompt, r.label) for r in rows] == [("Extract emails", 1), ("Design a system", 3)]


def test_request_rows_and_append(spark, tmp_dir):
    import datetime as dt
    from decimal import Decimal
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), "x" * 300, "mid", 10, 5, Decimal("0.1"), Decimal("0.2"), 1.0, "y" * 300)],
        "id long, ts timestamp, prompt string, routed_model string, input_tokens long, output_tokens long, "
        "cost_usd decimal(18,8), cost_if_highest_quality decimal(18,8), latency_ms double, output_text string")
    r = sinks.request_rows(df).first()
    assert len(r.prompt_preview) == 150 and len(r.output_preview) == 200
    assert r.low_confidence is False and r.complexity_tier is None and r.user_id == "default"
    import hashlib
    assert r.prompt_hash == hashlib.sha256(("x" * 300).encode()).hexdigest()[:16]
    sinks.append_requests(df, f"{tmp_dir}/requests")
    sinks.append_requests(df, f"{tmp_dir}/requests")
    assert spark.read.parquet(f"{tmp_dir}/requests").where("day = DATE'2024-01-01'").count() == 2


def test_csv_report_with_header(spark, tmp_dir):
    df = spark.createDataFrame([("a", 1)], "model string, n long")
    sinks.write_csv(df, f"{tmp_dir}/report")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/report")
    assert back.columns == ["model", "n"]


def test_response_documents(spark):
    log = fx.request_log(spark, SF_SMALL).limit(5)
    doc = json.loads(pr.response_documents(log).first().document)
    assert doc["total_tokens"] == doc["input_tokens"] + doc["output_tokens"]
    assert doc["savings_usd"] == pytest.approx(doc["cost_if_highest_quality"] - doc["cost_usd"])
    assert "T" in doc["timestamp"]


def test_extract_prompt_last_user_else_last(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"),
                                (1, 3, "assistant", "d"), (2, 0, "system", "s"), (2, 1, "assistant", "t")],
                               "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.prompt for r in pr.extract_prompts(df).collect()}
    assert got == {1: "c", 2: "t"}


def test_validate_requests(spark):
    got = {r.conv_id: (r.status, r.reject_reason, r.max_tokens, r.temperature)
           for r in pr.validate_requests(fx.chat_requests(spark, SF_SMALL)).collect()}
    by_mod = {c % 7: v for c, v in got.items()}
    assert by_mod[0][0] == "valid" and by_mod[0][2:] == (1024, 0.1)
    assert by_mod[1][1] == "empty_content"
    assert by_mod[2][1] == "temperature_out_of_range"
    assert by_mod[3][1] == "max_tokens_out_of_range"
    assert by_mod[4][1] == "no_messages"
    assert by_mod[6] == ("valid", None, 1024, 1.5)


def test_model_persistence_round_trip(spark, tmp_dir):
    from promptledger.operators import classifier as clf
    from promptledger.plans import jobs
    data = jobs.prepared(fx.prompts(spark, SF_SMALL), keep=("doc_id",))
    models, results = jobs.fit_candidates(data, k=2)
    best = results.where("is_best").first()
    model = models[best.candidate]
    clf.save_model(model, f"{tmp_dir}/m", best.candidate, {r.candidate: r.accuracy for r in results.collect()})
    again, meta = clf.load_model(f"{tmp_dir}/m")
    assert meta["name"] == best.candidate and meta["calibrated"] and meta["accuracies"][best.candidate] == best.accuracy
    a = clf.score(model, data).select("doc_id", "predicted").orderBy("doc_id").collect()
    b = clf.score(again, data).select("doc_id", "predicted").orderBy("doc_id").collect()
    assert a == b
    acc = clf.accuracy(clf.score(model, data)).first().accuracy
    assert acc > 0.6


def test_calibrated_model_probabilities(spark, tmp_dir):
    from pyspark.ml.functions import vector_to_array
    from promptledger.operators.calibration import PlattCalibratedModel
    from promptledger.plans import jobs
    data = jobs.prepared(fx.prompts(spark, SF_SMALL), keep=("doc_id",))
    model = jobs.calibrated_model(data, k=3)
    out = model.transform(data).select(F.aggregate(vector_to_array("probability"), F.lit(0.0),
                                                   lambda a, x: a + x).alias("s"))
    assert all(abs(r.s - 1.0) < 1e-9 for r in out.collect())
    model.save(f"{tmp_dir}/cal")
    again = PlattCalibratedModel.load(f"{tmp_dir}/cal")
    assert len(again.members) == 3


def test_request_rows_precomputed_hash_and_preview_match(spark):
    long_prompt = "Write a parser. " * 40
    df = spark.createDataFrame(
        [(1, "small", 10, 20, long_prompt, "out " * 80)],
        "id long, routed_model string, input_tokens long, output_tokens long, prompt string, output_text string"
    ).select("*", F.current_timestamp().cast("timestamp_ntz").alias("ts"), F.lit(None).cast("decimal(18,8)").alias("cost_usd"),
             F.lit(None).cast("decimal(18,8)").alias("cost_if_highest_quality"), F.lit(1.0).alias("latency_ms"))
    direct = sinks.request_rows(df).first()
    pre = sinks.request_rows(df.select("*", pr.prompt_hash().alias("prompt_hash"), *pr.previews()).drop("prompt")).first()
    assert direct.prompt_hash == pre.prompt_hash and len(direct.prompt_hash) == 16
    assert direct.prompt_preview == pre.prompt_preview == long_prompt[:150]
    assert direct.output_preview == ("out " * 80)[:200]


def test_labelled_csv_by_name(spark, tmp_dir):
    import pytest
    from promptledger.sources.labelled import read_labelled
    for name, text in {"two": "prompt,tier\n" + "a,1\n" * 60, "turned": "domain,tier,prompt\n" + "x,2,a\n" * 60}.items():
        with open(f"{tmp_dir}/{name}.csv", "w") as f:
            f.write(text)
        df = read_labelled(spark, f"{tmp_dir}/{name}.csv")
        assert df.columns == ["prompt", "tier", "domain"] and df.where("prompt = 'a' and tier in (1, 2)").count() == 60
    with open(f"{tmp_dir}/bad.csv", "w") as f:
        f.write("text,tier\na,1\n")
    with pytest.raises(ValueError):
        read_labelled(spark, f"{tmp_dir}/bad.csv")


def test_baseline_rows_and_registry_rules(spark):
    from promptledger.operators import quality as dq
    from promptledger.operators import sinks
    from promptledger.sources import config_tables as ct
    runs = spark.createDataFrame([("p" * 400, None, 1), ("q", "o" * 400, 2)], "prompt string, output_text string, run int")
    got = {r.run: (len(r.prompt_preview), len(r.output_preview)) for r in sinks.baseline_rows(runs).collect()}
    assert got == {1: (150, 0), 2: (1, 200)}
    reg = ct.model_registry(spark)
    assert dq.registry_violations(reg).count() == 0
    assert dq.registry_violations(reg.withColumn("quality_tier", F.lit("best"))).count() == 3
