"""Derived views over the driver tables (the contract in FIXTURES.md).

Every view is a lazy DataFrame over a parquet scan; nothing is collected.
The same formulas exist as DuckDB SQL in :mod:`promptledger.plans.oracle`.

* ``request_log`` - one routed, priced, judged request per ``events`` row;
* ``prompts``     - one templated prompt per ``documents`` row, the whole
                    document text as the body, template group as label;
* the rest (verdict text, verdicts, completions, failures, ledger,
  predictions, baseline runs, chat requests) derive from those two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import escalation as esc
from ..operators.costs import price_requests
from ..operators.routing import resolve_model, route
from ..settings import DEFAULT_THRESHOLDS
from . import config_tables as ct
from .tables import read_table

# our own prompt templates: (prefix, suffix, fenced body), picked by doc_id % 12
PROMPT_TEMPLATES = [
    ("Extract every invoice number from this note: ", "", False),
    ("Is this sentence polite? Answer yes or no: ", "", False),
    ("Convert this amount to euros: ", " dollars", False),
    ("Count the vowels in: ", "", False),
    ("Summarize the passage in two lines and list the main points: ", "", False),
    ("Classify the message as praise, bug report or request: ", "", False),
    ("Translate the text to Spanish. It must stay formal: ", "", False),
    ("Return a JSON table of people and places. 1. names 2. cities: ", "", False),
    ("Analyze the strategy below, compare two options and recommend one. First, state risks. "
     "Then, propose a plan. Finally, justify it: ", "", False),
    ("Write a production-ready function that parses this log:", " Implement a comprehensive test.", True),
    ("Design a framework to evaluate the impact. Step 1 scope. Step 2 metrics. What would change? Why? ",
     "", False),
    ("", "", False),
]
FENCE = "\n```\n"


def request_log(spark: SparkSession, sf_dir: str, registry: DataFrame | None = None,
                settings: DataFrame | None = None, thresholds=DEFAULT_THRESHOLDS) -> DataFrame:
    """B.1: routed, priced and judged requests (one per event)."""
    ev = read_table(spark, sf_dir, "events", *EVENT_COLUMNS)
    return requests_from_events(ev, registry, settings, thresholds)


EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def requests_from_events(ev: DataFrame, registry: DataFrame | None = None, settings: DataFrame | None = None,
                         thresholds=DEFAULT_THRESHOLDS) -> DataFrame:
    """The B.1 transform over any events DataFrame, batch or streaming
    (stateless: projections and broadcast joins with config tables)."""
    spark = ev.sparkSession
    registry = ct.model_registry(spark) if registry is None else registry
    settings = ct.routing_settings(spark) if settings is None else settings
    k = F.get_json_object("props", "$.k").cast("int")
    eid = F.col("event_id")
    quality = (F.when(F.col("event_type") == "signup", F.lit(None).cast("double"))
               .when(F.col("event_type") == "error", F.lit(-1.0))
               .otherwise((F.lit(10) + (eid * 7) % 41).cast("double") / F.lit(10.0)))
    base = ev.select(
        eid.alias("id"),
        F.col("ts"),
        F.to_date("ts").alias("day"),
        F.col("user_id"),
        F.col("event_type"),
        F.when(k < 35, F.lit(1)).when(k < 75, F.lit(2)).otherwise(F.lit(3)).alias("complexity_tier"),
        ((F.lit(40) + (eid * 37) % 60).cast("double") / F.lit(100.0)).alias("classifier_conf"),
        (F.lit(20) + (eid * 13) % 480).cast("bigint").alias("input_tokens"),
        (F.lit(10) + k * 3 + (eid * 7) % 50).cast("bigint").alias("output_tokens"),
        (F.col("value") * F.lit(40.0)).alias("latency_ms"),
        quality.alias("quality_score"),
        ((F.lit(30) + (eid * 11) % 21).cast("double") / F.lit(10.0)).alias("expensive_score"),
        F.when((quality >= 0) & (eid % 6 != 0), F.concat(F.lit("misses point "), (eid % 6).cast("string"))).alias("judge_reason"),
    )
    base = base.withColumn(
        "quality_gap",
        F.when(F.col("quality_score") < 0, F.lit(0.0))
        .otherwise(F.col("expensive_score") - F.col("quality_score")))
    facts = ct.registry_facts(registry)
    routed = resolve_model(route(base, settings), registry, facts=facts)
    priced = price_requests(routed, registry, facts=facts)
    return esc.decide(priced, t=thresholds)


def templated(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Wrap each text in the template picked by ``id % 12``; the template
    group is the label (B.2)."""
    did = F.col(id_col)
    body = F.coalesce(F.col(text_col), F.lit(""))
    choice = did % 12
    expr = None
    for i, (prefix, suffix, fenced) in enumerate(PROMPT_TEMPLATES):
        if fenced:
            text = F.concat(F.lit(prefix), F.lit(FENCE), body, F.lit(FENCE.rstrip("\n")), F.lit(suffix))
        else:
            text = F.concat(F.lit(prefix), body, F.lit(suffix))
        expr = F.when(choice == i, text) if expr is None else expr.when(choice == i, text)
    label = (F.when(choice <= 3, F.lit(1)).when(choice <= 7, F.lit(2)).when(choice <= 10, F.lit(3))
             .otherwise(F.lit(1) + F.floor(did / 12).cast("int") % 3))
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, expr.alias("prompt"), label.cast("int").alias("label"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B.2: templated prompts over whole documents, with the template label."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return templated(docs, "doc_id", "text")


def golden_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden-style gate input: the ``benchmark`` items, templated the same
    way, with the expected tier."""
    return templated(read_table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text")


def completions(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """B.3: the best model's re-run of each request; missing for id % 11 = 0
    (a failed re-run), delivered twice for id % 5 = 0 (a replayed re-run that
    stopped one token earlier)."""
    log = request_log(spark, sf_dir) if log is None else log
    times = F.when(F.col("id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return log.where(F.col("id") % 11 != 0).withColumn("__again", F.explode(times)).select(
        F.col("id").alias("prompt_id"),
        F.lit("large").alias("model_key"),
        F.concat(F.lit("reference answer "), F.col("id").cast("string")).alias("output_text"),
        F.col("input_tokens"),
        (F.col("output_tokens") + F.col("id") % 17 - F.col("__again")).alias("output_tokens"),
        (F.col("latency_ms") * F.lit(0.5) + F.lit(100.0)).alias("latency_ms"),
    )


def verdict_text(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """B.3: raw judge output for verified requests in five shapes by id % 5
    (clean, fenced, preamble, missing key, not JSON); the stated gap is
    always wrong."""
    log = request_log(spark, sf_dir) if log is None else log
    v = log.where(F.col("quality_score") >= 0)
    cheap = F.format_string("%.1f", F.col("quality_score"))
    exp = F.format_string("%.1f", F.col("expensive_score"))
    correct = F.when(F.col("decision") == "routing_correct", F.lit("true")).otherwise(F.lit("false"))
    full = F.concat(F.lit('{"cheap_score": '), cheap, F.lit(', "expensive_score": '), exp,
                    F.lit(', "quality_gap": 99.0, "routing_correct": '), correct,
                    F.lit(', "failure_reason": null}'))
    partial = F.concat(F.lit('{"cheap_score": '), cheap, F.lit(', "quality_gap": 99.0, "routing_correct": '),
                       correct, F.lit("}"))
    m = F.col("id") % 5
    raw = (F.when(m == 0, full)
           .when(m == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
           .when(m == 2, F.concat(F.lit("Here is my assessment:\n"), full, F.lit("\nThanks.")))
           .when(m == 3, partial)
           .otherwise(F.lit("I cannot score these answers.")))
    return v.select("id", "ts", raw.alias("raw"))


def verdicts(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """Append-only verdict table: the parsed verdicts plus, for id % 4 = 0,
    an earlier superseded verdict with a different score."""
    from ..operators.verdicts import parse_verdicts
    log = request_log(spark, sf_dir) if log is None else log
    parsed = parse_verdicts(verdict_text(spark, sf_dir, log))
    current = parsed.select("id", "quality_score",
                            F.timestamp_add("SECOND", F.lit(60) + F.col("id") % 300, F.col("ts"))
                            .alias("verified_at"))
    older = parsed.where(F.col("id") % 4 == 0).select(
        "id", F.lit(5.0).alias("quality_score"),
        F.timestamp_add("SECOND", F.lit(30), F.col("ts")).alias("verified_at"))
    return current.unionByName(older)


def doc_count(spark: SparkSession, sf_dir: str):
    """Scalar subquery: number of documents (parquet footer count)."""
    return read_table(spark, sf_dir, "documents", "doc_id").agg(F.count(F.lit(1)).alias("n")).scalar()


def failure_log(spark: SparkSession, sf_dir: str, log: DataFrame | None = None,
                thresholds=DEFAULT_THRESHOLDS) -> DataFrame:
    """B.3 ``routing_failures`` without the prompt (:func:`with_prompts` adds
    it): one row per failed routing (K2), plus one orphan row per 1000
    requests whose ``request_id`` is unknown (for the foreign-key check J7)."""
    log = request_log(spark, sf_dir) if log is None else log
    fails = esc.routing_failures(log, thresholds)
    orphans = log.where(F.col("id") % 1000 == 0).select(
        (-(F.col("id") + 1)).alias("request_id"), F.col("ts"),
        F.col("complexity_tier").alias("classified_tier"),
        F.lit(3).alias("correct_tier"), F.lit(2.0).alias("quality_gap"),
        F.lit("unknown request").alias("failure_reason"))
    return fails.unionByName(orphans).withColumn(
        "id", F.when(F.col("request_id") >= 0, F.col("request_id") * 10 + 1)
        .otherwise(-F.col("request_id") * 10 + 2))


def with_prompts(spark: SparkSession, sf_dir: str, df: DataFrame, id_col: str = "id",
                 columns: list | None = None, prompts_df: DataFrame | None = None) -> DataFrame:
    """Prompt columns of each request: request id -> document
    ``abs(id) mod (number of documents)`` of the ``prompts`` view (a
    sort-merge join on the document key; many requests share a document,
    a document row is never repeated on the prompts side).

    ``columns`` are expressions over the prompts view (default: the whole
    ``prompt``), evaluated *before* the join, so a caller that needs only a
    hash or a preview shuffles those instead of whole texts."""
    cols = columns if columns is not None else [F.col("prompt")]
    src = prompts(spark, sf_dir) if prompts_df is None else prompts_df
    p = src.select(F.col("doc_id").alias("__doc"), *cols)
    keyed = df.withColumn("__doc", F.pmod(F.abs(F.col(id_col)), doc_count(spark, sf_dir)))
    return keyed.join(p, "__doc", "left").drop("__doc")


def consumed_ledger(failures: DataFrame) -> DataFrame:
    """B.3: failures already consumed by an earlier retrain (id % 3 = 0)."""
    return failures.where(F.col("id") % 3 == 0).select(F.col("id").alias("failure_id"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B.3: a prediction table over prompts (wrong for doc_id % 9 = 0)."""
    p = prompts(spark, sf_dir).select("doc_id", "label")
    pred = F.when(F.col("doc_id") % 9 == 0, F.lit(1) + F.col("label") % 3).otherwise(F.col("label"))
    return p.select("doc_id", "label", pred.cast("int").alias("predicted"))


def every_model(prompts_df: DataFrame, registry: DataFrame) -> DataFrame:
    """Each prompt once per model of ``registry`` (its keys are read once,
    size-checked, and unfolded per row)."""
    rows = ct.config_rows(registry.select("registry_order", "model_key"), ct.MAX_REGISTRY_ROWS, "model registry")
    keys = [r["model_key"] for r in sorted(rows)]
    return prompts_df.select("*", F.explode(F.array(*map(F.lit, keys))).alias("model_key"))


def baseline_runs(spark: SparkSession, sf_dir: str, registry: DataFrame | None = None) -> DataFrame:
    """Every prompt run once on every registry model (the baseline run).

    The run fails for doc_id % 13 = 0 on ``mid``."""
    registry = ct.model_registry(spark) if registry is None else registry
    p = prompts(spark, sf_dir).select("doc_id", F.col("label").alias("expected_tier"), "prompt")
    runs = every_model(p, registry)
    did = F.col("doc_id")
    factor = F.when(F.col("model_key") == "large", F.lit(3)).when(F.col("model_key") == "mid", F.lit(2)).otherwise(F.lit(1))
    ok = ~((did % 13 == 0) & (F.col("model_key") == "mid"))
    return runs.select(
        did.alias("prompt_index"), "expected_tier", "model_key",
        ok.alias("success"),
        F.when(ok, F.floor(F.length("prompt") / 4).cast("bigint")).alias("input_tokens"),
        F.when(ok, (F.lit(40) + did % 200 * factor).cast("bigint")).alias("output_tokens"),
        F.when(ok, (F.lit(200.0) + (did % 97).cast("double") * F.lit(3.0) * factor.cast("double"))).alias("latency_ms"),
    )


def fixed_scores(rows: DataFrame) -> DataFrame:
    """A scorer of known outcome in place of a fitted model: tier and
    confidence by formula from the features."""
    s = (F.col("reasoning_keywords") + F.col("complexity_keywords") + F.col("num_constraints")) / F.lit(2.0) + F.col("word_count") / F.lit(100.0)
    return rows.select("*", F.when(s < 0.75, F.lit(1)).when(s < 1.5, F.lit(2)).otherwise(F.lit(3)).alias("complexity_tier"),
                       (F.lit(0.5) + (F.col("char_count") % F.lit(50.0)) / F.lit(100.0)).alias("classifier_conf"))


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B.3 ``bad_requests``: one chat request per conversation, with request
    parameters by conv_id % 7 (1 empty content, 2 temperature 5.0,
    3 max_tokens 0, 4 no messages, 5 max_tokens 9000, 6 temperature 1.5)."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    m = F.col("conv_id") % 7
    turns = conv.select(
        "conv_id", "turn", "role",
        F.when(m == 1, F.lit("")).otherwise(F.col("text")).alias("content"),
        (m == 4).alias("__dropped"))
    return turns.select(
        "conv_id", "turn", "role", "content",
        F.when(m == 5, F.lit(9000)).when(m == 3, F.lit(0)).alias("max_tokens"),
        F.when(m == 2, F.lit(5.0)).when(m == 6, F.lit(1.5)).alias("temperature"),
        F.when(m == 0, F.concat(F.lit("user-"), F.col("conv_id").cast("string"))).alias("user_id"),
        "__dropped")
