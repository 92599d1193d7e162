"""The named queries: each is ``(spark, sf_dir) -> DataFrame`` over the
driver tables, registered with its DuckDB twin (or none when the result
is not SQL-expressible, e.g. a fitted model's predictions)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as rep
from ..sources import config_tables as ct
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .oracle import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ A1

@query("savings_summary", with_views(["request_log"], """
SELECT COUNT(*) AS total_requests,
  coalesce(CAST(round(sum(cost_usd), 6) AS DOUBLE), 0.0) AS total_cost_usd,
  coalesce(CAST(round(sum(cost_if_highest_quality), 6) AS DOUBLE), 0.0) AS total_baseline_cost,
  coalesce(CAST(round(sum(cost_if_highest_quality) - sum(cost_usd), 6) AS DOUBLE), 0.0) AS savings_usd,
  coalesce(CAST(round((1 - sum(cost_usd) / nullif(sum(cost_if_highest_quality), 0)) * 100, 1) AS DOUBLE), 0.0)
    AS savings_pct,
  round(avg(quality_score), 2) AS avg_quality_score,
  round(avg(CASE WHEN quality_score >= 0 THEN quality_score END), 2) AS avg_quality_verified,
  coalesce(round(avg(latency_ms), 0), 0.0) AS avg_latency_ms
FROM request_log"""))
def q_savings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rep.savings_summary(_log(spark, sf_dir))


# ------------------------------------------------------------ shared inputs

from ..functions import text as tx  # noqa: E402
from ..operators import costs as cst  # noqa: E402
from ..operators import escalation as esc  # noqa: E402
from ..operators import routing as rt  # noqa: E402
from ..operators import verdicts as vd  # noqa: E402
from ..operators.percentiles import exact_percentiles  # noqa: E402
from .. import settings as S  # noqa: E402


# Shared inputs, planned anew at every call: files that arrived since the
# last one are seen.

def _log(spark, sf):
    return fx.request_log(spark, sf)


def _prompts(spark, sf):
    return fx.prompts(spark, sf)


def _completions(spark, sf):
    return fx.completions(spark, sf, _log(spark, sf))


def _outcomes(spark, sf, pick=lambda log: log):
    """Escalation outcomes of the requests that ``pick`` takes from the log (default: all)."""
    log = _log(spark, sf)
    return esc.escalation_outcomes(pick(log), fx.completions(spark, sf, log), ct.model_registry(spark))


def _verdict_text(spark, sf):
    return fx.verdict_text(spark, sf, _log(spark, sf))


def _verdicts(spark, sf):
    return fx.verdicts(spark, sf, _log(spark, sf))


def _predictions(spark, sf):
    return fx.predictions(spark, sf)


def _log_esc(spark, sf):
    """Request log with its escalation outcome (every request appears once
    in the outcomes, so no second join is needed; the K8 / J4 merge of a
    separate escalation table is ``requests_with_escalation``)."""
    return _outcomes(spark, sf)


def _newest(spark, sf, n):
    """Outcomes of the newest ``n`` requests: the limit comes before the join
    with the re-runs."""
    return _outcomes(spark, sf, lambda log: rep.newest(log, n))


def _last_week(log):
    return rep.since(log, rep.default_as_of(log), 7)


def _dbl(c):
    return F.col(c).cast("double").alias(c)


_OUTCOMES_SQL = f"""
outcomes AS (
  SELECT l.*, c.prompt_id IS NOT NULL AS escalated,
    CASE WHEN c.prompt_id IS NOT NULL THEN (SELECT model_id FROM best_model) END AS escalated_model,
    CASE WHEN c.prompt_id IS NOT NULL THEN
      CAST(round(CAST(c.input_tokens AS DECIMAL(12,0)) * (SELECT price_in_per_token FROM best_model)
        + CAST(c.output_tokens AS DECIMAL(12,0)) * (SELECT price_out_per_token FROM best_model), 8) AS DECIMAL(18,8))
      ELSE CAST(0 AS DECIMAL(18,8)) END AS cost_delta_usd,
    CASE WHEN c.prompt_id IS NOT NULL THEN printf('quality_gap=%.1f cheap_score=%.1f', l.quality_gap, l.quality_score)
      ELSE 'escalation_api_failed' END AS reason
  FROM request_log l LEFT JOIN (SELECT prompt_id, model_key, max(input_tokens) AS input_tokens,
      max(output_tokens) AS output_tokens FROM completions GROUP BY ALL) c
    ON c.prompt_id = l.id AND c.model_key = (SELECT model_key FROM best_model)
  WHERE l.decision = 'escalate'
  UNION ALL
  SELECT l.*, false, CAST(NULL AS VARCHAR), CAST(0 AS DECIMAL(18,8)), l.decision
  FROM request_log l WHERE l.decision <> 'escalate'),
log_esc AS (
  SELECT l.*, coalesce(o.escalated, false) AS escalated, o.escalated_model,
    coalesce(o.cost_delta_usd, CAST(0 AS DECIMAL(18,8))) AS cost_delta_usd
  FROM request_log l LEFT JOIN (SELECT id, escalated, escalated_model, cost_delta_usd FROM outcomes) o ON o.id = l.id)"""


def _esc_sql(body: str, *more: str) -> str:
    """Oracle text over ``outcomes`` / ``log_esc``."""
    w = with_views(["request_log", "completions", "best_model", *more], "")
    return w.rstrip() + ",\n" + _OUTCOMES_SQL + "\n" + body


# ------------------------------------------------------------ A2 - A12

_AS_OF_7 = "day >= CAST((SELECT max(ts) FROM request_log) AS DATE) - 7"


@query("escalation_rate_7d", _esc_sql(f"""
SELECT count(*) AS num_requests,
  coalesce(round(avg(CAST(escalated AS INTEGER)) * 100, 1), 0.0) AS escalation_rate_pct
FROM log_esc WHERE {_AS_OF_7}"""))
def q_escalation_rate_7d(spark, sf):
    # the window is cut on the log, before the join with the re-runs
    return rep.escalation_rate(_outcomes(spark, sf, _last_week), days=None)


@query("requests_by_tier", with_views(["request_log"], """
SELECT complexity_tier, count(*) AS n FROM request_log WHERE complexity_tier IS NOT NULL GROUP BY complexity_tier"""))
def q_requests_by_tier(spark, sf):
    return rep.requests_by_tier(_log(spark, sf))


@query("requests_by_model", with_views(["request_log"], """
SELECT routed_model, count(*) AS n, round(avg(quality_score), 2) AS avg_quality
FROM request_log GROUP BY routed_model ORDER BY n DESC, routed_model"""))
def q_requests_by_model(spark, sf):
    return rep.requests_by_model(_log(spark, sf))


@query("summary_maps", with_views(["request_log"], """
SELECT 'tier' AS kind, CAST(complexity_tier AS VARCHAR) AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS avg_quality
FROM request_log WHERE complexity_tier IS NOT NULL GROUP BY complexity_tier
UNION ALL
SELECT 'model', routed_model, count(*), round(avg(quality_score), 2) FROM request_log GROUP BY routed_model"""))
def q_summary_maps(spark, sf):
    """The two nested maps of the stats answer, unfolded to rows."""
    maps = rep.summary_maps(_log(spark, sf))
    tiers = maps.select(F.explode("requests_by_tier").alias("key", "n")).select(
        F.lit("tier").alias("kind"), "key", "n", F.lit(None).cast("double").alias("avg_quality"))
    models = maps.select(F.explode("requests_by_model").alias("key", "v")).select(
        F.lit("model").alias("kind"), "key", F.col("v.count").alias("n"), "v.avg_quality")
    return tiers.unionByName(models)


@query("recent_requests", _esc_sql("""
SELECT id, ts, complexity_tier, classifier_conf, routed_model, CAST(cost_usd AS DOUBLE) AS cost_usd,
  CAST(cost_if_highest_quality AS DOUBLE) AS cost_if_highest_quality, latency_ms, quality_score, escalated,
  escalated_model
FROM log_esc ORDER BY ts DESC, id DESC LIMIT 50"""))
def q_recent_requests(spark, sf):
    r = rep.recent_requests(_newest(spark, sf, 50), 50)
    return r.select(*[_dbl(c) if c in ("cost_usd", "cost_if_highest_quality") else F.col(c) for c in r.columns])


@query("recent_requests_tier_filter", _esc_sql("""
SELECT * FROM (SELECT id, ts, complexity_tier, routed_model FROM log_esc ORDER BY ts DESC, id DESC LIMIT 50)
WHERE complexity_tier IN (2, 3)"""))
def q_recent_requests_tier_filter(spark, sf):
    return rep.recent_with_tier_filter(_newest(spark, sf, 50), [2, 3], 50).select(
        "id", "ts", "complexity_tier", "routed_model")


@query("daily_cost", with_views(["request_log"], """
SELECT day, CAST(round(sum(cost_usd), 6) AS DOUBLE) AS cost_actual,
  CAST(round(sum(cost_if_highest_quality), 6) AS DOUBLE) AS cost_baseline, count(*) AS num_requests
FROM request_log GROUP BY day ORDER BY day"""))
def q_daily_cost(spark, sf):
    return rep.daily_cost(_log(spark, sf))


@query("daily_escalation", _esc_sql("""
SELECT day, round(avg(CAST(escalated AS INTEGER)) * 100, 1) AS escalation_rate, count(*) AS num_requests
FROM log_esc GROUP BY day ORDER BY day"""))
def q_daily_escalation(spark, sf):
    return rep.daily_escalation(_log_esc(spark, sf))


@query("daily_cost_7d", with_views(["request_log"], f"""
SELECT day, CAST(round(sum(cost_usd), 6) AS DOUBLE) AS cost_actual,
  CAST(round(sum(cost_if_highest_quality), 6) AS DOUBLE) AS cost_baseline, count(*) AS num_requests
FROM request_log WHERE {_AS_OF_7} GROUP BY day ORDER BY day"""))
def q_daily_cost_7d(spark, sf):
    return rep.daily_cost(_log(spark, sf), days=7)


@query("daily_escalation_7d", _esc_sql(f"""
SELECT day, round(avg(CAST(escalated AS INTEGER)) * 100, 1) AS escalation_rate, count(*) AS num_requests
FROM log_esc WHERE {_AS_OF_7} GROUP BY day ORDER BY day"""))
def q_daily_escalation_7d(spark, sf):
    return rep.daily_escalation(_outcomes(spark, sf, _last_week))


@query("daily_escalation_alert", _esc_sql(f"""
SELECT max(escalation_rate) AS max_daily_rate, coalesce(max(escalation_rate > {S.ALERT_RATE_PCT}), false) AS alert
FROM (SELECT day, round(avg(CAST(escalated AS INTEGER)) * 100, 1) AS escalation_rate FROM log_esc GROUP BY day)"""))
def q_daily_escalation_alert(spark, sf):
    return rep.daily_escalation_alert(_log_esc(spark, sf))


@query("quality_histogram", with_views(["request_log"], """
SELECT bin, CASE WHEN bin < 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) + bin * CAST(0.25 AS DOUBLE) END AS bin_start,
  count(*) AS n
FROM (SELECT CASE WHEN quality_score < 0 THEN -1
             ELSE least(19, greatest(0, CAST(floor((quality_score - CAST(0.5 AS DOUBLE)) / CAST(0.25 AS DOUBLE))
               AS INTEGER))) END AS bin
      FROM request_log WHERE quality_score IS NOT NULL)
GROUP BY bin ORDER BY bin"""))
def q_quality_histogram(spark, sf):
    return rep.quality_histogram(_log(spark, sf))


@query("routing_distribution", with_views(["request_log", "registry"], """
SELECT c.routed_model, coalesce(r.display_name, c.routed_model) AS display_name, c.n,
  round(c.n * 100.0 / (SELECT count(*) FROM request_log), 1) AS share_pct
FROM (SELECT routed_model, count(*) AS n FROM request_log GROUP BY routed_model) c
LEFT JOIN registry r ON r.model_key = c.routed_model ORDER BY n DESC, routed_model"""))
def q_routing_distribution(spark, sf):
    return rep.routing_distribution(_log(spark, sf), ct.model_registry(spark))


@query("tier_distribution", with_views(["request_log"], """
SELECT complexity_tier, count(*) AS n,
  round(count(*) * 100.0 / (SELECT count(*) FROM request_log WHERE complexity_tier IS NOT NULL), 1) AS share_pct
FROM request_log WHERE complexity_tier IS NOT NULL GROUP BY complexity_tier ORDER BY complexity_tier"""))
def q_tier_distribution(spark, sf):
    return rep.tier_distribution(_log(spark, sf))


@query("escalation_alert", _esc_sql(f"""
SELECT n, coalesce(rate_pct, 0.0) AS rate_pct,
  CASE WHEN n < {S.ALERT_MIN_ROWS} THEN 'silent' WHEN coalesce(rate_pct, 0.0) > {S.ALERT_RATE_PCT} THEN 'alert'
       ELSE 'ok' END AS status
FROM (SELECT count(*) AS n, round(avg(CAST(escalated AS INTEGER)) * 100, 1) AS rate_pct
      FROM (SELECT escalated FROM log_esc ORDER BY ts DESC, id DESC LIMIT {S.ALERT_WINDOW}))"""))
def q_escalation_alert(spark, sf):
    return rep.escalation_alert(_newest(spark, sf, S.ALERT_WINDOW))


@query("audit_view", _esc_sql("""
SELECT id, strftime(ts, '%H:%M:%S') AS time, complexity_tier AS tier, routed_model AS model,
  '$' || CAST(CAST(round(cost_usd, 6) AS DECIMAL(18,6)) AS VARCHAR) AS cost,
  '$' || CAST(CAST(round(cost_if_highest_quality, 6) AS DECIMAL(18,6)) AS VARCHAR) AS baseline,
  CAST(CAST(round(latency_ms, 0) AS BIGINT) AS VARCHAR) AS latency,
  CASE WHEN quality_score IS NULL THEN '—' ELSE printf('%.1f', quality_score) END AS quality,
  CASE WHEN escalated THEN 'Yes' ELSE '' END AS escalated,
  CASE WHEN length(pv) > 60 THEN substring(pv, 1, 60) || '…' ELSE pv END AS prompt
FROM (SELECT e.*, substring(p.prompt, 1, 150) AS pv
      FROM (SELECT * FROM log_esc ORDER BY ts DESC, id DESC LIMIT 50) e
      LEFT JOIN prompts p ON p.doc_id = abs(e.id) % (SELECT count(*) FROM documents))""", "prompts"))
def q_audit_view(spark, sf):
    newest = _newest(spark, sf, 50)
    shown = fx.with_prompts(spark, sf, newest, "id", pr.previews()[:1], prompts_df=_prompts(spark, sf))
    return rep.audit_view(rep.recent_requests(shown, 50, extra=("prompt_preview",)))


@query("audit_flags", _esc_sql(f"""
SELECT id, CASE WHEN escalated THEN 'escalated' WHEN quality_score < {S.MIN_CHEAP_SCORE} THEN 'low_quality'
  ELSE 'none' END AS flag
FROM log_esc"""))
def q_audit_flags(spark, sf):
    return _log_esc(spark, sf).select("id", rep.row_flag().alias("flag"))


@query("latency_percentiles", with_views(["request_log"], """
SELECT n,
  max(CASE WHEN r = floor(n * 0.5) THEN latency_ms END) AS p50,
  max(CASE WHEN r = floor(n * 0.95) THEN latency_ms END) AS p95,
  max(CASE WHEN r = floor(n * 0.99) THEN latency_ms END) AS p99
FROM (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS r, count(*) OVER () AS n
      FROM request_log WHERE event_type <> 'error' AND latency_ms IS NOT NULL)
GROUP BY n"""))
def q_latency_percentiles(spark, sf):
    ok = _log(spark, sf).where(F.col("event_type") != "error")
    return exact_percentiles(ok, "latency_ms", [0.5, 0.95, 0.99], ["p50", "p95", "p99"])


@query("run_checks", with_views(["request_log"], """
SELECT total_requests, total_baseline_cost, savings_usd,
  total_requests >= 20 AS enough_rows, total_baseline_cost > 0 AS baseline_positive, savings_usd > 0 AS savings_positive,
  (total_requests >= 20 AND total_baseline_cost > 0 AND savings_usd > 0) AS passed
FROM (SELECT count(*) AS total_requests,
        coalesce(CAST(round(sum(cost_if_highest_quality), 6) AS DOUBLE), 0.0) AS total_baseline_cost,
        coalesce(CAST(round(sum(cost_if_highest_quality) - sum(cost_usd), 6) AS DOUBLE), 0.0) AS savings_usd
      FROM request_log)"""))
def q_run_checks(spark, sf):
    return rep.run_checks(rep.savings_summary(_log(spark, sf)))


_RUN_OK = "event_type <> 'error'"


@query("run_report", with_views(["request_log"], f"""
SELECT sent, succeeded, round(succeeded * 100.0 / sent, 0) AS success_pct, sent - succeeded AS errors,
  coalesce(CAST(round(c, 6) AS DOUBLE), 0.0) AS total_cost_usd,
  coalesce(CAST(round(b, 6) AS DOUBLE), 0.0) AS total_baseline_cost,
  coalesce(CAST(round(b - c, 6) AS DOUBLE), 0.0) AS savings_usd,
  CASE WHEN b > 0 THEN CAST(round((1 - c / b) * 100, 1) AS DOUBLE) END AS savings_pct
FROM (SELECT count(*) AS sent, count(CASE WHEN {_RUN_OK} THEN 1 END) AS succeeded,
        sum(CASE WHEN {_RUN_OK} THEN cost_usd END) AS c, sum(CASE WHEN {_RUN_OK} THEN cost_if_highest_quality END) AS b
      FROM request_log)"""))
def q_run_report(spark, sf):
    log = _log(spark, sf).withColumn("success", F.col("event_type") != "error")
    return rep.run_totals(log)


@query("run_routing_distribution", with_views(["request_log", "registry"], f"""
SELECT c.routed_model, coalesce(r.display_name, c.routed_model) AS display_name, c.n,
  round(c.n * 100.0 / (SELECT count(*) FROM request_log WHERE {_RUN_OK}), 1) AS share_pct
FROM (SELECT routed_model, count(*) AS n FROM request_log WHERE {_RUN_OK} GROUP BY routed_model) c
LEFT JOIN registry r ON r.model_key = c.routed_model"""))
def q_run_routing_distribution(spark, sf):
    return rep.routing_distribution(_log(spark, sf), ct.model_registry(spark), F.col("event_type") != "error")


# ------------------------------------------------------------ A15, A16, J5, C7

def _priced_runs(spark, sf):
    reg = ct.model_registry(spark)
    return cst.price_requests(fx.baseline_runs(spark, sf, reg), reg, model_col="model_key")


_SAV1 = ("CASE WHEN cost_if_highest_quality = 0 THEN 0.0 ELSE round(CAST((cost_if_highest_quality - cost_usd) "
         "/ cost_if_highest_quality * 100 AS DOUBLE), 1) END")


@query("cost_matrix", with_views(["priced_runs"], f"""
SELECT prompt_index, model_key, success, CAST(cost_usd AS DOUBLE) AS cost_usd,
  CAST(cost_if_highest_quality AS DOUBLE) AS cost_if_highest_quality, {_SAV1} AS savings_pct
FROM priced_runs"""))
def q_cost_matrix(spark, sf):
    p = _priced_runs(spark, sf)
    sav = cst.savings_columns(pct_places=1)[1]
    return p.select("prompt_index", "model_key", "success", _dbl("cost_usd"), _dbl("cost_if_highest_quality"), sav)


@query("baseline_by_model", with_views(["priced_runs", "registry"], f"""
SELECT g.model_key, g.display_name, coalesce(a.runs, 0) AS runs, coalesce(a.succeeded, 0) AS succeeded,
  round(CAST(a.c AS DOUBLE), 8) AS avg_cost_usd, round(a.l, 1) AS avg_latency_ms, round(a.s, 1) AS avg_savings_pct
FROM registry g LEFT JOIN (
  SELECT model_key, count(*) AS runs, count(CASE WHEN success THEN 1 END) AS succeeded,
    avg(CASE WHEN success THEN cost_usd END) AS c, avg(CASE WHEN success THEN latency_ms END) AS l,
    avg(CASE WHEN success THEN {_SAV1} END) AS s
  FROM priced_runs GROUP BY model_key) a ON a.model_key = g.model_key
ORDER BY g.registry_order"""))
def q_baseline_by_model(spark, sf):
    p = _priced_runs(spark, sf)
    runs = p.select("*", cst.savings_columns(pct_places=1)[1])
    return rep.baseline_by_model(runs, ct.model_registry(spark))


@query("baseline_overall", with_views(["priced_runs"], """
SELECT sent, succeeded, round(succeeded * 100.0 / sent, 0) AS success_pct, sent - succeeded AS errors,
  coalesce(CAST(round(c, 6) AS DOUBLE), 0.0) AS total_cost_usd,
  coalesce(CAST(round(b, 6) AS DOUBLE), 0.0) AS total_baseline_cost,
  coalesce(CAST(round(b - c, 6) AS DOUBLE), 0.0) AS savings_usd,
  CASE WHEN b > 0 THEN CAST(round((1 - c / b) * 100, 1) AS DOUBLE) END AS savings_pct
FROM (SELECT count(*) AS sent, count(CASE WHEN success THEN 1 END) AS succeeded,
        sum(CASE WHEN success THEN cost_usd END) AS c, sum(CASE WHEN success THEN cost_if_highest_quality END) AS b
      FROM priced_runs)"""))
def q_baseline_overall(spark, sf):
    return rep.run_totals(_priced_runs(spark, sf))


# ------------------------------------------------------------ routing / costs

@query("route_requests", with_views(["request_log"], """
SELECT id, complexity_tier, classifier_conf, low_confidence, routed_model FROM request_log"""))
def q_route_requests(spark, sf):
    return _log(spark, sf).select("id", "complexity_tier", "classifier_conf", "low_confidence", "routed_model")


_RETIRED = {"tier_3_model": "retired-model"}


def _patched_settings(spark, patch: dict):
    p = ct.local_table(spark, [(k, str(v)) for k, v in patch.items()], ct.SETTINGS_SCHEMA)
    return rt.apply_patch(ct.routing_settings(spark), p)


def _patched_log(spark, sf, patch: dict, keep: tuple[str, ...] = ()):
    """R4 + R2 + J2 + C1: the request log re-routed and re-priced under a
    patched routing map; ``keep`` names columns of the first routing that
    stay, prefixed with ``was_``."""
    log = _log(spark, sf)
    base = (log.select("*", *[F.col(c).alias(f"was_{c}") for c in keep])
            .drop("low_confidence", "routed_model", "cost_usd", "cost_if_highest_quality"))
    reg = ct.model_registry(spark)
    routed = rt.resolve_model(rt.route(base, _patched_settings(spark, patch)), reg)
    return cst.price_requests(routed, reg)


@query("route_unknown_model", with_views(["request_log", "cheapest_model", "registry"], f"""
SELECT priced_model, count(*) AS n, CAST(sum(cost) AS DOUBLE) AS cost_usd
FROM (
  SELECT coalesce(g.model_key, (SELECT model_key FROM cheapest_model)) AS priced_model,
    CAST(round(CAST(input_tokens AS DECIMAL(12,0)) * p.price_in_per_token
      + CAST(output_tokens AS DECIMAL(12,0)) * p.price_out_per_token, 8) AS DECIMAL(18,8)) AS cost
  FROM (SELECT *, CASE WHEN low_confidence THEN '{S.ROUTING['fallback_model']}'
                       WHEN complexity_tier = 3 THEN 'retired-model' ELSE routed_model END AS patched_model
        FROM request_log) l
  LEFT JOIN registry g ON g.model_key = l.patched_model
  LEFT JOIN registry p ON p.model_key = coalesce(g.model_key, (SELECT model_key FROM cheapest_model)))
GROUP BY priced_model"""))
def q_route_unknown_model(spark, sf):
    """A rule pointing at a model missing from the registry is priced
    as the cheapest model."""
    priced = _patched_log(spark, sf, _RETIRED)
    return priced.groupBy(F.col("routed_model").alias("priced_model")).agg(F.count(F.lit(1)).alias("n"),
                                              F.sum("cost_usd").cast("double").alias("cost_usd"))


_REROUTE = {"tier_2_model": "small"}


@query("reroute_savings", with_views(["request_log", "registry", "best_model"], f"""
SELECT scenario, count(*) AS total_requests, CAST(round(sum(cost), 6) AS DOUBLE) AS total_cost_usd,
  CAST(round(sum(cost_if_highest_quality), 6) AS DOUBLE) AS total_baseline_cost,
  CAST(round((1 - sum(cost) / sum(cost_if_highest_quality)) * 100, 1) AS DOUBLE) AS savings_pct
FROM (
  SELECT 'current' AS scenario, cost_usd AS cost, cost_if_highest_quality FROM request_log
  UNION ALL
  SELECT 'patched', CAST(round(CAST(input_tokens AS DECIMAL(12,0)) * p.price_in_per_token
      + CAST(output_tokens AS DECIMAL(12,0)) * p.price_out_per_token, 8) AS DECIMAL(18,8)), cost_if_highest_quality
  FROM (SELECT *, CASE WHEN low_confidence THEN '{S.ROUTING['fallback_model']}'
                       WHEN complexity_tier = 2 THEN 'small' ELSE routed_model END AS m FROM request_log) l
  LEFT JOIN registry p ON p.model_key = l.m)
GROUP BY scenario"""))
def q_reroute_savings(spark, sf):
    """R4 + R5: replay the log under a patched tier map and compare."""
    patched = _patched_log(spark, sf, _REROUTE, keep=("cost_usd",))
    # both costs of a request come from one read of the log
    scenario = F.array(F.struct(F.lit("current").alias("scenario"), F.col("was_cost_usd").alias("cost_usd")),
                       F.struct(F.lit("patched").alias("scenario"), F.col("cost_usd")))
    both = patched.select("cost_if_highest_quality", F.inline(scenario))
    c, b = F.sum("cost_usd"), F.sum("cost_if_highest_quality")
    return both.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("total_requests"), F.round(c, 6).cast("double").alias("total_cost_usd"),
        F.round(b, 6).cast("double").alias("total_baseline_cost"),
        F.round((F.lit(1) - c.cast("double") / b.cast("double")) * 100, 1).alias("savings_pct"))


@query("request_costs", with_views(["request_log"], """
SELECT id, routed_model, input_tokens, output_tokens, CAST(cost_usd AS DOUBLE) AS cost_usd,
  CAST(cost_if_highest_quality AS DOUBLE) AS cost_if_highest_quality FROM request_log"""))
def q_request_costs(spark, sf):
    return _log(spark, sf).select("id", "routed_model", "input_tokens", "output_tokens", _dbl("cost_usd"),
                                  _dbl("cost_if_highest_quality"))


@query("request_savings", with_views(["request_log"], """
SELECT id, CAST(cost_if_highest_quality - cost_usd AS DOUBLE) AS savings_usd,
  CASE WHEN cost_if_highest_quality = 0 THEN 0.0
       ELSE CAST(round((cost_if_highest_quality - cost_usd) / cost_if_highest_quality * 100, 2) AS DOUBLE) END
    AS savings_pct,
  input_tokens + output_tokens AS total_tokens
FROM request_log"""))
def q_request_savings(spark, sf):
    log = _log(spark, sf)
    return log.select("id", *cst.savings_columns(),
                      (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


@query("judge_costs", with_views(["verdict_text", "best_model"], """
SELECT id, CAST(CAST(round(CAST(200 + id % 50 AS DECIMAL(12,0)) * (SELECT price_in_per_token FROM best_model)
  + CAST(floor(length(raw) / 4) AS DECIMAL(12,0)) * (SELECT price_out_per_token FROM best_model), 8)
  AS DECIMAL(18,8)) AS DOUBLE) AS judge_cost_usd
FROM verdict_text"""))
def q_judge_costs(spark, sf):
    """Each judge call priced at the best model (inputs: a fixed
    instruction overhead plus a per-request part; output: the verdict)."""
    vt = _verdict_text(spark, sf).select(
        "id", (F.lit(200) + F.col("id") % 50).alias("judge_input_tokens"),
        F.floor(F.length("raw") / 4).alias("judge_output_tokens"))
    return cst.judge_costs(vt, ct.model_registry(spark)).select("id", _dbl("judge_cost_usd"))


@query("model_usage", with_views(["request_log", "registry"], """
SELECT g.model_key, g.provider, g.model_id, CAST(g.cost_per_1k_input_usd AS DOUBLE) AS cost_per_1k_input_usd,
  CAST(g.cost_per_1k_output_usd AS DOUBLE) AS cost_per_1k_output_usd, g.quality_tier, g.avg_latency_ms,
  g.display_name, coalesce(u.n, 0) AS requests, coalesce(CAST(u.c AS DOUBLE), 0.0) AS cost_usd
FROM registry g LEFT JOIN (SELECT routed_model, count(*) AS n, sum(cost_usd) AS c FROM request_log
  GROUP BY routed_model) u ON u.routed_model = g.model_key"""))
def q_model_usage(spark, sf):
    """The model listing with its traffic and spend."""
    reg = ct.model_registry(spark)
    use = _log(spark, sf).groupBy("routed_model").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("c"))
    j = reg.join(use, reg["model_key"] == use["routed_model"], "left")
    return j.select("model_key", "provider", "model_id", _dbl("cost_per_1k_input_usd"),
                    _dbl("cost_per_1k_output_usd"), "quality_tier", "avg_latency_ms", "display_name",
                    F.coalesce(F.col("n"), F.lit(0)).alias("requests"),
                    F.coalesce(F.col("c").cast("double"), F.lit(0.0)).alias("cost_usd"))


# ------------------------------------------------------------ K1

from ..operators import completion as cpl  # noqa: E402
from ..operators import prompts as pr  # noqa: E402
from ..operators import sinks as snk  # noqa: E402


@query("request_rows", with_views(["request_log", "prompts", "completions", "registry"], f"""
SELECT l.id, l.ts, l.day, coalesce(CAST(l.user_id AS VARCHAR), '{S.DEFAULT_USER_ID}') AS user_id,
  substring(sha256(p.prompt), 1, {S.PROMPT_HASH_HEX}) AS prompt_hash,
  substring(p.prompt, 1, {S.PROMPT_PREVIEW_CHARS}) AS prompt_preview,
  l.complexity_tier, l.classifier_conf, coalesce(l.low_confidence, false) AS low_confidence, l.routed_model,
  g.provider, l.input_tokens, l.output_tokens, CAST(l.cost_usd AS DOUBLE) AS cost_usd,
  CAST(l.cost_if_highest_quality AS DOUBLE) AS cost_if_highest_quality, l.latency_ms,
  substring(c.output_text, 1, {S.OUTPUT_PREVIEW_CHARS}) AS output_preview
FROM request_log l
LEFT JOIN prompts p ON p.doc_id = abs(l.id) % (SELECT count(*) FROM documents)
LEFT JOIN registry g ON g.model_key = l.routed_model
LEFT JOIN (SELECT prompt_id, max(output_text) AS output_text FROM completions GROUP BY prompt_id) c
  ON c.prompt_id = l.id"""))
def q_request_rows(spark, sf):
    """K1: the request-log row as appended (hash of the whole prompt,
    150 / 200-character previews, provider from the registry)."""
    reg = ct.model_registry(spark)
    ct.registry_facts(reg)                           # size-checked before the broadcast
    reg = reg.select(F.col("model_key").alias("routed_model"), "provider")
    out = (_completions(spark, sf).groupBy(F.col("prompt_id").alias("id"))
           .agg(F.max("output_text").alias("output_text")))
    # hash and preview are taken on the prompts side: the join moves them,
    # not whole texts
    prompt_cols = [pr.prompt_hash().alias("prompt_hash"), *pr.previews()]
    df = (fx.with_prompts(spark, sf, _log(spark, sf), "id", prompt_cols, prompts_df=_prompts(spark, sf))
          .join(F.broadcast(reg), "routed_model", "left")
          .join(out, "id", "left"))
    rows = snk.request_rows(df)
    return rows.select(*[_dbl(c) if c in ("cost_usd", "cost_if_highest_quality") else F.col(c)
                         for c in rows.columns])


# ------------------------------------------------------------ prompts / features

@query("extract_prompt", """
SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), arg_max(text, turn)) AS prompt
FROM conversations GROUP BY conv_id""")
def q_extract_prompt(spark, sf):
    return pr.extract_prompts(read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text"))


@query("validate_requests", with_views(["chat_requests"], f"""
SELECT conv_id, n_messages, mt AS max_tokens, temp AS temperature, coalesce(uid, 'default') AS user_id,
  CASE WHEN reason IS NULL THEN coalesce(up, lp) END AS prompt,
  CASE WHEN reason IS NULL THEN 'valid' ELSE 'rejected' END AS status, reason AS reject_reason
FROM (
  SELECT *, CASE WHEN n_messages = 0 THEN 'no_messages' WHEN empty THEN 'empty_content'
      WHEN mt < 1 OR mt > {S.MAX_TOKENS_LIMIT} THEN 'max_tokens_out_of_range'
      WHEN temp < 0 OR temp > {S.MAX_TEMPERATURE} THEN 'temperature_out_of_range' END AS reason
  FROM (
    SELECT conv_id, count(CASE WHEN NOT __dropped THEN 1 END) AS n_messages,
      coalesce(bool_or(CASE WHEN NOT __dropped THEN length(content) = 0 END), false) AS empty,
      arg_max(content, turn) FILTER (WHERE NOT __dropped AND role = 'user') AS up,
      arg_max(content, turn) FILTER (WHERE NOT __dropped) AS lp,
      coalesce(max(max_tokens), {S.DEFAULT_MAX_TOKENS}) AS mt,
      coalesce(max(temperature), CAST({S.DEFAULT_TEMPERATURE} AS DOUBLE)) AS temp,
      max(user_id) AS uid
    FROM chat_requests GROUP BY conv_id))"""))
def q_validate_requests(spark, sf):
    return pr.validate_requests(fx.chat_requests(spark, sf))


_FLOW_FEATURES = ", ".join(f"{e} AS {n}" for n, e in tx.sql_features("prompt").items()
                           if n in ("reasoning_keywords", "complexity_keywords", "num_constraints", "word_count", "char_count"))


@query("completion_flow", with_views(["chat_requests", "registry", "best_model", "cheapest_model", "routing_rules"], f"""
SELECT conv_id, substring(sha256(prompt), 1, {S.PROMPT_HASH_HEX}) AS prompt_hash, complexity_tier, classifier_conf, low_confidence,
  routed_model, provider, input_tokens, max_tokens AS output_tokens,
  CAST(CAST(round(CAST(input_tokens AS DECIMAL(12,0)) * price_in_per_token + CAST(max_tokens AS DECIMAL(12,0)) * price_out_per_token, 8)
    AS DECIMAL(18,8)) AS DOUBLE) AS cost_usd,
  CAST(CAST(round(CAST(input_tokens AS DECIMAL(12,0)) * (SELECT price_in_per_token FROM best_model)
    + CAST(max_tokens AS DECIMAL(12,0)) * (SELECT price_out_per_token FROM best_model), 8) AS DECIMAL(18,8)) AS DOUBLE) AS cost_if_highest_quality
FROM (
  SELECT s.*, classifier_conf < CAST({S.ROUTING['low_confidence_threshold']} AS DOUBLE) AS low_confidence,
    CASE WHEN classifier_conf < CAST({S.ROUTING['low_confidence_threshold']} AS DOUBLE) THEN '{S.ROUTING['fallback_model']}'
         ELSE (SELECT model_key FROM routing_rules r WHERE r.tier = complexity_tier) END AS routed_model,
    CAST(floor(length(prompt) / 4) AS BIGINT) AS input_tokens
  FROM (
    SELECT conv_id, prompt, CAST(max_tokens AS BIGINT) AS max_tokens,
      CASE WHEN s < 0.75 THEN 1 WHEN s < 1.5 THEN 2 ELSE 3 END AS complexity_tier,
      CAST(0.5 AS DOUBLE) + (char_count % 50.0) / CAST(100.0 AS DOUBLE) AS classifier_conf
    FROM (SELECT *, (reasoning_keywords + complexity_keywords + num_constraints) / CAST(2.0 AS DOUBLE) + word_count / CAST(100.0 AS DOUBLE) AS s
      FROM (SELECT conv_id, prompt, max_tokens, {_FLOW_FEATURES} FROM (
        SELECT conv_id, coalesce(up, lp) AS prompt, mt AS max_tokens FROM (
          SELECT conv_id, count(CASE WHEN NOT __dropped THEN 1 END) AS n_messages,
            coalesce(bool_or(CASE WHEN NOT __dropped THEN length(content) = 0 END), false) AS empty,
            arg_max(content, turn) FILTER (WHERE NOT __dropped AND role = 'user') AS up,
            arg_max(content, turn) FILTER (WHERE NOT __dropped) AS lp, coalesce(max(max_tokens), {S.DEFAULT_MAX_TOKENS}) AS mt,
            coalesce(max(temperature), CAST({S.DEFAULT_TEMPERATURE} AS DOUBLE)) AS temp
          FROM chat_requests GROUP BY conv_id)
        WHERE n_messages > 0 AND NOT empty AND mt BETWEEN 1 AND {S.MAX_TOKENS_LIMIT} AND temp BETWEEN 0 AND {S.MAX_TEMPERATURE})))) s)
LEFT JOIN registry g ON g.model_key = routed_model"""))
def q_completion_flow(spark, sf):
    """P1 + P2 + F + M14 + R1 + R2 + J2 + C1 + K1 in one chain, with scores of
    known outcome in place of a fitted model."""
    reg = ct.model_registry(spark)
    ct.registry_facts(reg)                           # size-checked before the broadcast
    valid = pr.validate_requests(fx.chat_requests(spark, sf)).where(F.col("status") == "valid")
    done = cpl.complete(valid, fx.fixed_scores, reg, ct.routing_settings(spark))
    rows = cpl.request_rows(done.withColumns({"id": F.col("conv_id"), "ts": F.lit(None).cast("timestamp"), "latency_ms": F.lit(None).cast("double")}), reg)
    return rows.select(F.col("id").alias("conv_id"), "prompt_hash", "complexity_tier", "classifier_conf", "low_confidence", "routed_model", "provider",
                       "input_tokens", "output_tokens", _dbl("cost_usd"), _dbl("cost_if_highest_quality"))


@query("response_documents", with_views(["request_log"], """
SELECT id, '{"request_id":' || id || ',"model_id":"' || routed_model || '","input_tokens":' || input_tokens || ',"output_tokens":' || output_tokens
  || ',"total_tokens":' || (input_tokens + output_tokens) AS head, right(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 26) AS stamp FROM request_log"""))
def q_response_documents(spark, sf):
    """The response document of every request (its integer head and its
    time stamp; numbers with fractions print differently in each engine)."""
    d = pr.response_documents(_log(spark, sf))
    return d.select("id", F.regexp_extract("document", r'^(.*"total_tokens":\d+)', 1).alias("head"),
                    F.get_json_object("document", "$.timestamp").alias("stamp"))


@query("prompt_hash", with_views(["prompts"], """
SELECT doc_id, substring(sha256(prompt), 1, 16) AS prompt_hash FROM prompts"""))
def q_prompt_hash(spark, sf):
    return _prompts(spark, sf).select("doc_id", pr.prompt_hash().alias("prompt_hash"))


@query("prompt_previews", with_views(["prompts"], f"""
SELECT doc_id, substring(prompt, 1, {S.PROMPT_PREVIEW_CHARS}) AS prompt_preview,
  CASE WHEN length(prompt) > {S.AUDIT_PREVIEW_CHARS} THEN substring(prompt, 1, {S.AUDIT_PREVIEW_CHARS}) || '…'
       ELSE prompt END AS audit_preview
FROM prompts"""))
def q_prompt_previews(spark, sf):
    return _prompts(spark, sf).select("doc_id", *pr.previews(), rep.audit_preview("prompt").alias("audit_preview"))


_FEAT_SQL = tx.sql_features("prompt")


def _documents(spark, sf):
    """Whole document texts (null as empty)."""
    d = read_table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))


@query("prompt_features", with_views(["prompts"], "SELECT doc_id, label, " + ", ".join(
    f"{e} AS {n}" for n, e in _FEAT_SQL.items()) + " FROM prompts"))
def q_prompt_features(spark, sf):
    f = tx.add_features(_prompts(spark, sf))
    return f.select("doc_id", "label", *S.FEATURE_NAMES)


@query("document_features", "SELECT doc_id, " + ", ".join(
    f"{e} AS {n}" for n, e in tx.sql_features("coalesce(text, '')").items()) + " FROM documents")
def q_document_features(spark, sf):
    """F1-F14 over the raw documents (whole texts, four languages)."""
    d = _documents(spark, sf)
    return tx.add_features(d, "t").select("doc_id", *S.FEATURE_NAMES)


@query("token_estimates", "SELECT doc_id, " + ", ".join(
    f"{e} AS {n}" for n, e in tx.sql_token_estimates("coalesce(text, '')").items()) + " FROM documents")
def q_token_estimates(spark, sf):
    d = _documents(spark, sf)
    return d.select("doc_id", *tx.token_estimates("t"))


# ------------------------------------------------------------ verdicts / escalation

@query("judge_inputs", with_views(["request_log", "prompts", "completions"], """
SELECT l.id, 'ORIGINAL_PROMPT:' || chr(10) || p.prompt || chr(10) || chr(10) || 'RESPONSE_A (cheap model):' || chr(10)
  || 'cheap answer ' || CAST(l.id AS VARCHAR) || chr(10) || chr(10) || 'RESPONSE_B (reference model):' || chr(10)
  || c.output_text AS judge_input
FROM request_log l JOIN (SELECT prompt_id, max(output_text) AS output_text FROM completions GROUP BY prompt_id) c
  ON c.prompt_id = l.id
LEFT JOIN prompts p ON p.doc_id = abs(l.id) % (SELECT count(*) FROM documents)
WHERE l.quality_score >= 0"""))
def q_judge_inputs(spark, sf):
    """V1: the judge message of every verified request with a reference
    answer (whole prompt text)."""
    answers = (_completions(spark, sf).groupBy(F.col("prompt_id").alias("id"))
               .agg(F.max("output_text").alias("reference_output")))
    asked = (_log(spark, sf).where(F.col("quality_score") >= 0)
             .select("id", F.concat(F.lit("cheap answer "), F.col("id").cast("string")).alias("cheap_output"))
             .join(answers, "id"))
    p = fx.with_prompts(spark, sf, asked, "id", prompts_df=_prompts(spark, sf))
    return vd.judge_inputs(p).select("id", "judge_input")


@query("parse_verdicts", with_views(["parsed_verdicts"], """
SELECT id, parse_error, quality_score, expensive_score, quality_gap, judge_routing_correct, failure_reason
FROM parsed_verdicts"""))
def q_parse_verdicts(spark, sf):
    return vd.parse_verdicts(_verdict_text(spark, sf)).select(
        "id", "parse_error", "quality_score", "expensive_score", "quality_gap", "judge_routing_correct",
        "failure_reason")


_LATEST_SQL = """
latest AS (SELECT id, quality_score, verified_at FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY verified_at DESC, quality_score DESC) AS rn FROM verdicts)
  WHERE rn = 1)"""


def _verdict_sql(body: str) -> str:
    w = with_views(["request_log", "verdicts"], "")
    return w.rstrip() + ",\n" + _LATEST_SQL + "\n" + body


def _with_verdicts(spark, sf):
    return vd.merge_verdicts(_log(spark, sf), _verdicts(spark, sf))


@query("requests_with_verdict", _verdict_sql("""
SELECT l.id, v.quality_score, v.verified_at FROM request_log l LEFT JOIN latest v ON v.id = l.id"""))
def q_requests_with_verdict(spark, sf):
    """Latest verdict per request merged onto the log."""
    return _with_verdicts(spark, sf).select("id", "quality_score", "verified_at")


@query("verification_status", _verdict_sql(f"""
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN v.quality_score IS NULL THEN 'pending' WHEN v.quality_score = {S.VERIFY_FAILED_SENTINEL}
         THEN 'failed' ELSE 'verified' END AS status
  FROM request_log l LEFT JOIN latest v ON v.id = l.id) GROUP BY status"""))
def q_verification_status(spark, sf):
    """V5: pending / failed (sentinel) / verified after the verdict merge."""
    w = _with_verdicts(spark, sf)
    return w.groupBy(vd.verification_status(w).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("escalation_decisions", with_views(["request_log"], """
SELECT id, quality_score, quality_gap, latency_ms, decision FROM request_log"""))
def q_escalation_decisions(spark, sf):
    """V6 + V8: the decision of every request."""
    return _log(spark, sf).select("id", "quality_score", "quality_gap", "latency_ms", "decision")


@query("routing_failures", with_views(["failures"], """
SELECT id, request_id, classified_tier, correct_tier, quality_gap, failure_reason FROM failures
WHERE request_id >= 0"""))
def q_routing_failures(spark, sf):
    """V6 + V7 + K2: failures of both failure branches with the bumped tier."""
    f = esc.routing_failures(_log(spark, sf))
    return f.select((F.col("request_id") * 10 + 1).alias("id"), "request_id", "classified_tier", "correct_tier",
                    "quality_gap", "failure_reason")


@query("escalation_outcomes", _esc_sql("""
SELECT id, decision, escalated, escalated_model, CAST(cost_delta_usd AS DOUBLE) AS cost_delta_usd, reason
FROM outcomes"""))
def q_escalation_outcomes(spark, sf):
    """V9 + V10 + J11."""
    return _outcomes(spark, sf).select("id", "decision", "escalated", "escalated_model",
                                       _dbl("cost_delta_usd"), "reason")


@query("requests_with_escalation", _esc_sql("""
SELECT id, escalated, escalated_model, CAST(cost_delta_usd AS DOUBLE) AS cost_delta_usd FROM log_esc"""))
def q_requests_with_escalation(spark, sf):
    """Escalation fields of every request, defaults false / 0 (the
    outcomes hold every request once; the merge of a separate escalation
    table is ``escalation.merge_escalations``)."""
    return _outcomes(spark, sf).select("id", "escalated", "escalated_model", _dbl("cost_delta_usd"))


@query("escalation_cost", _esc_sql("""
SELECT count(*) AS escalations, CAST(sum(cost_delta_usd) AS DOUBLE) AS escalation_cost_usd,
  CAST((SELECT sum(cost_usd) FROM request_log) AS DOUBLE) AS routed_cost_usd,
  CAST((SELECT sum(cost_usd) FROM request_log) + sum(cost_delta_usd) AS DOUBLE) AS cost_with_escalations_usd
FROM log_esc WHERE escalated"""))
def q_escalation_cost(spark, sf):
    """T5: the re-run cost beside the gross headline (not added to it)."""
    le = _log_esc(spark, sf)
    routed = _log(spark, sf).agg(F.sum("cost_usd").alias("c")).scalar()
    e = le.where(F.col("escalated")).agg(F.count(F.lit(1)).alias("escalations"), F.sum("cost_delta_usd").alias("d"))
    return e.select("escalations", F.col("d").cast("double").alias("escalation_cost_usd"),
                    routed.cast("double").alias("routed_cost_usd"),
                    (routed + F.col("d")).cast("double").alias("cost_with_escalations_usd"))


# ------------------------------------------------------------ feedback loop / DQ

from ..operators import flywheel as fw  # noqa: E402
from ..operators import quality as dq  # noqa: E402


def _failures(spark, sf, *prompt_columns):
    """Failure log; prompts are joined only for ``prompt_columns``."""
    f = fx.failure_log(spark, sf, _log(spark, sf))
    if not prompt_columns:
        return f
    return fx.with_prompts(spark, sf, f, "request_id", list(prompt_columns), prompts_df=_prompts(spark, sf))


_PENDING = "SELECT f.* FROM failures f WHERE f.id NOT IN (SELECT failure_id FROM ledger)"


@query("pending_failures", with_views(["failures", "ledger"], f"""
SELECT id, prompt, correct_tier FROM ({_PENDING})"""))
def q_pending_failures(spark, sf):
    """Failures not yet consumed (dry-run peek)."""
    f = _failures(spark, sf, "prompt")
    return fw.pending_failures(f, fx.consumed_ledger(_failures(spark, sf))).select("id", "prompt", "correct_tier")


@query("pending_failure_count", with_views(["failures", "ledger"], f"""
SELECT count(*) AS pending_failures FROM ({_PENDING})"""))
def q_pending_failure_count(spark, sf):
    f = _failures(spark, sf)
    return fw.pending_count(f, fx.consumed_ledger(f))


@query("export_failures", with_views(["failures", "ledger"], f"""
SELECT id, prompt, correct_tier AS tier FROM ({_PENDING})"""))
def q_export_failures(spark, sf):
    """W2 rows (the ledger append is the job in ``flywheel.export_failures``)."""
    f = _failures(spark, sf, "prompt")
    return fw.export_rows(fw.pending_failures(f, fx.consumed_ledger(_failures(spark, sf))))


@query("training_set", with_views(["prompts", "failures", "ledger"], f"""
SELECT prompt, label AS tier FROM prompts
UNION ALL
SELECT prompt, correct_tier AS tier FROM ({_PENDING})"""))
def q_training_set(spark, sf):
    """Labelled prompts UNION ALL pending failure rows."""
    f = _failures(spark, sf, "prompt")
    labelled = _prompts(spark, sf).select("prompt", F.col("label").alias("tier"))
    return fw.training_set(labelled, fw.export_rows(fw.pending_failures(f, fx.consumed_ledger(_failures(spark, sf)))))


@query("orphan_failures", with_views(["failures", "request_log"], """
SELECT id, request_id FROM failures WHERE request_id NOT IN (SELECT id FROM request_log)"""))
def q_orphan_failures(spark, sf):
    """Failures whose request does not exist."""
    return dq.orphans(_failures(spark, sf), _log(spark, sf).select("id")).select("id", "request_id")


@query("dq_null_baseline", with_views(["request_log"], """
SELECT count(*) AS rows, count(*) FILTER (WHERE cost_if_highest_quality IS NULL) AS null_baseline
FROM request_log"""))
def q_dq_null_baseline(spark, sf):
    return dq.null_baseline(_log(spark, sf))


@query("dq_duplicate_ids", with_views(["verdicts"], """
SELECT id, count(*) AS n FROM verdicts GROUP BY id HAVING count(*) > 1"""))
def q_dq_duplicate_ids(spark, sf):
    """Q2 over the append-only verdict table (re-judged requests repeat)."""
    return dq.duplicate_ids(_verdicts(spark, sf))


# the log as an unchecked import would deliver it: some rows twice, some values out of range
_IMPORTED_SQL = """
imported AS (
  SELECT id, CASE WHEN id % 97 = 0 THEN 4 ELSE complexity_tier END AS complexity_tier,
    CASE WHEN id % 89 = 0 THEN CAST(1.5 AS DOUBLE) ELSE classifier_conf END AS classifier_conf,
    CASE WHEN id % 83 = 0 THEN CAST(7.0 AS DOUBLE) ELSE quality_score END AS quality_score,
    CASE WHEN id % 79 = 0 THEN -input_tokens ELSE input_tokens END AS input_tokens, output_tokens
  FROM request_log
  UNION ALL SELECT id, complexity_tier, classifier_conf, quality_score, input_tokens, output_tokens
  FROM request_log WHERE id % 101 = 0)"""


def _imported_sql(body: str) -> str:
    return with_views(["request_log"], "").rstrip() + ",\n" + _IMPORTED_SQL + "\n" + body


def _imported(spark, sf):
    log, i = _log(spark, sf).select("id", "complexity_tier", "classifier_conf", "quality_score", "input_tokens", "output_tokens"), F.col("id")
    spoilt = log.select(
        "id", F.when(i % 97 == 0, F.lit(4)).otherwise(F.col("complexity_tier")).alias("complexity_tier"),
        F.when(i % 89 == 0, F.lit(1.5)).otherwise(F.col("classifier_conf")).alias("classifier_conf"),
        F.when(i % 83 == 0, F.lit(7.0)).otherwise(F.col("quality_score")).alias("quality_score"),
        F.when(i % 79 == 0, -F.col("input_tokens")).otherwise(F.col("input_tokens")).alias("input_tokens"), "output_tokens")
    return spoilt.unionByName(log.where(i % 101 == 0))


@query("dq_range_violations", _imported_sql("""
SELECT id, rule FROM (
  SELECT id, 'tier_out_of_range' AS rule FROM imported
    WHERE complexity_tier IS NOT NULL AND complexity_tier NOT BETWEEN 1 AND 3
  UNION ALL SELECT id, 'confidence_out_of_range' FROM imported
    WHERE classifier_conf IS NOT NULL AND classifier_conf NOT BETWEEN 0.0 AND 1.0
  UNION ALL SELECT id, 'score_out_of_range' FROM imported
    WHERE quality_score IS NOT NULL AND quality_score <> -1.0 AND quality_score NOT BETWEEN 1.0 AND 5.0
  UNION ALL SELECT id, 'negative_tokens' FROM imported WHERE input_tokens < 0 OR output_tokens < 0)"""))
def q_dq_range_violations(spark, sf):
    return dq.range_violations(_imported(spark, sf))


@query("dq_request_duplicates", _imported_sql("""
SELECT count(*) AS duplicated_ids FROM (SELECT id FROM imported GROUP BY id HAVING count(*) > 1)"""))
def q_dq_request_duplicates(spark, sf):
    """Q2 over the imported log."""
    return dq.duplicate_ids(_imported(spark, sf)).agg(F.count(F.lit(1)).alias("duplicated_ids"))


# ------------------------------------------------------------ classifier metrics (SQL-checkable)

from ..operators import classifier as clf  # noqa: E402


@query("label_distribution", with_views(["prompts"], """
SELECT label AS tier, count(*) AS n FROM prompts GROUP BY label ORDER BY label"""))
def q_label_distribution(spark, sf):
    """Labelled rows per tier."""
    return rep.label_distribution(_prompts(spark, sf).withColumnRenamed("label", "tier"))


@query("class_weights", with_views(["prompts"], """
SELECT label, n_class, (SELECT count(*) FROM prompts) / ((SELECT count(DISTINCT label) FROM prompts) * n_class)
  AS weight
FROM (SELECT label, count(*) AS n_class FROM prompts GROUP BY label)"""))
def q_class_weights(spark, sf):
    return clf.class_weights(_prompts(spark, sf))


@query("stratified_split", with_views(["prompts"], """
SELECT label, substring(md5(prompt), 1, 4) < '3333' AS is_test, count(*) AS n FROM prompts
GROUP BY label, is_test"""))
def q_stratified_split(spark, sf):
    """M2: rows per tier on each side of the hash split."""
    p = _prompts(spark, sf)
    return p.groupBy("label", clf.split_flag().alias("is_test")).agg(F.count(F.lit(1)).alias("n"))


@query("accuracy", with_views(["predictions"], """
SELECT avg(CAST(label = predicted AS INTEGER)) AS accuracy, count(*) AS n FROM predictions"""))
def q_accuracy(spark, sf):
    return clf.accuracy(_predictions(spark, sf))


@query("confusion_matrix", with_views(["predictions"], """
SELECT label, count(*) FILTER (WHERE predicted = 1) AS pred_1, count(*) FILTER (WHERE predicted = 2) AS pred_2,
  count(*) FILTER (WHERE predicted = 3) AS pred_3
FROM predictions GROUP BY label ORDER BY label"""))
def q_confusion_matrix(spark, sf):
    return clf.confusion_matrix(_predictions(spark, sf))


_REPORT_SQL = """
per AS (
  SELECT CAST(t AS VARCHAR) AS class,
    CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision, CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS recall,
    sup AS support
  FROM (SELECT t, count(*) FILTER (WHERE predicted = t AND label = t) * 1.0 AS tp,
          count(*) FILTER (WHERE predicted = t) AS pp, count(*) FILTER (WHERE label = t) AS sup
        FROM predictions, (SELECT unnest([1, 2, 3]) AS t) GROUP BY t)),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END
  AS f1 FROM per)
SELECT class, round(CAST(precision AS DOUBLE), 6) AS precision, round(CAST(recall AS DOUBLE), 6) AS recall,
  round(CAST(f1 AS DOUBLE), 6) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT class, precision, recall, f1, support FROM per2
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per2
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM per2)"""


@query("classification_report", with_views(["predictions"], "").rstrip() + ",\n" + _REPORT_SQL)
def q_classification_report(spark, sf):
    return clf.classification_report(_predictions(spark, sf))


_CANDIDATES_SQL = """
per AS (
  SELECT 'formula' AS candidate, 0 AS candidate_order, avg(CAST(label = predicted AS INTEGER)) AS accuracy FROM predictions
  UNION ALL SELECT 'always 2', 1, avg(CAST(label = 2 AS INTEGER)) FROM predictions)"""


@query("best_candidate", with_views(["predictions"], "").rstrip() + ",\n" + _CANDIDATES_SQL + """
SELECT candidate, candidate_order, accuracy FROM per ORDER BY accuracy DESC, candidate_order LIMIT 1""")
def q_best_candidate(spark, sf):
    """Selection over two prediction tables."""
    p = _predictions(spark, sf)
    results = None
    for i, (name, predicted) in enumerate((("formula", F.col("predicted")), ("always 2", F.lit(2)))):
        r = clf.accuracy(p.withColumn("predicted", predicted)).select(F.lit(name).alias("candidate"), F.lit(i).alias("candidate_order"), "accuracy")
        results = r if results is None else results.unionByName(r)
    return clf.best_candidate(results)


@query("prediction_gate", with_views(["predictions"], f"""
SELECT doc_id, label, predicted, label = predicted AS passed, a AS gate_accuracy, a >= {S.ACCURACY_TARGET} AS meets_target
FROM predictions, (SELECT avg(CAST(label = predicted AS INTEGER)) AS a FROM predictions)"""))
def q_prediction_gate(spark, sf):
    """M12 + M15 over the prediction table."""
    return clf.golden_gate(_predictions(spark, sf))


# ------------------------------------------------------------ classifier (rows-only checks)

from . import jobs  # noqa: E402


def _prompt_data(spark, sf):
    return jobs.prepared(_prompts(spark, sf), keep=("doc_id",))


@query("classify_prompts")
def q_classify_prompts(spark, sf):
    """M1 + M3 + M4 + M6 + M11 + M14: the calibrated winner scores every
    prompt (tier, confidence, low-confidence flag)."""
    data = _prompt_data(spark, sf)
    models, results = jobs.fit_candidates(data)
    best = results.where("is_best").first()["candidate"]
    return clf.score(models[best], data).select("doc_id", "label", "predicted", "confidence", "low_confidence", "is_test")


@query("candidate_results")
def q_candidate_results(spark, sf):
    """M3 + M4 + M5 + M7 + M11: both candidates, test accuracy, the best."""
    _, results = jobs.fit_candidates(_prompt_data(spark, sf))
    return results.select("candidate", "candidate_order", "accuracy", "is_best",
                          (F.col("accuracy") >= F.lit(S.ACCURACY_TARGET)).alias("meets_target"))


@query("cross_validation")
def q_cross_validation(spark, sf):
    """M8: 5-fold accuracy mean and standard deviation of each candidate."""
    data = _prompt_data(spark, sf)
    names = list(clf.candidates())
    found = clf.side_by_side(spark, [partial(clf.cross_validate, data, name, 5, fold_col="fold") for name in names])
    out = None
    for name, r in zip(names, found, strict=True):
        r = r.select(F.lit(name).alias("candidate"), "*")
        out = r if out is None else out.unionByName(r)
    return out


@query("calibrated_scores")
def q_calibrated_scores(spark, sf):
    """M6: Platt-calibrated confidence of every prompt."""
    data = _prompt_data(spark, sf)
    model = jobs.calibrated_model(data)
    return clf.score(model, data).select("doc_id", "label", "predicted", "confidence", "low_confidence", "is_test")


@query("golden_gate")
def q_golden_gate(spark, sf):
    """M12 + M15: a model fitted on all prompts must reach 0.80 on the
    golden set (benchmark items); pass / fail per prompt."""
    data = _prompt_data(spark, sf)
    model = clf.build_pipeline(clf.candidates(data.count())["logistic_regression"]).fit(data)
    gold = clf.featurise(fx.golden_prompts(spark, sf)).select("item_id", "label", *S.FEATURE_NAMES)
    scored = clf.score(model, gold).select("item_id", "label", "predicted", "confidence")
    return clf.golden_gate(scored)


# ------------------------------------------------------------ stored log

from ..operators import consumed as cs  # noqa: E402
from ..operators import request_store as rs  # noqa: E402
from ..operators import rollup as ru  # noqa: E402
from ..operators.colocated import ColocatedStore  # noqa: E402
from ..session import state_path  # noqa: E402

_STORED = ("id", "ts", "day", "complexity_tier", "classifier_conf", "routed_model", "cost_usd", "cost_if_highest_quality", "latency_ms",
           "quality_score", "quality_gap")


def _stored_log(spark, sf) -> str:
    """The log appended in three batches that overlap; the last one is a full replay."""
    path = state_path(spark, "request-log")
    rows = _log(spark, sf).select(*_STORED)
    for batch in (rows.where("id % 3 <> 0"), rows.where("id % 2 = 0"), rows):
        rs.append_once(batch, path)
    return path


@query("request_store", with_views(["request_log"], """
SELECT id, ts, day, complexity_tier, routed_model, CAST(cost_usd AS DOUBLE) AS cost_usd FROM request_log"""))
def q_request_store(spark, sf):
    """K1 + Q2: an import whose batches repeat ids, appended under the primary key."""
    return spark.read.parquet(_stored_log(spark, sf)).select("id", "ts", "day", "complexity_tier", "routed_model", _dbl("cost_usd"))


@query("newest_from_store", with_views(["request_log"], """
SELECT id, ts, complexity_tier, routed_model, latency_ms, quality_score FROM request_log ORDER BY ts DESC, id DESC LIMIT 50"""))
def q_newest_from_store(spark, sf):
    """A5 on the stored log: only its newest days are opened."""
    return rs.newest_rows(spark, _stored_log(spark, sf), 50).select("id", "ts", "complexity_tier", "routed_model", "latency_ms", "quality_score")


@query("colocated_requests", _esc_sql(_LATEST_SQL.lstrip().replace("latest AS", ", latest AS", 1) + """
SELECT l.id, v.quality_score, v.verified_at, l.escalated, l.escalated_model, CAST(l.cost_delta_usd AS DOUBLE) AS cost_delta_usd
FROM log_esc l LEFT JOIN latest v ON v.id = l.id""", "verdicts"))
def q_colocated_requests(spark, sf):
    """J3 + J4 over tables bucketed by request id: stored once, merged without a shuffle."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = state_path(spark, "colocated")
    store = ColocatedStore(spark, path.rsplit("/", 1)[-1].replace("-", "_"), path, n)
    log = _log(spark, sf)
    store.append_log(log.select(*_STORED))
    store.append_verdicts(fx.verdicts(spark, sf, log))
    store.append_outcomes(esc.escalation_outcomes(log, fx.completions(spark, sf, log), ct.model_registry(spark)))
    merged = store.requests()
    store.close()  # the files stay; the plan has them
    return merged.select("id", "quality_score", "verified_at", "escalated", "escalated_model", _dbl("cost_delta_usd"))


@query("rollup_report", _esc_sql(f"""
SELECT day, CAST(round(sum(cost_usd), 6) AS DOUBLE) AS cost_actual, CAST(round(sum(cost_if_highest_quality), 6) AS DOUBLE) AS cost_baseline,
  count(*) AS num_requests, round(avg(CAST(escalated AS INTEGER)) * 100, 1) AS escalation_rate,
  count(*) FILTER (WHERE quality_score >= 0 AND (quality_gap > {S.QUALITY_GAP_THRESHOLD} OR quality_score < {S.MIN_CHEAP_SCORE})) AS failures
FROM log_esc GROUP BY day"""))
def q_rollup_report(spark, sf):
    """A6 + A7 + W1 from daily partials: the log is rolled up as it is when a
    request is made, verdicts and escalations enter as later corrections."""
    path = state_path(spark, "rollup")
    now = _outcomes(spark, sf).select(*_STORED, "escalated")
    made = now.withColumns({"quality_score": F.lit(None).cast("double"), "quality_gap": F.lit(None).cast("double"), "escalated": F.lit(False)})
    ru.append(ru.partials(made), path)
    ru.correct(made, now, path)
    return ru.daily(spark.read.parquet(path))


@query("consumed_bitmaps", with_views(["failures", "ledger"], "SELECT id, request_id, classified_tier, correct_tier FROM (" + _PENDING + ")"))
def q_consumed_bitmaps(spark, sf):
    """J9 + W2: failures that no run has consumed; two runs compacted into bitmaps, one after them."""
    ledger, bits = state_path(spark, "ledger"), state_path(spark, "bitmaps")
    failures = _failures(spark, sf)
    used = fx.consumed_ledger(failures)
    cs.consume(used.where("failure_id % 2 = 0"), ledger, "run-1")
    cs.consume(used.where("failure_id % 5 = 0"), ledger, "run-2")
    cs.compact(spark, ledger, bits)
    cs.consume(used.where("failure_id % 2 <> 0"), ledger, "run-3")
    return cs.pending(failures, ledger, bits).select("id", "request_id", "classified_tier", "correct_tier")
