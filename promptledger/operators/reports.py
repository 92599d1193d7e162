"""Reports over the request log: A1-A21 and the dashboard projections P5-P8.

Global reports are one partial + final hash aggregate (one row crosses the
exchange per partition); grouped reports aggregate map-side before the
shuffle, so a hot group costs one row per partition.  Shares divide by the
sum of the aggregated rows, so the log is read once.  Money stays DECIMAL
until the final cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..settings import DEFAULT_THRESHOLDS, Thresholds
from ..sources import config_tables as ct


def _money(c: Column, places: int) -> Column:
    return F.round(c, places).cast("double")


def savings_summary(log: DataFrame) -> DataFrame:
    """A1: headline numbers; null results become 0 except mean quality.

    ``avg_quality_score`` includes the -1.0 sentinel like the service does;
    ``avg_quality_verified`` excludes it."""
    cost = F.sum("cost_usd")
    base = F.sum("cost_if_highest_quality")
    agg = log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        cost.alias("__c"), base.alias("__b"),
        F.avg("quality_score").alias("__q"),
        F.avg(F.when(F.col("quality_score") >= 0, F.col("quality_score"))).alias("__qv"),
        F.avg("latency_ms").alias("__l"),
    )
    c, b = F.col("__c"), F.col("__b")
    pct = F.round((F.lit(1) - c / F.nullif(b, F.lit(0))) * F.lit(100), 1).cast("double")
    return agg.select(
        "total_requests",
        F.coalesce(_money(c, 6), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(_money(b, 6), F.lit(0.0)).alias("total_baseline_cost"),
        F.coalesce(_money(b - c, 6), F.lit(0.0)).alias("savings_usd"),
        F.coalesce(pct, F.lit(0.0)).alias("savings_pct"),
        F.round("__q", 2).alias("avg_quality_score"),
        F.round("__qv", 2).alias("avg_quality_verified"),
        F.coalesce(F.round("__l", 0), F.lit(0.0)).alias("avg_latency_ms"),
    )


def window_start(as_of: Column, days: int) -> Column:
    """The whole boundary day is included (text comparison semantics)."""
    return F.date_sub(F.to_date(as_of), days)


def since(log: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (whole boundary day).

    The bound is a scalar subquery.  On ``ts`` it prunes row groups at run
    time; on ``day`` it prunes the folders of a log partitioned by day."""
    ts_type = log.schema["ts"].dataType.simpleString()
    start = window_start(as_of, days)
    recent = F.col("ts") >= start.cast(ts_type)
    return log.where(recent & (F.col("day") >= start) if "day" in log.columns else recent)


def default_as_of(log: DataFrame) -> Column:
    return log.agg(F.max("ts").alias("m")).scalar()


def escalation_rate(log: DataFrame, days: int | None = 7, as_of: Column | None = None) -> DataFrame:
    """A2: escalation rate (%, 1 place) over the last ``days`` days (None:
    over all rows given)."""
    recent = log if days is None else since(log, default_as_of(log) if as_of is None else as_of, days)
    return recent.agg(
        F.count(F.lit(1)).alias("num_requests"),
        F.coalesce(F.round(F.avg(F.col("escalated").cast("int")) * F.lit(100), 1), F.lit(0.0))
        .alias("escalation_rate_pct"))


def requests_by_tier(log: DataFrame) -> DataFrame:
    """A3: count per tier, null tier excluded."""
    return (log.where(F.col("complexity_tier").isNotNull())
            .groupBy("complexity_tier").agg(F.count(F.lit(1)).alias("n")))


def requests_by_model(log: DataFrame) -> DataFrame:
    """A4: count and mean quality per model, largest first (ties by model)."""
    return (log.groupBy("routed_model")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality_score"), 2).alias("avg_quality"))
            .orderBy(F.desc("n"), "routed_model"))


def summary_maps(log: DataFrame) -> DataFrame:
    """The two nested maps of the stats endpoint in one row.

    The maps hold one entry per tier / model (bounded by config), built
    from already-aggregated rows."""
    by_tier = requests_by_tier(log).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("complexity_tier").cast("string"), F.col("n")))).alias("requests_by_tier"))
    by_model = requests_by_model(log).agg(F.map_from_entries(F.collect_list(
        F.struct("routed_model", F.struct(F.col("n").alias("count"), "avg_quality")))).alias("requests_by_model"))
    return by_tier.select("requests_by_tier", by_model.select("requests_by_model").scalar().alias("requests_by_model"))


RECENT_COLUMNS = ["id", "ts", "complexity_tier", "classifier_conf", "routed_model", "cost_usd",
                  "cost_if_highest_quality", "latency_ms", "quality_score", "escalated", "escalated_model"]


def newest(log: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` rows (TakeOrderedAndProject; ties by id)."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def recent_requests(log: DataFrame, limit: int = 50, extra: tuple[str, ...] = ()) -> DataFrame:
    """A5: the newest ``limit`` requests; all columns must be there."""
    missing = {*RECENT_COLUMNS, *extra} - set(log.columns)
    if missing:
        raise ValueError(f"the request log lacks {sorted(missing)}")
    return newest(log, limit).select(*RECENT_COLUMNS, *extra)


def recent_with_tier_filter(log: DataFrame, tiers, limit: int = 50) -> DataFrame:
    """P5: the tier filter applies after the limit."""
    return newest(log, limit).where(F.col("complexity_tier").isin(list(tiers)))


def daily_cost(log: DataFrame, days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Actual vs baseline cost and count per day (optionally last N days)."""
    src = log
    if days is not None:
        as_of = default_as_of(log) if as_of is None else as_of
        src = since(log, as_of, days)
    return (src.groupBy("day")
            .agg(_money(F.sum("cost_usd"), 6).alias("cost_actual"),
                 _money(F.sum("cost_if_highest_quality"), 6).alias("cost_baseline"),
                 F.count(F.lit(1)).alias("num_requests"))
            .orderBy("day"))


def daily_escalation(log: DataFrame, days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Escalation rate (%, 1 place) and count per day."""
    src = log
    if days is not None:
        as_of = default_as_of(log) if as_of is None else as_of
        src = since(log, as_of, days)
    return (src.groupBy("day")
            .agg(F.round(F.avg(F.col("escalated").cast("int")) * F.lit(100), 1).alias("escalation_rate"),
                 F.count(F.lit(1)).alias("num_requests"))
            .orderBy("day"))


def daily_escalation_alert(log: DataFrame, t: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Any day above the alert rate."""
    d = daily_escalation(log)
    return d.agg(F.max("escalation_rate").alias("max_daily_rate"),
                 F.coalesce(F.max(F.col("escalation_rate") > F.lit(t.alert_rate_pct)), F.lit(False))
                 .alias("alert"))


def quality_histogram(log: DataFrame, lo: float = 0.5, width: float = 0.25, bins: int = 20) -> DataFrame:
    """Scored rows (P6) in ``bins`` equal bins from ``lo``; the -1.0
    sentinel gets its own bucket (-1), values past the top go to the last."""
    q = F.col("quality_score")
    b = F.when(q < 0, F.lit(-1)).otherwise(
        F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((q - F.lit(lo)) / F.lit(width)).cast("int"))))
    return (log.where(q.isNotNull()).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("bin",
                    F.when(F.col("bin") < 0, F.lit(None).cast("double"))
                    .otherwise(F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                    "n")
            .orderBy("bin"))


def routing_distribution(log: DataFrame, registry: DataFrame, only: Column | None = None) -> DataFrame:
    """A9 + J6: count and share per model, largest first, display names
    (a model missing from the registry keeps its key)."""
    src = log if only is None else log.where(only)
    counts = _with_total(src.groupBy("routed_model").agg(F.count(F.lit(1)).alias("n")))
    ct.registry_facts(registry)                      # size-checked before the broadcast
    names = registry.select(F.col("model_key").alias("routed_model"), "display_name")
    j = counts.join(F.broadcast(names), "routed_model", "left")
    return (j.select("routed_model",
                     F.coalesce(F.col("display_name"), F.col("routed_model")).alias("display_name"),
                     "n", F.round(F.col("n") * F.lit(100.0) / F.col("total"), 1).alias("share_pct"))
            .orderBy(F.desc("n"), "routed_model"))


def _with_total(counts: DataFrame) -> DataFrame:
    """``counts`` (one row per group) with the sum of ``n``: the log is read
    once, the window sees only the aggregated rows."""
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))


def tier_distribution(log: DataFrame, only: Column | None = None) -> DataFrame:
    """A10: count and share per tier, in tier order (null tier left out)."""
    src = log if only is None else log.where(only)
    src = src.where(F.col("complexity_tier").isNotNull())
    return (_with_total(src.groupBy("complexity_tier").agg(F.count(F.lit(1)).alias("n")))
            .select("complexity_tier", "n", F.round(F.col("n") * F.lit(100.0) / F.col("total"), 1).alias("share_pct"))
            .orderBy("complexity_tier"))


def escalation_alert(log: DataFrame, t: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """Escalation rate of the newest ``alert_window`` requests; silent
    under ``alert_min_rows``; alert strictly above the rate."""
    latest = newest(log, t.alert_window)
    agg = latest.agg(F.count(F.lit(1)).alias("n"),
                     F.round(F.avg(F.col("escalated").cast("int")) * F.lit(100), 1).alias("rate_pct"))
    rate = F.coalesce(F.col("rate_pct"), F.lit(0.0))
    status = (F.when(F.col("n") < t.alert_min_rows, F.lit("silent"))
              .when(rate > F.lit(t.alert_rate_pct), F.lit("alert")).otherwise(F.lit("ok")))
    return agg.select("n", rate.alias("rate_pct"), status.alias("status"))


def audit_view(recent: DataFrame) -> DataFrame:
    """Dashboard audit columns with display formatting."""
    def money(c):
        return F.when(F.col(c).isNull(), F.lit("—")).otherwise(
            F.concat(F.lit("$"), F.format_string("%.6f", F.col(c).cast("double"))))
    cols = [
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.col("complexity_tier").alias("tier"),
        F.col("routed_model").alias("model"),
        money("cost_usd").alias("cost"),
        money("cost_if_highest_quality").alias("baseline"),
        F.when(F.col("latency_ms").isNull(), F.lit("—"))
        .otherwise(F.format_string("%.0f", F.col("latency_ms"))).alias("latency"),
        F.when(F.col("quality_score").isNull(), F.lit("—"))
        .otherwise(F.format_string("%.1f", F.col("quality_score"))).alias("quality"),
        F.when(F.col("escalated"), F.lit("Yes")).otherwise(F.lit("")).alias("escalated"),
    ]
    if "prompt_preview" in recent.columns:
        cols.insert(1, audit_preview("prompt_preview").alias("prompt"))
    return recent.select("id", *cols)


def audit_preview(c: str) -> Column:
    """60 characters and an ellipsis when longer."""
    n = S.AUDIT_PREVIEW_CHARS
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(F.col(c))


def row_flag(escalated: str = "escalated", score: str = "quality_score") -> Column:
    """Escalated first, else low quality when score < 3.0 (the sentinel
    counts as low), else none."""
    return (F.when(F.col(escalated), F.lit("escalated"))
            .when(F.col(score) < F.lit(S.MIN_CHEAP_SCORE), F.lit("low_quality"))
            .otherwise(F.lit("none")))


def baseline_by_model(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Mean cost, latency and savings per model over successful runs;
    models whose runs all failed are still listed (null means)."""
    ok = F.col("success")
    agg = runs.groupBy("model_key").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(F.when(ok, F.lit(1))).alias("succeeded"),
        F.avg(F.when(ok, F.col("cost_usd"))).alias("__c"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("__l"),
        F.avg(F.when(ok, F.col("savings_pct"))).alias("__s"))
    reg = registry.select("model_key", "display_name", "registry_order")
    j = reg.join(agg, "model_key", "left")
    return j.select("model_key", "display_name",
                    F.coalesce(F.col("runs"), F.lit(0)).alias("runs"),
                    F.coalesce(F.col("succeeded"), F.lit(0)).alias("succeeded"),
                    F.round(F.col("__c").cast("double"), 8).alias("avg_cost_usd"),
                    F.round("__l", 1).alias("avg_latency_ms"),
                    F.round("__s", 1).alias("avg_savings_pct"),
                    "registry_order").orderBy("registry_order").drop("registry_order")


def run_totals(runs: DataFrame) -> DataFrame:
    """Sent, succeeded, success %, errors, totals and savings
    (with the real baseline)."""
    ok = F.col("success")
    agg = runs.agg(
        F.count(F.lit(1)).alias("sent"),
        F.count(F.when(ok, F.lit(1))).alias("succeeded"),
        F.sum(F.when(ok, F.col("cost_usd"))).alias("__c"),
        F.sum(F.when(ok, F.col("cost_if_highest_quality"))).alias("__b"))
    c, b = F.col("__c"), F.col("__b")
    return agg.select(
        "sent", "succeeded",
        F.round(F.col("succeeded") * F.lit(100.0) / F.col("sent"), 0).alias("success_pct"),
        (F.col("sent") - F.col("succeeded")).alias("errors"),
        F.coalesce(_money(c, 6), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(_money(b, 6), F.lit(0.0)).alias("total_baseline_cost"),
        F.coalesce(_money(b - c, 6), F.lit(0.0)).alias("savings_usd"),
        F.when(b > 0, F.round((F.lit(1) - c / b) * F.lit(100), 1).cast("double")).alias("savings_pct"))


def run_checks(summary: DataFrame, min_rows: int = 20) -> DataFrame:
    """At least ``min_rows`` rows, baseline above 0, savings above 0."""
    return summary.select(
        "total_requests", "total_baseline_cost", "savings_usd",
        (F.col("total_requests") >= min_rows).alias("enough_rows"),
        (F.col("total_baseline_cost") > 0).alias("baseline_positive"),
        (F.col("savings_usd") > 0).alias("savings_positive"),
        ((F.col("total_requests") >= min_rows) & (F.col("total_baseline_cost") > 0)
         & (F.col("savings_usd") > 0)).alias("passed"))


def label_distribution(labelled: DataFrame, label: str = "tier") -> DataFrame:
    """Rows per label, sorted by label."""
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)
