"""Structured Streaming jobs ST1-ST6.

Every job takes a streaming DataFrame (or a source path) and returns a
started ``StreamingQuery`` writing to a sink with a checkpoint in the
shared checkpoint folder, so a restarted or re-tried job resumes where it
stopped.  ``ts`` columns arrive as TIMESTAMP_NTZ and are cast to
TIMESTAMP (session time zone UTC) before any watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reports as rep
from ..operators.completion import Scorer, complete, from_messages, request_rows
from ..operators.flywheel import export_rows
from ..settings import DEFAULT_THRESHOLDS, Thresholds


def require_utc(spark: SparkSession) -> None:
    """The log's ``ts`` is a naive UTC wall clock.  Casting it to TIMESTAMP
    (needed for watermarks) and cutting day windows both read the session
    time zone, so any other zone would shift every daily bucket; such a
    session is refused rather than producing shifted days."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    if tz not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"streaming jobs need spark.sql.session.timeZone=UTC, the session has {tz!r}")


def event_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """File-source stream of events (parquet), ``ts`` as TIMESTAMP (UTC
    session required, see :func:`require_utc`)."""
    require_utc(spark)
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def ingest(requests: DataFrame, sink_path: str, checkpoint: str, dedup_delay: str = "1 hour",
           trigger: dict | None = None) -> StreamingQuery:
    """ST6, last step: append routed requests (id, ts, day, ...) to the log;
    a replayed request id within ``dedup_delay`` is dropped
    (``dropDuplicatesWithinWatermark`` keeps state bounded by the delay)."""
    deduped = requests.withWatermark("ts", dedup_delay).dropDuplicatesWithinWatermark(["id"])
    w = (deduped.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def ingest_chats(chats: DataFrame, score: Scorer, registry: DataFrame, settings: DataFrame, sink_path: str,
                 checkpoint: str, dedup_delay: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """ST6: chat requests (id, ts, messages, parameters) are validated,
    featurised, scored, routed, priced and appended as log rows; rejected
    ones are left out.  Stateless but for the id deduplication."""
    valid = from_messages(chats).where(F.col("status") == "valid")
    rows = request_rows(complete(valid, score, registry, settings).withColumn("latency_ms", F.lit(None).cast("double")), registry)
    return ingest(rows, sink_path, checkpoint, dedup_delay, trigger)


def daily_cost(requests: DataFrame, sink_path: str, checkpoint: str, lateness: str = "1 hour",
               trigger: dict | None = None) -> StreamingQuery:
    """ST1: tumbling one-day windows of actual vs baseline cost; a day is
    emitted once the watermark passes its end (append mode)."""
    agg = (requests.withWatermark("ts", lateness)
           .groupBy(F.window("ts", "1 day").alias("w"))
           .agg(F.sum("cost_usd").alias("__c"), F.sum("cost_if_highest_quality").alias("__b"),
                F.count(F.lit(1)).alias("num_requests"))
           .select(F.to_date(F.col("w.start")).alias("day"),
                   F.round("__c", 6).cast("double").alias("cost_actual"),
                   F.round("__b", 6).cast("double").alias("cost_baseline"), "num_requests"))
    w = (agg.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def verdict_join(requests: DataFrame, verdicts: DataFrame, sink_path: str, checkpoint: str,
                 lateness: str = "1 hour", max_delay: str = "1 hour",
                 trigger: dict | None = None) -> StreamingQuery:
    """ST2: requests joined with later-arriving verdicts (left outer,
    interval-bounded so join state is bounded); never-verified requests are
    emitted with a null score once the watermark passes the interval."""
    r = requests.select("id", "ts", "routed_model", "cost_usd").withWatermark("ts", lateness)
    v = (verdicts.select(F.col("id").alias("v_id"), "quality_score", "verified_at")
         .withWatermark("verified_at", lateness))
    cond = ((F.col("id") == F.col("v_id")) & (F.col("verified_at") >= F.col("ts"))
            & (F.col("verified_at") <= F.col("ts") + F.expr(f"INTERVAL {max_delay}")))
    j = r.join(v, cond, "leftOuter").select("id", "ts", "routed_model", "cost_usd", "quality_score",
                                            "verified_at")
    w = (j.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def alert_step(state_path: str, alerts_path: str, t: Thresholds = DEFAULT_THRESHOLDS):
    """The ``foreachBatch`` body of ST3, idempotent per batch id.

    The state of epoch ``N`` (the newest ``alert_window`` requests) is a
    function of the state of epoch ``N-1`` and batch ``N`` only, written to
    its own folder in overwrite mode, and so is the alert row.  A batch that
    is run again after a failure (``foreachBatch`` is at-least-once) rewrites
    the same two folders with the same rows instead of counting its requests
    twice.  State of an earlier epoch that is missing is an error: going on
    without it would silence an alert.  Batch ``N`` runs only once batch ``N-1``
    is committed, so when its state is written that of epoch ``N-2`` is deleted:
    two versions are left, however long the stream runs.  ``latest`` is a copy
    for readers; the step never reads it."""
    cols = ["id", "ts", "escalated"]

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        cur = batch.select(*cols)
        if epoch > 0:  # only the first epoch has no state; a missing folder is an error
            cur = cur.unionByName(spark.read.parquet(f"{state_path}/epoch={epoch - 1}").select(*cols))
        top = cur.orderBy(F.desc("ts"), F.desc("id")).limit(t.alert_window)
        top.write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")
        kept = spark.read.parquet(f"{state_path}/epoch={epoch}")
        rep.escalation_alert(kept, t).write.mode("overwrite").parquet(f"{alerts_path}/epoch={epoch}")
        kept.write.mode("overwrite").parquet(f"{state_path}/latest")
        if epoch > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/epoch={epoch - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return step


def rolling_alert(requests: DataFrame, state_path: str, alerts_path: str, checkpoint: str,
                  t: Thresholds = DEFAULT_THRESHOLDS, trigger: dict | None = None) -> StreamingQuery:
    """ST3: after every micro-batch, the newest ``alert_window`` requests
    (a bounded table, one version per epoch) are evaluated with A11; the
    status row of epoch ``N`` lands in ``alerts_path/epoch=N``."""
    w = requests.writeStream.foreachBatch(alert_step(state_path, alerts_path, t)).option(
        "checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def hot_reload_routing(requests: DataFrame, routed: Callable[[DataFrame, DataFrame], DataFrame], settings_path: str,
                       sink_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """ST4: ``routed(batch, settings)`` routes and prices a batch; the settings are re-read from a shared table at every
    micro-batch, so a new mapping takes effect on the next batch.  Batch
    ``N`` is written to ``sink_path/epoch=N`` in overwrite mode, so a re-run
    batch replaces its own output instead of appending it twice."""
    spark = requests.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        (routed(batch, spark.read.parquet(settings_path)).select("id", "complexity_tier", "low_confidence", "routed_model", "cost_usd")
         .write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}"))

    w = requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def incremental_export(spark: SparkSession, failures_path: str, schema, sink_path: str,
                       checkpoint: str) -> StreamingQuery:
    """ST5: every failure file is exported exactly once; the stream's
    checkpoint replaces the consumed flag (a second run finds nothing new)."""
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(failures_path)
    w = (export_rows(src).writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return w.trigger(availableNow=True).start()

