"""Colocated tables (J3, J4, J9), daily partials (A1-A7) and consumed bitmaps."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from promptledger.operators import consumed as cs
from promptledger.operators import escalation as esc
from promptledger.operators import flywheel as fw
from promptledger.operators import reports as rep
from promptledger.operators import rollup as ru
from promptledger.operators import verdicts as vd
from promptledger.operators.colocated import ColocatedStore

T0 = dt.datetime(2024, 5, 1)
LOG = ("id long, ts timestamp, day date, complexity_tier int, routed_model string, cost_usd decimal(18,8), cost_if_highest_quality decimal(18,8), "
       "latency_ms double, quality_score double, quality_gap double, escalated boolean")
MONEY = Decimal("0.00000001")


def _log(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = T0 + dt.timedelta(hours=i)
        cost = (Decimal(rng.randrange(1, 10**6)) * MONEY).quantize(MONEY)
        out.append((i, ts, ts.date(), rng.choice([1, 2, 3, None]), rng.choice(["small", "mid"]), cost, cost * 3, rng.choice([None, round(rng.random() * 900, 2)]),
                    rng.choice([None, -1.0, 2.0, 3.5, 4.5]), rng.choice([0.0, 1.0, 2.0]), False))
    return out


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def store(spark, tmp_dir):
    s = ColocatedStore(spark, "t_" + tmp_dir.rsplit("-", 1)[-1], f"{tmp_dir}/store", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables of the size of a log are not broadcast
    yield s
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    s.close()


def test_colocated_requests_equal_the_merges_and_move_no_row(spark, tmp_dir, store, capsys):
    rng = random.Random(2)
    log = spark.createDataFrame(_log(400), LOG).drop("escalated")
    # a third of all verdicts belong to one request
    vers = [(rng.randrange(400) if rng.random() < 0.66 else 7, float(rng.randrange(1, 6)), T0 + dt.timedelta(minutes=rng.randrange(9000))) for _ in range(900)]
    outs = [(rng.randrange(400), rng.random() < 0.5, "m", Decimal(rng.randrange(5)) * MONEY) for _ in range(300)]
    verdicts = spark.createDataFrame(vers, "id long, quality_score double, verified_at timestamp")
    outcomes = spark.createDataFrame(outs, "id long, escalated boolean, escalated_model string, cost_delta_usd decimal(18,8)")
    store.append_log(log.where("id < 250"))
    store.append_log(log.where("id >= 250"))
    for part in (0, 1):
        store.append_verdicts(verdicts.where(F.hour("verified_at") % 2 == part))
        store.append_outcomes(outcomes.where(F.col("escalated") == bool(part)))
    want = esc.merge_escalations(vd.merge_verdicts(log, verdicts), outcomes)
    got = store.requests()
    assert _rows(got.select(want.columns)) == _rows(want)
    assert store.table("verdicts").where("id = 7").count() == 2  # one row per append
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and plan.count("Bucketed: true") >= 3
    # another session's view of the same files
    store.close()
    again = ColocatedStore(spark, store.name, store.path, 8)
    assert _rows(again.requests().select(want.columns)) == _rows(want)
    again.requests().explain("formatted")
    assert "Exchange" not in capsys.readouterr().out


def test_colocated_pending_moves_no_row(spark, store, capsys):
    failures = spark.range(500).select("id", (F.col("id") % 3 + 1).alias("correct_tier"))
    ledger = spark.range(0, 500, 3).select(F.col("id").alias("failure_id"))
    store.append_failures(failures)
    store.append_ledger(ledger)
    store.append_ledger(ledger)  # a replay is harmless
    assert _rows(store.pending()) == _rows(fw.pending_failures(failures, ledger))
    store.pending().explain("formatted")
    assert "Exchange" not in capsys.readouterr().out


def _reports_agree(spark, path, rows):
    log = spark.createDataFrame(rows, LOG)
    parts = spark.read.parquet(path)
    assert _rows(ru.savings_summary(parts)) == _rows(rep.savings_summary(log))
    d = log.groupBy("day").agg(F.count_if((F.col("quality_score") >= 0) & esc.is_routing_failure()).alias("failures"))
    want = rep.daily_cost(log).join(rep.daily_escalation(log).drop("num_requests"), "day").join(d, "day")
    assert _rows(ru.daily(parts).select(want.columns)) == _rows(want)
    assert _rows(ru.by_tier(parts)) == _rows(rep.requests_by_tier(log))
    assert [tuple(r) for r in ru.by_model(parts).collect()] == [tuple(r) for r in rep.requests_by_model(log).collect()]


def test_partials_equal_the_scan_after_late_corrections(spark, tmp_dir):
    path = f"{tmp_dir}/rollup"
    rows = _log(300)
    ru.append(ru.partials(spark.createDataFrame(rows[:200], LOG)), path)
    ru.append(ru.partials(spark.createDataFrame(rows[200:], LOG)), path)
    _reports_agree(spark, path, rows)
    late = [r for r in rows if r[0] % 5 == 0 and r[0] < 100]  # verdicts and escalations of old days
    now = [(*r[:8], 1.5, 2.0, True) for r in late]
    ru.correct(spark.createDataFrame(late, LOG), spark.createDataFrame(now, LOG), path)
    newer = {r[0]: r for r in now}
    _reports_agree(spark, path, [newer.get(r[0], r) for r in rows])
    before = {f: spark.read.parquet(path).inputFiles() for f in ("all",)}["all"]
    days = sorted({r[2] for r in late})
    ru.compact(spark, path, days)
    _reports_agree(spark, path, [newer.get(r[0], r) for r in rows])
    kept = [f for f in before if not any(f"day={d}" in f for d in days)]
    after = spark.read.parquet(path).inputFiles()
    assert kept and set(kept) <= set(after) and len(after) < len(before)


def test_partials_of_nothing(spark, tmp_dir):
    empty = spark.createDataFrame([], LOG)
    r = ru.savings_summary(ru.partials(empty)).first()
    assert tuple(r) == tuple(rep.savings_summary(empty).first())


def test_bitmaps_equal_the_anti_join(spark, tmp_dir, capsys):
    ledger, bits = f"{tmp_dir}/ledger", f"{tmp_dir}/bits"
    failures = spark.range(0, 200_000, 7).select("id", F.lit("p").alias("prompt"))
    assert cs.pending(failures, ledger, bits).count() == failures.count() and cs.compact(spark, ledger, bits) == 0
    used = [spark.range(0, 60_000, 14), spark.range(30_000, 120_000, 21), spark.range(0, 200_000, 700)]
    for k, u in enumerate(used):
        cs.consume(u.select(F.col("id").alias("failure_id")), ledger, f"r{k}")
        whole = used[0]
        for x in used[1: k + 1]:
            whole = whole.unionByName(x)
        want = _rows(fw.pending_failures(failures, whole.select(F.col("id").alias("failure_id"))))
        assert _rows(cs.pending(failures, ledger, bits)) == want  # from the runs alone or with an older version
        assert cs.compact(spark, ledger, bits) == 1 and cs.compact(spark, ledger, bits) == 0
        assert _rows(cs.pending(failures, ledger, bits)) == want
    cs.pending(failures, ledger, bits).explain("formatted")
    assert "run_id=" not in capsys.readouterr().out  # nothing of the ledger's history is read
    # a run that is repeated, and a version that was cut short, change nothing
    cs.consume(used[2].select(F.col("id").alias("failure_id")), ledger, "r2")
    spark.createDataFrame([(0, b"\xff")], cs.BITMAPS).write.parquet(f"{bits}/version=99999999-x/bits")
    assert _rows(cs.pending(failures, ledger, bits)) == want and cs.compact(spark, ledger, bits) == 0
