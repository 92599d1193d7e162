"""ST2 with corrections: late, repeated and re-ordered verdicts equal the batch merge; state is bounded."""

import datetime as dt
import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from promptledger.operators.verdicts import merge_verdicts
from promptledger.streaming import verdict_state as vs

T0 = dt.datetime(2024, 1, 1)
REQ = "id long, ts timestamp, routed_model string, cost_usd decimal(18,8)"
VER = "id long, quality_score double, verified_at timestamp"


def _write(spark, folder, rows, schema, step):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/step={step}")


def _run(spark, tmp_dir, **more):
    rs = spark.readStream.schema(REQ).option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/r")
    ver = spark.readStream.schema(VER).option("recursiveFileLookup", "true").parquet(f"{tmp_dir}/v")
    q = vs.verdict_changes(rs, ver, f"{tmp_dir}/out", f"{tmp_dir}/ck", lateness="0 seconds", **more)
    q.awaitTermination()
    return q


def _rows(df):
    return sorted((r["id"], r["ts"], r["routed_model"], str(r["cost_usd"]), r["quality_score"], r["verified_at"]) for r in df.select(
        "id", "ts", "routed_model", "cost_usd", "quality_score", "verified_at").collect())


def test_any_order_equals_the_batch_merge(spark, tmp_dir):
    rng = random.Random(6)
    from decimal import Decimal
    reqs = [(i, T0 + dt.timedelta(minutes=7 * i), "small", Decimal(i)) for i in range(60)]
    vers = []
    for i in range(60):
        if i % 4:  # one to three verdicts, up to five hours after the request, some equal in time
            vers += [(i, float(rng.randrange(1, 6)), reqs[i][1] + dt.timedelta(minutes=rng.choice([5, 30, 90, 300]))) for _ in range(rng.randrange(1, 4))]
    vers += rng.sample(vers, 15)
    vers.append((999, 2.0, T0 + dt.timedelta(hours=1)))  # no such request
    rng.shuffle(vers)
    late = reqs[:10]
    for step in range(3):  # some verdicts come before their request, some long after the watermark has passed
        _write(spark, f"{tmp_dir}/r", (reqs[10:40], reqs[40:] + reqs[12:20], late)[step], REQ, step)
        _write(spark, f"{tmp_dir}/v", vers[step::3], VER, step)
        _run(spark, tmp_dir, max_delay=dt.timedelta(minutes=30))
    changes = spark.read.parquet(f"{tmp_dir}/out")
    batch = merge_verdicts(spark.createDataFrame(reqs, REQ), spark.createDataFrame(vers, VER))
    assert _rows(vs.current(changes)) == _rows(batch)
    assert vs.current(changes).count() == len(reqs)
    assert changes.where("id = 0 and quality_score is null").count() == 1  # never judged: emitted by its timer


def test_state_ends_and_later_verdicts_still_count(spark, tmp_dir):
    from decimal import Decimal
    reqs = [(i, T0 + dt.timedelta(minutes=i), "mid", Decimal(1)) for i in range(20)]
    _write(spark, f"{tmp_dir}/r", reqs, REQ, 0)
    _write(spark, f"{tmp_dir}/v", [(1, 3.0, T0 + dt.timedelta(minutes=2))], VER, 0)
    keep = dt.timedelta(hours=2)
    _run(spark, tmp_dir, keep=keep)
    _write(spark, f"{tmp_dir}/r", [(100, T0 + dt.timedelta(days=2), "mid", Decimal(1))], REQ, 1)
    q = _run(spark, tmp_dir, keep=keep)
    kept = [op["numRowsTotal"] for p in q.recentProgress for op in json.loads(p.json)["stateOperators"]]
    assert kept[-1] < 20  # of 21 ids and three states each, those of the last request are left
    _write(spark, f"{tmp_dir}/v", [(5, 4.0, T0 + dt.timedelta(days=3)), (1, 1.0, T0)], VER, 2)
    _run(spark, tmp_dir, keep=keep)
    _write(spark, f"{tmp_dir}/r", [(101, T0 + dt.timedelta(days=9), "mid", Decimal(1))], REQ, 3)
    _run(spark, tmp_dir, keep=keep)
    got = {r["id"]: r["quality_score"] for r in vs.current(spark.read.parquet(f"{tmp_dir}/out")).collect()}
    assert got[5] == 4.0 and got[1] == 3.0 and len(got) >= 21
    assert Path(f"{tmp_dir}/ck").exists() and spark.read.parquet(f"{tmp_dir}/out").where(F.col("ts").isNull()).count() >= 1
