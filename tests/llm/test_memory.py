"""What bounds the memory of tasks: batches of whole texts, memory given back, texts dealt once."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from llm_rows import prose
from pyspark.sql import functions as F

from promptledger.llm import batches, disclosure, jaccard_join, sentencepiece_backend, storage


def test_batches_are_bounded_in_bytes(spark):
    def sizes(parts):
        for b in parts:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "b"])

    df = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("x"), 5_000).alias("t"))
    with storage.bounded_batches(spark):
        n, most = df.mapInArrow(sizes, "n long, b long").agg(F.sum("n"), F.max("b")).first()
    assert n == 2_000 and most < 1.2 * storage.BATCH_BYTES


def test_every_step_of_the_join_runs_on_bounded_batches(spark, monkeypatch):
    seen, real, before = [], storage.written, spark.conf.get(storage.MOST_BYTES)
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: (seen.append((name, spark.conf.get(storage.MOST_BYTES))), real(df, name))[1])
    seed = prose(random.Random(3), 60)
    rows = [(i, f"{seed} {i % 4}") for i in range(12)]
    got = jaccard_join.grouped(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r.component_id for r in got} == {0}
    assert {"jaccard-survey", "jaccard-prefixes", "jaccard-sets", "jaccard-verified"} <= {n for n, _ in seen}
    assert {v for _, v in seen} == {str(storage.BATCH_BYTES)} and spark.conf.get(storage.MOST_BYTES) == before


def test_a_task_gives_freed_memory_back():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    rows = [np.ones(100_000, np.uint8) for _ in range(1_500)]
    last = rows[-1]
    del rows
    before = resident()
    assert list(batches.released(iter([1]))) == [1]
    assert last.sum() == 100_000 and before - resident() > 75_000_000


def test_texts_are_not_dealt_out_to_meet_few_spans(spark, monkeypatch):
    plans, real = {}, storage.written
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(disclosure, "written", lambda df, name: (plans.update({name: plan_of(df)}), real(df, name))[1])
    rows = [(i, f"note {'abcd'[i]} about zorbax who writes from jo.doe@mail.example to {w} today", "more") for i, w in enumerate(("berlin", "paris", "rome", "oslo"))]
    rows += [(10 + i, "many people write about today and from there note who writes " * 40 + str(i), "more") for i in range(20)]
    rows += [rows[0], (60, "zorbax at jo.doe@mail.example", "more"), (60, "zorbax at jo.doe@mail.example", "other"), (None, "zorbax jo.doe@mail.example", None), (50, None, "more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")

    def check(out):
        got = out.collect()
        assert out.columns == docs.columns and len(got) == len(rows)
        assert sorted((r.key, r.text) for r in got if r.doc_id == 60) == [("more", " at [EMAIL]"), ("other", " at [EMAIL]")]
        assert [r.text for r in got if r.doc_id is None] == [" [EMAIL]"] and [r.text for r in got if r.doc_id == 50] == [None]
        assert sum(r.doc_id == 0 and "[EMAIL]" in r.text and "zorbax" not in r.text for r in got) == 2
        return sorted(map(str, got))

    out = disclosure.sanitise(docs)
    assert "rightHint=(strategy=broadcast)" in plan_of(out) and "rightHint=(strategy=broadcast)" in plans["private-added"]
    assert not any("first(text" in p for p in plans.values())
    few = check(out)
    monkeypatch.setattr(disclosure, "BROADCAST_ROWS", 3)
    out = disclosure.sanitise(docs)
    assert "strategy=broadcast" not in plan_of(out) + plans["private-added"]
    assert check(out) == few


def test_texts_are_encoded_in_small_parts():
    texts = [None, "", "a" * 1_000_000] + ["some words " * 100] * 1_000
    parts = list(sentencepiece_backend._parts(texts))
    assert [t for p in parts for t in p] == [t or "" for t in texts]
    assert max(sum(map(len, p)) for p in parts[1:]) < 260_000
