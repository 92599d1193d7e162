"""Operator 8: held-out accuracy on planted words."""

import random
import zlib

import pytest

from llm_rows import nothing, odd, odd_rows, prose  # noqa: F401  (fixtures)

from promptledger.llm import toxicity_cnn as tc


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic, lang = int(i % 4 == 0), ("en", "xx")[i % 2 == 0 and i % 3 == 0]
        w = prose(rng, rng.randrange(20, 200)).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "Vile!" if lang == "en" else "grumpf" + rng.choice(["a", "en", "os"]))
        rows.append((i, " ".join(w), lang))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(planted):
    docs, labels, toxic = planted
    got = tc.judge(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == toxic[r.doc_id] for r in out) / len(out) > 0.95
    assert sum(r.flagged == bool(toxic[r.doc_id]) for r in out) / len(out) > 0.95
    kept = {r.doc_id for r in tc.clean(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if not r.flagged}


def test_score_reads_the_text_only(spark, planted):
    docs, labels, _ = planted
    net = tc.fit(docs, labels)
    a = {r.doc_id: r.score for r in tc.score(docs, net).collect()}
    from pyspark.sql import functions as F
    b = {r.doc_id - 5_000: r.score for r in tc.score(docs.select((F.col("doc_id") + 5_000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang")), net).collect()}
    assert a == b


def test_odd_rows_and_missing_labels(spark, odd, nothing, planted):
    docs, labels, _ = planted
    got = tc.score(odd, tc.fit(docs, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([(1, None), (2, 7)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in tc.judge(odd, none).collect()} == {(0.0, 0)}
    assert tc.judge(nothing, labels).count() == 0
    assert tc.clean(odd, none).columns == odd.columns


def test_long_and_equal_texts_take_part_in_fitting(spark, planted):
    """Toxic words that only texts of over 2,000 tokens have; and texts that occur with both labels."""
    docs, labels, _ = planted
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(2_000, 2_120):
        toxic = i % 2
        w = prose(rng, 2_500).split()
        if toxic:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), "zwurbel")
        rows.append((i, " ".join(w), "en"))
        marks.append((i, toxic))
    rows += [(3_000 + i, f"plain snark {chr(97 + i // 40)}{chr(97 + i // 4 % 10)}", "en") for i in range(400)]
    marks += [(3_000 + i, int(i % 4 < 2)) for i in range(400)]  # a text is toxic if one of its rows is
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    labels = labels.unionByName(spark.createDataFrame(marks, labels.schema))
    net = tc.fit(docs, labels)
    got = {r.doc_id: r.score for r in tc.score(docs, net).collect()}
    held = [i for i in range(2_000, 2_120) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= tc.PREDICT) == bool(i % 2) for i in held) / len(held) > 0.9
    snark = [got[3_000 + i] for i in range(400)]
    assert sum(s > 0.5 for s in snark) > 300
    again = tc.fit(docs.repartition(7), labels)
    assert (again.embed == net.embed).all() and (again.scale, again.shift) == (net.scale, net.shift)
    assert tc.fit(docs, labels, most=0) is None
