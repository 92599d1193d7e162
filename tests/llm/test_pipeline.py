"""The pipeline's stages take effect and keep clean rows."""

import random

from llm_rows import prose  # noqa: F401  (fixtures)

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    d = str(tmp_path_factory.mktemp("sf"))
    item = prose(rng, 20)
    rows = []
    for i in range(300):
        w = prose(rng, 100).split()
        if i % 5 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "vile")
        rows.append((i, " ".join(w)))
    rows += [(1_000, rows[1][1]), (1_001, rows[1][1] + " one more"), (1_002, "x " + item + " y"), (1_003, "mail me at jo@mail.example now " + prose(rng, 40)), (1_004, None), (1_005, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_in_order_take_effect(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, tables).collect()}
    clean = {i for i in range(300) if i % 5} | {1_003, 1_004, 1_005}
    assert clean <= out.keys() and not out.keys() & {1_000, 1_001, 1_002}
    assert sum(i in out for i in range(0, 300, 5)) <= 3
    assert out[1_004].n_tokens == 0 and out[1_003].key == "extra" and all(r.round_trip for r in out.values())


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns
    text = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs, tables).collect()}
    assert text[1_003].startswith("mail me at [EMAIL] now") and len(text) == 306


def test_empty_documents(spark, tables, tmp_path):
    d = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
