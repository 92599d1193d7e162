"""The registered queries over the smallest tables: columns and types of their
contracts, whole tables, and the DuckDB twins."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import canon, duck  # noqa: E402

from promptledger.llm import queries as llm  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_store": "doc_id long, start long, n_tokens long, ids_crc32 long",
    "op2_repeats": "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    "op3_jaccard_join": "doc_id long, n_shingles long, component_id long",
    "op5_disclosure": "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    "op6_quality_forest": "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean",
    "op7_pitman_yor": "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    "op8_toxicity_cnn": "doc_id long, held_out boolean, score double, predicted int",
    "op9_host_trust": "page_id long, host string, path string, rule string, verdict string",
    "op10_decontamination": "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    "op11_source_mix": "doc_id long, size long, source_size long, target double, taken long",
    "op12_centroids": "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string",
    "op13_periodic_runs": "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string",
}


def test_every_operator_is_registered_once():
    names = entry.queries()
    assert all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = llm.QUERIES[name](spark, SF)
    kinds = {k: {"bigint": "long"}.get(t, t) for k, t in df.dtypes}
    for column in COLUMNS[name].split(", "):
        k, kind = column.split()
        assert kinds[k] == kind
    table = {"op9": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_twins(spark, name):
    df = llm.QUERIES[name](spark, SF)
    found = duck(SF).execute(llm.ORACLE[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in found.description], found.fetchall())
