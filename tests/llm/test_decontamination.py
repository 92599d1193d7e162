"""Operator 10 against its DuckDB twin, which compares every window."""

import random
import re

import duckdb

from llm_rows import nothing, odd, odd_rows, prose  # noqa: F401  (fixtures)

from promptledger.llm import decontamination as dc


def twin(docs, items):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    if items:
        con.executemany("insert into benchmark values (?, ?)", items)
    return sorted(con.execute("select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from (" + dc.sql() + ")").fetchall())


def run(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in dc.judge(d, b).collect())


def test_planted_passages(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 9, 10, 11, 25, 40))] + [(20, "the of"), (21, ""), (22, None), (23, "!!!")]
    items += [(24, items[4][1]), (100, "Ü ist Ä, wie ß und 日本 so auch hier im Text")]
    docs = []
    for i in range(120):
        w = prose(rng, 60).split()
        if i % 3 == 0:
            p = (items[rng.randrange(6)][1] + " the, of").upper().split()
            lo = rng.randrange(max(1, len(p) - 12))
            w[20:20] = p[lo: lo + rng.randrange(8, 30)]
        docs.append((i, "; ".join(w) if i % 2 else " ".join(w)))
    docs += [(200, items[3][1] * 3), (201, items[-1][1] + "!"), (202, "THE\nOF the of")]
    assert run(spark, docs, items) == twin(docs, items)


def test_odd_rows(spark, odd, odd_rows, nothing):
    items = [(1, "one"), (2, odd_rows[5][1][:400]), (3, "Same text, twice. Same text")]
    single = [r for r in odd_rows if r[0] not in (8, 9)]
    assert run(spark, single, items) == twin(single, items)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.judge(odd, b).collect()
    assert len(got) == len(odd_rows) and [r.contaminated for r in got if r.doc_id == 8] == [True, True]
    kept = dc.clean(odd, b)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 9, 9, 10, 11, 12]
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.judge(nothing, b).count() == 0 and not any(r.contaminated for r in dc.judge(odd, none).collect())
    assert dc.clean(odd, none).count() == len(odd_rows)


def test_words_are_the_matches_of_the_pattern(spark):
    texts = ["".join(chr(c) for c in range(lo, lo + 300)) for lo in range(0, 600, 150)] + ["", " ", None, "Ab", "A\x00b-C", "\u00dc \U0001f600x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", dc.words("text").alias("w"))
    for r in df.collect():
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        assert r.w == re.findall(dc.WORD, lower)
    assert "extract_all" not in df._jdf.queryExecution().toString()  # it copies the text for every match
