"""Operator 6: rule statistics against Python, and the forest."""

import random
import re
from collections import Counter

import numpy as np

from llm_rows import nothing, odd, odd_rows, prose  # noqa: F401  (fixtures)

from promptledger.llm import quality_forest as qf


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
    often, hit, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics(spark, odd_rows):
    rng = random.Random(6)
    rows = odd_rows + [(100 + i, "".join(rng.choices(["a", "b", " ", "\n", "#", "é", "c d e ", "\x0b"], k=rng.randrange(60)))) for i in range(300)]
    got = qf.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((i, *brute(t)) for i, t in rows)


def test_forest_finds_what_is_unlike_the_rest():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3_000, 4))
    forest = qf.Forest(x)
    far, near = forest.score(np.full((1, 4), 8.0))[0], forest.score(np.zeros((1, 4)))[0]
    assert far > 0.7 > 0.5 > near
    assert qf.Forest(np.ones((1, 4))).score(np.ones((2, 4))).shape == (2,)


def test_one_id_with_many_rows_does_not_fill_the_sample(spark):
    stats = spark.range(60_000).selectExpr("if(id < 30000, 7, id) doc_id", "if(id < 30000, 900, 100 + id % 50) n_words",
                                           *(f"0L {c}" for c in qf.STATS[1:]))
    forest = qf.fit(stats)
    odd, common = forest.score(qf.features(stats.where("doc_id = 7 or doc_id = 40000").distinct().orderBy("n_words").toPandas()))[::-1]
    assert odd >= common  # its 30,000 equal rows are drawn once at most


def test_trees_have_their_own_rows_of_a_large_corpus(monkeypatch):
    taken = []
    monkeypatch.setattr(qf.Forest, "_grow", lambda self, x, rng: taken.append(x) or ())
    qf.Forest(np.arange(40.0).reshape(-1, 1), trees=5, psi=8)
    assert [len(x) for x in taken] == [8] * 5 and sorted(np.concatenate(taken).ravel()) == list(range(40))
    qf.Forest(np.arange(20.0).reshape(-1, 1), trees=5, psi=8)
    assert [len(set(x.ravel())) for x in taken[5:]] == [8] * 5


def test_threshold_keeps_good_rows_and_rejects_bad_ones(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad = i % 25 == 0
        t = prose(rng, 80)
        rows.append((i, t.replace(" ", " %%## ") if bad else t))
        labels.append((i, 0 if bad else 1))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in qf.judge(docs, lab).collect()}
    assert np.mean([got[i] for i in range(600) if i % 25]) >= 0.98
    assert np.mean([not got[i] for i in range(600) if i % 25 == 0]) > 0.8


def test_odd_rows_without_labels(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = qf.judge(odd, none).collect()
    assert len(got) == odd.count() and all(r.kept == (not r.base_failed) for r in got)
    assert qf.judge(nothing, none).count() == 0
