"""Operator 7: counts against brute force, the sampler against enumeration."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa

from llm_rows import nothing, odd_rows, prose  # noqa: F401  (fixtures)

from promptledger.llm import pitman_yor as py


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def check(spark, rows):
    got = sorted(py.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: (r.doc_id, r.n_tokens, r.base_score))
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(c[x] > 0 for x in w)) for i, w in ((i, tokens(t)) for i, t in rows))
    assert [(r.doc_id, r.n_tokens, r.n_known, r.held_out, r.train_tokens) for r in got] == [(i, m, k, held(i), n) for i, m, _, k in want]
    assert np.allclose([r.base_score for r in got], [b for _, _, b, _ in want])
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    return got


def test_odd_rows(spark, odd_rows):
    check(spark, odd_rows)


def test_model_beats_add_one_on_text_with_structure(spark):
    rng = random.Random(1)
    after = {w: [prose(rng, 1) for _ in range(3)] for w in range(40)}
    rows = []
    for i in range(200):
        w = []
        for _ in range(80):
            k = rng.randrange(40)
            w += [f"lead{k}", rng.choice(after[k])]
        rows.append((i, " ".join(w)))
    got = check(spark, rows)
    out = [r for r in got if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_empty_table_and_no_training_rows(spark, nothing):
    assert py.score(nothing).count() == 0
    only = next(i for i in range(100) if held(i))
    r = py.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_tables_follow_the_seating_law():
    """Number of tables of 5 customers, by listing all seatings of one dish."""
    d, a, c = 0.6, 0.7, 5
    weight = Counter()
    for seats in product(range(c), repeat=c):  # restricted growth strings
        if all(s <= max(seats[:i], default=-1) + 1 for i, s in enumerate(seats)):
            sizes = Counter(seats).values()
            weight[len(sizes)] += a ** len(sizes) * math.prod(math.prod(k - d for k in range(1, n)) for n in sizes)
    total = sum(weight.values())
    code = py.code_of(np.array([a]))[0]
    a_code = 2.0 ** ((int(code) - py.CODE_ZERO) / py.CODE_STEP)
    exact = {t: w / a ** t * a_code ** t for t, w in weight.items()}
    total = sum(exact.values())
    law = np.diff(np.concatenate([[0], py.table_law(d)[0][code, c]]))
    assert np.allclose([exact.get(t, 0) / total for t in range(c + 1)], law[: c + 1])
    draws = py.draw_tables(np.full(40_000, c), np.full(40_000, code), d, np.random.default_rng(0))
    assert np.allclose(np.bincount(draws, minlength=c + 1) / 40_000, law[: c + 1], atol=0.01)
    large = py.draw_tables(np.array([0, 1, 1_000]), np.array([200, 200, 200], np.uint8), d, np.random.default_rng(0))
    assert large[0] == 0 and large[1] == 1 and 1_000 // py.PARTY <= large[2] <= 1_000


def test_large_dishes_are_seated_in_one_restaurant():
    """Mean and spread of the tables of 100 to 5,000 customers against the recursion of S_d."""
    for d in (py.DISCOUNT, 0.6):
        row, done = np.array([0.0]), 0
        for c in (100, 1_000, 4_096, 5_000):
            for n in range(done, c):
                left = n - d * np.arange(n + 1)
                stay = np.where(left > 0, np.log(np.maximum(left, 1e-300)), -np.inf) + row
                row = np.logaddexp(np.append(stay, -np.inf), np.append([-np.inf], row))
            done = c
            for a in (1.0, 8.0, 128.0, 1_024.0):
                w, t = row + math.log(a) * np.arange(c + 1), np.arange(c + 1)
                p = np.exp(w - w.max())
                p /= p.sum()
                mean = p @ t
                spread = math.sqrt(p @ (t - mean) ** 2)
                drawn = py.draw_tables(np.full(10_000, c), np.repeat(py.code_of(np.array([a])), 10_000), d, np.random.default_rng(c))
                assert drawn.min() >= 1 and drawn.max() <= c
                assert abs(drawn.mean() - mean) < 0.01 * mean + 0.05 * spread and abs(drawn.std() - spread) < 0.1 * spread
    huge = py.draw_tables(np.full(2_000, 50_000_000), np.repeat(py.code_of(np.array([64.0])), 2_000), 0.9, np.random.default_rng(0))
    assert abs(huge.mean() - (1 + 64 / 0.9)) < 1


def test_probabilities_are_averaged_over_rounds(spark):
    """Two rounds or more are kept after burn-in; their mean is still a law over the first word."""
    assert py.ROUNDS - py.BURN_IN > 1 and py.BURN_IN >= 1
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(30))) for i in [i for i in range(400) if not held(i)][:40]]
    asked = [*"abcdef", "zzz", ""]
    rows += list(zip([i for i in range(400) if held(i)], asked))
    got = [r for r in py.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) == len(asked) and sum(10 ** r.score for r in got) < 1 + 1e-6


def test_messages_are_unpacked_as_packed():
    for v in (np.array([], "<u8"), np.array([7], "u1"), np.arange(1000, dtype="<u8") * 10**12, np.array([0, 1, 2**32 - 1], "<u4"),
              np.array([0.5, -1e30], "<f4")):
        assert np.array_equal(py._unpack(py._pack(v), v.dtype.str), v)
    bucket, key = np.array([0, 0, 0, 2, 2]), np.array([3, 3, 9, 1, 2**48 - 1], np.uint64)
    assert np.array_equal(py._added(py._steps(bucket, key), np.array([3, 2])), key)


def test_distinct_and_order():
    rng = np.random.default_rng(5)
    for keys in (np.zeros(0, np.uint64), np.array([4], np.uint64), rng.integers(0, 50, 999, dtype=np.uint64)):
        for limit in (50, 2**60):  # one number for key and index, or two
            for got, want in zip(py._distinct(keys, limit), np.unique(keys, return_inverse=True)):
                assert np.array_equal(got, want)
    h = rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64)
    for some in (h, h[rng.integers(0, 5000, 9000)], h[:1], np.concatenate([h, h + np.uint64(1)])):  # the last shares first bits
        for got, want in zip(py._distinct_hashes(some), np.unique(some, return_inverse=True)):
            assert np.array_equal(got, want)
    assert np.array_equal(py._order(h), np.argsort(h >> np.uint64(13), kind="stable"))
    # buckets are ranges of the hash, also where near ties leave it out of order
    bucket = (h[py._order(h)] >> np.uint64(32)) * np.uint64(7) >> np.uint64(32)
    assert (np.diff(bucket.astype(np.int64)) >= 0).all()


def test_texts_are_split_into_words_once(spark):
    """The rounds read numbered words, not texts, and a round's questions are answered by what they need only."""
    docs = spark.createDataFrame([(i, f"some words of text {i % 3}") for i in range(20)], "doc_id long, text string")
    plan = py.score(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "vocabulary" in plan and "text#" not in plan


def test_numbered_words_are_the_tokens_of_the_texts():
    texts = ["a B  a\tc", None, "", "b b é a", "c"]
    ids = [4, None, 6, 7, 7]
    table = pa.table({"block": pa.array([3] * 5, pa.int32()), "doc_id": pa.array(ids, pa.int64()), "text": pa.array(["" if t is None else t for t in texts])})
    row = py._numbered(table)
    own = py.Block(row)
    want = [tokens(t) for t in texts]
    assert row.num_rows == 1 and row["block"].to_pylist() == [3] and own.ids == ids and np.diff(own.edge).tolist() == [len(w) for w in want]
    number = {}
    for w, at in zip((x for d in want for x in d), own.word.tolist()):
        assert number.setdefault(w, at) == at
    assert len(set(number.values())) == len(number) == len(own.vocabulary) - 1  # one more word: the beginning
    assert own.begin not in number.values() and own.vocabulary[own.begin] == py.BEGIN
    assert [int(c) for c in own.count] == [sum(at == i for at, t in zip(own.word, own.train) if t) for i in range(len(own.vocabulary))]


def test_first_of_equal_hashes():
    rng = np.random.default_rng(2)
    for h in (rng.integers(0, 1 << 63, 5_000).astype(np.uint64).repeat(2), rng.integers(1 << 40, (1 << 40) + 300, 1_000).astype(np.uint64),
              np.array([9], np.uint64), np.full(5, 7, np.uint64)):
        h = rng.permutation(h)
        for got, want in zip(py._first_hashes(h), np.unique(h, return_index=True, return_inverse=True)):
            assert np.array_equal(got, want)
