"""Runs against a search of every period; the exact pre-test; odd rows."""

import hashlib
import random
import zlib

import numpy as np
from llm_rows import nothing, odd, odd_rows, prose  # noqa: F401

from promptledger.llm import periodic_runs as p
from promptledger.llm.batches import mix


def brute(x, least=12):
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            w = x[i: i + size]
            if j > i and size >= max(least, 2 * q) and not any(w[t:] == w[: size - t] for t in range(1, q)):
                out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 4, 30])
    x = [rng.randrange(k) for _ in range(n)]
    if n > 3 and rng.random() < 0.5:
        a, size = rng.randrange(n), rng.choice([2, 3, 5])
        x = [x[i] if i < a else x[a + (i - a) % (1 + (n - a) // size)] for i in range(n)]
    return x


def test_runs_equal_a_search_of_every_period():
    rng = random.Random(1)
    for _ in range(1500):
        x = some_words(rng)
        assert p.runs_of(x) == brute(x) and p.runs_of(x, 2) == brute(x, 2)


def test_no_run_lies_outside_the_stretches():
    rng = random.Random(2)
    for _ in range(1500):
        x = some_words(rng)
        h = mix(np.array(x, np.uint64) + np.uint64(7))
        got = [(a + lo, n, q) for lo, hi in p.stretches(h, np.zeros(len(x), np.int64)) for a, n, q in p.runs_of(x[lo:hi])]
        assert sorted(got, key=lambda r: (r[0], r[2])) == brute(x)


def test_long_periodic_words_take_few_steps():
    words = [i % 700 for i in range(60_000)]
    paths = p.LinkCutPaths((sam := p.SuffixLinks(words)).link, sam.length)
    met = sum(len(paths.access(s, i)) for i, s in enumerate(sam.prefix))
    assert met < 20 * len(words) and p.runs_of(words) == [(0, 60_000, 700)]
    assert p.runs_of([1] * 30_000) == [(0, 30_000, 1)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, q = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % q] for i in range(n)]
    found = brute(words) if n < 2000 else p.runs_of(p._numbers(words))
    drop = {i for a, size, q in found for i in range(a + q, a + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{a},{size},{q}\n" for a, size, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), n)


def same(got, want):
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_digest_of_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = prose(rng, rng.randrange(0, 120)).split()
        if i % 3 == 0 and words:
            at = rng.randrange(len(words))
            words[at:at] = words[at: at + rng.randrange(1, 9)] * rng.randrange(2, 9)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, runs string")
    got = p.digest(df).collect()
    same(got, [expected(*r) for r in rows])
    assert sum(r["n_runs"] > 0 for r in got) > 50


def test_odd_rows_and_nothing(spark, odd, odd_rows, nothing):  # noqa: F811
    more = [(None, "a b " * 20), (20, "na " * 3_000), (21, prose(random.Random(9), 30_000))]
    df = odd.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, key long"))
    same(p.digest(df).collect(), [expected(*r) for r in odd_rows + more])
    assert p.digest(nothing).collect() == []
