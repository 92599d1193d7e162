"""Operator 2 against brute force over all 100-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from llm_rows import nothing, odd_rows, prose  # noqa: F401  (fixtures)

from promptledger.llm import repeats


def brute(rows):
    seen, out = set(), {}
    for n, (i, text) in enumerate(sorted(rows, key=lambda r: (r[0], r[1] or ""))):
        data = (text or "").encode()
        cut = np.zeros(len(data) + 1, int)
        for s in range(len(data) - 99):
            x = data[s: s + 100]
            if x in seen:
                cut[s] += 1
                cut[s + 100] -= 1
            seen.add(x)
        gone = np.cumsum(cut)[:-1] > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        out.setdefault(i, []).append((len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in repeats.digest(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {i: sorted(v) for i, v in got.items()} == brute(rows)


def test_odd_rows(spark, odd_rows):
    check(spark, odd_rows)


def test_copies_edits_and_shared_passages(spark):
    rng = random.Random(5)
    base = [prose(rng, 80) for _ in range(12)]
    passage = prose(rng, 30)
    rows = []
    for i in range(150):
        t = rng.choice(base)
        if i % 3 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        if i % 2 == 0:
            t = prose(rng, rng.randrange(8)) + " " + passage + " " + prose(rng, rng.randrange(8)) + t
        if i % 10 == 0:
            t = "ab" * rng.randrange(40, 140) + t + "\n" * 120
        rows.append((i, t))
    check(spark, rows)  # the passage stands in more different contexts than a block brings together


def test_empty_table(nothing):
    assert repeats.digest(nothing).count() == 0


def naive_repeats(stretches, windows):
    """Groups of places with a common prefix of at least 100 bytes that cannot be extended, by trying all pairs."""
    places = [(j, t) for j, n in enumerate(windows) for t in range(n)]

    def lcp(p, q):
        a, b = stretches[p[0]][p[1]:], stretches[q[0]][q[1]:]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    found = set()
    for p in places:
        for length in {lcp(p, q) for q in places if q != p}:
            if length >= 100:
                group = tuple(sorted(q for q in places if stretches[q[0]][q[1]: q[1] + length] == stretches[p[0]][p[1]: p[1] + length]
                                     and len(stretches[q[0]]) - q[1] >= length))
                before = {stretches[j][t - 1] if t else -1 - j for j, t in group}
                if len(group) > 1 and len(before) > 1:
                    found.add((length, group))
    return found


@pytest.mark.parametrize("seed", range(6))
def test_interval_tree_gives_all_maximal_repeats(seed):
    rng = random.Random(seed)
    core = bytes(rng.choice(b"ab") for _ in range(118))
    stretches = []
    for _ in range(9):
        lo, hi = rng.randrange(6), rng.randrange(104, 118)
        stretches.append(bytes(rng.choice(b"abc\0") for _ in range(rng.randrange(4))) + core[lo:hi] + bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(5))))
    windows = np.array([len(s) - 99 for s in stretches])
    stretches = [s for s, n in zip(stretches, windows) if n > 0]
    windows = windows[windows > 0]
    sa = repeats.SuffixArray(stretches, windows)
    got = {(length, tuple(sorted(zip(sa.stretch[lo:hi].tolist(), sa.place[lo:hi].tolist())))) for length, lo, hi in sa.maximal_repeats()}
    assert got == naive_repeats(stretches, windows.tolist())
