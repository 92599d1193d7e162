"""The mix against a schedule written out word by word in Python, and odd rows."""

import math
import random
from collections import Counter, defaultdict

import pytest
from llm_rows import nothing, odd, odd_rows, prose  # noqa: F401

from promptledger.llm import source_mix as m


def water(sizes, weights=m.WEIGHTS, most=m.MOST):
    """Targets by giving out the excess again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        heavy = sum(weight[s] for s in names if s not in capped)
        share = {s: most * sizes[s] if s in capped else weight[s] * rest / heavy for s in names}
        over = {s for s in names if s not in capped and share[s] > most * sizes[s]}
        if not over:
            return names, share
        capped |= over


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, rng.choice(["web"] * 6 + ["books", "code", "a", "é", None]), prose(rng, rng.choice([0, 1, 5, 40, 300]))) for i in range(400)]
    return out + [(7, "web", "same row twice"), (7, "web", "same row twice"), (None, "code", "no id"), (401, "tiny", "one two"), (402, "web", prose(rng, 9000))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, source string, text string, rank long, part string, size int")


def test_targets_are_shared_by_weight_under_the_caps(docs, rows):
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(t.split())
    names, share = water(sizes)
    found = {r["source"]: r for r in m.targets(m.sizes(docs)).collect()}
    assert {s: r["rank"] for s, r in found.items()} == {s: i for i, s in enumerate(names)}
    assert all(math.isclose(found[s]["target"], share[s], rel_tol=1e-12) for s in names)
    assert any(share[s] == 3 * sizes[s] for s in names) and math.isclose(sum(share.values()), sum(sizes.values()))


@pytest.mark.parametrize("block", [16, 1024])
def test_pieces_follow_the_schedule_of_points(spark, docs, rows, block):
    goal, laid, mixed = m.mix(docs, block=block)
    goals = {r["rank"]: r for r in goal.collect()}
    total = sum(g["target"] for g in goals.values())
    # the schedule, point by point
    turn, plan = Counter(), []
    for j in range(math.ceil(total / block)):
        x = j * m.GOLDEN % (1 << m.UNIT) / (1 << m.UNIT) * total
        s = max((r for r in goals if goals[r]["below"] <= x and goals[r]["target"] > 0), key=lambda r: goals[r]["below"])
        plan.append((j, s, turn[s]))
        turn[s] += 1
    got = m.schedule(goal, block).collect()
    want = {s: math.floor(goals[s]["target"] + 0.5) for s in goals}
    assert sorted((r["slot"], r["rank"], r["turn"]) for r in got if r["slot"] < len(plan)) == [p for p in plan if p[2] * block < want[p[1]]]
    assert sum(r["slot"] >= len(plan) for r in got) <= 12 * len(goals)
    # every source's pieces, in order of the schedule, read its endless stream from the start to its target
    stream = defaultdict(list)
    for r in sorted((r for r in laid.collect() if r["at"] is not None), key=lambda r: r["at"]):
        assert r["at"] == len(stream[r["rank"]])
        stream[r["rank"]] += [(r["at"], w) for w in range(r["size"])]
    out = defaultdict(list)
    for r in sorted(mixed.collect(), key=lambda r: (r["slot"], r["turn"], r["epoch"], r["at"], r["from_word"])):
        out[r["rank"]] += [(r["at"], w) for w in range(r["from_word"], r["from_word"] + r["n_words"])]
    assert all(out[s] == (stream[s] * 4)[: want[s]] for s in goals)


def test_digest_of_sources_and_documents(docs, rows):
    got = m.digest(docs).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[(r["source_size"], r["target"])].append(r["taken"])
    assert all(sum(t) == math.floor(target + 0.5) for (_, target), t in by.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, m.digest(docs.repartition(7)).collect()), key=str)


def test_odd_rows_and_nothing(spark, odd, nothing, odd_rows):  # noqa: F811
    got = m.digest(odd.withColumnRenamed("lang", "source")).collect()
    assert len(got) == len(odd_rows) and {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    sizes = Counter((i, len((t or "").encode().split())) for i, t in odd_rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == sizes
    assert m.digest(nothing.withColumnRenamed("lang", "source")).collect() == []
    blank = spark.createDataFrame([(1, "a", " "), (2, None, None)], "doc_id long, source string, text string")
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in m.digest(blank).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
