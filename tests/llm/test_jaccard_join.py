"""Operator 3 against brute force over all pairs."""

import random
import re


from llm_rows import nothing, odd, odd_rows, prose  # noqa: F401  (fixtures)

from promptledger.llm import jaccard_join
from promptledger.llm.components import components, extended


def brute(rows, k, num, den=100):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[j: j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(den * len(x & y) >= num * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i)) for i in ids for s in sets[i])


def got(df, k, num):
    return sorted(tuple(r) for r in jaccard_join.grouped(df, k, num).collect())


def test_near_copies_and_crowds(spark):
    rng = random.Random(2)
    rows, i = [], 0
    for size in (1, 2, 3, 5, 40):
        seed = prose(rng, 120).split()
        for _ in range(size):
            w = list(seed)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((i, " ".join(w).upper() if i % 7 == 0 else "  ".join(w)))
            i += 1
    rows += [(i + j, "the same short text") for j in range(4)] + [(i + 9, "the same"), (i + 10, "the SAME\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, 3, 90) == brute(rows, 3, 90)
    assert got(df, 5, 80) == brute(rows, 5, 80)


def test_links_of_a_crowd_grow_with_its_members_only(spark):
    rng, rows = random.Random(5), []
    seed = prose(rng, 200).split()
    for i in range(240):
        w = list(seed)
        w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    _, links, _ = jaccard_join.join(df, 5, 80)
    assert links.count() <= 240 * jaccard_join.PICKS * jaccard_join.DEAL
    assert {r[2] for r in got(df, 5, 80)} == {0}


def test_odd_rows_and_empty_table(odd, odd_rows, nothing):
    assert got(odd, 3, 90) == brute(odd_rows, 3, 90)
    assert got(nothing, 3, 90) == []


def test_one_document_of_each_group_stays(spark, odd):
    kept = jaccard_join.distinct_documents(odd).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12]
    assert kept[0].asDict().keys() == odd.first().asDict().keys()
    null = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in jaccard_join.distinct_documents(null).collect()) == [0, 0, 1]


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (100, 100)], "a long, b long")
    found = {r.id: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert components(links.where("a < 0")).count() == 0


def test_components_are_extended_by_further_links(spark):
    label = components(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long"))
    more = spark.createDataFrame([(2, 4), (4, 1), (8, 7), (9, 6), (5, 6)], "a long, b long")
    assert {r.id: r.component for r in extended(label, more).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 5}
    assert extended(label, more.where("a < 0")).count() == 6
