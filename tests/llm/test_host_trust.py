"""Operator 9: rules, and propagation against numpy."""

import duckdb
import numpy as np

from promptledger.llm import host_trust as ht

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [("http://a.example.net/en/1", "allow", "example.net/en/"), ("https://EXAMPLE.NET/de/", "block", "net/"), ("ftp://x.net", None, None),
        ("http://example.com/de/x?y#z", "block", "example.com/de/"), ("http://badexample.com/de/", None, None), ("http://q.org/fr/", "allow", "org/fr/"),
        ("no scheme", None, None), (None, None, None), ("", None, None), ("http://q.org?/fr/", None, None), ("http://a.net:80/x", None, None)]


def pages(spark, html="<a href='http://evil.net/x'>"):
    return spark.createDataFrame([(i, u, html, "x", 1.0) for i, (u, _, _) in enumerate(URLS)] + [(0, URLS[0][0], None, None, None)],
                                 "page_id long, url string, html string, host string, trust double")


def test_rules_and_odd_urls(spark):
    got = {r.page_id: r for r in ht.judge(pages(spark), RULES).collect()}
    for i, (_, verdict, rule) in enumerate(URLS):
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict)
    assert (got[0].host, got[0].path) == ("a.example.net", "/en/1") and (got[7].host, got[7].path, got[7].verdict) == ("", "", "allow")
    assert (got[9].host, got[9].path) == ("q.org", "") and (got[3].path, got[10].host) == ("/de/x", "a.net:80")
    assert ht.judge(pages(spark).where("page_id < 0"), RULES).count() == 0


def test_same_as_sql(spark, tmp_dir):
    rows = [(i, f"http://h{i % 2}.site{i % 4}.{'net' if i % 4 == 0 else 'com'}/{'en' if i % 2 else 'de'}/", "".join(
        f'<a HREF = "https://H{(i * k) % 2}.site{k % 4}.{"net" if k % 4 == 0 else "com"}/">' for k in range(i % 5))) for i in range(200)]
    rows += [(200 + i, "http://spam.com/", "<a href='//only.farm.net/'>") for i in range(20)] + [(300 + i, "http://only.farm.net/de/", None) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = [("block", "farm.net", "/de/"), ("allow", "site1.com", "/")]
    got = {r.page_id: r for r in ht.judge(df, rules).collect()}
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = con.execute("select page_id, host, path, \"rule\", verdict, trust, distrust from (" + ht.sql(rules) + ")").fetchall()
    for p, host, path, rule, verdict, trust, distrust in want:
        r = got[p]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
        assert np.allclose([r.trust or 0, r.distrust or 0], [trust or 0, distrust or 0])
    assert got[200].rule is None and got[200].verdict == "block"
    assert "allow" in {r.verdict for r in got.values() if r.rule is None}


def test_propagation_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = 12
    w = rng.integers(0, 3, (n, n)) * (1 - np.eye(n, dtype=int))
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h1", 0.0, 1.0)], "host string, trust double, distrust double")
    t, b = np.eye(n)[0], np.eye(n)[1]
    along, against = w / np.maximum(w.sum(1, keepdims=True), 1), w / np.maximum(w.sum(0, keepdims=True), 1)
    x, y = t.copy(), b.copy()
    for _ in range(ht.ROUNDS):
        x = (1 - ht.DAMPING) * t + ht.DAMPING * along.T @ x
        y = (1 - ht.DAMPING) * b + ht.DAMPING * against @ y
    got = {r.host: r for r in ht.propagate(edges, seeds).collect()}
    for i in range(n):
        r = got.get(f"h{i}")
        assert np.allclose([r.trust if r else 0, r.distrust if r else 0], [x[i], y[i]])


def test_a_host_with_some_blocked_pages_is_a_seed(spark):
    """30% of the pages of mixed.net are blocked; farm.com, which only links to it, is blocked for that."""
    rows = [(i, f"http://mixed.net/{'de' if i < 3 else 'xx'}/", None) for i in range(10)]
    rows += [(20 + i, "http://farm.com/", "<a href='http://mixed.net/'>") for i in range(5)]
    rows += [(40 + i, f"http://good{i}.org/fr/", f"<a href='http://plain{i}.com/'>") for i in range(8)] + [(60 + i, f"http://plain{i}.com/", None) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in ht.judge(df, [("block", "mixed.net", "/de/"), ("allow", "org", "/fr/")]).collect()}
    assert all(got[i] == "block" for i in [*range(3), *range(20, 25)])
    assert all(got[i] == "allow" for i in [*range(40, 48), *range(60, 68)])


def test_bar_lies_between_the_seeds_of_both_kinds(spark):
    seeds = spark.createDataFrame([("a", 0.75, 0.0), ("b", 0.25, 0.5), ("c", 0.0, 0.5)], "host string, trust double, distrust double")
    own = 1 - ht.DAMPING
    # received from others: a 0.3 trust and 0.1 distrust, b nothing, c distrust only; d is no seed
    rank = spark.createDataFrame([("a", 0.75 * own + 0.3, 0.1), ("b", 0.25 * own, 0.5 * own), ("c", 0.0, 0.5 * own + 0.2), ("d", 0.3, 0.1)],
                                 "host string, trust double, distrust double")
    found = ht.suspicion(rank, seeds)
    got = {r.host: r.suspicion for r in found.collect()}
    assert np.allclose([got["a"], got["c"], got["d"]], [0.25, 1.0, 0.25]) and got["b"] is None
    assert np.isclose(ht.bar(found, seeds), (0.25 + 1.0) / 2)
    assert ht.bar(found, seeds.withColumn("trust", seeds.trust * 0)) == ht.NO_BAR
