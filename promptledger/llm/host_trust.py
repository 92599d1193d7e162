"""URL filters: trust and distrust propagated over the host graph (operator 9).

Rules decide the urls they fit.  For the others, every host with an allowed
page is a trusted seed, and every host with a blocked page a blocked seed (a
host can be both); a seed weighs as much as the share of its pages that the
rules allow or block.  Personalised PageRank carries trust along the edges of
the host graph (a host vouches for the hosts it links to) and distrust against
them (a host that links to a bad host is suspect).  Edges are the hyperlinks
between hosts, and both directions between a host and its parent domain.

What a host receives from others is its rank less what it was given as a seed;
its suspicion is the distrust's share of what it receives.  The bar is
calibrated on the seeds, each judged by what it receives from others alone: it
lies midway between the mean suspicion of the blocked and of the allowed ones
(by weight).  A host is blocked if its suspicion is above the bar; hosts that
receive nothing are allowed, and so are all if there are not seeds of both
kinds to calibrate with, except those that receive distrust only.

All of it is DataFrame joins and sums: links are summed per pair of hosts
before they are shuffled, so a host with a third of all pages costs one row per
partition and pair, and no task holds a host's pages together.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed.  Null html has no links.  Repeated rows are
judged alike.  Of rules of equal length, a blocking one wins.  Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptledger.llm.storage import written

DAMPING, ROUNDS, CUT_EVERY = 0.85, 12, 4
MARGIN = 1e-9          # above the bar: sums of another order differ by less
NO_BAR = 1 - 2 * MARGIN  # without seeds of both kinds: only hosts that receive nothing but distrust are above it
MAX_RULES = 500        # rules are folded into one expression
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""

Rule = tuple[str, str, str]  # action (block or allow), host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _by_length(rules: list[Rule]) -> list[Rule]:
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r))


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its action (both null if none fits)."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in reversed(_by_length(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def judged_by_rules(pages: DataFrame, rules: list[Rule], *more: str) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rule, action = rule_of(rules, F.col("host"), F.col("path"))
    return (pages.select("page_id", host.alias("host"), path.alias("path"), *more)
            .withColumn("rule", rule).withColumn("action", action))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: hyperlinks between hosts, plus host to parent domain and back."""
    host, _ = host_and_path(F.col("url"))
    linked = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = (pages.select(host.alias("src"), linked.alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER))
             .where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n")))
    hosts = (pages.select(host.alias("host")).where("host != ''").distinct()
             .unionByName(links.select(F.col("dst").alias("host"))).distinct())
    # every ancestor of a host down to two labels, and the edge from each name to its parent
    label = F.split("host", r"\.")
    names = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(label) - 1, F.lit(1))),
                                               lambda i: F.concat_ws(".", F.slice(label, i, F.size(label))))).alias("host")).distinct()
    parent = F.regexp_extract("host", r"^[^.]*\.(.*\..*)$", 1)
    up = names.select(F.col("host").alias("src"), parent.alias("dst"), F.lit(1).cast("long").alias("n")).where("dst != ''")
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    return links.unionByName(up).unionByName(down).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, trust, distrust after ``ROUNDS`` steps from ``seeds(host, trust, distrust)`` (each summing to 1)."""
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    edges = written(edges.join(out, "src").join(into, "dst")
                    .select("src", "dst", (F.col("n") / F.col("out")).alias("along"), (F.col("n") / F.col("into")).alias("against")),
                    "host-edges")
    seeds = written(seeds, "host-seeds")
    base = seeds.select("host", *(((1 - DAMPING) * F.col(c)).alias(c) for c in ("trust", "distrust")))
    rank = seeds
    for step in range(1, ROUNDS + 1):
        on_src, on_dst = rank.withColumnRenamed("host", "src"), rank.withColumnRenamed("host", "dst")
        forward = edges.join(on_src, "src").select(F.col("dst").alias("host"), (DAMPING * F.col("trust") * F.col("along")).alias("trust"),
                                                   F.lit(0.0).alias("distrust"))
        back = edges.join(on_dst, "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("trust"),
                                                (DAMPING * F.col("distrust") * F.col("against")).alias("distrust"))
        rank = (base.unionByName(forward).unionByName(back).groupBy("host")
                .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
        if step % CUT_EVERY == 0 or step == ROUNDS:
            rank = written(rank, "host-ranks")
    return rank


def suspicion(rank: DataFrame, seeds: DataFrame) -> DataFrame:
    """``rank`` with the distrust's share of what the host receives from others (null if it receives nothing)."""
    given = seeds.select("host", *((F.lit(1 - DAMPING) * F.col(c)).alias(f"given_{c}") for c in ("trust", "distrust")))
    received = {c: F.greatest(F.col(c) - F.coalesce(f"given_{c}", F.lit(0.0)), F.lit(0.0)) for c in ("trust", "distrust")}
    some = received["trust"] + received["distrust"]
    return (rank.join(given, "host", "left")
            .select("host", "trust", "distrust", F.when(some > MARGIN * MARGIN, received["distrust"] / some).alias("suspicion")))


def bar(rank: DataFrame, seeds: DataFrame) -> float:
    """Midway between the mean suspicion of the allowed and the blocked seeds; ``NO_BAR`` without one of them."""
    own = rank.where("suspicion is not null").select("host", "suspicion").join(seeds, "host")
    means = own.agg(*(F.try_divide(F.sum(F.col(c) * F.col("suspicion")), F.sum(c)) for c in ("trust", "distrust"))).first()
    return NO_BAR if None in tuple(means) else sum(means) / 2


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    known = judged_by_rules(pages, rules)
    action = F.col("action")
    per_host = (known.where("host != ''").groupBy("host")
                .agg((F.count_if(action == "allow") / F.count("*")).alias("good"), (F.count_if(action == "block") / F.count("*")).alias("bad")))
    total = per_host.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seeds = (per_host.where("good > 0 or bad > 0")
             .select("host", (F.col("good") / F.lit(total.good or 1.0)).alias("trust"), (F.col("bad") / F.lit(total.bad or 1.0)).alias("distrust")))
    rank = suspicion(propagate(host_edges(pages), seeds), seeds)
    suspect = F.col("suspicion") > F.lit(bar(rank, seeds) + MARGIN)
    return (known.join(rank, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("action", F.when(suspect, F.lit("block")), F.lit("allow")).alias("verdict"), "trust", "distrust"))


def sql(rules: list[Rule]) -> str:
    """The same over the view ``pages`` in DuckDB, one CTE per step."""
    def fits(h: str, p: str) -> str:
        return f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"

    ordered = _by_length(rules)
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h + p}'" for _, h, p in ordered) + " end"
    action = "case " + " ".join(f"when {fits(h, p)} then '{a}'" for a, h, p in ordered) + " end"
    link = LINK.replace("'", "''")
    steps, last = [], "seeds"
    for i in range(ROUNDS):
        steps.append(f"""r{i} as materialized (select host, sum(trust) trust, sum(distrust) distrust from (
          select host, {1 - DAMPING} * trust trust, {1 - DAMPING} * distrust distrust from seeds
          union all select dst, {DAMPING} * trust * along, 0 from e join {last} on src = host
          union all select src, 0, {DAMPING} * distrust * against from e join {last} on dst = host) group by host)""")
        last = f"r{i}"
    return f"""
    with u as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
    h as materialized (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
    k as materialized (select page_id, host, path, {rule} "rule", {action} "action" from h),
    per as (select host, count(*) filter ("action" = 'allow') / count(*) good, count(*) filter ("action" = 'block') / count(*) bad
              from k where host != '' group by host),
    seeds as materialized (select host, good / coalesce(nullif((select sum(good) from per), 0), 1) trust,
            bad / coalesce(nullif((select sum(bad) from per), 0), 1) distrust from per where good > 0 or bad > 0),
    l as (select host src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') dst from h),
    links as (select src, dst, count(*) n from l where src != '' and dst != '' and src != dst group by all),
    hosts as (select distinct host from h where host != '' union select dst from links),
    parts as (select string_split(host, '.') p from hosts),
    names as (select distinct array_to_string(p[i:], '.') host from parts, lateral (select unnest(range(1, greatest(len(p), 2))) i)),
    up as (select host src, regexp_extract(host, '^[^.]*\\.(.*\\..*)$', 1) dst, 1 n from names),
    e0 as (select src, dst, sum(n) n from (select * from links union all select * from up where dst != ''
           union all select dst, src, n from up where dst != '') group by all),
    e as materialized (select src, dst, n / sum(n) over (partition by src) along, n / sum(n) over (partition by dst) against from e0),
    {", ".join(steps)},
    got as (select r.host, r.trust, r.distrust, s.trust good, s.distrust bad,
            greatest(r.trust - coalesce({1 - DAMPING} * s.trust, 0), 0) t, greatest(r.distrust - coalesce({1 - DAMPING} * s.distrust, 0), 0) d
            from {last} r left join seeds s on r.host = s.host),
    judged as materialized (select host, trust, distrust, good, bad, case when t + d > {MARGIN * MARGIN} then d / (t + d) end suspicion from got),
    means as (select sum(good * suspicion) / nullif(sum(good), 0) g, sum(bad * suspicion) / nullif(sum(bad), 0) b
              from judged where suspicion is not null),
    cut as (select coalesce((g + b) / 2, {NO_BAR!r}) + {MARGIN} bar from means)
    select page_id, k.host, path, "rule", coalesce("action", case when suspicion > (select bar from cut) then 'block' end, 'allow') verdict,
           trust, distrust from k left join judged r on k.host = r.host"""
