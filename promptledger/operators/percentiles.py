"""Exact order statistics without a global sort.

``sorted(values)[int(n * p)]`` (zero-based) for several ``p`` at once.  Each
rank is bracketed between two values:

1. one pass takes approximate percentiles a little below and above each rank
   (a mergeable sketch);
2. one pass counts the values below and up to those two, and takes their
   neighbours.  The rank lies between them, below or above: whichever it is
   becomes the bracket.  Steps 1 and 2 repeat on the bracket's own rows while
   it holds more than ``MOST``;
3. one pass counts each distinct value inside the brackets and picks the one
   at the rank.

Every step is an aggregate with partial results per partition, right whatever
the sketch returns; no more than ``MOST`` values of a bracket come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 50_000       # rows of a bracket that one aggregate may hold
ACCURACY = 10_000   # of the approximate percentiles: a rank error of n / ACCURACY


def exact_percentiles(df: DataFrame, value_col: str, ps: list[float], names: list[str], most: int = MOST,
                      accuracy: int = ACCURACY) -> DataFrame:
    """One row: ``n`` and ``names[i]`` = the value at zero-based rank ``floor(n * ps[i])``
    of the non-null ``value_col`` (null if there is no such rank)."""
    v, kind = F.col("v"), df.schema[value_col].dataType
    vals = df.select(F.col(value_col).alias("v")).where(v.isNotNull())
    n, least, largest = vals.agg(F.count("*"), F.min("v"), F.max("v")).first()
    rank = {name: int(n * p) for name, p in zip(names, ps) if int(n * p) < n}
    # value range of the bracket, rows below it, rows inside it
    bracket = {name: (least, largest, 0, n) for name in rank}
    stuck: set[str] = set()
    while wide := [x for x, (lo, hi, _, inside) in bracket.items() if inside > most and lo != hi]:
        sketch = []
        for x in wide:
            lo, hi, below, inside = bracket[x]
            at, slack = (rank[x] - below) / inside, 0.0 if x in stuck else 2 / accuracy
            sketch.append(F.percentile_approx(F.when(v.between(lo, hi), v), [max(0.0, at - slack), min(1.0, at + slack)], accuracy))
        tried = dict(zip(wide, vals.agg(*sketch).first()))
        counts = []
        for a, b in tried.values():
            counts += [F.count_if(v < a), F.count_if(v <= b), F.max(F.when(v < a, v)), F.min(F.when(v > b, v))]
        got = vals.agg(*counts).first()
        for j, x in enumerate(wide):
            (a, b), (under, upto, before, after) = tried[x], got[4 * j: 4 * j + 4]
            lo, hi, below, inside = old = bracket[x]
            if rank[x] < under:
                bracket[x] = (lo, before, below, under - below)
            elif rank[x] >= upto:
                bracket[x] = (after, hi, upto, below + inside - upto)
            else:
                bracket[x] = (a, b, under, upto - under)
            # equal values can fill both ends: then one value splits the bracket
            (stuck.add if bracket[x] == old else stuck.discard)(x)
    picks = [_pick(bracket[x], rank[x], kind).alias(x) if x in rank else F.lit(None).cast(kind).alias(x) for x in names]
    some = F.lit(False)
    for lo, hi, _, _ in bracket.values():
        if lo != hi:
            some = some | v.between(lo, hi)
    counted = vals.where(some).groupBy("v").agg(F.count("*").alias("c"))
    return counted.agg(F.lit(n).cast("bigint").alias("n"), *picks)


def _pick(bracket: tuple, rank: int, kind) -> Column:
    """Aggregate over (v, c): the value at ``rank`` among the bracket's values."""
    lo, hi, below, _ = bracket
    if lo == hi:
        return F.lit(lo).cast(kind)
    rows = F.sort_array(F.collect_list(F.when(F.col("v").between(lo, hi), F.struct("v", "c"))))
    start = F.struct(F.lit(below).cast("bigint").alias("seen"), F.lit(None).cast(kind).alias("v"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["c"]
        return F.struct(seen.alias("seen"), F.when(acc["v"].isNull() & (seen > rank), x["v"]).otherwise(acc["v"]).alias("v"))

    return F.aggregate(rows, start, step, lambda acc: acc["v"])
