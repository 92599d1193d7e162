"""Mixing sources to target weights by a low-discrepancy schedule (operator 11).

1. Sources in code-point order (null last) weigh ``WEIGHTS``, repeating, and
   share all words of the input.  A source gets at most ``MOST`` times its own
   words; the excess is shared again by weight until no target is above.
2. Each source's documents are shuffled (by a hash of id and text) and laid end
   to end as a circular stream of words, cut into blocks of ``BLOCK`` words.
3. Slot j of the schedule is the point j * golden ratio modulo 1.  Mapped
   through the cumulative targets, it names the slot's source.
4. The slots of a source are ranked; the slot of rank r takes the words
   r * BLOCK to (r + 1) * BLOCK of the endless repetition of the source's
   stream, up to the source's target.  Blocks of slots and pieces of documents
   are joined on (source, block).
5. The points miss a source's share by a few blocks at most (the discrepancy of
   the sequence); what is still missing is taken by slots after the last one,
   so every source takes its target, rounded to a word.

All ranks and running sums go in two steps, within parts of bounded size and
over the parts' totals, so a source with a third of all words is spread over
many tasks.  Texts are read once, for their size and hash, and never shuffled.
Only DataFrame functions are used; single rows of totals reach the driver.

Defined results: a null, empty or blank text has size 0 and nothing is taken of
it.  Rows that agree in id, text and source are documents of their own and
interchangeable.  A null source is one more source.  An empty table gives an
empty result; further columns are ignored.  The schedule has at most 2^40 slots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptledger.llm.storage import small, written

WEIGHTS, MOST, BLOCK = (5, 2, 1), 3, 1024
PART = 1 << 14                       # documents (on average) and slots of one part of a running sum
UNIT = 40                            # points are multiples of 2^-40
GOLDEN = 679_568_617_637             # odd integer next to 2^40 / golden ratio
BLANK = r"\x20\x09-\x0D"


def size_of(text: str) -> Column:
    """Number of words: each is replaced with one letter, together with the blanks after it."""
    marks = F.regexp_replace(F.col(text), f"[{BLANK}]*+[^{BLANK}]++", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def _after(df: DataFrame, by: list[str], part: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all earlier rows of the same ``by``, in the order of (part, order)."""
    # the window and the join deal rows by the same columns, so rows move once
    totals = df.groupBy(*by, part).agg(F.sum(value).alias("_all"))
    before = totals.select(*by, part, (F.sum("_all").over(Window.partitionBy(*by).orderBy(part)) - F.col("_all")).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return df.withColumn("_inner", inner).join(before, [*by, part]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_inner", "_before")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and key (a hash of id and text) of every document; the only pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of("text").alias("size"),
                       F.substring(F.sha2(F.concat_ws(":", F.lit("11"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text), 256), 1, 16).alias("key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, rank (from 0), weight, target, and ``below``: the sum of the targets of earlier sources."""
    per = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"))
                  .repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    order = [F.col("source").asc_nulls_last()]
    ranked = _after(per.withColumn("one", F.lit(1)).withColumn("all", F.lit(0)), ["all"], "part", order, "one", "rank")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", "part", "rank", weight.cast("long").alias("weight")), "mix-ranks")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rest, heavy, open_ = float(total), 0.0, None
    cap = F.col("source_size") * F.lit(float(most))
    while True:  # a round ends with more sources at their cap or is the last
        live = ranked if open_ is None else ranked.where(open_)
        heavy = float(live.agg(F.sum("weight")).first()[0] or 0)
        if not heavy:
            break
        share = F.col("weight") * F.lit(rest) / F.lit(heavy)
        over = live.where(share > cap).agg(F.count("*").alias("n"), F.sum("source_size").alias("s")).first()
        if not over["n"]:
            break
        # the level only rises, so what is above its cap once stays there
        fits = share <= cap
        open_ = fits if open_ is None else open_ & fits
        rest -= float(most) * over["s"]
    share = F.col("weight") * F.lit(rest) / F.lit(heavy or 1.0)
    target = share if open_ is None else F.when(open_, share).otherwise(cap)
    found = ranked.withColumn("target", target.cast("double"))
    return written(_after(found.withColumn("all", F.lit(0)), ["all"], "part", order, "target", "below").drop("part", "all"), "mix-targets")


def streams(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """doc_id, size, rank of the source and ``at``: where the document starts in its source's stream (null: no words)."""
    n = sized.count()
    digits = max(0, math.ceil(math.log(max(n, 1) / PART, 16)))
    named = (sized.join(small(goal.select(F.col("source").alias("_source"), "rank")), F.col("source").eqNullSafe(F.col("_source")))
             .select("doc_id", "size", "rank", "key", F.substring("key", 1, digits).alias("part")))
    return written(_after(named, ["rank"], "part", [F.col("key"), F.col("doc_id"), F.col("size")], "size", "at")
                   .select("doc_id", "size", "rank", F.when(F.col("size") > 0, F.col("at")).alias("at")), "mix-streams")


def point(j: Column) -> Column:
    """j * GOLDEN modulo 2^UNIT, without overflow of a long."""
    half = UNIT // 2
    high, low, mask = GOLDEN >> half, GOLDEN & ((1 << half) - 1), (1 << UNIT) - 1
    return (F.shiftleft((j * F.lit(high)).bitwiseAND(F.lit((1 << half) - 1)), half) + j * F.lit(low)).bitwiseAND(F.lit(mask))


def schedule(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, rank (of the source), turn (rank of the slot within its source), first and last word (exclusive) of the endless stream."""
    spark = goal.sparkSession
    whole = goal.agg(F.sum("target").alias("all"), F.count("*").alias("n")).first()
    total, n = whole["all"] or 0.0, whole["n"]
    slots = math.ceil(total / block)
    want = goal.select("rank", "below", "target", F.round("target").cast("long").alias("want"))
    scale = float(1 << UNIT)
    bins = min(20, max(6, math.ceil(math.log2(max(n, 1))) + 2))
    edge = lambda at: F.least(F.floor(at / F.lit(total or 1.0) * scale), F.lit(1 << UNIT)).cast("long")
    spans = (want.withColumn("lo", edge(F.col("below"))).withColumn("hi", edge(F.col("below") + F.col("target"))).where("hi > lo")
             .withColumn("bin", F.explode(F.sequence(F.shiftright("lo", UNIT - bins), F.shiftright(F.col("hi") - 1, UNIT - bins)))))
    drawn = (spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("x"))
             .withColumn("at_bin", F.shiftright("x", UNIT - bins))
             .join(small(spans.select("bin", "lo", "hi", "rank", "want")), (F.col("at_bin") == F.col("bin")) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
             .select("slot", "rank", "want", F.expr(f"slot div {PART}").alias("part"), F.lit(1).alias("one")))
    turns = _after(drawn, ["rank"], "part", [F.col("slot")], "one", "turn").select("slot", "rank", "want", "turn")
    have = turns.groupBy(F.col("rank").alias("_rank")).agg(F.count("*").alias("n"))
    # after the last point: the blocks that a source still lacks, in order of source and turn
    lacking = (want.join(have, F.col("rank") == F.col("_rank"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
               .where(F.col("n") * block < F.col("want"))
               .select(F.lit(slots).cast("long").alias("slot"), "rank", "want",
                       F.explode(F.sequence(F.col("n"), F.expr(f"(want - 1) div {block}"))).alias("turn")))
    return (turns.unionByName(lacking).withColumn("first", F.col("turn") * block).where("first < want")
            .select("slot", "rank", "turn", "first", F.least(F.col("first") + block, "want").alias("last")))


def pieces(laid: DataFrame, goal: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: slot, rank, turn, epoch, doc_id, at (of the document in its stream), from_word and n_words, a row per piece of a document."""
    length = goal.where("source_size > 0").select(F.col("rank").alias("_rank"), "source_size")
    lap = (plan.join(small(length), F.col("rank") == F.col("_rank"))
           .withColumn("epoch", F.explode(F.expr("sequence(first div source_size, (last - 1) div source_size)")))
           .withColumn("lo", F.greatest(F.col("first") - F.col("epoch") * F.col("source_size"), F.lit(0)))
           .withColumn("hi", F.least(F.col("last") - F.col("epoch") * F.col("source_size"), F.col("source_size")))
           .withColumn("block", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
           .select("slot", "rank", "turn", "epoch", "lo", "hi", "block"))
    cut = (laid.where("size > 0").withColumn("end", F.col("at") + F.col("size"))
           .withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (end - 1) div {block})")))
           .select("doc_id", "rank", "block", "at", F.greatest("at", F.col("block") * block).alias("p_lo"), F.least("end", (F.col("block") + 1) * block).alias("p_hi")))
    both = lap.join(cut, ["rank", "block"]).withColumn("f", F.greatest("lo", "p_lo")).withColumn("t", F.least("hi", "p_hi")).where("f < t")
    return both.select("slot", "rank", "turn", "epoch", "doc_id", "at", (F.col("f") - F.col("at")).alias("from_word"), (F.col("t") - F.col("f")).alias("n_words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets per source, documents with their place, pieces of the mix in order of slot, turn, epoch, at)."""
    sized = written(sizes(docs), "mix-sizes")
    goal = targets(sized, weights, most)
    laid = streams(sized, goal)
    return goal, laid, pieces(laid, goal, schedule(goal, block), block)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of every document."""
    goal, laid, mixed = mix(docs)
    taken = mixed.groupBy(F.col("rank").alias("_r"), F.col("at").alias("_at")).agg(F.sum("n_words").alias("taken"))
    return (laid.join(taken, (F.col("rank") == F.col("_r")) & (F.col("at") == F.col("_at")), "left")
            .join(small(goal.select(F.col("rank").alias("_rank"), "source_size", "target")), F.col("rank") == F.col("_rank"))
            .select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def sql(weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> str:
    """DuckDB twin of ``digest`` over ``documents``: each source's stream is read from its start up to its target.

    Targets by the sorted caps: the capped sources are those with the least cap per weight.
    """
    picks = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return f"""
    with d as materialized (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+')) as bigint) size,
                  substr(sha256('11:' || coalesce(cast(doc_id as varchar), 'null') || ':' || coalesce(text, '')), 1, 16) key from documents),
    s as (select *, row_number() over (order by source nulls last) - 1 rank from (select source, cast(sum(size) as bigint) source_size from d group by source)),
    w as (select *, case rank % {len(weights)} {picks} end w from s),
    f as (select *, {float(most)} * source_size cap, sum(source_size) over () total, sum(w) over () all_w,
                 {float(most)} * coalesce(sum(source_size) over (order by source_size / w, rank rows between unbounded preceding and 1 preceding), 0) cap_before,
                 coalesce(sum(w) over (order by source_size / w, rank rows between unbounded preceding and 1 preceding), 0) w_before from w),
    level as (select rank, (w * cast(total - cap_before as double)) / cast(all_w - w_before as double) > cap capped from f),
    rest as (select max(total) - coalesce(sum(cap) filter (capped), 0) rest, sum(w) filter (not capped) heavy from f join level using (rank)),
    t as (select source, source_size, case when capped then cap else (w * cast(rest as double)) / cast(heavy as double) end target
          from f join level using (rank), rest),
    o as (select d.*, source_size, target, cast(round(target) as bigint) want,
                 cast(sum(size) over (partition by d.source order by key, d.doc_id nulls first, size rows between unbounded preceding and current row) - size as bigint) before
          from d join t on d.source is not distinct from t.source)
    select doc_id, size, source_size, target,
           case when size = 0 then 0 else size * (want // source_size) + least(greatest(want % source_size - before, 0), size) end taken from o"""
