"""N-gram Jaccard self-join by prefix filtering (operator 3).

A document's set holds the hashes of its distinct ``k``-word shingles (fewer
words: the whole sequence as one).  Documents with equal sets form a class;
only classes are compared.

1. One pass counts every shingle of every document in a table of hash slots
   (``SLOTS_PER_DOC`` per document, at most ``MAX_SLOTS``).  The counts, as one
   byte per slot, order all shingles from rare to frequent; any order is
   correct, this one keeps frequent shingles out of the prefixes.
2. The first n - ceil(t n) + 1 shingles of a set of n are its prefix; sets with
   a Jaccard similarity of t share one.  Prefix shingles are joined under the
   length filter (t max <= min), the positional filter (1 + what follows the
   match in either set must reach the overlap needed) and the suffix filter:
   every set keeps one parity bit for each of ``PARTS`` parts of the hash range,
   and two sets differ in at least as many elements as in bits.
3. Each distinct pair that is left is verified once on the whole sets.

Prefix shingles with more than ``CROWD`` classes are not paired in full: the
classes are first dealt into small random groups and paired there, each class
under its ``PICKS`` such shingles of smallest hash (near copies pick mostly the
same).  Classes outside the component that most of a shingle's classes belong to
are then dealt again, into groups of ``AGAIN``; then, with the components known by
then, every pair of different components that shares any such shingle is paired,
less those verified before.  No link between components is lost; a crowd of near
copies costs about ``PICKS`` * (``DEAL`` - 1) / 2 pairs a member, however long its
texts are, and only classes without a link found so far meet the whole crowd.
Later links join components as wholes, so no link is followed twice.

Defined results: a null or empty text has an empty set, is linked with nothing
and is its own component.  Repeated rows and rows with one id are one component.
Rows with a null id get a null component.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptledger.llm.batches import ByteSums, Run, combine, mix, released, runs, shingles, take
from promptledger.llm.components import components, extended
from promptledger.llm.storage import bounded_batches, small, written

SLOTS_PER_DOC, MIN_SLOTS, MAX_SLOTS = 16, 1 << 20, 1 << 26
BLOCK = 1 << 16          # slots summed together
RUN_BYTES = 500_000      # bytes of whole texts handled at once: bounds the temporary arrays of a worker
CROWD, DEAL = 8, 6       # classes of a shingle that are paired in full; size of the random groups beyond
PICKS, AGAIN = 6, 16     # crowded shingles under which a class is dealt into such groups; size of the groups of those left over
PARTS = 256              # parts of the hash range whose parities bound the difference of two sets
BITS = [f"w{i}" for i in range(PARTS // 64)]


def sets_of(run: Run, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, sorted, with their documents."""
    start, end, doc = run.words()
    words = ByteSums(run.data, lower=True).hash(start, end)
    h, of = shingles(words, doc, k)
    n = np.bincount(doc, minlength=run.n)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = []
        for d, f in zip(short, first):
            x = words[f: f + 1]
            for j in range(1, n[d]):
                x = combine(x, words[f + j: f + j + 1])
            whole.append(mix(x + np.uint64(n[d])))
        h, of = np.concatenate([h, *whole]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], of[new]


def _signature(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal for equal sets."""
    out = []
    for salt in (0x5A17, 0xC0DE):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)])
        edge = np.searchsorted(of, np.arange(n + 1))
        out.append(mix(total[edge[1:]] - total[edge[:-1]]).view(np.int64))
    return out[0], out[1]


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h & np.uint64(slots - 1)).astype(np.int64)


def _parities(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """n x (PARTS / 64) words of parity bits."""
    part = (h >> np.uint64(40)).astype(np.int64) % PARTS
    odd = np.bincount(of * PARTS + part, minlength=n * PARTS).reshape(n, PARTS).astype(np.uint8) & 1
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def _survey(docs: DataFrame, k: int, slots: int) -> DataFrame:
    """One pass: rows of (doc_id, n, s1, s2, parities) and rows of (block, counts) of the frequency table."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "s1", "s2", *BITS, "block", "counts"]
        seen = np.zeros(slots, np.uint32)
        for batch in batches:
            for run in runs(batch, most=RUN_BYTES):
                h, d = sets_of(run, k)
                s1, s2 = _signature(h, d, run.n)
                seen += np.bincount(_slot(h, slots), minlength=slots).astype(np.uint32) if len(h) > slots // 8 else np.uint32(0)
                if len(h) <= slots // 8:
                    np.add.at(seen, _slot(h, slots), 1)
                bits = _parities(h, d, run.n)
                yield pa.RecordBatch.from_arrays(
                    [take(batch, "doc_id", run.lo, run.hi), pa.array(np.bincount(d, minlength=run.n).astype(np.int64)), pa.array(s1), pa.array(s2),
                     *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(len(BITS))), pa.nulls(run.n, pa.int32()), pa.nulls(run.n, pa.binary())], names=names)
        for b in range(slots // BLOCK):
            part = seen[b * BLOCK: (b + 1) * BLOCK]
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none] * (4 + len(BITS)) + [pa.array([b], pa.int32()),
                                                  pa.array([np.minimum(part, 65535).astype("<u2").tobytes()])], names=names)

    return docs.mapInArrow(lambda b: released(of(b)), "doc_id long, n long, s1 long, s2 long, " + ", ".join(f"{w} long" for w in BITS) + ", block int, counts binary")


def _levels(survey: DataFrame, slots: int) -> np.ndarray:
    """One byte per slot: the count of its shingles on a log scale."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(block: int, counts: np.ndarray) -> pa.RecordBatch:
            level = np.minimum(np.round(6 * np.log2(1 + counts)), 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()])], names=["block", "level"])

        at, counts = None, None
        for batch in batches:  # sorted by block, so one block's sum at a time
            for block, part in zip(batch.column("block").to_pylist(), batch.column("counts")):
                if block != at:
                    if at is not None:
                        yield row(at, counts)
                    at, counts = block, np.zeros(BLOCK, np.int64)
                counts += np.frombuffer(part.as_buffer(), "<u2")
        if at is not None:
            yield row(at, counts)

    found = (survey.where("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block")
             .mapInArrow(total, "block int, level binary"))
    out = np.zeros(slots, np.uint8)
    for r in found.toLocalIterator():  # at most MAX_SLOTS bytes in all
        out[r["block"] * BLOCK: (r["block"] + 1) * BLOCK] = np.frombuffer(r["level"], np.uint8)
    return out


def _prefixes(docs: DataFrame, k: int, num: int, den: int, level: np.ndarray) -> DataFrame:
    """shingle, c (class hash), pos, n: the prefix of every set, one copy of a class per task."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, done = shared.value, set()
        for batch in batches:
            for run in runs(batch, most=RUN_BYTES):
                h, d = sets_of(run, k)
                if not len(h):
                    continue
                c, _ = _signature(h, d, run.n)
                n = np.bincount(d, minlength=run.n)
                first = np.array([x not in done and not done.add(x) for x in c.tolist()]) & (n > 0)
                keep = first[d]
                h, d = h[keep], d[keep]
                order = np.lexsort((h, rank[_slot(h, len(rank))], d))
                h, d = h[order], d[order]
                pos = np.arange(len(d)) - np.searchsorted(d, np.arange(run.n))[d]
                pick = pos < (n + (num * n // -den) + 1)[d]
                d = d[pick]
                yield pa.RecordBatch.from_arrays([pa.array(h[pick].view(np.int64)), pa.array(c[d]), pa.array(pos[pick].astype(np.int32)),
                                                  pa.array(n[d].astype(np.int32))], names=["shingle", "c", "pos", "n"])

    return docs.mapInArrow(lambda b: released(of(b)), "shingle long, c long, pos int, n int")


def _pairs(left: DataFrame, right: DataFrame, on: list[str], num: int, den: int, either: bool) -> DataFrame:
    """Distinct candidate pairs a < b of classes that agree in ``on``, under the length, positional and suffix filters."""
    a = left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns))
    low, high = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    rest = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    cond = (den * low >= num * high) & ((num + den) * rest >= num * (F.col("a_n") + F.col("b_n")))
    differ = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in BITS[1:]), F.bit_count(F.col(f"a_{BITS[0]}").bitwiseXOR(F.col(f"b_{BITS[0]}"))))
    cond = cond & ((num + den) * differ <= (den - num) * (F.col("a_n") + F.col("b_n")))
    for c in on:
        cond = cond & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    cond = cond & ((F.col("a_comp") != F.col("b_comp")) if either else (F.col("a_c") < F.col("b_c")))
    return a.join(b, cond).select(F.least("a_c", "b_c").alias("a"), F.greatest("a_c", "b_c").alias("b")).distinct()


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """a, b, linked: every candidate pair of class ids, verified on the representatives' whole texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = written(classes.join(ids, F.col("c") == F.col("id")).select("rep"), "jaccard-wanted")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, most=RUN_BYTES):
                h, d = sets_of(run, k)
                edge = np.searchsorted(d, np.arange(run.n + 1))
                yield pa.RecordBatch.from_arrays(
                    [take(batch, "doc_id", run.lo, run.hi), pa.array([h[edge[i]: edge[i + 1]].tobytes() for i in range(run.n)], pa.binary())], names=["id", "items"])

    sets = written(docs.join(small(wanted), F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "text")
                   .mapInArrow(lambda b: released(of(b)), "id long, items binary").dropDuplicates(["id"]), "jaccard-sets")
    reps = classes.select("c", "rep")
    pairs = (pairs.join(reps.withColumnsRenamed({"c": "a", "rep": "x"}), "a").join(reps.withColumnsRenamed({"c": "b", "rep": "y"}), "b").select("x", "y"))
    both = (pairs.join(sets.withColumnsRenamed({"id": "x", "items": "xi"}), "x")
            .join(sets.withColumnsRenamed({"id": "y", "items": "yi"}), "y").select("x", "y", "xi", "yi"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for p, q in zip(batch.column("xi"), batch.column("yi")):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                at = np.searchsorted(p, q)
                same = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                linked.append(den * same >= num * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(linked, pa.bool_())], names=["x", "y", "linked"])

    return written(both.mapInArrow(lambda b: released(verify(b)), "x long, y long, linked boolean"), "jaccard-verified")


def join(docs: DataFrame, k: int, num: int, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, n_shingles, rep), links (x, y) between representatives of classes with
    ``den`` * intersection >= ``num`` * union (links within one component may be left out), and the
    components (id, component) of the linked ones."""
    with bounded_batches(docs.sparkSession):  # whole sets are sent in pairs, so rows alone bound nothing
        return _joined(docs, k, num, den)


def _joined(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slots = MIN_SLOTS
    while slots < min(MAX_SLOTS, SLOTS_PER_DOC * docs.count()):
        slots *= 2
    survey = written(_survey(docs, k, slots), "jaccard-survey")
    rows = survey.where("block is null")
    classes = written(rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), *(F.max(w).alias(w) for w in BITS))
                      .withColumnRenamed("s1", "c"), "jaccard-classes")
    prefix = written(_prefixes(docs.where("doc_id is not null"), k, num, den, _levels(survey, slots)), "jaccard-prefixes")
    often = prefix.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("shingle")
    shared = written(prefix.join(often, "shingle").distinct().join(classes.select("c", *BITS), "c"), "jaccard-shared")
    crowd = shared.groupBy("shingle").agg(F.count("*").alias("m"))
    pick = F.row_number().over(Window.partitionBy("c", F.col("m") <= CROWD).orderBy(F.xxhash64("shingle"), "shingle"))
    deal = F.when(F.col("m") <= CROWD, F.lit(0)).when(F.col("pick") <= PICKS, F.pmod(F.xxhash64("c", "shingle"), F.ceil(F.col("m") / DEAL)))
    dealt = written(shared.join(crowd, "shingle").withColumn("pick", pick).withColumn("deal", deal.cast("long")).drop("pick"), "jaccard-dealt")
    paired = dealt.where("deal is not null")
    first = written(_pairs(paired, paired, ["shingle", "deal"], num, den, either=False), "jaccard-pairs")
    links = _links(first, classes, docs, k, num, den)

    label = components(_edges(links))

    # what is left: different components that share a crowded shingle, in larger random groups first, then exactly
    tried, found = first, _edges(links)
    for size in (AGAIN, None):
        named = classes.join(label, F.col("rep") == F.col("id"), "left").select("c", F.coalesce("component", "rep").alias("comp"))
        crowded = written(dealt.where(F.col("m") > CROWD).drop("deal").join(named, "c"), "jaccard-crowded")
        sizes = crowded.groupBy("shingle", "comp").agg(F.count("*").alias("size")).groupBy("shingle").agg(
            F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("shingle", F.col("top.comp").alias("major"))
        group = F.pmod(F.xxhash64("shingle", "c"), F.ceil(F.col("m") / size)) if size else F.lit(0)
        open_ = written(crowded.join(sizes, "shingle").withColumn("deal", group.cast("long")).drop("m"), "jaccard-open")
        left = _pairs(open_.where("comp != major").drop("major"), open_.drop("major"), ["shingle", "deal"], num, den, either=True)
        left = written(left.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        more = _edges(_links(left, classes, docs, k, num, den))
        label, tried, found = extended(label, more), tried.unionByName(left), found.unionByName(more)
    members = (rows.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2")
               .join(classes.withColumnsRenamed({"c": "s1"}), ["s1", "s2"], "left")
               .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep")))
    return members, found.withColumnsRenamed({"a": "x", "b": "y"}), label


def _edges(links: DataFrame) -> DataFrame:
    return links.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))


def grouped(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    members, _, label = join(docs, k, num, den)
    out = members.join(label, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id (one of the rows with that id).

    Rows with a null id stay.
    """
    found = written(grouped(docs.select("doc_id", "text"), k, num, den).where("doc_id is not null"), "jaccard-groups")
    gone = small(written(found.where("doc_id != component_id").select("doc_id").distinct(), "jaccard-gone"))
    twice = small(written(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-twice"))
    d = docs.alias("d")
    once = d.join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti").alias("d").join(
        twice.alias("t"), F.col("d.doc_id") == F.col("t.doc_id"), "left_anti")
    again = d.join(twice.alias("t"), F.col("d.doc_id") == F.col("t.doc_id"), "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id"]))


def sql(k: int, num: int, den: int = 100) -> str:
    """DuckDB twin of ``grouped`` over ``documents``: all pairs that share a shingle, and reachability (ids are distinct)."""
    return f"""
    with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x20\\x09-\\x0D]+') w from documents),
    s as materialized (select distinct doc_id, array_to_string(w[p:p + {k - 1}], ' ') g
          from (select doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) p from w where len(w) > 0)),
    n as materialized (select doc_id, count(*) n from s group by doc_id),
    i as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
    l as materialized (select a, b from i join n p on p.doc_id = a join n q on q.doc_id = b where {den} * c >= {num} * (p.n + q.n - c)),
    e as materialized (select a, b from l union all select b, a from l),
    r as (with recursive r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b) select a, min(b) m from r group by a)
    select w.doc_id, coalesce(n.n, 0) n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) component_id
    from w left join n on n.doc_id = w.doc_id left join r on r.a = w.doc_id"""
