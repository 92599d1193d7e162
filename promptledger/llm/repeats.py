"""Suffix-array deduplication of repeated passages (operator 2).

Removes every byte that lies in a string of ``MIN`` bytes which also starts
earlier (in a document of a smaller id, or earlier in the same document).

1. Documents are dealt into blocks by ranges of their id, so that block and
   place give the order of occurrences.  The blocks are kept as a table
   bucketed by block; later steps join it without moving the texts again.
2. Each window of ``MIN`` bytes is owned by the smallest hash among its
   ``GRAM``-byte strings (leftmost of equals).  Equal windows have equal
   owners, so repeats are sought among anchors (runs of windows with one
   owner) of equal owner hash.  An anchor's stretch is the text of its windows.
3. Anchors whose owner occurs once hold no repeat.  Of equal stretches, all
   but the first are removed whole.  First stretches whose owner has several
   different stretches go on with their bytes.
4. Stretches of equal owner meet in one bucket.  There an enhanced suffix
   array is built over all places where a window starts: sorted suffixes and
   common-prefix lengths.  A stack scan visits the tree of common-prefix
   intervals from ``MIN`` bytes on; an interval whose occurrences are preceded
   by different bytes is a maximal repeat and is put out as a group with all
   its occurrences.  All but its first occurrence are removed.
5. Owners with more than ``CROWD`` different stretches (or ``LOCAL`` in one
   block) are not brought together: their windows are summed by hash to the
   first occurrence, and later ones are removed.

Every 100-byte string that occurs twice has the same occurrences as the maximal
repeat around it, so the groups give exactly the bytes to remove.

Defined results: a null or empty text has no bytes and its hash is that of the
empty string.  Rows with one id are ordered by text and then arbitrarily among
equal texts (which differ only in which copy stays); null ids come first.  Texts
shorter than ``MIN`` bytes lose nothing.  An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.batches import ByteSums, combine, mix, runs
from promptledger.llm.storage import bucketed, written

MIN, GRAM = 100, 50
BLOCK_BYTES = 8_000_000
PIECE = 1 << 20            # windows looked at together
PLACE_BITS = 24            # of the packed minimum: place in the piece
LOCAL, CROWD = 32, 1_000
UNIQUE, LATER, OPEN, CROWDED = 0, 1, 2, 3


# ---------------------------------------------------------------- blocks

def blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """The table (block, seq, doc_id, text) bucketed by block, and the number of blocks asked for."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    ranged = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
              .repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block, np.int32)), pa.array(np.arange(seq, seq + m, dtype=np.int64)),
                                              batch.column("doc_id"), batch.column("text")], names=["block", "seq", "doc_id", "text"])
            seq += m

    return bucketed(ranged.mapInArrow(number, "block int, seq long, doc_id long, text string"), n, "block", "repeat-blocks"), n


def _ordered(table: pa.Table) -> pa.RecordBatch:
    table = table.sort_by("seq").combine_chunks()
    if not table.num_rows:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in table.schema.types], names=table.schema.names)
    return table.set_column(table.schema.get_field_index("text"), "text", table.column("text").cast(pa.large_string())).combine_chunks().to_batches()[0]


# ---------------------------------------------------------------- anchors

def _piece(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the windows that lie in one document: owner hash, stretch hash, first and last window."""
    n = len(data) - MIN + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= 0:
        return none
    sums = ByteSums(data, lower=False)
    at = np.arange(len(data) - GRAM + 1)
    gram = sums.hash(at, at + GRAM)
    low = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
    width, step = MIN - GRAM + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step:])
    owner = (low[:n] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    inside = np.ones(n, bool)
    for edge in offs[(offs > 0) & (offs < len(data))].tolist():  # windows that cross from one document to the next
        inside[max(0, edge - MIN + 1): edge] = False
    first = np.flatnonzero(inside & np.concatenate([[True], (owner[1:] != owner[:-1]) | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([(owner[1:] != owner[:-1]) | ~inside[1:], [True]]))
    own = owner[first]
    stretch = combine(sums.hash(first, last + MIN), (own - first).astype(np.uint64))
    return gram[own], stretch, first, last


class Anchors:
    """All anchors of one block in order of place, with the block's bytes."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        parts, lengths, base, raw = [], [np.zeros(1, np.int64)], 0, []
        for run in runs(batch):
            for lo in range(0, max(1, len(run.data) - MIN + 1), PIECE):
                data = run.data[lo: lo + PIECE + MIN - 1]
                offs = run.offs[np.searchsorted(run.offs, lo, "right"): np.searchsorted(run.offs, lo + len(data), "left")] - lo
                h, c, a, b = _piece(data, offs)
                parts.append((h, c, a + base + lo, b + base + lo))
            lengths.append(run.offs[1:] + base)
            raw.append(run.data)
            base += len(run.data)
        self.data = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
        self.offs = np.concatenate(lengths)
        self.h, self.c, self.first, self.last = (np.concatenate(x) for x in zip(*parts)) if parts else _piece(self.data, self.offs)
        order = np.lexsort((self.c, self.h))
        h, c = self.h[order], self.c[order]
        new_h = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        new = np.concatenate([[True], new_h[1:] | (c[1:] != c[:-1])]) if len(h) else new_h
        group = np.cumsum(new_h) - 1
        crowd = np.bincount(group[new], minlength=group[-1] + 1 if len(group) else 0) > LOCAL if len(h) else np.zeros(0, bool)
        # what the block knows by itself: a later copy of a stretch, a crowded owner, or nothing yet
        self.code = np.full(len(h), UNIQUE, np.uint8)
        self.code[order[~new]] = LATER
        if len(h):
            self.code[order[new & crowd[group]]] = CROWDED
            self.marks = h[new_h][crowd]
        else:
            self.marks = h

    def asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors to ask about, by bucket and then place, and their buckets."""
        ask = np.flatnonzero(self.code == UNIQUE)
        bucket = _bucket(self.h[ask], buckets)
        order = np.argsort(bucket, kind="stable")
        return ask[order], bucket[order]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


def _edges(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _questions(text: DataFrame, n: int) -> DataFrame:
    """block, bucket, keys (owner and stretch hashes), marks (owners that are crowded in the block)."""
    def of(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        a = Anchors(_ordered(table))
        ask, bucket = a.asked(n)
        rows: dict[int, list] = {}
        edge = _edges(bucket)
        for lo, hi in zip(edge[:-1], edge[1:]):
            rows[int(bucket[lo])] = [np.concatenate([a.h[ask[lo:hi]], a.c[ask[lo:hi]]]).tobytes(), b""]
        at = _bucket(a.marks, n)
        for b in np.unique(at).tolist():
            rows.setdefault(b, [b"", b""])[1] = a.marks[at == b].tobytes()
        return pa.table({"block": pa.array([block] * len(rows), pa.int32()), "bucket": pa.array(list(rows), pa.int32()),
                         "keys": pa.array([r[0] for r in rows.values()], pa.binary()), "marks": pa.array([r[1] for r in rows.values()], pa.binary())})

    return text.groupBy("block").applyInArrow(of, "block int, bucket int, keys binary, marks binary")


def _answers(questions: DataFrame) -> DataFrame:
    """block, bucket, codes: one byte per anchor asked about."""
    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
        sizes = np.array([len(x) // 2 for x in keys])
        h = np.concatenate([x[: len(x) // 2] for x in keys])
        c = np.concatenate([x[len(x) // 2:] for x in keys])
        marks = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("marks")]))
        code = np.zeros(len(h), np.uint8)
        if len(h):
            order = np.lexsort((c, h))  # stable: equal stretches stay in order of place
            hs, cs = h[order], c[order]
            new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
            new = np.concatenate([[True], new_h[1:] | (cs[1:] != cs[:-1])])
            group = np.cumsum(new_h) - 1
            kinds = np.bincount(group[new])[group]
            marked = np.isin(hs, marks)
            code[order] = np.where(~new, LATER, np.where(marked | (kinds > CROWD), CROWDED, np.where(kinds > 1, OPEN, UNIQUE)))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         "codes": pa.array([code[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:])], pa.binary())})

    return questions.groupBy("bucket").applyInArrow(of, "block int, bucket int, codes binary")


def _findings(text: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """What each block does with the answers: rows of three kinds.

    kind 0: (block, ranges) of the later stretches; kind 1: (block, at, h, lead, windows, stretch) of the open
    ones; kind 2: (block, at, h, lead) of the windows of crowded owners, h and lead being two hashes.
    """
    names = ["kind", "block", "at", "h", "lead", "windows", "bytes"]

    def of(table: pa.Table, found: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        a = Anchors(_ordered(table))
        ask, bucket = a.asked(n)
        codes = {b.as_py(): c.as_py() for b, c in zip(found.column("bucket"), found.column("codes"))}
        edge = _edges(bucket)
        for lo, hi in zip(edge[:-1], edge[1:]):
            a.code[ask[lo:hi]] = np.frombuffer(codes[int(bucket[lo])], np.uint8)
        later = np.flatnonzero(a.code == LATER)
        out = [(0, block, 0, 0, 0, 0, merged(a.first[later], a.last[later] + MIN).tobytes())]
        for i in np.flatnonzero(a.code == OPEN).tolist():
            lo, hi = int(a.first[i]), int(a.last[i])
            out.append((1, block, lo, int(a.h[i].view(np.int64)), 0, hi - lo + 1, a.data[lo: hi + MIN].tobytes()))
        cols = list(zip(*out))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        plain = pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
        crowded = np.flatnonzero(a.code == CROWDED)
        if not len(crowded):
            return plain
        size = a.last[crowded] - a.first[crowded] + 1
        start = np.repeat(a.first[crowded], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        one, two = _window_hashes(a.data, start)
        m = len(start)
        return pa.concat_tables([plain, pa.table(
            [pa.array(np.full(m, 2, np.int32)), pa.array(np.full(m, block, np.int32)), pa.array(start), pa.array(one), pa.array(two),
             pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.binary())], names=names)])

    return text.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        of, "kind int, block int, at long, h long, lead long, windows int, bytes binary")


def _window_hashes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for the windows at sorted starts, without sums over the whole block."""
    one, two = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for lo in range(0, len(data), PIECE):
        i, j = np.searchsorted(start, [lo, lo + PIECE])
        if j > i:
            sums = ByteSums(data[lo: lo + PIECE + MIN], lower=False)
            s = start[i:j] - lo
            one[i:j] = sums.hash(s, s + MIN).view(np.int64)
            two[i:j] = combine(sums.hash(s, s + 37), mix(sums.hash(s + 29, s + MIN))).view(np.int64)
    return one, two


def merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Union of ranges as an array of (lo, hi), sorted; ranges that touch are one."""
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return np.column_stack([lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]]).astype(np.int64)


# ---------------------------------------------------------------- suffix array

class SuffixArray:
    """Enhanced suffix array over the window starts of many stretches.

    ``stretch`` and ``place`` give each suffix (in sorted order), ``lcp`` the
    length of the prefix it shares with the one before it.
    """

    def __init__(self, stretches: list[bytes], windows: np.ndarray) -> None:
        self.size = np.array([len(s) for s in stretches], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.size)])
        most = int(self.size.max(initial=0))
        self.data = np.frombuffer(b"".join(stretches) + bytes(most + 16), np.uint8)
        of = np.repeat(np.arange(len(stretches)), windows)
        place = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = self.base[of] + place
        # a window that occurs once here is in no interval
        if len(at):
            sums = ByteSums(self.data, lower=False)
            _, back, often = np.unique(sums.hash(at, at + MIN), return_inverse=True, return_counts=True)
            keep = often[back] > 1
            of, place, at = of[keep], place[keep], at[keep]
        left = self.size[of] - place
        eight = np.zeros(len(self.data) - 7, np.uint64)
        for j in range(8):
            eight = (eight << np.uint64(8)) | self.data[j: len(self.data) - 7 + j]
        keys = []
        for r in range(0, most, 8):
            own = np.clip(left - r, 0, 8).astype(np.uint64)
            key = eight[np.minimum(at + r, len(eight) - 1)]
            keys.append(np.where(own == 0, np.uint64(0), key >> ((np.uint64(8) - own) * np.uint64(8)) << ((np.uint64(8) - own) % np.uint64(8) * np.uint64(8))))
        order = np.lexsort([left, *keys[::-1]]) if keys else np.zeros(0, np.int64)
        self.stretch, self.place = of[order], place[order]
        at, left = at[order], left[order]
        self.before = np.where(self.place > 0, self.data[at - 1].astype(np.int64), -1 - self.stretch)
        lcp = np.zeros(len(order), np.int64)
        if len(order) > 1:
            open_ = np.ones(len(order) - 1, bool)
            for key in keys:
                key = key[order]
                differ = key[1:] ^ key[:-1]
                same = np.where(differ == 0, 8, _leading_bytes(differ))
                lcp[1:] += np.where(open_, same, 0)
                open_ &= differ == 0
            lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
        self.lcp = lcp

    def maximal_repeats(self, least: int = MIN) -> Iterator[tuple[int, int, int]]:
        """(length, lo, hi) of the common-prefix intervals of at least ``least`` bytes whose occurrences are preceded by different bytes.

        One stack scan: an interval is open while suffixes share its prefix; when it closes, its
        smallest and largest preceding byte tell whether all could be extended to the left.
        """
        lcp, before = self.lcp.tolist(), self.before.tolist()
        stack: list[list[int]] = []  # length, lo, smallest and largest preceding byte
        for i in range(1, len(lcp) + 1):
            length = lcp[i] if i < len(lcp) and lcp[i] >= least else 0
            lo, small, large = i - 1, before[i - 1], before[i - 1]
            while stack and stack[-1][0] > length:
                top = stack.pop()
                lo, small, large = top[1], min(small, top[2]), max(large, top[3])
                if small != large:
                    yield top[0], lo, i
                if stack and stack[-1][0] >= length:
                    stack[-1][2], stack[-1][3] = min(stack[-1][2], small), max(stack[-1][3], large)
                    small, large = stack[-1][2], stack[-1][3]
            if length:
                if stack and stack[-1][0] == length:
                    stack[-1][2], stack[-1][3] = min(stack[-1][2], small), max(stack[-1][3], large)
                else:
                    stack.append([length, lo, small, large])


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of non-zero 64-bit values."""
    n = np.zeros(len(x), np.int64)
    for bits in (32, 16, 8):
        high = (x >> np.uint64(64 - bits)) == 0
        n += np.where(high, bits // 8, 0)
        x = np.where(high, x << np.uint64(bits), x)
    return n


def repeat_groups(open_: DataFrame, n: int) -> DataFrame:
    """group, length, block, at, is_first: every maximal repeat among open stretches, with all its occurrences."""
    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("at", "ascending")])
        block, at = table.column("block").to_numpy(), table.column("at").to_numpy()
        sa = SuffixArray([x.as_py() for x in table.column("bytes")], table.column("windows").to_numpy().astype(np.int64))
        spans = list(sa.maximal_repeats())
        bucket = table.column("bucket")[0].as_py()
        size = np.array([hi - lo for _, lo, hi in spans], np.int64)
        rows = np.concatenate([np.arange(lo, hi) for _, lo, hi in spans]) if spans else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(spans)), size)
        of_, place = sa.stretch[rows], sa.place[rows]
        # stretches are in order of occurrence, and no two of them start a window at the same place
        order = np.lexsort((place, of_, group))
        first = np.zeros(len(rows), bool)
        if len(rows):
            first[order[np.concatenate([[True], group[order][1:] != group[order][:-1]])]] = True
        return pa.table({"bucket": pa.array(np.full(len(rows), bucket, np.int32)), "group": pa.array(group),
                         "length": pa.array(np.repeat(np.array([s[0] for s in spans], np.int64), size)),
                         "block": pa.array(block[of_].astype(np.int32)), "at": pa.array(at[of_] + place), "is_first": pa.array(first)})

    keyed = open_.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(n)).cast("int"))
    return keyed.groupBy("bucket").applyInArrow(of, "bucket int, group long, length long, block int, at long, is_first boolean")


# ---------------------------------------------------------------- result

def removed(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept: the remaining bytes] of every document."""
    text, n = blocks(docs)
    answers = _answers(_questions(text, n))
    found = written(_findings(text, answers, n), "repeat-findings")
    later = found.where("kind = 0").select("block", F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"), F.col("bytes").alias("ranges"))
    groups = repeat_groups(found.where("kind = 1"), n).where("not is_first")
    none = F.lit(None).cast("binary").alias("ranges")
    shared = groups.select("block", F.col("at").alias("lo"), (F.col("at") + F.col("length")).alias("hi"), none)
    window = found.where("kind = 2").select("h", "lead", "block", "at")
    lead = window.groupBy("h", "lead").agg(F.min(F.struct("block", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    crowd = (window.join(lead, ["h", "lead"]).where("block != first.block or at != first.at")
             .select("block", F.col("at").alias("lo"), (F.col("at") + MIN).alias("hi"), none))
    single = shared.unionByName(crowd)
    # each task joins its ranges per block before they are moved

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, lo, hi = (batch.column(c).to_numpy() for c in ("block", "lo", "hi"))
            order = np.argsort(block, kind="stable")
            edge = _edges(block[order])
            for a, b in zip(edge[:-1], edge[1:]):
                pick = order[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([int(block[pick[0]])], pa.int32()), pa.array([merged(lo[pick], hi[pick]).tobytes()])],
                                                 names=["block", "ranges"])

    ranges = later.select("block", "ranges").unionByName(single.select("block", "lo", "hi").mapInArrow(packed, "block int, ranges binary"))

    def cut(table: pa.Table, ranges: pa.Table) -> pa.Table:
        batch = _ordered(table)
        parts = [np.frombuffer(x.as_py(), np.int64).reshape(-1, 2) for x in ranges.column("ranges")]
        cuts = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        cuts = merged(cuts[:, 0], cuts[:, 1])
        raw = [x.as_py().encode() for x in batch.column("text")]
        out, base, i = [], 0, 0
        for doc, data in zip(batch.column("doc_id").to_pylist(), raw):
            end, at, gone, spans, keep = base + len(data), 0, 0, 0, []
            while i < len(cuts) and cuts[i, 0] < end:
                lo, hi = max(int(cuts[i, 0]), base) - base, min(int(cuts[i, 1]), end) - base
                keep.append(data[at:lo])
                at, gone, spans = hi, gone + hi - lo, spans + 1
                if cuts[i, 1] > end:  # the next document's cut touches this one's
                    break
                i += 1
            keep.append(data[at:])
            kept = b"".join(keep)
            out.append((doc, len(data), gone, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            base = end
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return text.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return removed(docs, with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
