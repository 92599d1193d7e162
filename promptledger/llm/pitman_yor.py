"""Language-model scoring with a hierarchical Pitman-Yor model (operator 7).

Words are drawn from the restaurant of the word before them; all context
restaurants share one parent, the unigram restaurant, whose base is uniform over
the vocabulary and one unknown word:

    P(w|u) = (c_uw - d t_uw + (theta + d t_u) P(w)) / (theta + c_u)
    P(w)   = (t_.w - d0 s_w + (theta0 + d0 s) / (V + 1)) / (theta0 + t)

c are customers (training tokens), t tables of the context restaurants (each
sends one customer to the parent) and s tables of the parent.

Documents are kept as a table of numbered words, one row per block and bucketed by
it; the texts are split into words once.  A block asks about each of its
distinct words and word pairs once; questions meet by hash, and answers return
to the block:

1. words: training counts c(w), N and V;
2. pairs: customers of each dish (u, w), summed over blocks.  There the tables
   are sampled: given the strength A = (theta + d t_u) P(w), the number of tables
   of c customers has probability proportional to
   S_d(c, t) A^t (S: generalised Stirling numbers), which integrates out who sits
   where;
3. words again: tables by dish and by context give t_u and the parent's
   customers t_.w, whose own tables s_w are sampled likewise.

Restaurant totals and parent probabilities are held fixed while a pair is
sampled (from counts at first, from the last round after).  2 and 3 are repeated
``ROUNDS`` times; P(w|u) is averaged over the rounds after the first ``BURN_IN``,
each with the pairs, tables and parent of its own state.  The tables of these rounds
stay until the end, so disk grows with the rounds that are kept.  The law comes from the recursion of S_d, for all
sizes up to ``SMALL`` and some up to ``PARTY``; a dish between or above them is
continued from the next smaller one, as one restaurant (``draw_large``).  A
frequent word or pair is one row per block.

Tokens: words of the ASCII-lower-cased text, then one end token.

Defined results: a null or empty text is its end token alone.  Rows with one id
are in one fold and all count.  A null id belongs to the training fold (it has
no crc).  Without training tokens every token has probability 1.  An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.batches import ByteSums, combine, runs
from promptledger.llm.storage import bucketed, discard, folder, written

FOLDS, HELD_OUT = 7, 2
DISCOUNT, STRENGTH = 0.9, 1.0        # of the context restaurants
DISCOUNT_TOP, STRENGTH_TOP = 0.75, 1.0
SMALL, PARTY, BURN_IN, ROUNDS = 64, 4096, 1, 3
BLOCK_BYTES = 8_000_000
END, BEGIN = np.uint64(0x0E0D_0000_0000_0001), np.uint64(0x0B0E_0000_0000_0001)
KEY_BITS, MIX = 56, np.uint64(0x9E37_79B9_7F4A_7C15)  # of a pair's hash
CODEC = pa.Codec("zstd", compression_level=1)
CODES, CODE_STEP, CODE_ZERO = 256, 4, 160   # log-scale codes of a strength, up to 2^23
# customers whose law of tables is kept: all up to SMALL, then four an octave up to PARTY
LARGE = tuple(round(SMALL * 2 ** (i / 4)) for i in range(4 * (PARTY // SMALL).bit_length() - 3))
SIZES = (*range(SMALL), *LARGE)
_SIZES = frozenset(SIZES)


# ---------------------------------------------------------------- sampling

@lru_cache(maxsize=4)
def log_stirling(d: float) -> dict[int, np.ndarray]:
    """log S_d(c, t) for 0 <= t <= c (-inf where impossible), for the customers c in ``SIZES``."""
    out, row = {}, np.array([0.0])
    for c in range(SIZES[-1] + 1):
        if c in _SIZES:
            out[c] = row
        left = c - d * np.arange(c + 1)
        stay = np.where(left > 0, np.log(np.maximum(left, 1e-300)), -np.inf) + row
        row = np.logaddexp(np.append(stay, -np.inf), np.concatenate([[-np.inf], row]))
    return out


def _laws(d: float, c: int) -> np.ndarray:
    """Per code: the law of the number of tables of ``c`` customers."""
    log_a = (np.arange(CODES) - CODE_ZERO) / CODE_STEP * math.log(2)
    w = log_stirling(d)[c] + log_a[:, None] * np.arange(c + 1)
    w = np.exp(w - w.max(1, keepdims=True))
    return w / w.sum(1, keepdims=True)


@lru_cache(maxsize=4)
def table_law(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Per code and customers up to ``SMALL``: cumulative law of the number of tables; and all rows one after the other, 2 * row added."""
    p = np.zeros((CODES, SMALL + 1, SMALL + 1))
    for c in range(SMALL + 1):
        p[:, c, : c + 1] = _laws(d, c)
    law = np.cumsum(p, 2)
    return law, (law + np.arange(CODES * (SMALL + 1)).reshape(CODES, SMALL + 1, 1) * 2).ravel()  # rows apart: one sorted array


@lru_cache(maxsize=4)
def large_law(d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the sizes ``LARGE`` and each code, one row after the other: cumulative law
    (2 * row added, without the ends that have no mass), where each row begins, the tables
    its first value stands for; and the mean by size and code."""
    flat, begin, first, mean = [], [0], [], []
    for c in LARGE:
        p = _laws(d, c)
        mean.append(p @ np.arange(c + 1))
        for q in p:
            some = np.flatnonzero(q > 1e-14)
            cum = np.cumsum(q[some[0]: some[-1] + 1])
            flat.append(cum / cum[-1] + 2 * len(first))
            first.append(some[0])
            begin.append(begin[-1] + len(cum))
    return np.concatenate(flat), np.array(begin), np.array(first), np.array(mean)


def code_of(strength: np.ndarray) -> np.ndarray:
    return np.clip(np.round(np.log2(np.maximum(strength, 1e-300)) * CODE_STEP) + CODE_ZERO, 0, CODES - 1).astype(np.uint8)


def _from_large(d: float, size: np.ndarray, code: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Tables at the quantile ``u`` of the exact law, for an index into ``LARGE`` and a code."""
    flat, begin, first, _ = large_law(d)
    row = size * CODES + code
    at = np.searchsorted(flat, u * (1 - 1e-12) + 2 * row, "left") - begin[row]
    return first[row] + at


def draw_large(c: np.ndarray, code: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """``draw_tables`` for more than ``SMALL`` customers: g of them by the exact law (g: the
    largest of ``LARGE`` within c), the others one after the other.

    Given t tables of n customers, the next one opens a table with weight A and joins one
    with weight n - d t.  As the sum of these weights depends on t, the law of n + 1
    customers at strength A follows from that of n at a slightly lower strength.  With
    m the mean tables, m - A / d = K stays the same along that path, and
    A = A_g ((c - d K) / (g - d K))^d, so (A - A_g) / d tables are opened after g.
    """
    mean = large_law(d)[3]
    sizes = np.array(LARGE)
    at = np.searchsorted(sizes, c, "right") - 1
    g = sizes[at].astype(float)
    k = mean - 2.0 ** ((np.arange(CODES) - CODE_ZERO) / CODE_STEP) / d
    lo, hi = np.zeros(len(c)), code.astype(float)

    def k_at(x: np.ndarray) -> np.ndarray:
        i = np.minimum(x.astype(np.int64), CODES - 2)
        return k[at, i] + (x - i) * (k[at, i + 1] - k[at, i])

    for _ in range(40):  # the code of A_g
        mid = (lo + hi) / 2
        far = mid + CODE_STEP * d * np.log2((c - d * k_at(mid)) / (g - d * k_at(mid))) > code
        lo, hi = np.where(far, lo, mid), np.where(far, mid, hi)
    low = np.where(c == g, code, hi)
    i = np.minimum(low.astype(np.int64), CODES - 2)
    u = rng.random(len(c))
    # one quantile of the two neighbouring codes
    here, there = _from_large(d, at, i, u), _from_large(d, at, i + 1, u)
    t = np.floor(here + (low - i) * (there - here) + rng.random(len(c)) * (1 - 1e-9)).astype(np.int64)
    a, a_g = (2.0 ** ((x - CODE_ZERO) / CODE_STEP) for x in (code, low))
    more = np.clip((a - a_g) / d / np.maximum(c - g, 1), 0, 1)
    return np.clip(t + rng.binomial((c - g).astype(np.int64), more), 1, c)


def draw_tables(c: np.ndarray, code: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """One draw of the number of tables of each dish, given its customers and the code of its strength."""
    _, flat = table_law(d)
    t = np.minimum(c, 1)
    small = np.flatnonzero((c > 1) & (c <= SMALL))
    if len(small):
        row = code[small].astype(np.int64) * (SMALL + 1) + c[small]
        at = np.searchsorted(flat, rng.random(len(small)) * (1 - 1e-12) + 2 * row, "left")
        t[small] = np.clip(at - row * (SMALL + 1), 1, c[small])
    large = np.flatnonzero(c > SMALL)
    if len(large):
        t[large] = draw_large(c[large], code[large].astype(np.int64), d, rng).astype(t.dtype)
    return t


# ---------------------------------------------------------------- blocks

def _order(h: np.ndarray) -> np.ndarray:
    """Order by the first bits of a hash (as many as leave room for the index, which decides ties)."""
    bits = np.uint64(max(1, len(h)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    return (np.sort(h & ~low | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)  # sorting values is far faster than argsort


def _distinct(keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with its inverse, of numbers below ``limit``: key and index are sorted as one number if both fit."""
    bits = max(1, len(keys)).bit_length()
    if limit.bit_length() + bits > 64:
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
    key, at = both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    inverse = np.empty(len(key), np.int64)
    inverse[at] = np.cumsum(new) - 1
    return key[new], inverse


def _distinct_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with its inverse, of hashes: few different ones share their first bits."""
    one, _, inverse = _first_hashes(h)
    return one, inverse


def _first_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``np.unique`` with the first index of each and the inverse, of hashes that fill a range of numbers."""
    low = h.min()
    spread = h - low << np.uint64(64 - int(h.max() - low).bit_length()) if len(h) > 1 and h.max() > low else h
    order = _order(spread)
    kept, bits = spread[order], np.uint64(max(1, len(h)).bit_length())
    new = kept[1:] != kept[:-1]
    if (new & (kept[1:] >> bits == kept[:-1] >> bits)).any():
        return np.unique(h, return_index=True, return_inverse=True)
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.concatenate([[0], np.cumsum(new)])
    first = order[np.concatenate([[True], new])]
    return h[first], first, inverse


NUMBERED = "block int, ids array<bigint>, sizes binary, vocabulary binary, words binary"


def _numbered(table: pa.Table) -> pa.Table:
    """One row for the texts of a block: ids, tokens of each text, distinct words (ascending hashes, as differences) and each token's number among them."""
    table = table.combine_chunks()
    batch = pa.RecordBatch.from_arrays([table.column("text").cast(pa.large_string()).combine_chunks()], names=["text"])
    words, size = [], []
    for run in runs(batch):
        start, end, doc = run.words()
        words.append(ByteSums(run.data, lower=True).hash(start, end))
        size.append(np.bincount(doc, minlength=run.n))
    size = np.concatenate(size) + 1
    last = np.cumsum(size) - 1
    token = np.empty(last[-1] + 1, np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[last] = True
    token[~is_end] = np.concatenate(words)
    token[is_end] = END
    vocabulary, at = _distinct_hashes(np.concatenate([token, [BEGIN]]))  # BEGIN is only ever a context
    return pa.table({"block": table.column("block")[:1], "ids": pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                     "sizes": pa.array([_pack(size.astype("<u8"))]), "vocabulary": pa.array([_pack(np.diff(vocabulary, prepend=np.uint64(0)))]),
                     "words": pa.array([_pack(at[:-1].astype("<u8"))])})


class Block:
    """Tokens of one block: its distinct words and pairs, and how the tokens refer to them."""

    def __init__(self, table: pa.Table, pairs: bool = True) -> None:
        (row,) = table.to_pylist()
        self.ids = row["ids"]
        size = _unpack(row["sizes"], "<u8").astype(np.int64)
        self.edge = np.concatenate([[0], np.cumsum(size)])
        self.held_out = np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in self.ids], bool)
        self.train = np.repeat(~self.held_out, size)
        vocabulary = np.cumsum(_unpack(row["vocabulary"], "<u8"), dtype=np.uint64)
        # words by bucket-independent order
        self.vocabulary, self.word = vocabulary, _unpack(row["words"], "<u8").astype(np.int64)
        self.count = np.bincount(self.word[self.train], minlength=len(vocabulary))
        self.begin = np.searchsorted(vocabulary, BEGIN)
        self._orders: dict = {}
        if pairs:
            before = np.concatenate([[self.begin], self.word[:-1]])
            before[self.edge[:-1]] = self.begin
            self.before = before
            keys = before.astype(np.uint64) * np.uint64(len(vocabulary)) + self.word.astype(np.uint64)
            key, self.pair = _distinct(keys, len(vocabulary) ** 2)
            self.pair_u, self.pair_w = (x.astype(np.int64) for x in np.divmod(key, np.uint64(len(vocabulary))))
            self.pair_count = np.bincount(self.pair[self.train], minlength=len(key))

    def words_by_bucket(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if ("words", n) not in self._orders:
            bucket = ((self.vocabulary >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            self._orders["words", n] = order, bucket[order]
        return self._orders["words", n]

    def pairs_by_bucket(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the pairs by hash (by its first bits), their buckets (ranges of the hash), and its first ``KEY_BITS``."""
        if ("pairs", n) not in self._orders:
            h = combine(self.vocabulary[self.pair_u], self.vocabulary[self.pair_w]) * MIX
            order = _order(h)
            h = h[order]
            bucket = (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
            self._orders["pairs", n] = order, bucket, h >> np.uint64(64 - KEY_BITS)
        return self._orders["pairs", n]


def _pack(v: np.ndarray) -> bytes:
    """An array as compressed bytes: whole numbers by the width of the largest, all first bytes before all second ones."""
    if v.dtype.kind == "u":
        v = v.astype(np.min_scalar_type(v.max(initial=0)))
    planes = np.ascontiguousarray(v).view("u1").reshape(len(v), v.itemsize).T
    return bytes([v.itemsize]) + len(v).to_bytes(4, "little") + CODEC.compress(planes.tobytes(), asbytes=True)


def _unpack(packed: bytes, dtype: str) -> np.ndarray:
    width, m = packed[0], int.from_bytes(packed[1:5], "little")
    planes = CODEC.decompress(packed[5:], decompressed_size=m * width, asbytes=True) if m else b""
    held = np.dtype(f"<u{width}") if np.dtype(dtype).kind == "u" else np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(width, m).T).reshape(-1).view(held).astype(dtype, copy=False)


def _steps(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keys of each bucket, ascending but for near ties, as differences modulo 2^64; ``_added`` adds them up again."""
    out = key.copy()
    same = np.flatnonzero(bucket[1:] == bucket[:-1]) + 1
    out[same] -= key[same - 1]
    return out


def _added(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    parts = np.split(steps, np.cumsum(sizes)[:-1]) if len(sizes) else []
    return np.concatenate([np.cumsum(x, dtype=np.uint64) for x in parts]) if parts else steps


def _edges(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return zip(cuts[:-1], cuts[1:]) if len(values) else iter(())


def _rows(block: int, bucket: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """One row per bucket with each column's slice, packed."""
    spans = list(_edges(bucket))
    cols = {"block": pa.array([block] * len(spans), pa.int32()), "bucket": pa.array([int(bucket[lo]) for lo, _ in spans], pa.int32())}
    return pa.table(cols | {k: pa.array([_pack(v[lo:hi]) for lo, hi in spans], pa.binary()) for k, v in columns.items()})


def _gather(table: pa.Table, column: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(x.as_py(), dtype) for x in table.column(column)]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


def _back(found: pa.Table, kind: str, order: np.ndarray, bucket: np.ndarray, column: str, dtype: str) -> np.ndarray:
    """A block's answers of one kind, put back into the order of its own words or pairs."""
    held, packed = found.column("bucket").to_pylist(), found.column(column)
    own = {held[i]: packed[i].as_py() for i, k in enumerate(found.column("kind").to_pylist()) if k == kind}
    out = np.zeros(len(order), dtype)
    for lo, hi in _edges(bucket):
        out[order[lo:hi]] = _unpack(own[int(bucket[lo])], dtype)
    return out


ANSWER = "kind string, block int, bucket int, x binary, y binary, a double, b double"


def _answer(table: pa.Table, kind: str, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, a: float = 0.0, b: float = 0.0) -> pa.Table:
    """One row per question, and the bucket's sums a and b on the first."""
    edge = np.concatenate([[0], np.cumsum(sizes)])
    m = table.num_rows
    cut = lambda v: pa.array([_pack(v[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:])], pa.binary())
    first = np.zeros(m)
    first[0] = 1
    return pa.table({"kind": pa.array([kind] * m), "block": table.column("block"), "bucket": table.column("bucket"), "x": cut(x), "y": cut(y),
                     "a": pa.array(first * a), "b": pa.array(first * b)})


def _seed(table: pa.Table, salt: int) -> np.random.Generator:
    return np.random.default_rng([table.column("bucket")[0].as_py(), salt])


# ---------------------------------------------------------------- steps

def _word_counts(text: DataFrame, n: int) -> DataFrame:
    """Answers "words": c(w) of every word of every block; a and b sum to N and V."""
    def ask(table: pa.Table) -> pa.Table:
        own = Block(table, pairs=False)
        order, bucket = own.words_by_bucket(n)
        return _rows(table.column("block")[0].as_py(), bucket, keys=own.vocabulary[order], counts=own.count[order].astype("<u4"))

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        keys, sizes = _gather(table, "keys", "<u8")
        counts, _ = _gather(table, "counts", "<u4")
        one, at = _distinct_hashes(keys)
        c = np.bincount(at, counts.astype(float), len(one)).astype(np.int64)
        return _answer(table, "words", sizes, c[at].astype("<u8"), np.zeros(len(at), "<u1"), float(c.sum()), float((c > 0).sum()))

    return (text.groupBy("block").applyInArrow(ask, "block int, bucket int, keys binary, counts binary")
            .groupBy("bucket").applyInArrow(total, ANSWER))


def _probability(own: Block, found: pa.Table, n: int, known: dict, state: int) -> np.ndarray:
    """P(w|u) of the block's pairs in one state: pairs, tables and parent of the same round."""
    pairs, seats = f"pairs{state}", f"parent{state}"
    at, bucket = own.words_by_bucket(n)
    guests = _back(found, "words", at, bucket, "x", "<u8").astype(float)
    guests[own.begin] = known["docs"]  # every training document begins once
    parent = _parent(_back(found, seats, at, bucket, "x", "<f4").astype(float), known)
    tables = _back(found, seats, at, bucket, "y", "<f4").astype(float)
    order, bucket, _ = own.pairs_by_bucket(n)
    mass = np.maximum(_back(found, pairs, order, bucket, "x", "<f4").astype(float), 0.0)
    return (mass + (STRENGTH + DISCOUNT * tables[own.pair_u]) * parent[own.pair_w]) / (STRENGTH + guests[own.pair_u])


def _pair_tables(text: DataFrame, answers: DataFrame, n: int, known: dict, step: int) -> DataFrame:
    """Answers "pairs": x = c_uw - d t_uw, y = tables (at the first block that has the pair)."""
    def ask(table: pa.Table, found: pa.Table) -> pa.Table:
        own = Block(table)
        at, bucket = own.words_by_bucket(n)
        c = _back(found, "words", at, bucket, "x", "<u8").astype(float)
        if step:
            parent = _back(found, "parent", at, bucket, "x", "<f4").astype(float)
            tables = _back(found, "parent", at, bucket, "y", "<f4").astype(float)
        else:  # before anything is seated: word counts for the parent, a power law for the tables
            parent, tables = np.maximum(c - DISCOUNT_TOP * np.minimum(c, 1), 0), np.power(np.maximum(c, 1), 0.85)
        strength = (STRENGTH + DISCOUNT * tables[own.pair_u]) * _parent(parent, known)[own.pair_w]
        order, bucket, key = own.pairs_by_bucket(n)
        return _rows(table.column("block")[0].as_py(), bucket, keys=_steps(bucket, key), counts=own.pair_count[order].astype("<u4"), codes=code_of(strength)[order])

    def seat(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        steps, sizes = _gather(table, "keys", "<u8")
        keys = _added(steps, sizes)
        counts, _ = _gather(table, "counts", "<u4")
        codes, _ = _gather(table, "codes", "u1")
        one, first, at = _first_hashes(keys)
        c = np.bincount(at, counts.astype(float), len(one)).astype(np.int64)
        t = draw_tables(c, codes[first], DISCOUNT, _seed(table, 1 + step))
        tables = np.zeros(len(keys), "<u4")
        tables[first] = t
        return _answer(table, "pairs", sizes, (c - DISCOUNT * t)[at].astype("<f4"), tables)

    return (text.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, "block int, bucket int, keys binary, counts binary, codes binary")
            .groupBy("bucket").applyInArrow(seat, ANSWER))


def _parent_tables(text: DataFrame, answers: DataFrame, n: int, known: dict, step: int) -> DataFrame:
    """Answers "parent": x = t_.w - d0 s_w, y = t_u; a and b sum to t (the parent's customers) and s."""
    def ask(table: pa.Table, found: pa.Table) -> pa.Table:
        own = Block(table)
        order, bucket, _ = own.pairs_by_bucket(n)
        tables = _back(found, "pairs", order, bucket, "y", "<u4").astype(float)
        m = len(own.vocabulary)
        dish = np.bincount(own.pair_w, tables, m)
        context = np.bincount(own.pair_u, tables, m)
        order, bucket = own.words_by_bucket(n)
        return _rows(table.column("block")[0].as_py(), bucket, keys=own.vocabulary[order], dish=dish[order].astype("<u4"), context=context[order].astype("<u4"))

    def seat(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        keys, sizes = _gather(table, "keys", "<u8")
        one, at = _distinct_hashes(keys)
        dish = np.bincount(at, _gather(table, "dish", "<u4")[0].astype(float), len(one)).astype(np.int64)
        context = np.bincount(at, _gather(table, "context", "<u4")[0].astype(float), len(one))
        code = np.repeat(code_of(np.array([(STRENGTH_TOP + DISCOUNT_TOP * known["s"]) / (known["V"] + 1)])), len(one))
        t = draw_tables(dish, code, DISCOUNT_TOP, _seed(table, 101 + step))
        return _answer(table, "parent", sizes, (dish - DISCOUNT_TOP * t)[at].astype("<f4"), context[at].astype("<f4"), float(dish.sum()), float(t.sum()))

    return (text.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, "block int, bucket int, keys binary, dish binary, context binary")
            .groupBy("bucket").applyInArrow(seat, ANSWER))


def _parent(mass: np.ndarray, known: dict) -> np.ndarray:
    """P(w) from t_.w - d0 s_w."""
    return (mass + (STRENGTH_TOP + DISCOUNT_TOP * known["s"]) / (known["V"] + 1)) / (STRENGTH_TOP + known["t"])


def _scores(text: DataFrame, answers: DataFrame, n: int, states: list[dict]) -> DataFrame:
    """Scores from the mean probability over the kept states, whose totals are ``states``."""
    known = states[-1]

    def of(table: pa.Table, found: pa.Table) -> pa.Table:
        own = Block(table)
        at, bucket = own.words_by_bucket(n)
        c = _back(found, "words", at, bucket, "x", "<u8").astype(float)
        p = sum(_probability(own, found, n, totals, i) for i, totals in enumerate(states)) / len(states)
        score = np.add.reduceat(np.log10(np.minimum(p, 1.0))[own.pair], own.edge[:-1])
        base = np.add.reduceat(np.log10((c + 1) / (known["N"] + 1 * (known["V"] + 1)))[own.word], own.edge[:-1])
        seen = np.add.reduceat((c > 0)[own.word].astype(np.int64), own.edge[:-1])
        return pa.table({"doc_id": pa.array(own.ids, pa.int64()), "held_out": pa.array(own.held_out), "n_tokens": pa.array(np.diff(own.edge)),
                         "n_known": pa.array(seen), "train_tokens": pa.array(np.full(len(seen), int(known["N"]))), "base_score": pa.array(base), "score": pa.array(score)})

    return text.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        of, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _sums(answers: DataFrame, kind: str) -> tuple[float, float]:
    r = answers.where(F.col("kind") == kind).agg(F.sum("a"), F.sum("b")).first()
    return r[0] or 0.0, r[1] or 0.0


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    # a block is a share of one task's input, so writing the blocks moves nothing
    tasks = max(1, rows.rdd.getNumPartitions())
    share = max(1, math.ceil(size / tasks / BLOCK_BYTES))
    block = (F.spark_partition_id() * share + F.pmod(F.xxhash64("doc_id", F.col("text")), F.lit(share))).cast("int")
    n = tasks * share
    spark = docs.sparkSession
    place = folder(spark, "lm-texts")
    text = bucketed(rows.withColumn("block", block), n, "block", "lm-texts", place)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(-1)) == HELD_OUT
    known: dict = {"docs": text.where(~held).count()}
    text = bucketed(text.groupBy("block").applyInArrow(_numbered, NUMBERED), n, "block", "lm-blocks")
    discard(spark, [place])  # from here on only the numbered words are read
    words = written(_word_counts(text, n), "lm-words")
    known["N"], known["V"] = _sums(words, "words")
    known |= {"t": known["N"], "s": known["V"]}  # until the parent is seated
    answers, last, states, kept = words, [], [], words
    for step in range(rounds):
        own = [folder(spark, name) for name in ("lm-pairs", "lm-parent")]
        pairs = written(_pair_tables(text, answers, n, dict(known), step), "lm-pairs", own[0])
        discard(spark, last)  # nothing reads a round before the burn-in's end again
        parent = written(_parent_tables(text, pairs.drop("x"), n, dict(known), step), "lm-parent", own[1])
        known["t"], known["s"] = _sums(parent, "parent")
        answers = words.unionByName(parent)
        if step >= min(BURN_IN, rounds - 1):
            kept = kept.unionByName(parent.unionByName(pairs.withColumn("y", F.lit(None).cast("binary"))).withColumn("kind", F.concat("kind", F.lit(len(states)))))
            states.append(dict(known))
        last = own if not states else []
    return _scores(text, kept, n, states)
