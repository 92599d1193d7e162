"""Periodic run detection: suffix automaton with link-cut access (operator 13).

A run is a stretch of words with smallest period q and a length of at least
``LEAST`` and 2q that no neighbouring word extends with that period.

1. Stretches without any run are left out by an exact test, in numpy.  A run
   of period q covers itself with windows of ``LEAST`` / 2 words that occur
   again q words away, and q is at most half its length.  So only windows that
   occur again at a distance of at most half the stretch covered by such
   windows are kept, and this is repeated until nothing changes.  Every run
   lies whole inside one of the stretches that are left.
2. Each stretch gets its suffix automaton.  Its suffix links form a tree, held
   as a link-cut tree: a preferred path is a splay tree and has one colour, the
   place where its strings ended last.  Word i is appended by an access from
   the state of its prefix to the root, which recolours the path to i.  The
   access meets the old paths as segments (``low`` < lengths <= ``high``) with
   a colour e.  If q = i - e lies within a segment's lengths, the last q words
   also end at e and nowhere between: a square with primitive period q.
3. A square is extended to both sides as far as the words repeat; the run is
   kept by period, so its later squares cost one lookup.

An access meets O(log n) segments, amortised.  Memory and time of a text grow
with its repetitive stretches; texts are handled one by one, whole.

Defined results: a null, empty or blank text has no words and no runs.
Repeated rows are judged alike; rows with one id are judged row by row.  An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.batches import ByteSums, combine, runs, shingles

LEAST = 12               # fewest words of a run
RUN_BYTES = 500_000      # bytes of whole texts handled at once
OUT_BYTES = 4_000_000    # bytes of collapsed texts in one batch

Run3 = tuple[int, int, int]  # start, length, period


class SuffixLinks:
    """Suffix automaton of a word list: length and link of every state (0: root), and the state of every prefix."""

    def __init__(self, words: list[int]) -> None:
        self.length, self.link, self.prefix = [0], [-1], []
        go: list[dict[int, int]] = [{}]
        last = 0
        for w in words:
            new = len(go)
            go.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in go[p]:
                go[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = go[p][w]
                if self.length[q] > self.length[p] + 1:
                    copy = len(go)
                    go.append(dict(go[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and go[p].get(w) == q:
                        go[p][w] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[new] = q
            self.prefix.append(new)
            last = new


class LinkCutPaths:
    """Preferred paths of a rooted tree as splay trees, with one colour per path (kept at the splay root; -1: none).

    States are shifted by one, so that 0 stands for none.  A node's ``up`` is
    its parent in the splay tree or, at a splay root, the tree node above the path.
    """

    def __init__(self, link: list[int], length: list[int]) -> None:
        n = len(link) + 1
        self.up = [0] + [p + 1 for p in link]
        self.left, self.right = [0] * n, [0] * n
        self.colour = [-1] * n
        self.length = [-1] + length

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        if not y or (left[y] != x and right[y] != x):
            return
        top = y
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner:  # same side twice: the parent turns first
                self._turn(y if (left[z] == y) == (left[y] == x) else x)
            top = z if inner else y
            self._turn(x)
            y = up[x]
        self.colour[x] = self.colour[top]

    def _turn(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = right[x]
            left[y], right[x] = b, y
        else:
            b = left[x]
            right[y], left[x] = b, y
        if b:
            up[b] = y
        up[y] = x
        up[x] = z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def access(self, state: int, colour: int) -> list[tuple[int, int, int]]:
        """Recolour the path from ``state`` to the root; the old segments met, as (low, high, colour) with a colour."""
        v = u = state + 1
        below, met = 0, []
        up, right, paint, length = self.up, self.right, self.colour, self.length
        while u:
            self._splay(u)
            above, old = up[u], paint[u]
            if old >= 0:
                met.append((length[above], length[u], old))
            if right[u]:
                paint[right[u]] = old
            right[u] = below
            below, u = u, above
        self._splay(v)
        paint[v] = colour
        return met


def runs_of(words: list[int], least: int = LEAST) -> list[Run3]:
    """All runs of a word list, by start, then period."""
    sam = SuffixLinks(words)
    paths = LinkCutPaths(sam.link, sam.length)
    reached: dict[int, int] = {}  # by period: the end of its latest run
    found: list[Run3] = []
    n = len(words)
    for i, state in enumerate(sam.prefix):
        for low, high, e in paths.access(state, i):
            q = i - e
            if not low < q <= high or reached.get(q, 0) > i:
                continue
            a = i - 2 * q + 1
            while a > 0 and words[a - 1] == words[a - 1 + q]:
                a -= 1
            b = i + 1
            while b < n and words[b] == words[b - q]:
                b += 1
            reached[q] = b
            if b - a >= least:
                found.append((a, b - a, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of places outside of which no document of ``words`` (hashes, by document) has a run.

    Equal words have equal hashes, so a collision can only keep a stretch that has no run.
    """
    half = least // 2
    if len(words) < least:
        return []
    window, _ = shingles(words, np.zeros_like(doc), half)
    at = np.flatnonzero(doc[: len(window)] == doc[half - 1:])
    key = combine(window[at], doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    apart = at[order[1:]] - at[order[:-1]]
    far = np.iinfo(np.int64).max
    near = np.full(len(words), far)
    first, second = at[order[:-1][same]], at[order[1:][same]]
    near[first] = apart[same]
    near[second] = np.minimum(near[second], apart[same])
    while True:
        kept = np.flatnonzero(near < far)
        if not len(kept):
            return []
        # windows that touch or overlap, of one document, cover one stretch
        new = np.concatenate([[True], (kept[1:] - kept[:-1] > half) | (doc[kept[1:]] != doc[kept[:-1]])])
        begin = np.flatnonzero(new)
        lo = kept[begin]
        hi = kept[np.concatenate([begin[1:], [len(kept)]]) - 1] + half
        size = (hi - lo)[np.cumsum(new) - 1]
        bad = (2 * near[kept] > size) | (size < least)
        if not bad.any():
            return list(zip(lo.tolist(), hi.tolist()))
        near[kept[bad]] = far


def _numbers(words: list[bytes]) -> list[int]:
    ids: dict[bytes, int] = {}
    return [ids.setdefault(w, len(ids)) for w in words]


def detect(docs: DataFrame, order: Callable[[int | None, int], np.ndarray | None] | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without its repetitions.

    ``order(doc_id, n)`` may give the number of the word to read at each of the
    n places of a text (None: as written).  ``collapsed`` holds the words that
    no run contains after its first period, joined by one space.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for run in runs(batch, most=RUN_BYTES):
                start, end, doc = run.words()
                hashes = ByteSums(run.data, lower=False).hash(start, end)
                edge = np.searchsorted(doc, np.arange(run.n + 1))
                ids = batch.column("doc_id").slice(run.lo, run.n).to_pylist()
                moved = {}
                for d in range(run.n):
                    n = int(edge[d + 1] - edge[d])
                    as_read = order(ids[d], n) if order and n else None
                    if as_read is not None:
                        moved[d] = as_read
                        hashes[edge[d]: edge[d + 1]] = hashes[edge[d]: edge[d + 1]][as_read]
                by_doc: dict[int, list[tuple[int, int]]] = {}
                for lo, hi in stretches(hashes, doc, least):
                    d = int(doc[lo])
                    by_doc.setdefault(d, []).append((lo - int(edge[d]), hi - int(edge[d])))
                raw, offs = run.data.tobytes(), run.offs.tolist()
                n_words, found, texts, size, first = [], [], [], 0, run.lo
                for d in range(run.n):
                    words = raw[offs[d]: offs[d + 1]].split()  # bytes split at exactly the six ASCII blanks
                    if d in moved:
                        words = [words[j] for j in moved[d].tolist()]
                    mine = []
                    for lo, hi in by_doc.get(d, []):
                        mine += [(a + lo, length, q) for a, length, q in runs_of(_numbers(words[lo:hi]), least)]
                    n_words.append(len(words))
                    found.append([{"start": a, "length": length, "period": q} for a, length, q in mine])
                    if mine:
                        keep = np.ones(len(words), bool)
                        for a, length, q in mine:
                            keep[a + q: a + length] = False
                        words = [words[j] for j in np.flatnonzero(keep).tolist()]
                    texts.append(b" ".join(words))
                    size += len(texts[-1])
                    if size > OUT_BYTES or d == run.n - 1:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").slice(first, len(texts)), pa.array(n_words, pa.int64()), pa.array(found, kind),
                             pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
                        first += len(texts)
                        n_words, found, texts, size = [], [], [], 0

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(of, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"))


def tail_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's reading order: of every tenth hash of an id, the words from a on repeat with a period."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode("ascii"))
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


def digest(docs: DataFrame, order: Callable[[int | None, int], np.ndarray | None] | None = tail_order) -> DataFrame:
    """Per row: n_runs, the longest run (ties: smallest start, then period), and hashes of all runs and of the collapsed text."""
    found = detect(docs, order)
    # array_max compares field by field: greatest length, then smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
                    F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                    F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words"))
