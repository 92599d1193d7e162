"""Quality rules: isolation forest on rule statistics (operator 6).

1. One pass over the whole texts gives each document's rule statistics
   (counts of words, symbols, repeated lines, repeated words and so on).
2. ``TREES`` isolation trees are grown, each on its own ``PSI`` documents: the
   ``TREES * PSI`` documents with the smallest hashes of id and statistics are
   dealt to the trees, so each tree has a random sample of the whole corpus
   (both numbers are parameters of the method; in a corpus of fewer documents
   trees share them).  Rows with the same id and statistics are drawn once.  A
   document that few random splits isolate is anomalous: its mean path length
   is short.
3. The anomaly threshold is calibrated on every labelled row that the base
   rules pass: of the thresholds that keep at least ``KEEP`` of the rows
   labelled good, the one that separates good and bad rows best.

Defined results: a null or empty text has no words and fails the base rules.
Repeated rows are judged alike.  Without labels of both kinds no threshold is
set and only the base rules decide.  An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.batches import ByteSums, combine, counts, runs, shingles, take
from promptledger.llm.storage import written

TREES, PSI, KEEP = 100, 256, 0.99
BINS = 1_000  # steps in which anomaly scores are counted for the calibration

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_chars", "n_punct", "n_distinct_words")


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode("ascii"), np.uint8)] = True
    return out


_SYMBOL = _mask("#*$%&|<>")
_PUNCT = _mask(".,;:!?")
_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _repeat_words(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words in 3-word windows that the document has twice or more."""
    if len(words) < 3:
        return np.zeros(n, np.int64)
    window, _ = shingles(words, np.zeros_like(doc), 3)
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    _, back, often = np.unique(combine(window[inside], doc[inside].astype(np.uint64)), return_inverse=True, return_counts=True)
    twice = np.zeros(len(window), bool)
    twice[inside] = often[back] > 1
    hit = np.zeros(len(words), bool)
    for j in range(3):
        hit[j: len(words) - 2 + j] |= twice
    return counts(doc[hit], n)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of ``STATS`` for every row of ``docs(doc_id, text)``."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch):
                start, end, doc = run.words()
                words = ByteSums(run.data, lower=False).hash(start, end)
                word_byte = np.zeros(len(run.data) + 1, np.int8)
                np.add.at(word_byte, start, 1)
                np.add.at(word_byte, end, -1)
                in_word = np.cumsum(word_byte[:-1], dtype=np.int8) > 0
                raw, offs = run.data.tobytes(), run.offs.tolist()
                again = []
                for a, b in zip(offs[:-1], offs[1:]):
                    own = [x for x in raw[a:b].split(b"\n") if x.strip()]
                    again.append(len(own) - len(set(own)))
                first = _FIRST[run.data]
                distinct = np.unique(combine(words, doc.astype(np.uint64)), return_index=True)[1]
                cols = [counts(doc, run.n), _per_doc(first & in_word, run.offs), _per_doc(_SYMBOL[run.data], run.offs),
                        again, _repeat_words(words, doc, run.n), _per_doc(first, run.offs),
                        _per_doc(_PUNCT[run.data], run.offs), counts(doc[distinct], run.n)]
                yield pa.RecordBatch.from_arrays(
                    [take(batch, "doc_id", run.lo, run.hi), *(pa.array(c, pa.int64()) for c in cols)],
                    names=["doc_id", *STATS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, schema)


def features(stats: pd.DataFrame) -> np.ndarray:
    """Scale-free features of the statistics, one row per document.

    Symbols are rare, so their share is taken on a log scale: a random split
    then falls between none and few about as often as between few and many.
    """
    words = np.maximum(stats["n_words"].to_numpy(float), 1)
    return np.column_stack([
        stats["word_chars"] / words, np.log1p(1000 * stats["n_symbols"] / words), stats["n_repeat_words"] / words,
        stats["n_punct"] / words, stats["n_distinct_words"] / words, stats["n_chars"] / words])


# ---------------------------------------------------------------- forest

def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as flat arrays: feature (-1: leaf), split value, children, path length at a leaf."""

    def __init__(self, x: np.ndarray, seed: int = 7, trees: int = TREES, psi: int = PSI) -> None:
        rng = np.random.default_rng(seed)
        self.psi = min(psi, len(x))
        dealt = rng.permutation(len(x)) if len(x) >= trees * psi else None
        self.trees = [self._grow(x[rng.choice(len(x), self.psi, replace=False) if dealt is None else dealt[i * psi: (i + 1) * psi]], rng)
                      for i in range(trees)]

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, value, left, right, path = [], [], [], [], []
        most = math.ceil(math.log2(max(2, len(x))))

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(feature)
            for column, fill in ((feature, -1), (value, 0.0), (left, 0), (right, 0), (path, 0.0)):
                column.append(fill)
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and depth < most else []
            if not len(spread):
                path[at] = depth + _mean_path(len(rows))
                return at
            f = int(rng.choice(spread))
            v = rng.uniform(rows[:, f].min(), rows[:, f].max())
            feature[at], value[at] = f, v
            low = rows[:, f] < v
            left[at] = node(rows[low], depth + 1)
            right[at] = node(rows[~low], depth + 1)
            return at

        node(x, 0)
        return tuple(np.array(c) for c in (feature, value, left, right, path))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in 0..1: 2 to the minus mean path length over that of ``psi`` rows."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = np.where(x[rows, np.maximum(f, 0)] < value[at], left[at], right[at])
                at = np.where(inner, go, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(_mean_path(self.psi), 1e-9))


def fit(stats: DataFrame, trees: int = TREES, psi: int = PSI) -> Forest | None:
    rows = (stats.distinct().withColumn("_h", F.xxhash64("doc_id", *STATS, F.lit(11))).orderBy("_h", "doc_id", *STATS)
            .limit(trees * psi).drop("_h").toPandas())
    return Forest(features(rows), trees=trees, psi=psi) if len(rows) else None


def anomaly(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """``stats`` with the column ``anomaly``."""
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(anomaly=forest.score(features(part)) if forest and len(part) else 0.0)

    return stats.mapInPandas(score, ", ".join(f"{n} {t}" for n, t in stats.dtypes) + ", anomaly double")


def threshold(scored: DataFrame, labels: DataFrame, keep: float = KEEP) -> float:
    """Calibrated on ``scored`` rows with a label, through counts per score bin (at most 2 x ``BINS`` rows)."""
    label = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality in (0, 1)")
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    found = (scored.join(label, "doc_id").groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "quality")
             .count().collect())
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in found:
        (good if r["quality"] == 1 else bad)[min(r["bin"], BINS)] += r["count"]
    if not good.sum() or not bad.sum():
        return math.inf
    kept_good = np.cumsum(good) / good.sum()
    kept_bad = np.cumsum(bad) / bad.sum()
    gain = np.where(kept_good >= keep, kept_good - kept_bad, -1.0)
    best = np.flatnonzero(gain == gain.max())[-1]  # of equals, the one that keeps most
    return (int(best) + 1) / BINS


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly and kept."""
    stats = written(statistics(docs), "quality-stats")
    scored = written(anomaly(stats, fit(stats)), "quality-scores")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    cut = threshold(scored.where(~base), labels)
    ok = F.lit(True) if math.isinf(cut) else F.col("anomaly") < F.lit(cut)
    return scored.withColumn("base_failed", base).withColumn("kept", ~base & ok)
