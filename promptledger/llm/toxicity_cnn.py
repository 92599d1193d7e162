"""Toxicity: convolutional text classifier trained in numpy (operator 8).

A token (run of letters, ASCII lower-cased) is embedded as the sum of hashed
vectors of the whole token and of its first 4, 5 and 6 bytes.  Filters of
widths 1, 2 and 3 run over the tokens; each keeps its largest positive
response over the whole text (max pooling), and a logistic layer turns the
pooled responses into a probability, calibrated by Platt scaling at the
labels' own share of toxic rows.

The network is fitted on a bounded sample of labelled rows: the whole texts of
``SAMPLE`` ids a class, in hash order, while they have ``SAMPLE_TOKENS`` tokens
or fewer together (scoring has no limit).  Equal texts are one row of the
sample, toxic if one of them is.  Thresholds by language are calibrated on every
labelled row of the training fold.  The score depends on the text alone.

Defined results: a null or empty text has no tokens and gets the score of the
bias terms.  Labels other than 0 and 1 are ignored; several labels of one id
count as toxic if one is.  Without labelled rows of both classes every score
is 0.  Repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.batches import ByteSums, Run, released, runs, take
from promptledger.llm.storage import without, written

SLOTS = 1 << 17          # rows of the hashed embedding table
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6)
SAMPLE = 3_000           # labelled rows of each class that the network is fitted on
SAMPLE_TOKENS = 2_000_000  # tokens of all drawn texts together; a text of any length can be drawn
EPOCHS, BATCH, RATE = 6, 64, 0.15
PREDICT = 0.7
RUN_BYTES = 500_000      # bytes scored at a time
BINS = 200               # steps of the score in which thresholds are sought
MIN_LABELLED = 30        # labelled rows of each class below which a language takes the common threshold


def fold(column: str = "doc_id", n: int = 3):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def tokens(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Embedding slots (tokens x 4) and the document of every token of a run."""
    start, end, doc = run.words(letters=True)
    if not len(start):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), doc
    sums = ByteSums(run.data, lower=True)
    found = [sums.hash(start, end)]
    for n in PREFIXES:
        found.append(sums.hash(start, np.minimum(start + n, end)) ^ np.uint64(n))
    return np.stack([(h % np.uint64(SLOTS)).astype(np.int32) for h in found], 1), doc


class Network:
    """Parameters, forward pass and training."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (SLOTS, DIM)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = np.full(FILTERS * len(WIDTHS), 0.5, np.float32)
        self.out_bias = np.float32(-1)
        self.scale, self.shift = 1.0, 0.0

    def warm_start(self, slots: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> None:
        """First embedding dimension: smoothed log-odds of the slots in toxic and clean texts."""
        edge = np.searchsorted(doc, np.arange(len(toxic) + 1))
        seen = np.zeros((2, SLOTS))
        for d, label in enumerate(toxic):
            seen[label, np.unique(slots[edge[d]: edge[d + 1]])] += 1
        good, bad = seen
        odds = np.log((bad + 4) / (good + 4)) - np.log(max(1, toxic.sum()) / max(1, (1 - toxic).sum()))
        self.embed[:, 0] = np.clip(odds, -3, 3) / 3
        for w in WIDTHS:
            self.filters[w][:, 0, :] = np.abs(self.filters[w][:, 0, :]) + 0.3 / w
            self.bias[w] -= 0.3

    def pooled(self, act: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, act.shape[1]), np.float32)
        if len(doc):
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out[doc[first]] = np.maximum(np.maximum.reduceat(act, first, axis=0), 0)
        return out

    def _windows(self, word: np.ndarray, doc: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Responses of the filters of width ``w`` and the document of each window."""
        n = len(doc) - w + 1
        if n <= 0:
            return np.zeros((0, FILTERS), np.float32), doc[:0]
        act = sum(word[j: n + j] @ self.filters[w][j] for j in range(w)) + self.bias[w]
        inside = doc[:n] == doc[w - 1:]
        return act[inside], doc[:n][inside]

    def train(self, slots: np.ndarray, doc: np.ndarray, toxic: np.ndarray, seed: int = 9) -> None:
        """Adagrad on the log loss; the max passes its gradient to one window per filter."""
        rng = np.random.default_rng(seed)
        edge = np.searchsorted(doc, np.arange(len(toxic) + 1))
        past = {"embed": np.full(SLOTS, 1e-2, np.float32), "out": np.full(len(self.out), 1e-2, np.float32)}
        past |= {w: np.full_like(self.filters[w], 1e-2) for w in WIDTHS}
        for _ in range(EPOCHS):
            order = rng.permutation(len(toxic))
            for lo in range(0, len(order), BATCH):
                pick = order[lo: lo + BATCH]
                rows = np.concatenate([np.arange(edge[d], edge[d + 1]) for d in pick])
                size = edge[pick + 1] - edge[pick]
                self._step(slots[rows], np.repeat(np.arange(len(pick)), size), toxic[pick], past)

    def _step(self, slots: np.ndarray, doc: np.ndarray, toxic: np.ndarray, past: dict) -> None:
        n = len(toxic)
        word = self.embed[slots].sum(1)
        pools, best = [], []
        for w in WIDTHS:
            act, of = self._windows(word, doc, w)
            m = self.pooled(act, of, n)
            span = np.flatnonzero(doc[: max(0, len(doc) - w + 1)] == doc[w - 1:]) if len(doc) >= w else np.zeros(0, int)
            at = np.full((n, FILTERS), -1)
            for f in range(FILTERS):
                hit = np.flatnonzero((act[:, f] == m[of, f]) & (m[of, f] > 0))
                at[of[hit[::-1]], f] = span[hit[::-1]]
            pools.append(m)
            best.append(at)
        pool = np.concatenate(pools, 1)
        p = 1 / (1 + np.exp(-(pool @ self.out + self.out_bias)))
        d = ((p - toxic) / n).astype(np.float32)
        d_pool = d[:, None] * self.out
        g = pool.T @ d + 1e-4 * self.out
        past["out"] += g * g
        self.out -= RATE * g / np.sqrt(past["out"])
        self.out_bias -= np.float32(RATE * d.sum())
        grad_rows, grad_slots = [], []
        for i, w in enumerate(WIDTHS):
            at, dp = best[i], d_pool[:, i * FILTERS: (i + 1) * FILTERS]
            of, f = np.nonzero(at >= 0)
            if not len(of):
                continue
            pos, gv = at[of, f], dp[of, f]
            gf = np.zeros_like(self.filters[w])
            for j in range(w):
                np.add.at(gf[j].T, f, gv[:, None] * word[pos + j])
                grad_slots.append(slots[pos + j].ravel())
                grad_rows.append(np.repeat(gv[:, None] * self.filters[w][j].T[f], slots.shape[1], axis=0))
            past[w] += gf * gf
            self.filters[w] -= RATE * gf / np.sqrt(past[w])
            gb = np.bincount(f, gv, FILTERS)
            self.bias[w] -= (RATE * gb).astype(np.float32)
        if grad_rows:
            slot, back = np.unique(np.concatenate(grad_slots), return_inverse=True)
            total = np.zeros((len(slot), DIM), np.float32)
            np.add.at(total, back, np.concatenate(grad_rows))
            past["embed"][slot] += (total * total).mean(1)
            self.embed[slot] -= RATE * total / np.sqrt(past["embed"][slot])[:, None]

    def raw(self, slots: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Logits of ``n`` documents."""
        if len(slots):
            one, back = np.unique(slots[:, 0].astype(np.int64) * SLOTS + slots[:, -1], return_index=True, return_inverse=True)[1:]
            word = self.embed[slots[one]].sum(1)
            # the filters' responses are taken per distinct token, then laid out along the text
            word = word[back.ravel()]
        else:
            word = np.zeros((0, DIM), np.float32)
        pool = np.concatenate([self.pooled(*self._windows(word, doc, w), n) for w in WIDTHS], 1)
        return pool @ self.out + self.out_bias

    def calibrate(self, logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Platt scaling by Newton steps on weighted rows, with smoothed targets."""
        good, bad = (weight * (1 - toxic)).sum(), (weight * toxic).sum()
        target = np.where(toxic == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
        x = np.column_stack([logit, np.ones_like(logit)])
        b = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            g = x.T @ (weight * (p - target)) + 1e-3 * (b - [1, 0])
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, g)
            b = b - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        self.scale, self.shift = max(float(b[0]), 1e-3), float(b[1])

    def score(self, slots: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        z = self.raw(slots, doc, n) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def _labels(labels: DataFrame) -> DataFrame:
    """One row per id of the training fold."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
            .where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
            .where(fold() != 1))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_TOKENS) -> Network | None:
    """The network, fitted on the whole texts of at most ``sample`` labelled ids of each class; None without both classes.

    Equal texts count once, as toxic if one of them is.  Of the drawn texts, those with
    the smallest hashes are taken while they have ``most`` tokens or fewer together.
    """
    label = _labels(labels)
    share = {r["toxic"]: r["count"] for r in label.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    order = F.xxhash64("doc_id", F.lit(3))
    drawn = [label.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 x sample rows

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch):
                found, doc = tokens(run)
                edge = np.searchsorted(doc, np.arange(run.n + 1))
                label_of = take(batch, "toxic", run.lo, run.hi).to_pylist()
                ids_of = take(batch, "doc_id", run.lo, run.hi).to_pylist()
                rows = [(ids_of[i], label_of[i], found[edge[i]: edge[i + 1]].tobytes()) for i in range(run.n)]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                                      pa.array(cols[2], pa.binary())], names=["doc_id", "toxic", "slots"])

    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
                    .mapInArrow(slots, "doc_id long, toxic int, slots binary")
                    .groupBy("slots").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
                    .withColumn("at", F.xxhash64("doc_id", "slots")), "toxicity-sample")
    # an id can have any number of texts, so they are bounded too: at most 2 x sample pairs of numbers
    size = texts.select("at", (F.octet_length("slots") / (4 * (1 + len(PREFIXES)))).alias("n")).orderBy("at").limit(2 * sample).toPandas()
    size = size[size["n"].cumsum() <= most]
    if not len(size):
        return None
    rows = texts.where(F.col("at") <= int(size["at"].iloc[-1])).orderBy("doc_id", "at").select("toxic", "slots").toPandas()
    if rows["toxic"].nunique() < 2:
        return None
    parts = [np.frombuffer(b, np.int32).reshape(-1, 1 + len(PREFIXES)) for b in rows["slots"]]
    toxic = rows["toxic"].to_numpy().astype(int)
    del rows
    # every fourth text of the sample only calibrates
    held = np.arange(len(toxic)) % 4 == 3
    if len(set(toxic[~held])) < 2 or len(set(toxic[held])) < 2:
        held = np.ones(len(toxic), bool)
        learn = held
    else:
        learn = ~held

    def joined(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [parts[i] for i in np.flatnonzero(which)]
        return np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.int32), [len(p) for p in own])

    net = Network()
    x, doc = joined(learn)
    net.warm_start(x, doc, toxic[learn])
    net.train(x, doc, toxic[learn])
    x, doc = joined(held)
    y = toxic[held]
    total = sum(share.values())
    weight = np.where(y == 1, share[1] / total / max(1, y.sum()), share[0] / total / max(1, (1 - y).sum())) * len(y)
    net.calibrate(net.raw(x, doc, len(y)), y, weight)
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, key (hash of the text), lang and score of every row of ``docs(doc_id, text, lang)``; the score reads the text only."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size, whatever the data

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, most=RUN_BYTES):
                found = np.zeros(run.n) if shared.value is None else shared.value.score(*tokens(run), run.n)
                yield pa.RecordBatch.from_arrays(
                    [*(take(batch, c, run.lo, run.hi) for c in ("doc_id", "key", "lang")), pa.array(found)],
                    names=["doc_id", "key", "lang", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("lang").cast("string").alias("lang"), "text")
            .mapInArrow(lambda b: released(of(b)), "doc_id long, key long, lang string, score double"))


def thresholds(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """lang and its threshold: the best F1 on all labelled rows of the training fold.

    Works on counts per language, score step and label, summed before they meet.
    """
    found = (scored.join(_labels(labels), "doc_id")
             .groupBy("lang", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
             .agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count("*").alias("n")))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        bad, n = np.zeros(BINS), np.zeros(BINS)
        np.add.at(bad, part["bin"], part["bad"])
        np.add.at(n, part["bin"], part["n"])
        cut = PREDICT
        if bad.sum() >= MIN_LABELLED and (n - bad).sum() >= MIN_LABELLED:
            hit, called = np.cumsum(bad[::-1])[::-1], np.cumsum(n[::-1])[::-1]
            f1 = 2 * hit / (called + bad.sum())
            at = np.arange(BINS) / BINS
            top = np.flatnonzero((f1 >= f1.max() - 1e-12) & (at > 0))
            if len(top):
                cut = float(at[top[np.argmin(np.abs(at[top] - PREDICT))]])
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "threshold": [cut]})

    return found.groupBy("lang").applyInPandas(best, "lang string, threshold double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, key, held_out, score, predicted (at 0.7) and flagged (at the language's own threshold)."""

    scored = written(score(docs, fit(docs, labels)), "toxicity-scores")
    cut = written(thresholds(scored, labels), "toxicity-thresholds").withColumnRenamed("lang", "_lang")
    return (scored.join(cut, F.col("lang").eqNullSafe(F.col("_lang")), "left")
            .select("doc_id", "key", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= PREDICT).cast("int").alias("predicted"),
                    (F.col("score") >= F.coalesce("threshold", F.lit(PREDICT))).alias("flagged")))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are flagged at their language's threshold."""
    return without(docs, judge(docs, labels).where("flagged"))
