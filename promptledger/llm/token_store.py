"""Token ids in a keyed binary store (operator 1).

Format, under one folder of the shared storage:

* ``shard-NNNNN.ids``: the ids of many documents in ascending key order, raw
  little-endian (2 bytes each for a vocabulary below 65,536, else 4), each
  document followed by the end id; then one unsigned 64-bit offset per
  document plus a last one; then a 32-byte trailer (magic, id width, number
  of documents, number of ids).
* ``index-NNNNN.npz``: a minimal perfect hash over the keys of one hash
  bucket: a cascade of bit vectors in which every key owns one set bit.  The
  rank of that bit is the key's slot; each slot stores a 32-bit fingerprint,
  the shard, the first record and the number of records of the key.
* ``manifest.json``: id width, bucket count and, per shard, the number of
  documents, of ids, of ids before it, and of documents with a null key.

A key is found in constant time: bucket, a few bit tests, one rank, one
fingerprint; the payload is then a slice of the shard.

Defined results: a null text is an empty document (the end id alone).
Repeated keys keep every row, next to each other and ordered by text; a lookup
returns them all, once, however often the key is asked for.  Null keys are
stored first; the manifest tells where, and a lookup of null returns them all.
An empty table gives a store without shards.  Other columns are ignored.
"""

from __future__ import annotations

import io
import json
import math
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm.batches import mix
from promptledger.llm.storage import get, in_place, open_fs, put, written

MAGIC = b"PLIDS1\0\0"
TRAILER = "<8sQQQ"
BUCKET_KEYS = 8_192       # expected keys of one index bucket
CACHED_WORDS = 800_000    # words whose ids a worker remembers
ENCODE_CHARS = 2_000_000  # characters handed to the tokenizer at a time
JOINED_WORDS = 20_000     # new words handed to it as one text
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks without the apostrophe: after letters, the tokenizer takes them as one run
NULL_BUCKET = -1          # where lookups of the null key go
_FINGERPRINT = np.uint64(0xA24BAED4963EE407)


# ---------------------------------------------------------------- tokenizer

class WordEncoder:
    """Ids of whole texts, through a cache of the words seen before.

    Holds for tokenizers that drop white space between words (as the one with
    word ends does): the ids of a text are those of its space-separated words,
    one after the other, so each distinct word is encoded once per worker.  A
    word's letters are encoded apart from the ``MARKS`` after them, as the
    tokenizer takes them apart too; words of letters alone give one word end each,
    so many of them are encoded as one text and cut there.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 65_536 else "<u4")
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, ``JOINED_WORDS`` at a time as one text."""
        out, width = [], self.dtype.itemsize
        for lo in range(0, len(words), JOINED_WORDS):
            part = words[lo: lo + JOINED_WORDS]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, self.dtype)
            cut = ((np.flatnonzero(self.last[ids]) + 1) * width).tolist()
            if len(cut) != len(part):  # some letter became several words, or the tokenizer marks no ends
                out += self.one_by_one(part)
                continue
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *cut], cut)]
        return out

    def learn(self, new: list[str]) -> None:
        known = self.known
        cores = {w: w.rstrip(MARKS) for w in new}
        alone = [c for c in set(cores.values()).difference(known) if _letters(c)]
        known.update(zip(alone, self.letters(alone)))
        rest = []
        for w, core in cores.items():
            if w in known:
                continue
            if core in known:
                marks = w[len(core):]
                if marks not in known:
                    (known[marks],) = self.one_by_one([marks])
                known[w] = known[core] + known[marks]
            else:
                rest.append(w)
        known.update(zip(rest, self.one_by_one(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = []
        for text in texts:
            if "<|" not in text and _plain(text):
                text = text.lower()  # what the normaliser does to these; a special token's name is left alone
            plain.append(text.replace("\n", " "))
        words = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        self.learn([w for w in distinct if w not in self.known])
        ids = pa.array([self.known[w] for w in distinct], pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        edges = np.frombuffer(offsets, np.int64)[ids.offset:][words.offsets.to_numpy()].tolist()
        raw = data.to_pybytes() if data is not None else b""
        return [raw[lo:hi] for lo, hi in zip(edges[:-1], edges[1:])]


def _letters(word: str) -> bool:
    """Whether a word is of letters alone, also in the tokenizer's normal form."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _plain(text: str) -> bool:
    """Whether all characters lie below U+0100: then none changes under NFC, and lower case goes character by character."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= ENCODE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


# ---------------------------------------------------------------- perfect hash

def _levels(keys: np.ndarray, gamma: float = 2.0) -> list[np.ndarray]:
    """Bit vectors: at each level a key that shares its slot with none keeps it."""
    out, seed = [], 1
    while len(keys):
        size = max(64, math.ceil(gamma * len(keys) / 64) * 64)
        slot = (mix(keys + np.uint64(seed)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        out.append(alone)
        keys = keys[~alone[slot]]
        seed += 1
    return out


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys; ``slot`` is -1 where no level has the key's bit."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.sizes = words, sizes
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = _levels(keys.astype(np.uint64))
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        words = np.packbits(bits, bitorder="little").view("<u8")
        return cls(words, np.array([len(x) for x in levels], np.int64))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (mix(keys[open_] + np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_, base = open_[~hit], base + size
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ _FINGERPRINT) >> np.uint64(32)).astype(np.uint32)


def _bucket(n: int):
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n)).cast("int")


# ---------------------------------------------------------------- writing

def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> dict:
    """Encode ``docs(doc_id, text)`` into a store at ``folder``; returns its manifest."""
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = encoder(tokenizer), TaskContext.get().partitionId()
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        files, path = open_fs(f"{folder}/shard-{number:05d}.ids")
        own, out, ends, record = f"{path}.{uuid.uuid4().hex}.part", None, [0], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = files.open_output_stream(own)
            sizes = []
            for part in _pieces(batch.column("text").to_pylist()):
                for ids in enc.encode(part):
                    out.write(ids)
                    out.write(end)
                    sizes.append(len(ids) // width + 1)
                    ends.append(ends[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(sizes), number, np.int32)),
                 pa.array(np.arange(record, record + len(sizes), dtype=np.int64)), pa.array(sizes, pa.int64())],
                names=["doc_id", "shard", "record", "n_tokens"])
            record += len(sizes)
        if out is not None:
            out.write(np.array(ends, "<u8").tobytes())
            out.write(struct.pack(TRAILER, MAGIC, width, record, ends[-1]))
            out.close()
            in_place(files, own, path)

    records = written(rows.mapInArrow(shard, "doc_id long, shard int, record long, n_tokens long"), "token-records")
    # one row per shard: a bounded summary, whatever the number of documents
    shards = sorted(records.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("ids"),
                                                F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect())
    total = sum(s.n for s in shards)
    manifest = {"buckets": max(1, math.ceil(total / BUCKET_KEYS)), "shards": {}}
    before = 0
    for s in shards:
        manifest["shards"][str(s.shard)] = {"docs": s.n, "ids": s.ids, "start": before, "nulls": s.nulls}
        before += s.ids

    def index(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        keys = part["doc_id"].to_numpy(np.int64)
        mph = PerfectHash.build(keys)
        order = np.argsort(mph.slot(keys))
        buffer = io.BytesIO()
        np.savez(buffer, words=mph.words, sizes=mph.sizes, mark=fingerprint(keys)[order],
                 shard=part["shard"].to_numpy(np.int32)[order], record=part["record"].to_numpy(np.int64)[order],
                 count=part["n"].to_numpy(np.int64)[order])
        put(f"{folder}/index-{key[0]:05d}.npz", [buffer.getvalue()])
        return pd.DataFrame({"bucket": [key[0]], "n_keys": [len(keys)]})

    (records.where("doc_id is not null").groupBy("doc_id", "shard")
     .agg(F.min("record").alias("record"), F.count("*").alias("n"))
     .withColumn("bucket", _bucket(manifest["buckets"]))
     .groupBy("bucket").applyInPandas(index, "bucket int, n_keys long")
     .agg(F.sum("n_keys")).collect())
    put(f"{folder}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


# ---------------------------------------------------------------- reading

class IndexBucket:
    def __init__(self, folder: str, number: int) -> None:
        with np.load(io.BytesIO(get(f"{folder}/index-{number:05d}.npz"))) as z:
            self.hash = PerfectHash(z["words"], z["sizes"])
            self.mark, self.shard, self.record, self.count = z["mark"], z["shard"], z["record"], z["count"]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of ``keys`` and which of them the fingerprints confirm."""
        slot = self.hash.slot(keys)
        known = slot >= 0
        known[known] = self.mark[slot[known]] == fingerprint(keys[known])
        return slot, known


class Shard:
    """One shard file, read by slices."""

    def __init__(self, folder: str, number: int) -> None:
        files, path = open_fs(f"{folder}/shard-{number:05d}.ids")
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - struct.calcsize(TRAILER))
        magic, self.width, self.docs, self.ids = struct.unpack(TRAILER, self.file.read(struct.calcsize(TRAILER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard of token ids")
        self.file.seek(self.ids * self.width)
        self.offsets = np.frombuffer(self.file.read(8 * (self.docs + 1)), "<u8").astype(np.int64)

    def get(self, record: int) -> np.ndarray:
        lo, hi = self.offsets[record], self.offsets[record + 1]
        self.file.seek(int(lo * self.width))
        return np.frombuffer(self.file.read(int((hi - lo) * self.width)), f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.file.close()


def read(keys: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Documents of ``keys(doc_id)`` from the store: doc_id, start, n_tokens, ids_crc32[, ids].

    Keys go to their index bucket, then their locations to their shard, where
    payload slices are read in file order.  Unknown keys give no row; a key
    asked for twice gives its rows once.
    """
    manifest = json.loads(get(f"{folder}/manifest.json"))
    n, starts = manifest["buckets"], {int(k): v["start"] for k, v in manifest["shards"].items()}
    # null keys come first in the order of keys, so they are the first records of their shards
    nulls = {int(k): v["nulls"] for k, v in manifest["shards"].items() if v["nulls"]}
    names = ["doc_id", "shard", "record", "n"]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for batch in batches:
            ids, bucket = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("bucket").to_numpy()
            for lo, hi in _groups(bucket):
                if bucket[lo] == NULL_BUCKET:
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(nulls), pa.int64()), pa.array(list(nulls), pa.int32()), pa.array([0] * len(nulls), pa.int64()),
                         pa.array(list(nulls.values()), pa.int64())], names=names)
                    continue
                if bucket[lo] != at:
                    at, index = bucket[lo], IndexBucket(folder, bucket[lo])
                slot, known = index.find(ids[lo:hi])
                slot = slot[known]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][known]), pa.array(index.shard[slot]), pa.array(index.record[slot]),
                     pa.array(index.count[slot])], names=names)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            ids, number = batch.column("doc_id").to_pylist(), batch.column("shard").to_numpy()
            record, count = batch.column("record").to_numpy(), batch.column("n").to_numpy()
            for lo, hi in _groups(number):
                if number[lo] != at:
                    if shard is not None:
                        shard.close()
                    at, shard = number[lo], Shard(folder, number[lo])
                out = []
                for i in range(lo, hi):
                    for r in range(record[i], record[i] + count[i]):
                        got = shard.get(r)
                        out.append((ids[i], int(starts[int(at)] + shard.offsets[r]), len(got),
                                    zlib.crc32(got.tobytes()), *([got.tolist()] if payload else [])))
                cols = list(zip(*out)) if out else []
                if cols:
                    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * payload
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])

    bucket = F.when(F.col("doc_id").isNull(), F.lit(NULL_BUCKET)).otherwise(_bucket(n))
    # a repeated key is asked for once; the grouping is by bucket already, so it moves no rows again
    located = (keys.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("bucket", bucket)
               .repartition("bucket").groupBy("bucket", "doc_id").agg(F.lit(1)).select("doc_id", "bucket").sortWithinPartitions("bucket"))
    return (located.mapInArrow(locate, "doc_id long, shard int, record long, n long")
            .repartition("shard").sortWithinPartitions("shard", "record")
            .mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * payload))


def _groups(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        edges = [0, *cuts.tolist(), len(values)]
        yield from zip(edges[:-1], edges[1:])


def manifest_of(spark: SparkSession, folder: str) -> dict:
    return json.loads(get(f"{folder}/manifest.json"))
