"""SentencePiece encoding and decoding on the tokenizers library (operator 4).

The model file (a protobuf) is parsed here; from it the normaliser, the
metaspace marker, the model (BPE merges in score order, or unigram scores) and
byte fallback are rebuilt as a ``tokenizers`` object.  Batches are encoded by
the library's threads (``threads`` per task; at least two, or the task's cores).

A text is normalised whole and cut before each marker that follows another
character, and before each line end if no piece contains one; no piece crosses
such a cut (checked when the model is loaded; else texts stay whole).  Every
distinct segment is encoded once per worker and decoded back.  The ids are the
rebuilt object's.  ``parity`` of a document says that the sentencepiece library
gives the same ids: compared by segment for a model whose normaliser only
replaces blanks, else by whole text.  ``round_trip`` says that its ids decode
to its normalised text.

Defined results: a null or empty text gives no ids and round-trips.  Control
and byte names in a text (``<s>``, ``<0x0A>``) are ordinary text.  Repeated
rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.llm.batches import released

MARK = "▁"
CACHED_SEGMENTS = 800_000
LEARNED = 4_096          # segments encoded at once: the tokenizer's results are far larger than the ids
ENCODE_CHARS = 250_000    # texts split at once: the words of a part, as Python strings, are many times its size

# Fixed values of the model file format: field numbers and enumerations.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
TRAINER_TYPE, TRAINER_BYTE_FALLBACK, TRAINER_UNK = 3, 35, 40
NORM_CHARSMAP, NORM_PREFIX, NORM_SQUEEZE, NORM_ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[i]
        i += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, i


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value (varint as int, all else as bytes) of a protobuf message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            size, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i: i + size], i + size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unk: int
    charsmap: bytes
    prefix: bool
    squeeze: bool
    escape: bool


def parse(proto: bytes) -> Model:
    pieces, trainer, norm = [], {}, {}
    for number, value in fields(proto):
        if number == PIECES:
            p = dict(fields(value))
            pieces.append((p.get(PIECE_TEXT, b"").decode(), struct.unpack("<f", p.get(PIECE_SCORE, bytes(4)))[0], p.get(PIECE_TYPE, NORMAL)))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            norm = dict(fields(value))
    return Model(pieces, trainer.get(TRAINER_TYPE, UNIGRAM), bool(trainer.get(TRAINER_BYTE_FALLBACK, 0)), trainer.get(TRAINER_UNK, 0),
                 norm.get(NORM_CHARSMAP, b""), bool(norm.get(NORM_PREFIX, 1)), bool(norm.get(NORM_SQUEEZE, 1)), bool(norm.get(NORM_ESCAPE, 1)))


def build(model: Model):
    """The tokenizers object: no normaliser (see ``Codec.normalise``), model and decoder."""
    from tokenizers import Tokenizer, decoders, models
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unk = model.pieces[model.unk][0]
    if model.kind == BPE:
        usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = sorted(((-score, ids[p], p[:k], p[k:]) for p, score in usable.items() for k in range(1, len(p))
                         if p[:k] in usable and p[k:] in usable))
        inner = models.BPE(vocab=ids, merges=[(a, b) for _, _, a, b in merges], unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        inner = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are known")
    out = Tokenizer(inner)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return out


class Codec:
    """Encoder and decoder of one model file, with a bounded cache of segments."""

    def __init__(self, path: str, threads: int = 1) -> None:
        self.threads = threads
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece
        from tokenizers import normalizers
        with open(path, "rb") as f:
            proto = f.read()
        self.model = parse(proto)
        self.tokenizer = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        texts = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED)]
        self.at_marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in texts)
        self.at_lines = not any("\n" in p for p in texts)
        m = self.model
        self.plain = m.prefix and m.escape and not m.squeeze and self.charsmap is None and self.at_marks and self.at_lines
        self.known: dict[str, bytes] = {}   # ids by key of a segment (see ``_key``)
        self.disagree: set[str] = set()     # keys whose ids the two libraries see differently
        self.broken: set[str] = set()       # keys that do not decode to themselves

    def normalise(self, text: str) -> str:
        m = self.model
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if m.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if m.prefix:
            text = " " + text
        return text.replace(" ", MARK) if m.escape else text

    def segments(self, text: str) -> list[str]:
        """Pieces of a normalised text between which nothing merges."""
        if not text:
            return []
        out = []
        for line in re.split("(?=\n)", text) if self.at_lines and "\n" in text else (text,):
            if line:
                out += re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line) if self.at_marks else [line]
        return out

    def _keys(self, text: str) -> list[str]:
        """Keys of a text's segments: the word of a marked one, a line end and what follows, else the marker and the segment."""
        if self.plain and MARK not in text and text[:1] != " ":
            lines = text.replace("\n", " \n")
            if "  " not in lines:
                return lines.split(" ") if text else []
        return [s[1:] if s[0] == MARK and MARK not in s[1:] else s if s[0] == "\n" else MARK + s for s in self.segments(self.normalise(text))]

    @staticmethod
    def _segment(key: str) -> str:
        return key[1:] if key[:1] == MARK else key if key[:1] == "\n" else MARK + key

    def _reference_ids(self, segments: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids of normalised segments.

        It puts the marker in front of a text, so a segment is encoded after
        a line end, whose ids are then taken off.
        """
        lead = len(self.reference.encode("\n"))
        plain = ["\n" + s.replace(MARK, " ") for s in segments]
        return [ids[lead:] for ids in self.reference.encode(plain, num_threads=self.threads)]

    def _learn(self, keys: list[str]) -> None:
        segments = [self._segment(k) for k in keys]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        truth = self._reference_ids(segments) if self.plain else found  # other models: see ``_agree``
        back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        for k, s, f, t, b in zip(keys, segments, found, truth, back):
            self.known[k] = array("I", f).tobytes()
            if f != t:
                self.disagree.add(k)
            if b.replace(" ", MARK) != s:
                self.broken.add(k)

    def _agree(self, texts: list[str], split: list[list[str]], ids: list[bytes]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids, per text."""
        if self.plain:
            return [not self.disagree or self.disagree.isdisjoint(keys) for keys in split]
        return [array("I", t).tobytes() == own for t, own in zip(self.reference.encode(texts, num_threads=self.threads), ids)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """Per text: ids (little-endian, 4 bytes), parity, round trip."""
        if len(self.known) > CACHED_SEGMENTS:
            self.forget()
        split = [self._keys(t) for t in texts]
        new = {k for keys in split for k in keys}.difference(self.known)
        new = list(new)
        for lo in range(0, len(new), LEARNED):
            self._learn(new[lo: lo + LEARNED])
        known = self.known.__getitem__
        ids = [b"".join(map(known, keys)) for keys in split]
        return [(own, agreed, not self.broken or self.broken.isdisjoint(keys))
                for own, agreed, keys in zip(ids, self._agree(texts, split, ids), split)]

    def forget(self) -> None:
        """Empty the cache of segments."""
        for kept in (self.known, self.disagree, self.broken):
            kept.clear()

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids, without the marker that was put in front."""
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [t[1:] if self.model.prefix and t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=2)
def codec(path: str, threads: int = 1) -> Codec:
    return Codec(path, threads)


def _threads(threads: int | None) -> int:
    task = TaskContext.get()
    return threads or max(2, task.cpus() if task else 1)


def _parts(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= ENCODE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, model: str, keep: list[str] | None = None, with_ids: bool = True, threads: int | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs(text, ...)`` with n_tokens, ids_crc32, parity, round_trip[, ids].

    New columns replace those of the same names; all others are carried along.
    """
    new = ["n_tokens", "ids_crc32", "parity", "round_trip", "ids"][: 5 if with_ids else 4]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    body = "_text"
    while body in {c.lower() for c in keep}:
        body += "_"
    rows = docs.select(*keep, F.col("text").alias(body))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, _threads(threads))
        for batch in batches:
            lo = 0
            for part in _parts(batch.column(body).to_pylist()):
                found = own.encode(part)
                cols = [pa.array([len(f[0]) // 4 for f in found], pa.int64()), pa.array([zlib.crc32(f[0]) for f in found], pa.int64()),
                        pa.array([f[1] for f in found]), pa.array([f[2] for f in found])]
                if with_ids:
                    ends = np.cumsum([0] + [len(f[0]) // 4 for f in found]).astype(np.int32)
                    flat = np.frombuffer(b"".join(f[0] for f in found), "<u4").astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, len(part)) for c in keep] + cols, names=keep + new)
                lo += len(part)
        own.forget()  # the worker lives on for other steps, and a task's segments are several times the model

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"]
                       + ["ids array<int>"] * with_ids)
    return rows.mapInArrow(lambda b: released(of(b)), schema)


def decode(encoded: DataFrame, model: str, threads: int | None = None) -> DataFrame:
    """``encoded(ids, ...)`` with the column ``decoded``; null ids decode to an empty text."""
    keep = [c for c in encoded.columns if c != "decoded"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, _threads(threads))
        for batch in batches:
            texts = own.decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=keep + ["decoded"])

    kinds = dict(encoded.dtypes)
    return encoded.select(*keep).mapInArrow(of, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["decoded string"]))
