"""Operator 4: parity with the sentencepiece library and round trips."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from llm_rows import nothing, odd, odd_rows  # noqa: F401  (fixtures)

from promptledger.llm import sentencepiece_backend as sb

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_random_texts_are_encoded_alike():
    own, ref = sb.Codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    atoms = [" ", "  ", "\n", "a", "b", "the", "é", "日", "\t", "x1", "<s>", "\x00", ".", " the", "<0x0A>", "\U0001f600"]
    texts = ["".join(rng.choices(atoms, k=rng.randrange(14))) for _ in range(4_000)] + [" " * n + "a" for n in range(20)] + ["x" * 3_000]
    for t, (ids, parity, back) in zip(texts, own.encode(texts)):
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == ref.encode(t) and parity and back, t
    some = texts[:500]
    assert own.decode([np.frombuffer(x[0], "<u4").tolist() for x in own.encode(some)]) == some


def test_rows(odd, odd_rows, nothing):
    ref = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = sb.encode(odd, PATH).collect()
    assert len(out) == len(odd_rows)
    want = sorted((i, zlib.crc32(np.array(ref.encode(t or ""), "<u4").tobytes())) for i, t in odd_rows)
    assert sorted((r.doc_id, r.ids_crc32) for r in out) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) and r["_id"] == "k" for r in out)
    back = {(r.doc_id, r.decoded) for r in sb.decode(sb.encode(odd.select("doc_id", "text"), PATH), PATH).select("doc_id", "decoded").collect()}
    assert back == {(i, t or "") for i, t in odd_rows}
    assert sb.encode(nothing, PATH).count() == 0


def _field(number, kind, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])
    return varint(number << 3 | kind) + (varint(value) if kind == 0 else value if kind == 5 else varint(len(value)) + value)


def test_unigram_model_with_byte_fallback(tmp_path):
    pieces = [("<unk>", 0, sb.UNKNOWN), ("<s>", 0, sb.CONTROL), ("</s>", 0, sb.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0, sb.BYTE) for b in range(256)]
    pieces += [(p, s, sb.NORMAL) for p, s in (("▁", -2), ("▁ab", -3), ("ab", -4), ("a", -5), ("b", -5.5), ("c", -6), ("▁c", -4.5), ("abc", -6.5))]
    proto = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, k)) for p, s, k in pieces)
    proto += _field(2, 2, _field(3, 0, sb.UNIGRAM) + _field(35, 0, 1)) + _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, 1) + _field(4, 0, 0) + _field(5, 0, 1))
    path = tmp_path / "u.model"
    path.write_bytes(proto)
    own, ref = sb.Codec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b", "c", " ", "é", "ab"], k=rng.randrange(12))) for _ in range(500)]
    for t, (ids, parity, back) in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode(t) and parity and back, t


def test_ids_come_from_the_rebuilt_object_and_parity_tells_differences():
    own, ref = sb.Codec(PATH, threads=2), sentencepiece.SentencePieceProcessor(model_file=PATH)
    real = own.tokenizer

    class Other:  # an object that encodes one word differently
        def encode_batch_fast(self, texts, add_special_tokens):
            return real.encode_batch_fast([t.replace("cat", "dog") for t in texts], add_special_tokens=add_special_tokens)

        def decode_batch(self, ids, skip_special_tokens):
            return real.decode_batch(ids, skip_special_tokens=skip_special_tokens)

    own.tokenizer = Other()
    (one, agrees, back), (_, fine, whole) = own.encode(["a cat", "a bird"])
    assert np.frombuffer(one, "<u4").tolist() == ref.encode("a dog") and not agrees and not back and fine and whole
    own.plain, own.known = False, {}
    assert [x[1] for x in own.encode(["a cat", "a bird"])] == [False, True]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2, "y")], "doc_id long, text string, _text string, n_tokens long, _TEXT_ string")
    r = sb.encode(df, PATH).first()
    assert (r["_text"], r["_TEXT_"], r["text"]) == ("x", "y", "a b") and r.n_tokens == len(r.ids) and r.parity and r.round_trip


def test_workers_keep_no_segments_of_a_task(spark):
    docs = spark.createDataFrame([(i, f"segment{i} and {i * 7919}") for i in range(400)], "doc_id long, text string").repartition(4, "doc_id")
    assert sb.encode(docs, PATH, threads=2).where("parity and round_trip").count() == 400

    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(sb.codec(PATH, 2).known)], pa.int64())], names=["held"])

    assert [r.held for r in docs.select("doc_id").mapInArrow(held, "held long").where("held > 0").collect()] == []


def test_segments_are_learnt_a_bounded_number_at_a_time(monkeypatch):
    own, sizes = sb.Codec(PATH), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda keys: (sizes.append(len(keys)), learn(keys)))
    text = " ".join(f"w{i}" for i in range(10_000))
    ((ids, parity, back),) = own.encode([text])
    assert parity and back and max(sizes) <= sb.LEARNED and sum(sizes) == len(own.known) == 10_000
    assert np.frombuffer(ids, "<u4").tolist() == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)
    own.forget()
    assert not own.known
