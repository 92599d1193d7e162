"""Operator 1: encoded ids and their keyed store."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm_rows import nothing, odd, odd_rows  # noqa: F401  (fixtures)

from promptledger.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tok, out, start = Tokenizer.from_file(PATH), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_store_equals_the_library(spark, odd, odd_rows, tmp_dir):
    at = f"{tmp_dir}/store"
    ts.write(odd, at, PATH)
    got = sorted(tuple(r) for r in ts.read(odd, at).collect())
    assert got == sorted(expected(odd_rows))
    one = ts.read(spark.createDataFrame([(9,), (9,), (77,)], "doc_id long"), at, payload=True).collect()
    assert [r.doc_id for r in one] == [9] * 2 and all(len(r.ids) == r.n_tokens for r in one)


def test_folders_are_full_uris(spark):
    from promptledger.llm.storage import folder, get, put
    at = folder(spark, "some")
    assert ":" in at
    put(f"{at}/x", [b"ab", b"c"])
    assert get(f"{at}/x") == b"abc"


def test_special_names_and_upper_case(spark, tmp_dir):
    rows = [(1, "A <|endoftext|> b"), (2, "<|ENDOFTEXT|> x"), (3, "ÀÉ ΟΔΟΣ İx THE end's"), (4, "a b ć d")]
    at = f"{tmp_dir}/store"
    ts.write(spark.createDataFrame(rows, "doc_id long, text string"), at, PATH)
    got = sorted(tuple(r) for r in ts.read(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), at).collect())
    assert got == expected(rows)


def test_words_are_encoded_together_as_alone():
    enc = ts.WordEncoder(PATH)
    alone = enc.one_by_one

    def few(words):
        assert len(words) <= 60  # letters are not encoded word by word
        return alone(words)

    enc.one_by_one = few
    words = [a + b + c for a in ("un", "RE", "çé", "") for b in ("tall", "mpi", "sthß", "o", "ÑÜ") for c in ("ing", "ed", "ten")]
    texts = [" ".join(w + m for w in words) for m in ("", ".", "!!", "###", "...,", "<>", "-")]
    expected = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    assert enc.encode(texts) == expected and enc.encode([]) == []
    odd = ["ab\u0958. x\u0130, \u0130a! \u00b5Z", "don't. it's! a' 'll ab'. x<\u0338 y=.\u0338", "e\u0301t\u00e9. \u1100\u1161, 12. a1! \u03a3\u03a3.", ""]
    enc.one_by_one = alone
    assert enc.encode(odd) == [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in odd]


def test_null_ids_and_empty_table(spark, nothing, tmp_dir):
    ts.write(nothing, f"{tmp_dir}/none", PATH)
    assert ts.read(nothing, f"{tmp_dir}/none").count() == 0
    rows = [(None, "a b"), (5, "c"), (None, None), (None, "a b"), (5, "c"), (0, "zero"), (5, None)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    ts.write(some, f"{tmp_dir}/some", PATH)
    got = ts.read(some, f"{tmp_dir}/some").collect()
    assert len(got) == len(rows)  # one row per document, whatever its id
    first = [(-1, t) if i is None else (i, t) for i, t in rows]
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == expected(first)
    assert [r.doc_id for r in ts.read(some.where("doc_id is null"), f"{tmp_dir}/some").collect()] == [None] * 3


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = np.unique(np.random.default_rng(1).integers(-2**62, 2**62, 20_000))
    mph = ts.PerfectHash.build(keys)
    slot = mph.slot(keys)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    mark = np.empty(len(keys), np.uint32)
    mark[slot] = ts.fingerprint(keys)
    strange = keys + 1
    strange = strange[~np.isin(strange, keys)]
    at = mph.slot(strange)
    assert (mark[at[at >= 0]] == ts.fingerprint(strange[at >= 0])).mean() < 0.001
    assert len(ts.PerfectHash.build(np.zeros(0, np.int64)).slot(keys)) == len(keys)
