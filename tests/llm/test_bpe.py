"""Byte-level BPE against tiktoken."""

from __future__ import annotations

import hashlib
import random
import string

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quirefold.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def texts():
    rng = random.Random(3)
    wild = "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x400, 0x3000), rng.randrange(0x4E00, 0xD7FF), rng.randrange(0x10000, 0x11000)])) for _ in range(2000))
    letters = "".join(rng.choice(string.ascii_lowercase) for _ in range(1500))
    return [
        None, "", " \n\t x  　 ", "it's we'll I'D don't", "12345 67 8", letters, "a" * 700 + " " + "ab" * 200, "ࡰ\U00010570 \U0001e4f0\U0001f600 中文", wild, "=-" * 300 + "1234567890" * 30, "x  \n\n  y  ",
        "the the the cat cat sat " * 20, "the the the cat cat sat " * 20, "<|endoftext|>", "été \u0000\u0085",
    ]


def check(rows, ranks):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, r in rows:
        ids = enc.encode_ordinary(text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), text
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("slots", [1 << 20, 4])
def test_digests_against_tiktoken(spark, vocabulary, monkeypatch, slots):
    monkeypatch.setattr(bpe.encode, "__defaults__", ("text", "ids", slots))
    docs = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts())], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.digests(docs, vocabulary).collect()}
    check([(t, got[i if i else None]) for i, t in enumerate(texts())], vocabulary.ranks)


def test_most_words_seen_twice_have_a_slot(spark, vocabulary):
    """Of 200 000 words some 2 % share a slot with another; of 2^20 slots it would be 9 %."""
    docs = spark.range(40).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(10000)), lambda i: F.translate((F.col("id") % 20 * 10000 + i).cast("string"), "0123456789", "abcdefghij"))).alias("text"))
    assert bpe.frequent_words(docs, vocabulary).count() > 193_000


def test_ids_and_bytes(spark, vocabulary):
    docs = spark.createDataFrame([(1, "a tale of two tales", "x")], "doc_id long, text string, ids string")
    r = bpe.encode(docs, vocabulary, slots=16).select("*", bpe.decoded(F.col("ids"), vocabulary).alias("raw")).first()
    assert bytes(r.raw) == b"a tale of two tales" and r.doc_id == 1 and len(r.ids) == r.ids.__len__() > 0
    assert bpe.encode(docs.limit(0), vocabulary, slots=16).collect() == []


def test_any_ranks(spark):
    """Ranks that no training would give: merges whose parts rank above them, and the whole word by chunks of a few bytes."""
    rng = random.Random(7)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(60)}
    order = [*{bytes([i]) for i in range(256)}, *sorted(pieces)]
    rng.shuffle(order)
    # tiktoken gives a word that is a piece by itself that one id, so words here are longer than pieces
    vocabulary = bpe.Vocabulary({p: i for i, p in enumerate(order)})
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(8, 200))) for _ in range(60)]
    enc = tiktoken.Encoding("any", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    got = {r.word: r.ids for r in bpe.encoded_words(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary).collect()}
    assert all(got[w] == enc.encode_ordinary(w) for w in words)


def test_vocabularies_are_checked(tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Vocabulary.read(str(tmp_path / "few"))
