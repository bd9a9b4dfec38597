import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import wavelet
from ledgerlens.llm.decontaminate import word_hashes
from ledgerlens.llm.wavelet import END_ID, Encoder, WaveletMatrix, matrix, token_shards, write_shards
from tests.llm.cases import ODD, clashing, docs, rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 2), (513, 3), (5000, 50257), (1025, 1 << 16)])
def test_matrix_is_the_sequence(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, top, n) * (rng.random(n) < 0.7)).astype(np.uint16)
    m = WaveletMatrix.build(ids, 16)
    assert (m.decode() == ids).all()
    for i in rng.integers(0, n, 30).tolist() if n else []:
        assert m.access(i) == ids[i]
        v = int(ids[i])
        assert m.rank(v, i) == (ids[:i] == v).sum() and m.count(v) == (ids == v).sum()
        k = int((ids[:i] == v).sum())
        assert m.select(v, k) == i
    assert m.count(65535 if top < 65535 else 70000) == 0 and m.select(12345, n) == -1


ODD_TEXTS = ["", " ", "a  b", " a b", "a b ", "a  b", "x\n y", "don't  two <|endoftext|> x", "᠎ a b", "é è\tü  \n\n z", "a'S b's", "'s t", "I'll we've 12 34a b1c ...!!! 　x", "a \x1f b", "𝔘𝔫𝔦 code 数字 ١٢ x²", "then.\nNext", "x\x00y z\x7f"]


def test_encoder_is_the_tokenizer(tokenizer):
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", "\t", "é", "ß", "don't", "'ll", "12", "...", " ", " ", "\x1c", "𝔘", "ǅ", "ª", "<|endoftext|>", "'", "A", "z9", "\r\n"]
    texts = ODD_TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    e = Encoder()
    assert [np.frombuffer(e(t), e.dtype).tolist() for t in texts] == expected
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch(texts)] == expected


def test_caches_that_fill_up_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet, "CACHE", 3)
    e = Encoder()
    texts = [f"word{i % 7} some other{i}" for i in range(50)]
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch(texts)] == [tokenizer.encode(t).ids for t in texts]


def test_pieces_of_earlier_batches_are_not_encoded_again(tokenizer, monkeypatch):
    texts = ["A word, (another) word.\nThe é2's end x12-y\nz", "don't 'tis .'s \n's y " + "long" * 20, "word another, The"]
    want = [tokenizer.encode(t).ids for t in texts]
    e = Encoder()
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch(texts)] == want
    monkeypatch.setattr(e, "_piece", lambda *_: pytest.fail("encoded again"))
    monkeypatch.setattr(e, "_word", lambda *_: pytest.fail("encoded again"))
    plain = [0, 2]  # white space touches a piece of the other
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch([texts[i] for i in plain])] == [want[i] for i in plain]


@pytest.mark.parametrize(("pieces", "bits", "probes"), [(20, 22, 8), (10**6, 3, 1), (50, 4, 3)])
def test_kept_pieces_that_are_full_or_dropped_change_nothing(tokenizer, monkeypatch, pieces, bits, probes):
    for name, value in (("PIECES", pieces), ("TABLE_BITS", bits), ("PROBES", probes)):
        monkeypatch.setattr(wavelet, name, value)
    rng = random.Random(4)
    parts = ["the", " ", " ", " ", "\n", "\n\n", "é", "don't", "'s", "'", "12", "...", ",", "A", "_", "²", "x" * 70, "y" * 64, "<|endoftext|>"]
    e = Encoder()
    for _ in range(20):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(20)]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_whose_polynomial_hashes_collide(tokenizer):
    """Thue-Morse words: equal under any polynomial modulo 2**64, and with the same letters."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [f"x {one} {two}", f"{two} {one}", f"y {one}"]
    e = Encoder()
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch(texts)] == [tokenizer.encode(t).ids for t in texts]
    hashed, _ = word_hashes(" ".join(texts).encode())
    assert len(set(hashed.tolist())) == 4


def test_pieces_are_compared_by_their_bytes(tokenizer, monkeypatch):
    words = ["a", "b", "abcdefgh", "abcdefgi", "abcdefghi", "abcdefghj", "y" * 64, "y" * 63 + "z", "y" * 70, "y" * 69 + "z"]
    texts = [f"q {x} {y} {x}" for x in words for y in words]

    def lengths_only(data):  # the weakest hash there is
        _, start = word_hashes(data)
        return np.diff(np.append(start, len(data) + 1)).astype(np.uint64), start

    monkeypatch.setattr(wavelet, "word_hashes", lengths_only)
    e = Encoder()
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch(texts)] == [tokenizer.encode(t).ids for t in texts]


def test_long_texts_are_encoded_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet, "SLICE", 50)
    rng = random.Random(3)
    parts = ["the", " ", "  ", "\n", "é", "don't", "12", " <|endoftext|>", "᠎", "A", " 数字", " ünï"]
    texts = ["".join(rng.choice(parts) for _ in range(400)) for _ in range(20)] + ["word " * 100, "x" * 500]
    e = Encoder()
    assert [np.frombuffer(e.long(t), e.dtype).tolist() for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def expected(table, tokenizer):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    hashes = {r.t: r.h for r in spark.createDataFrame([(r[1] or "",) for r in table], "t string").select("t", F.xxhash64("t").alias("h")).collect()} if table else {}
    out, at = [], 0
    for r in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""])):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, END_ID]
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 22, 50])
def test_shards_give_back_every_document(spark, tokenizer, size):
    assert rows(token_shards(clashing(docs(spark)), shard_tokens=size)) == expected(ODD, tokenizer)


def test_many_small_documents(spark, tokenizer):
    rng = random.Random(2)
    table = [(i, " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randrange(9))), "en", "s", 1) for i in rng.sample(range(10**6), 300)]
    assert rows(token_shards(docs(spark, table), shard_tokens=64)) == expected(table, tokenizer)
    assert token_shards(docs(spark, [])).count() == 0


def test_a_shard_answers_queries_from_its_file(spark, tokenizer):
    text = "the cat and the dog and the end"
    row = write_shards(docs(spark, [(1, text, "en", "s", 1)])).first()
    ids = [*tokenizer.encode(text).ids, END_ID]
    m = matrix(row)
    the = tokenizer.encode(" the").ids[0]
    assert [m.access(i) for i in range(m.n)] == ids and m.count(the) == ids.count(the)
    assert [m.select(the, k) for k in range(m.count(the))] == [i for i, v in enumerate(ids) if v == the]
