import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerlens.llm import pieces
from ledgerlens.llm.pieces import MARK, PieceEncoder, decode, encode, op13_piece_encoding
from tests.llm.cases import ODD, clashing, docs


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def own():
    return PieceEncoder()


def texts():
    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "\t", "é", "ß", "don't", "12", "...", "\x00", "▁", "𝔘", "ª", "<s>", "</s>", "<0x41>", "ing", "station", "A", "é", "梦", "の", "한국", "☃", "​", "xx", "er", "    ", "unbelievable", "�"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(1500)]
    made += ["".join(rng.choice("abcdefghij ▁eeeaaa  tions") for _ in range(rng.randrange(200))) for _ in range(800)]
    return made + [c * k for c in (" ", "x", "▁", "梦", "☃", "ab", "  a") for k in (0, 1, 2, 3, 15, 16, 17, 33, 500)]


def test_encoding_is_the_librarys(library, own):
    made = texts()
    expected = library.encode(made)
    assert [x.tolist() for x in own.batch(made)] == expected
    assert [x.tolist() for x in own.batch(made)] == expected  # by words that are known now


def test_every_word_is_found_by_backtracking_and_by_merging(library, own):
    rng = random.Random(2)
    words = [MARK + "".join(rng.choice("aeinorstlé梦☃-.") for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    for w in words:
        by_merging = [i for p in own.merged(w) for i in ([own.id[p]] if p in own.id else [own.bytes[b] for b in p.encode()])]
        assert own.backtrack(w) == by_merging == library.encode(w[1:])


def test_neighbours_that_do_not_fit_are_taken_back(own):
    """The longest matches alone are wrong for some words, so pieces are taken back and places marked."""
    plain = sum([p for _, (p, _) in own.automaton.iter_long(MARK + w)] != own.backtrack(MARK + w) for w in "dining tocking whering eauouon unhappiness bookkeeping".split())
    assert plain


def test_decoding_is_the_librarys(library, own):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 13, 200, 130, rng.randrange(3, 259), rng.randrange(259, 32000), 29871]) for _ in range(rng.randrange(9))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids)
    for t in texts()[::5]:
        assert own.decode(np.array([*library.encode(t), 2], np.int64)) == library.decode(library.encode(t))


def test_what_is_forgotten_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    monkeypatch.setattr(pieces, "PAIRS", 2)
    monkeypatch.setattr(pieces, "WORDS", 2)
    e, made = PieceEncoder(), texts()[:300]
    assert [x.tolist() for at in range(0, 300, 7) for x in e.batch(made[at : at + 7])] == library.encode(made)


def expected(library, rows):
    found = []
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or ""), 2]
        found.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize("slice_size", [1 << 22, 64])
def test_rows(spark, library, monkeypatch, slice_size):
    """Odd rows, in slices, and texts that are longer than one: cut only between words."""
    monkeypatch.setattr(pieces, "SLICE", slice_size)
    rows = [*ODD, (20, "tail with blanks   ", "en", "a", 1), (21, "a" * 200 + " b " + "  c" * 50 + " end", "en", "a", 1)]
    for df in (docs(spark, rows), clashing(docs(spark, rows)).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))):
        told = decode(encode(df))
        assert told.columns == ["doc_id", "ids", "decoded"]
        got = told.select("doc_id", F.size("ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256), F.sha2("decoded", 256))
        assert sorted(map(tuple, got.collect()), key=str) == expected(library, rows)
    assert encode(docs(spark, rows).limit(0)).count() == 0


def test_query(spark, library, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op13_piece_encoding(spark, str(tmp_path)).collect()), key=str) == expected(library, ODD)


def test_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [2], "z")], "doc_id long, ids array<int>, decoded string")
    assert sorted(map(tuple, decode(rows).collect())) == [(1, None, None), (2, [], ""), (3, [2], "")]
