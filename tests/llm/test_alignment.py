import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import alignment
from ledgerlens.llm.alignment import CountShards, align_tokenizers, aligned_chunks, op12_token_alignment, pair_counts
from ledgerlens.llm.common import id_text
from tests.llm.cases import ODD, clashing, docs

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(libraries, rows):
    """Whole texts by the libraries, every pair of tokens compared by its bytes' ranges."""
    a, b = libraries
    from tokenizers.pre_tokenizers import ByteLevel

    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printed} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printed)}
    assert set(byte) == set(ByteLevel.alphabet())
    found = []
    for doc_id, text, *_ in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        spans = []
        for data in (bytes_a, bytes_b):
            at, own = 0, []
            for d in data:
                own.append((at, at + len(d)))
                at += len(d)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for start, end in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, own) if start <= s and e <= end) for ids, own in zip((ids_a, ids_b), spans)))
        links, first = [], 0
        for i, (s, e) in zip(ids_a, spans[0]):
            while spans[1][first][1] <= s:
                first += 1
            j = first
            while j < len(ids_b) and spans[1][j][0] < e:
                links.append((i, ids_b[j]))
                j += 1
        found.append((doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for f in found for p in set(f[4]))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    return sorted(((d, na, nb, g, len(ls), sum(count[x] == top[x[0]] for x in ls), sum(count[x] for x in ls), sha) for d, na, nb, g, ls, sha in found), key=str)


def told(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def many(n=150):
    rng = random.Random(4)
    parts = ["the", " ", " ", " ", "  ", "\n", "\t", "é", "ß", "don't", "12", "...", "\x00", "▁", "𝔘", "ª", "<s>", "<|endoftext|>", "ing", "station", "A", "é", "梦", "の", "\x1c", "᠎", " ", "unbelievable", " Nächte", " eau"]
    return [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(40))), "en", "a", 1) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_rows_against_brute_force(spark, libraries, monkeypatch, small):
    if small:  # long texts in slices, many chunks, sums that are sent on early
        for name, value in (("SLICE", 40), ("CHUNK_WORDS", 30), ("CHUNK_PLACES", 60), ("PAIRS", 64)):
            monkeypatch.setattr(alignment, name, value)
    rows = [*ODD, *many(), (1000, "a ▁ b", "x", "x", 0), (1001, " lead", "x", "x", 0), (1002, "trail \n", "x", "x", 0), (1003, "  ", "x", "x", 0)]
    assert told(align_tokenizers(docs(spark, rows))) == brute(libraries, rows)


def test_rows_with_other_columns_and_none(spark, libraries):
    wide = clashing(docs(spark)).withColumn("n_a", F.lit("x")).withColumn("pair", F.lit(1))
    assert told(align_tokenizers(wide)) == brute(libraries, ODD)
    assert told(align_tokenizers(docs(spark).limit(0))) == []
    assert align_tokenizers(docs(spark).limit(0)).columns == COLUMNS
    blank = [(1, None, None, None, None), (2, "", None, None, None)]
    assert told(align_tokenizers(docs(spark, blank))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_count_shards_mapped_or_sent(spark):
    """Counts are those of plain counting, over shards that a pair's A id crosses, and alike by both ways to the executors."""
    rows = many(60)
    chunks = aligned_chunks(id_text(docs(spark, rows, 5)))
    counts = pair_counts(chunks)
    plain = Counter()
    for r in chunks.collect():
        vocab, holders = np.frombuffer(r["vocab"], "<i8"), np.frombuffer(r["holders"], "<i8")
        plain.update(dict(zip(vocab.tolist(), holders.tolist())))
    assert {r["pair"]: r["docs"] for r in counts.collect()} == plain
    mapped, sent = CountShards(counts), CountShards(counts, mounted=False)
    assert len(mapped.shards) > 1 and (mapped.highest == sent.highest).all()
    asked = np.array(sorted([*plain, 0, 5, 7 << 32, max(plain) + 1]), np.int64)
    for shards in (mapped, sent):
        assert CountShards.look_up(shards.open(), asked).tolist() == [plain.get(p, 0) for p in asked.tolist()]
    assert isinstance(mapped.open()[0][0], np.memmap)


def test_query(spark, libraries, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert told(op12_token_alignment(spark, str(tmp_path))) == brute(libraries, ODD)
