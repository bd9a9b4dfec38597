import random
import re
import time

import pytest

import corpus_pipeline
from ledgerlens.llm import decontaminate
from ledgerlens.llm.decontaminate import MASKS, drop_contaminated, fold, overlaps, seeds, word_hashes
from tests.llm.cases import clashing, docs, rows


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(table, items, min_words=12):
    """The rule itself: over all stretches of every alignment that shares a seed, the longest of which 80 % agree."""
    best = {}
    for doc_id, text, *_ in table:
        w = words(text)
        for item_id, item in items:
            i = words(item)
            for offset in range(-len(i) + 1, len(w)):
                first = max(0, offset)
                same = [w[at] == i[at - offset] for at in range(first, min(len(w), offset + len(i)))]
                if not any(all(same[p + q] for q, c in enumerate(m) if c == "1") for m in MASKS for p in range(len(same) - len(m) + 1)):
                    continue
                least = max(5, min(min_words, len(i)))
                found = [(b - a, sum(same[a:b]), -a) for a in range(len(same)) for b in range(a + least, len(same) + 1) if 5 * sum(same[a:b]) >= 4 * (b - a)]
                if found:
                    n, ok, a = max(found)
                    key = (ok, -n, a - first)
                    best[doc_id, item_id] = max(key, best.get((doc_id, item_id), key))
    return sorted(((d, i, -k[1], k[0], -k[2]) for (d, i), k in best.items()), key=str)


def make(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 50)))) for i in range(12)]
    table = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            passage = rng.choice(items)[1].split()
            for at in range(rng.randrange(7), len(passage), rng.choice([5, 7, 50])):
                passage[at] = rng.choice([word(), passage[at].upper()])
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage[rng.randrange(3) :]
        table.append((d, rng.choice([" ", ", ", "\n"]).join(text), "en", "s", 1))
    return table, items


@pytest.mark.parametrize("seed", [1, 2, 3, 5, 6])
def test_overlaps_are_brute_force(spark, seed):
    table, items = make(seed)
    found = overlaps(docs(spark, table), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == brute(table, items)


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    table = [(1, None, None, None, None), (2, "", "", "", 0), (None, f"x {passage.upper()}!", None, None, None), (3, passage, None, None, 1), (3, passage, None, None, 1), (4, "word " * 3000, "en", "s", 1)]
    items = [(7, passage), (8, None), (None, passage), (9, ""), (10, "too short")]
    found = overlaps(clashing(docs(spark, table)), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == sorted([(None, 7, 13, 13, 1), (None, None, 13, 13, 1), (3, 7, 13, 13, 0), (3, None, 13, 13, 0)], key=str)


def test_empty_tables(spark):
    table, items = make(4)
    none = spark.createDataFrame([], "item_id long, text string")
    assert overlaps(docs(spark, table), none).count() == 0
    assert overlaps(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_long_texts_are_cut_into_slices_that_overlap(spark, monkeypatch):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(4000))
    cuts = [text.find(" ", i) for i in (700, 9000, 21000)]
    for c in reversed(cuts):
        text = f"{text[:c]} {passage}{text[c:]}"
    monkeypatch.setattr(decontaminate, "SLICE", 4000)
    items = [(1, passage)]
    found = rows(overlaps(docs(spark, [(1, text, "en", "s", 1)], 1), spark.createDataFrame(items, "item_id long, text string")))
    first = text.split().index("p0")
    assert found == [(1, 1, 30, 30, first)]


def test_word_hashes_do_not_depend_on_place():
    a, _ = word_hashes(fold("x alpha beta alpha"))
    b, start = word_hashes(fold("alpha, BETA"))
    assert a[1] == a[3] == b[0] and a[2] == b[1] and start.tolist() == [0, 7]
    assert len(word_hashes(b"  ")[0]) == 0
    assert len(seeds(a, 0)) == 0


def test_word_hashes_in_parts_are_the_same(monkeypatch):
    rng = random.Random(3)
    data = " ".join("x" * rng.randrange(30) for _ in range(200)).encode() + b" " + b"y" * 200 + b"  end"
    whole = word_hashes(data)
    for part in (1, 7, 64):
        monkeypatch.setattr(decontaminate, "PART", part)
        h, start = word_hashes(data)
        assert h.tolist() == whole[0].tolist() and start.tolist() == whole[1].tolist()


def test_drop_contaminated_keeps_columns_and_clean_rows(spark):
    table, items = make(5)
    kept = drop_contaminated(docs(spark, table), spark.createDataFrame(items, "item_id long, text string"))
    bad = {r[0] for r in brute(table, items)}
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in table if r[0] not in bad)


def test_twelve_exact_words_count_whatever_follows(spark):
    """12 exact words, 10 others, 11 exact ones: the alignment as a whole agrees in 0.70 only."""
    passage = [f"p{i}" for i in range(33)]
    text = [w if i < 12 or i >= 22 else f"x{i}" for i, w in enumerate(passage)]
    twice = [*text, *(f"y{i}" for i in range(300)), *passage[:12]]
    table, items = [(1, " ".join(text), "en", "s", 1), (2, " ".join(twice), "en", "s", 1), (3, " ".join(text[24:]), "en", "s", 1)], [(7, " ".join(passage))]
    found = rows(overlaps(docs(spark, table), spark.createDataFrame(items, "item_id long, text string")))
    assert found == brute(table, items)
    assert [r[0] for r in found] == [1, 2]


def test_one_word_over_and_over(spark):
    table, items = [(1, "buffalo " * 700, "en", "s", 1), (2, "buffalo " * 11, "en", "s", 1)], [(7, "buffalo " * 30), (8, "buffalo " * 6)]
    found = overlaps(docs(spark, table), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == brute(table, items)


@pytest.mark.parametrize(("piece", "slice_size"), [(4096, 1 << 20), (100, 1 << 20), (64, 3000)])
def test_a_long_passage_is_reported_whole(spark, monkeypatch, piece, slice_size):
    """An item of 3,000 words, verbatim after 50 others and once more with words replaced, whatever the pieces and slices."""
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    monkeypatch.setattr(decontaminate, "SLICE", slice_size)
    rng = random.Random(8)
    item = [f"p{rng.randrange(10**6)}" for _ in range(3000)]
    worn = [w if rng.random() < 0.9 else "x" for w in item]
    table = [(1, " ".join([f"o{i}" for i in range(50)] + item + ["after"] * 70), "en", "s", 1), (2, " ".join(["before"] * 300 + worn), "en", "s", 1)]
    found = rows(overlaps(docs(spark, table), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[1500:1530]))], "item_id long, text string")))
    same = sum(a == b for a, b in zip(item, worn))
    assert found[0] == (1, 7, 3000, 3000, 50) and found[1] == (1, 8, 30, 30, 1550)
    assert found[2][:2] == (2, 7) and found[2][3] == same and 2990 <= found[2][2] <= 3000


def test_one_word_over_and_over_in_long_texts(spark):
    """200,000 times a word against 20 items of 500: no row for each pair of places."""
    began = time.time()
    items = [(i, "buffalo " * 500) for i in range(20)]
    found = rows(overlaps(docs(spark, [(1, "buffalo " * 200_000, "en", "s", 1)]), spark.createDataFrame(items, "item_id long, text string")))
    assert found == sorted([(1, i, 500, 500, 0) for i in range(20)], key=str)
    assert time.time() - began < 120


def test_rows_whose_first_hashes_collide(spark, monkeypatch):
    from pyspark.sql import functions as F

    keys = decontaminate.row_keys
    monkeypatch.setattr(decontaminate, "row_keys", lambda *a: (F.lit(5).cast("long"), keys(*a)[1]))
    passage = " ".join(f"p{i}" for i in range(20))
    kept = drop_contaminated(docs(spark, [(1, passage, "en", "s", 1), (2, "clean", "en", "s", 1)]), spark.createDataFrame([(7, passage)], "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [2]


def test_rows_go_by_their_own_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    table = [(None, passage, "en", "s", 1), (None, "clean", "en", "s", 1), (3, f"x {passage}", "en", "s", 1), (3, "also clean", "en", "s", 1), (4, None, None, None, None)]
    kept = drop_contaminated(docs(spark, table), spark.createDataFrame([(7, passage)], "item_id long, text string"))
    assert sorted(map(str, (r.text for r in kept.collect()))) == ["None", "also clean", "clean"]


def test_query_finds_exact_words_before_a_part_that_agrees_less(spark, tmp_path):
    """15 exact words, then 30 with every third replaced: 35 of 44 agree, which is less than 0.8, but 15 of 15 do."""
    passage = [f"p{i}" for i in range(45)]
    text = " ".join(w if i < 15 or i % 3 < 2 else f"x{i}" for i, w in enumerate(passage))
    table, items = [(1, text, "en", "s", 1), (2, "nothing of it", "en", "s", 1)], [(7, " ".join(passage))]
    docs(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(decontaminate.op2_spaced_seeds(spark, str(tmp_path))) == brute(table, items) != []
    kept = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs(spark, table), str(tmp_path))
    assert [r.doc_id for r in kept.collect()] == [2]
