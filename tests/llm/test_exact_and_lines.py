import hashlib
import random
from collections import defaultdict

import pytest

from ledgerlens.llm.common import attach
from ledgerlens.llm.exact_dedup import by_filters, drop_duplicates, exact_dedup, possibly_repeated, repeated_cells, text_hash
from ledgerlens.llm.line_dedup import line_dedup
from tests.llm.cases import ODD, SCHEMA, clashing, docs, rows


def brute_exact(table):
    groups = defaultdict(list)
    for r in table:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        used = False
        for i in ids:
            kept = i == best and not used
            used |= kept
            out.append((i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def many(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", f"t{rng.randrange(60)}", f"u{i}"]), "en", "s", 1) for i in range(n)]


@pytest.mark.parametrize("table", [ODD, many(1), []])
@pytest.mark.parametrize("blocks", [1, 64])
def test_exact_dedup_is_brute_force(spark, table, blocks):
    found = exact_dedup(docs(spark, table), bits_per_row=16 if blocks == 64 else 1, max_blocks=blocks)
    assert rows(found) == brute_exact(table)


def test_filter_clears_single_rows_beyond_its_bound(spark):
    """20,000 rows against a filter of 32,768 bits: ranges of hashes go one after the other, each with a filter of its own."""
    from pyspark.sql import functions as F

    table = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 10 = 0, concat('copy', id % 1000), concat('single', id)) AS text")
    hashed = table.select("doc_id", "text", text_hash(F.col("text")).alias("hash"))
    told = by_filters(hashed, 20_000, 16, 1)
    assert told.count() == 20_000
    single = told.where("text like 'single%'")
    assert single.where("maybe").count() < 0.02 * single.count() and told.where("text like 'copy%' and not maybe").count() == 0
    # one filter of that size for all rows would be full
    assert possibly_repeated(hashed, *repeated_cells(hashed, 20_000, 16, 1)).where("maybe and text like 'single%'").count() > 0.2 * single.count()
    found = exact_dedup(table, max_blocks=1)
    assert found.count() == 20_000 and found.where("group_size = 20").count() == 2000 and found.where("kept").count() == 18_100


def test_other_columns_do_not_matter(spark):
    assert rows(exact_dedup(clashing(docs(spark)))) == brute_exact(ODD)


def test_drop_duplicates_keeps_one_row_of_each_text(spark):
    table = many(2)
    kept = drop_duplicates(docs(spark, table))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute_exact(table) if r[3])


def test_attach_deals_out_hot_keys(spark):
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 700)) AS k")
    groups = left.groupBy("k").agg({"id": "max", "*": "count"}).toDF("k", "size", "top") if False else left.groupBy("k").agg({"id": "max"}).join(left.groupBy("k").count(), "k").toDF("k", "top", "size")
    out = attach(left, groups, "k", "size", 3000, ["id"])
    expected = left.join(groups, "k").select("id", "k", "top", "size")
    assert rows(out.select("id", "k", "top", "size")) == rows(expected)


BLANKS = " \t\n\x0b\x0c\r"


def brute_lines(table, min_chars, min_docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANKS).translate(lower)
    ident = lambda i: -(2**63) if i is None else i
    held = defaultdict(set)
    for r in table:
        for line in (r[1] or "").split("\n"):
            held[key(line)].add(ident(r[0]))
    out = []
    for r in table:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != ident(r[0]))]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lines(seed):
    rng = random.Random(seed)
    pool = [f"Shared line number {i} with enough text in it" for i in range(8)] + ["é" * 5, "", "  "]
    return [(i % 50, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", "\r"]) for _ in range(rng.randrange(12))), "en", "s", 1) for i in range(60)]


@pytest.mark.parametrize("table", [ODD, lines(3), []])
@pytest.mark.parametrize(("chars", "least"), [(40, 5), (5, 2)])
def test_line_dedup_is_brute_force(spark, table, chars, least):
    assert rows(line_dedup(docs(spark, table), min_chars=chars, min_docs=least)) == brute_lines(table, chars, least)


def test_line_dedup_with_clashing_columns(spark):
    assert rows(line_dedup(clashing(docs(spark)), min_chars=5, min_docs=2)) == brute_lines(ODD, 5, 2)


def test_texts_that_lose_nothing_pass_straight_through(spark):
    """Of 400 texts 20 share a line."""
    table = [(i, f"own {i} line\n" + ("a line that is long enough to be dropped if it is shared\n" if i % 20 == 0 else "") + "end", "en", "s", 1) for i in range(400)]
    found = line_dedup(docs(spark, table))
    assert sorted((r.doc_id, r.n_dropped) for r in found.collect() if r.n_dropped) == [(i, 1) for i in range(0, 380, 20)]
    assert found.count() == 400 and {r.text for r in found.where("doc_id = 380").collect()} == {table[380][1]}
