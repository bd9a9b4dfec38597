import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import vector_codes
from ledgerlens.llm.vector_codes import product_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, n_parts=16, entries=64, rounds=2):
    """Plain loops over Python integers; rows of one length with distinct ids."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = {r[0]: [math.floor(256 * x) for x in r[1]] for r in kept}
    width = len(kept[0][1]) // n_parts
    part = {(i, p): v[p * width : (p + 1) * width] for i, v in ints.items() for p in range(n_parts)}
    books = [[part[i, p] for i in sorted(ints)[:entries]] for p in range(n_parts)]

    def best(i, p):
        far = [sum((a - b) ** 2 for a, b in zip(part[i, p], e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        at = {k: best(*k)[0] for k in part}
        for p in range(n_parts):
            for e in range(len(books[p])):
                own = [part[i, p] for i in ints if at[i, p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = {i: [best(i, p) for p in range(n_parts)] for i in ints}
    error = {i: sum(f for _, f in v) for i, v in found.items()}
    by_label = {}
    for i, _, label in kept:
        by_label[label] = by_label.get(label, 0) + error[i]
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for e, _ in found[i]), error[i], by_label[label], sha) for i, _, label in kept)


def told(df):
    return sorted(map(tuple, df.collect()))


def vectors(n, dim, seed):
    rng = random.Random(seed)
    return [(i * 3, [rng.choice([rng.gauss(0, 0.1), rng.gauss(0, 3), 0.5, -0.00390625]) for _ in range(dim)], rng.choice([None, 1, 1, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(("n", "dim"), [(300, 32), (20, 16), (1, 48)])
def test_codes_are_those_of_plain_loops(spark, n, dim):
    rows = [(i, [float(x) for x in np.float32(v)], label) for i, v, label in vectors(n, dim, n)]
    assert told(product_codes(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_ties_and_floors(spark):
    """Equal starts leave the later one unused; means of negative sums go down."""
    rows = [(1, [-1 / 256] * 16, 0), (2, [-1 / 256] * 16, 0), (3, [-2 / 256] * 16, 0), (4, [-2 / 256 + 0.001] * 16, None)]
    rows = [(i, v, label) for i, v, label in rows]
    assert told(product_codes(spark.createDataFrame(rows, SCHEMA), entries=2)) == brute(rows, entries=2)


def test_more_rows_than_a_block(spark, monkeypatch):
    rows = [(i, [float(x) for x in np.float32(v)], label) for i, v, label in vectors(200, 16, 9)]
    whole = told(product_codes(spark.createDataFrame(rows, SCHEMA).coalesce(1)))
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    assert told(product_codes(spark.createDataFrame(rows, SCHEMA).coalesce(1))) == whole == brute(rows)


def test_rows_without_a_use(spark):
    bad = [(1, None, 1), (2, [None] + [0.0] * 15, 1), (3, [float("nan")] * 16, None), (4, [0.0] * 15 + [float("inf")], 2), (5, [float("-inf")] + [0.0] * 15, 2)]
    good = [(6, [0.25] * 16, 1), (7, [1.0] * 16, None), (8, [1.0] * 16, None)]
    assert told(product_codes(spark.createDataFrame(bad + good, SCHEMA))) == brute(good)
    assert told(product_codes(spark.createDataFrame(bad, SCHEMA))) == []
    assert told(product_codes(spark.createDataFrame([], SCHEMA))) == []


def test_other_lengths_null_ids_and_repeats(spark):
    good = [(1, [0.25] * 16, 1), (2, [1.0] * 16, 3), (2, [1.0] * 16, 3)]
    odd = [(0, [], 5), (3, [1.0] * 32, 1), (None, [1.0] * 16, 3), (4, [1e30] * 16, 9)]
    got = product_codes(spark.createDataFrame(good + odd, SCHEMA).withColumn("_label", F.lit(1)).withColumn("code", F.lit(1)))
    rows = sorted(map(tuple, got.drop("codebooks_sha256").collect()), key=str)
    assert len(rows) == 7
    by = {r[0]: r for r in rows}
    assert by[0][1:] == (None, None, None) and by[3][1:3] == (None, None)
    assert by[1][1] == "00" * 16 and by[2][1] == by[None][1] and by[4][2] == 0  # held to the bound, and an entry of its own


def test_one_entry_at_most_256(spark):
    with pytest.raises(ValueError):
        product_codes(spark.createDataFrame([], SCHEMA), entries=300)
