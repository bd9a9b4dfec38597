import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from ledgerlens.llm import common, simhash
from ledgerlens.llm.graph import components
from ledgerlens.llm.simhash import exact_bands, fingerprint, keep_one_of_each, link_bands, near_duplicates
from tests.llm.cases import ODD, clashing, docs, rows


def brute_fingerprint(text, k=4):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(lower)) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(table, radius=4):
    prints = [brute_fingerprint(r[1]) for r in table]
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(table):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(table)), key=str)


def near(seed, n=120):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 400))) for _ in range(12)]
    out = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        out.append((i, " ".join(words), "en", "s", 1))
    return out


@pytest.mark.parametrize("table", [ODD, near(1), near(2), []])
def test_near_duplicates_are_brute_force(spark, table):
    assert rows(near_duplicates(docs(spark, table))) == brute(table)


def test_other_columns_do_not_matter(spark):
    assert rows(near_duplicates(clashing(docs(spark)))) == brute(ODD)


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    monkeypatch.setattr(simhash, "SLICE", 333)
    assert int(fingerprint(text)[0]) == brute_fingerprint(text)


@pytest.mark.parametrize(("bits", "radius", "n"), [(64, 4, 10**5), (64, 4, 10**10), (64, 8, 10**6)])
def test_exact_bands_miss_nothing(bits, radius, n):
    bands = exact_bands(bits, radius, n)
    rng = random.Random(0)
    for _ in range(300):
        flipped = set(rng.sample(range(bits), radius))
        assert any(not flipped & set(b) for b in bands)


@pytest.mark.parametrize("ball", [40, 900, 3000])
def test_tiles_find_every_link(ball):
    """A dense group, outliers and random rows under one key: the same components as all pairs."""
    rng = np.random.default_rng(ball)
    center = rng.integers(0, 2**63, dtype=np.uint64)
    f = np.full(ball, center)
    for _ in range(3):
        f ^= np.uint64(1) << rng.integers(0, 64, ball).astype(np.uint64)
    f = np.unique(np.concatenate([f, rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    key = (np.arange(len(f)) % 3).astype(np.int64)
    u, v = link_bands(key, np.bitwise_count(f).astype(np.int32), f[:, None], f.view(np.int64), 4)
    root = {int(x): int(x) for x in f.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        root[find(a)] = find(b)
    mine = {x: find(x) for x in root}
    labels = np.arange(len(f))
    for k in range(3):
        at = np.flatnonzero(key == k)
        close = np.bitwise_count(f[at, None] ^ f[None, at]) <= 4
        while True:
            low = np.where(close, labels[at][None, :], len(f)).min(1)
            if (low == labels[at]).all():
                break
            labels[at] = low
    values = f.view(np.int64).tolist()
    groups = lambda names: sorted(sorted(values[i] for i in range(len(f)) if names[i] == g) for g in set(names))
    assert groups(labels.tolist()) == groups([mine[x] for x in values])


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (5, 4)], "u long, v long")
    found = {r.node: r.root for r in components(chain).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(chain.where("u < 0")).count() == 0


def test_wide_fingerprints_find_texts_at_similarity_08(spark):
    rng = random.Random(5)
    table, pairs = [], 0
    for i in range(0, 240, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 600))]
        edited = list(words)
        for at in range(0, len(words), 50):  # one word of 50: five shingles of 50, similarity 0.82
            edited[min(len(words) - 1, at + rng.randrange(50))] = f"x{rng.randrange(10**6)}"
        table += [(i, " ".join(words), "en", "s", 1), (i + 1, " ".join(edited), "en", "s", 1)]
        pairs += 1
    kept = {r.doc_id for r in keep_one_of_each(docs(spark, table)).collect()}
    assert {i for i in range(0, 240, 2)} <= kept
    assert sum(i in kept for i in range(1, 240, 2)) <= 0.1 * pairs


def test_rows_go_by_their_own_text(spark):
    """Ids that repeat with other texts, and null ids: only near copies and repeated rows go."""
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))
    a, b, c, d = text(), text(), text(), text()
    near = lambda t: t.replace(t.split()[50], "other")
    table = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, near(b), "en", "s", 1), (None, c, "en", "s", 1), (None, near(c), "en", "s", 1), (None, near(a), "en", "s", 1), (4, d, "en", "s", 1), (4, d, "fr", "s", 2)]
    kept = keep_one_of_each(docs(spark, table)).collect()
    assert sorted((r.doc_id or 0, r.text in (a, b, d)) for r in kept) == [(0, False), (1, True), (1, True), (4, True)]


def test_rows_and_sets_whose_first_hashes_collide(spark, monkeypatch):
    """Hashes of one bit: nothing is lost, and only copies go."""
    monkeypatch.setattr(simhash, "NODE_MASK", 1)
    base = " ".join(f"w{i}" for i in range(40))
    table = [(i, " ".join(f"{i}x{k}" for k in range(30)), "en", "s", 1) for i in range(12)] + [(50, base, "en", "s", 1), (51, base, "en", "s", 1), (52, base + " more", "en", "s", 1), (53, "short", "en", "s", 1), (53, "other", "en", "s", 1)]
    kept = simhash.keep_one_of_each(docs(spark, table))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((r[0], r[1]) for r in table if r[0] not in (51, 52))


def test_centre_of_a_star_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_HOT_GROUPS", 3)
    star = spark.range(1, 900).selectExpr("cast(0 as long) u", "id v").unionByName(spark.range(900, 1000).selectExpr("id u", "id + 1000 v"))
    found = {r.node: r.root for r in components(star).collect()}
    assert found == {**dict.fromkeys(range(900), 0), **{i + d: i for i in range(900, 1000) for d in (0, 1000)}}


def test_rows_without_id_stay(spark):
    kept = keep_one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns
    assert [r.text for r in kept.collect() if r.doc_id is None] == [ODD[7][1]]  # the empty one is like that of id 3
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 7, 8, 9]


def brute_similar(table, similarity=0.8):
    """(ids kept, similar pairs) over all pairs of texts by their sets of five-word shingles."""
    split = [(r[1] or "").lower().split() for r in table]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    pairs = [(i, j) for j in range(len(table)) for i in range(j) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    root = list(range(len(table)))
    for i, j in pairs * 3:  # ids ascend, and no chain here is long
        root[i] = root[j] = min(root[i], root[j])
    return {table[i][0] for i in range(len(table)) if root[i] == i}, pairs


def edited(seed):
    """Families of a text and copies of it with one word of every 20 to 80 replaced: similarity 0.6 to 0.9."""
    rng = random.Random(seed)
    table = []
    for i in range(0, 320, 4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(80, 400))]
        table.append((i, " ".join(words), "en", "s", 1))
        for k in range(1, 4):
            copy, step = list(words), rng.randrange(20, 80)
            for at in range(rng.randrange(step), len(words), step):
                copy[at] = f"x{rng.randrange(10**6)}"
            table.append((i + k, " ".join(copy), "en", "s", 1))
    return table


def test_pipeline_stage_is_brute_force_on_both_sides_of_08(spark):
    table = edited(3)
    kept, pairs = brute_similar(table)
    assert len(pairs) > 100 and len(kept) > 100
    found = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs(spark, table), "").collect()}
    assert found == kept


def test_blocks_of_a_dense_group_lose_no_link(spark, monkeypatch):
    """A chain of texts, each similar to the next only, among others that are not; more blocks than one."""
    monkeypatch.setattr(simhash, "BLOCK", 700)
    monkeypatch.setattr(simhash, "COLUMNS", 64)
    rng = random.Random(4)
    words, table = [f"w{i}" for i in range(100)], []
    for i in range(40):
        if i:
            words[rng.randrange(100)] = f"x{i}"
            if i % 10 == 0:  # a break: less than 0.8
                for at in range(0, 100, 12):
                    words[at] = f"y{i}-{at}"
        table.append((i, " ".join(words), "en", "s", 1))
    kept, pairs = brute_similar(table)
    assert len(pairs) > 40 and len(kept) >= 4
    assert {r.doc_id for r in keep_one_of_each(docs(spark, table)).collect()} == kept


def test_common_counts_are_those_of_sets(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 5, 30, 30, 200)]
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in sets[2:]] for x in sets]
    assert simhash.common_counts(sets, sets[2:]).tolist() == want
    assert simhash.common_counts([sets[0]], [sets[0]]).tolist() == [[0]]


def test_similarity_takes_odd_rows(spark):
    kept = corpus_pipeline.drop_near_copies(spark, clashing(docs(spark)), "")
    assert kept.columns == clashing(docs(spark)).columns
    assert [r.text for r in kept.collect() if r.doc_id is None] == [ODD[7][1]]  # the empty one is like that of id 3
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 7, 8, 9]
    assert corpus_pipeline.drop_near_copies(spark, docs(spark, []), "").count() == 0
