"""SimHash near-duplicates: fingerprints, tiled exact comparison, components."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, id_text, materialise, table
from ledgerlens.llm.graph import components

SEED = 42
#: Shingles hashed at a time, and rows of bands compared at a time in a task.
SLICE, CHUNK = 1 << 15, 400_000
#: Set values of a block of a candidate group, about, and columns of the matrices by which two blocks are compared.
BLOCK, COLUMNS = 1 << 15, 4096
#: Odd constants that derive further hash words from the first.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, repeats included, in slices of bounded length."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, both know ASCII only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), SLICE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + SLICE], ends[i : i + SLICE], strict=True)], np.uint64)


def _ones(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many of the hashes set each bit of `words` 64-bit words."""
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), SLICE):
        h = hashes[i : i + SLICE]
        for w in range(words):
            x = h
            if w:  # a mixed copy of the hash, as good as another seed
                x = (h ^ (h >> np.uint64(31))) * np.uint64(MIX[w % len(MIX)])
                x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[(w + 1) % len(MIX)])
                x ^= x >> np.uint64(32)
            bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts[64 * w : 64 * w + 64] += bits.sum(0, dtype=np.int64)
    return counts


def fingerprint(text: str, shingle: int = 4, words: int = 1) -> np.ndarray:
    """`words` 64-bit words; a bit is 1 if set in over half the hashes. Without any word of text: zero."""
    counts, n = np.zeros(64 * words, np.int64), 0
    for h in shingle_hashes(text, shingle):
        n += len(h)
        counts += _ones(h, words)
    return np.packbits(counts * 2 > n).view(">u8").astype(np.uint64)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The text's shingle hashes, each once, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """One row per row of docs: doc_id and f0, f1, ... (the fingerprint's words as longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.zeros((b.num_rows, words), np.uint64)
            for i, text in enumerate(b.column("text")):
                f[i] = fingerprint(text.as_py(), shingle, words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(f[:, w].view(np.int64)) for w in range(words))], ["doc_id", *(f"f{w}" for w in range(words))])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"f{w} long" for w in range(words)))


def exact_bands(bits: int, radius: int, n: int, per_group: int = 4096) -> list[list[int]]:
    """Sets of bit positions of which any two fingerprints within the radius share one whole set.

    The bits are cut into radius + m blocks; radius flips leave m of them alone,
    so each choice of m blocks is a set. m is the least with which random
    fingerprints, n in all, leave at most per_group to a value of a set.
    """
    for m in range(1, 5):
        blocks = [list(x) for x in np.array_split(np.arange(bits), radius + m)]
        if n >> (m * (bits // (radius + m))) <= per_group:
            break
    return [sorted(int(i) for b in chosen for i in b) for chosen in itertools.combinations(blocks, m)]


def sampled_bands(bits: int, width: int, count: int, seed: int = SEED) -> list[list[int]]:
    """`count` random sets of `width` bit positions, the same in every run."""
    rng = random.Random(seed)
    return [sorted(rng.sample(range(bits), width)) for _ in range(count)]


def _masks(band: list[int], words: int) -> list[int]:
    out = [0] * words
    for i in band:
        out[i // 64] |= 1 << (63 - i % 64)
    return [m - (1 << 64) if m >> 63 else m for m in out]


class Forest:
    """Union-find over 0..n-1, by whole arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            u, v = self.root[u], self.root[v]
            apart = u != v
            u, v = u[apart], v[apart]
            if not len(u):
                return
            np.minimum.at(self.root, np.maximum(u, v), np.minimum(u, v))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _tiles(group: np.ndarray, pop: np.ndarray, f: np.ndarray, node: np.ndarray, radius: int, forest: Forest, tile: int, most: int | None = None) -> None:
    """Compare the rows, sorted by group, tile against tile; link what is within the radius.

    A pair of tiles is skipped if no group is in both, if their population
    counts differ beyond the radius, or if all their nodes are linked already.
    """
    n = len(group)
    pad = -n % tile
    g = np.concatenate([group, np.full(pad, -1)]).reshape(-1, tile)
    p = np.concatenate([pop, np.zeros(pad, pop.dtype)]).reshape(-1, tile)
    x = np.concatenate([f, np.zeros((pad, f.shape[1]), f.dtype)]).reshape(-1, tile, f.shape[1])
    at = np.concatenate([node, np.zeros(pad, node.dtype)]).reshape(-1, tile)
    last = np.full(len(g), tile - 1)
    last[-1] -= pad
    g_first, g_last = g[:, 0], g[np.arange(len(g)), last]
    real = g >= 0
    p_min, p_max = np.where(real, p, 1 << 30).min(1), np.where(real, p, -1).max(1)
    batch = max(1, (1 << 19) // (tile * tile))
    for d in range(len(g) if most is None else most):
        i = np.arange(len(g) - d)
        i = i[g_last[i] == g_first[i + d]] if d else i
        if not len(i):
            break
        i = i[(p_min[i + d] - p_max[i] <= radius) & (p_min[i] - p_max[i + d] <= radius)]
        for s in range(0, len(i), batch):
            a = i[s : s + batch]
            roots = forest.root[at[np.stack([a, a + d])]]
            done = (roots == roots[:1, :, :1]).all((0, 2)) & real[a].all(1) & real[a + d].all(1)
            a = a[~done]
            if not len(a):
                continue
            apart = np.zeros((len(a), tile, tile), np.uint8 if f.shape[1] < 4 else np.uint16)
            for w in range(f.shape[1]):
                apart += np.bitwise_count(x[a, :, None, w] ^ x[a + d, None, :, w])
            near = apart <= radius
            near &= g[a][:, :, None] == g[a + d][:, None, :]
            near &= real[a][:, :, None]
            k, r, c = np.nonzero(near)
            u, v = at[a[k], r], at[a[k] + d, c]
            forest.link(u, v)


def link_bands(key: np.ndarray, pop: np.ndarray, f: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius among rows that share a band's value, reduced to (node, least node of its component here)."""
    order = np.lexsort((pop, key))
    key, pop, f, node = key[order], pop[order], f[order], node[order]
    group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])) if len(key) else key
    size = np.bincount(group) if len(key) else np.zeros(0, np.int64)
    several = size[group] > 1
    group, pop, f, node = group[several], pop[several].astype(np.int64), f[several], node[several]
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, at = np.unique(node, return_inverse=True)
    forest = Forest(len(names))
    size = size[size > 1]
    small = size[np.unique(group, return_inverse=True)[1]] <= 256
    for part, tile in ((small, 32), (~small, 512)):
        if not part.any():
            continue
        g, p, x, a = group[part], pop[part], f[part], at[part]
        if tile == 512:
            # one pass along the diagonal links most of a dense group; what has
            # its commonest root then goes to tiles of its own, which are skipped
            _tiles(g, p, x, a, radius, forest, tile, 2)
            main = np.zeros(len(g), bool)
            for value in np.unique(g):
                own = np.flatnonzero(g == value)
                roots, counts = np.unique(forest.root[a[own]], return_counts=True)
                main[own] = forest.root[a[own]] == roots[counts.argmax()]
            order = np.lexsort((p, main, g))
            g, p, x, a = g[order], p[order], x[order], a[order]
        _tiles(g, p, x, a, radius, forest, tile)
    moved = forest.root != np.arange(len(names))
    return names[moved], names[forest.root[moved]]


def links(classes: DataFrame, bands: list[list[int]], words: int, radius: int) -> DataFrame:
    """(u, v) node pairs that span the components of each task's comparisons; classes: node, f0, f1, ..."""
    f = [f"f{w}" for w in range(words)]
    keys = [F.xxhash64(F.lit(j), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(f, _masks(band, words), strict=True)]) for j, band in enumerate(bands)]
    pop = sum((F.bit_count(c) for c in f[1:]), F.bit_count(f[0]))
    rows = classes.select("node", *f, pop.cast("int").alias("pop"), F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(parts: list[tuple]) -> pa.RecordBatch:
            u, v = link_bands(*(np.concatenate(x) for x in zip(*parts, strict=True)), radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "pop", "node", *f)}
            if not b.num_rows:
                continue
            held.append((col["key"], col["pop"], np.stack([col[c] for c in f], 1).view(np.uint64), col["node"]))
            if sum(len(x[0]) for x in held) >= CHUNK:  # all but the last key, which may go on
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                held = [tuple(x[cut:] for x in whole)]
                if cut:
                    yield out([tuple(x[:cut] for x in whole)])
        if held:
            yield out(held)

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, words: int = 1, bands: list[list[int]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (hex) and component_id, the least doc_id reachable by links.

    Fingerprints of `words` x 64 bits link at `radius` or fewer differing bits.
    Equal fingerprints are one class; classes that agree on all bits of a band
    are sorted by population count and compared exactly, tile against tile. By
    default the bands are such that no link within the radius can be missed
    (exact_bands); other bands make a wide radius affordable for some recall.

    Texts without words have fingerprint zero and link like others. Null ids
    count as no id: a component without any other has a null component_id.
    Repeated rows each get their row. No rows give no rows; other columns are
    not read. Driver: only counts and checksums.
    """
    f = [f"f{w}" for w in range(words)]
    own = materialise(fingerprints(docs, id_col, text_col, shingle, words), "fingerprints")
    node = F.col("f0") if words == 1 else F.xxhash64(*f)
    classes = materialise(own.groupBy(*f).agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_size")).withColumn("node", node), "classes")
    chosen = bands or exact_bands(64 * words, radius, classes.count())
    roots = components(links(classes.select("node", *f), chosen, words, radius))
    linked = roots.join(classes.select("node", "_least"), "node")
    named = linked.join(linked.groupBy("root").agg(F.min("_least").alias("_named")), "root").select("node", "_named")
    groups = classes.join(named, "node", "left").select("node", "_size", F.coalesce("_named", "_least").alias("component_id"))
    hexed = F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in f])).alias("fingerprint")
    rows = own.select("doc_id", node.alias("node"), hexed)
    return attach(rows, groups, "node", "_size", own.count(), ["doc_id"]).select("doc_id", "fingerprint", "component_id")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left has in common with each on the right, as products of 0/1 matrices of COLUMNS columns."""
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    cut = len(row[0])
    _, col, held = np.unique(np.concatenate([*left, *right, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    place = np.cumsum(held > 1) - 1  # values in one set only are in no pair
    out = np.zeros((len(left), len(right)), np.float32)
    ok = held[col] > 1
    sides = [(row[0][ok[:cut]], place[col[:cut][ok[:cut]]]), (row[1][ok[cut:]], place[col[cut:][ok[cut:]]])]
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        x, y = (np.zeros((len(n), COLUMNS), np.float32) for n in (left, right))
        for m, (r, c) in zip((x, y), sides, strict=True):
            own = (c >= first) & (c < first + COLUMNS)
            m[r[own], c[own] - first] = 1
        out += x @ y.T
    return out.astype(np.int64)


def similar_links(nodes: np.ndarray, sets: list[np.ndarray], right: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(node, node) links that span the pairs of sets with a Jaccard similarity of `share` or more: pairs of
    a row on the left and one on the right, or any two rows if all are on the left."""
    if len(nodes) < 2:
        return nodes[:0], nodes[:0]
    a = np.flatnonzero(~right)
    b = np.flatnonzero(right) if right.any() else a
    n = np.array([len(s) for s in sets])
    both = common_counts([sets[i] for i in a], [sets[i] for i in b])
    u, v = np.nonzero(both * share.denominator >= (n[a][:, None] + n[b][None, :] - both) * share.numerator)
    forest = Forest(len(nodes))
    forest.link(a[u], b[v])
    moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[moved], nodes[forest.root[moved]]


def checked_links(texts: DataFrame, members: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(u, v): links that span, in each candidate group, the pairs of texts that are similar by their sets of shingles.

    texts: doc_id, text; members: node, root (its group), n (size of its set),
    doc_id (of a text with that set). A group is cut into blocks of about BLOCK
    set values, and each pair of blocks is a task's work of its own: sets travel to block
    pairs, never a row for each pair of texts.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_size"), F.sum("n").alias("_values"))
    told = attach(members, sizes, "root", "_size", members.count(), ["node"])
    told = told.withColumn("_blocks", F.ceil(F.col("_values") / BLOCK).cast("int"))
    told = told.select("node", "root", "_blocks", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int").alias("_own"), F.col("doc_id").alias("_rep"))
    held = texts.join(told, F.col("doc_id") == F.col("_rep")).select("node", "root", "_blocks", "_own", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), shingle).astype("<u8").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "root", "_blocks", "_own")), pa.array(found, pa.binary())], ["node", "root", "_blocks", "_own", "grams"])

    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    rows = held.mapInArrow(sets, "node long, root long, _blocks int, _own int, grams binary").select("node", "root", "_own", "grams", other)
    rows = rows.select("root", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).alias("right"), "node", "grams")
    share = Fraction(str(similarity))
    key = ("root", "i", "j")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        u, v, size = [], [], 0

        def work() -> None:
            nodes = np.array([r[3] for r in held], np.int64)
            for out, x in zip((u, v), similar_links(nodes, [np.frombuffer(r[5], "<u8") for r in held], np.array([r[4] for r in held], bool), share), strict=True):
                out.append(x)

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (u, v)], ["u", "v"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*key, "node", "right", "grams")), strict=True):
                if held and row[:3] != held[0][:3]:
                    work()
                    size += len(held)
                    held = []
                held.append(row)
            if size > CHUNK:
                yield full()
                u, v, size = [], [], 0
        if held:
            work()
        yield full()

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(check, "u long, v long")


#: Bits of the hash by which sets and rows go at first; tests take fewer, so that hashes collide.
NODE_MASK = (1 << 64) - 1


def told_apart(rows: DataFrame, twins: DataFrame, key: str, also: str) -> DataFrame:
    """rows with another hash in place of those of twins (few): of it and of a second hash, so that 128 bits tell."""
    marked = rows.join(twins.select(F.col(key).alias("_twin")), F.col(key) == F.col("_twin"), "left")
    return marked.withColumn(key, F.when(F.col("_twin").isNotNull(), F.xxhash64(key, also)).otherwise(F.col(key))).drop("_twin")


def similar_groups(docs: DataFrame, similarity: float, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 58, words: int = 4, bands: list[list[int]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id (unique, not null) and component_id, the least doc_id reachable by pairs of texts that are similar.

    Two texts are similar if their shingle sets (64-bit hashes) have a Jaccard
    similarity of `similarity` or more. Equal sets are one class. SimHash
    proposes: classes whose fingerprints link, directly or by others, are a
    candidate group. In it every pair is checked, set against set.

    The fingerprints of texts at 0.8 differ in 39 of 256 bits, with a standard
    deviation of 6; a pair is missed only if no chain of links within the
    radius that share one of the bands joins it.
    """
    bands = bands or sampled_bands(64 * words, 13, 64)
    f = [f"f{w}" for w in range(words)]
    texts = id_text(docs, id_col, text_col)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, also, n, x = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, words), np.uint64)
            for i, text in enumerate(b.column("text")):
                grams = shingle_set(text.as_py(), shingle)
                node[i], also[i], n[i] = xxhash.xxh64_intdigest(grams.tobytes(), SEED) & NODE_MASK, xxhash.xxh64_intdigest(grams.tobytes(), SEED + 1), len(grams)
                x[i] = np.packbits(_ones(grams, words) * 2 > len(grams)).view(">u8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(node.view(np.int64)), pa.array(also.view(np.int64)), pa.array(n), *(pa.array(x[:, w].view(np.int64)) for w in range(words))], ["doc_id", "node", "also", "n", *f])

    own = materialise(texts.mapInArrow(prints, "doc_id long, node long, also long, n long, " + ", ".join(f"{c} long" for c in f)), "set-fingerprints")
    sets = lambda: own.groupBy("node").agg(*[F.min(c).alias(c) for c in ("n", *f)], F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_size"), F.min("also").alias("_a"), F.max("also").alias("_z"))
    classes = materialise(sets(), "set-classes")
    twins = classes.where("_a <> _z")
    if not twins.isEmpty():  # different sets of one hash get others
        own = materialise(told_apart(own, twins, "node", "also"), "set-fingerprints")
        classes = materialise(sets(), "set-classes")
    proposed = components(links(classes.where("n > 0").select("node", *f), bands, words, radius))
    members = materialise(classes.join(proposed, "node").select("node", "root", "n", F.col("_least").alias("doc_id")), "candidates")
    roots = components(checked_links(texts, members, similarity, shingle))
    met = roots.join(classes.select("node", "_least"), "node")
    named = met.join(met.groupBy("root").agg(F.min("_least").alias("_named")), "root").select("node", "_named")
    groups = classes.join(named, "node", "left").select("node", "_size", F.coalesce("_named", "_least").alias("component_id"))
    return attach(own.select("doc_id", "node"), groups, "node", "_size", own.count(), ["doc_id"]).select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, **how) -> DataFrame:
    """The rows of docs, all columns, without those that are similar to another and not the first of their component (similar_groups).

    Rows are told apart by two hashes of id and text: a row with a null id, or one that
    repeats an id with another text, goes or stays by its own text. Of rows that
    agree in both, one stays. The one that stays of a component has its least id
    (null last), and of several with that id the least hash.
    """
    values = docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key, also = F.xxhash64(*values).bitwiseAND(F.lit(NODE_MASK - (1 << 64) if NODE_MASK >> 63 else NODE_MASK)), F.xxhash64(F.lit("also"), *values)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), docs[id_col].cast("long").alias("_id"), key.alias("_key"), also.alias("_also"), docs[text_col].alias("text"))
    twins = materialise(keyed.groupBy("_key").agg(F.min("_also").alias("_a"), F.max("_also").alias("_z")).where("_a <> _z").select("_key"), "row-twins")
    keyed = keyed if twins.isEmpty() else told_apart(keyed, twins, "_key", "_also")
    rows = keyed.select(F.col("_key").alias("doc_id"), "text")
    found = similar_groups(rows, similarity, **how)
    groups = materialise(found.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")).distinct(), "near-groups")
    several = groups.join(groups.groupBy("_group").count().where("count > 1"), "_group", "left_semi")
    named = several.join(keyed.select("_key", "_id").distinct(), "_key")
    first = named.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_key"))["_key"].alias("_first"))
    gone = materialise(several.select("_key").join(first.select(F.col("_first").alias("_key")), "_key", "left_anti"), "near-copies")
    # rows that repeat are combined by each task before they are shuffled, and the join reuses that shuffle
    return keyed.groupBy("_key").agg(F.first("_row").alias("_row")).join(gone, "_key", "left_anti").select("_row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
