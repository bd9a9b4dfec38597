"""Benchmark passages in training documents, found by spaced seeds and checked word by word."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialise, table

#: A seed hashes the words at its 1s and ignores those at its 0s.
MASKS = ("11111", "110111", "1101011", "11001011", "101010101")
#: Bits of the filter that every task gets, at most (16 MB), and for each benchmark seed; bits that a seed sets.
FILTER_BITS, BITS_PER_SEED, PROBES = 1 << 27, 64, 4
#: Words kept on both sides of a run of hits, the gap that ends a run, and the most words of a run that travel together.
FLANK, GAP, PIECE = 64, 32, 4096
#: Bytes of text that a task works on at a time.
SLICE = 1 << 20

#: ASCII letters and digits and all other bytes from 0x80 make words; capital A-Z are lowered, the rest separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that are hashed at a time, about.
PART = 1 << 16
#: A random number for each byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, start) of each word of folded bytes, in parts that a processor's cache holds."""
    found, at = [], 0
    while len(data) - at > PART:
        end = data.rfind(b" ", at, at + PART)
        end = data.find(b" ", at + PART) if end <= at else end
        if end < 0:
            break
        h, start = _word_hashes(data[at:end])
        found.append((h, start + at))
        at = end
    h, start = _word_hashes(data[at:] if at else data)
    found.append((h, start + at))
    return (h, start) if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Differences of prefix sums of mixed bytes and places in the word."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], b != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    first = start[0]
    place = np.arange(first, len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
    v = _BYTE[b[first:]] + place.astype(np.uint64) * _STEP
    v = (v ^ (v >> np.uint64(29))) * _ODD  # not linear in the bytes
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v ^ (v >> np.uint64(32)))])
    return mix(total[end - first] - total[start - first] + (end - start).astype(np.uint64)), start


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """The hash of every position's seed under a mask."""
    kept = [i for i, c in enumerate(MASKS[mask]) if c == "1"]
    n = max(0, len(words) - len(MASKS[mask]) + 1)
    out = np.full(n, mask + 1, np.uint64)
    for i in kept:
        out = mix(out * np.uint64(0x100000001B3) + words[i : i + n])
    return out


def fold(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(FOLD)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, words (hashes of its words), of items with a word; an item is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_hashes(fold(t.as_py()))[0].view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])

    rows = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id long, words array<long>").where(F.size("words") > 0)


def _item_seeds(items: DataFrame) -> DataFrame:
    """seed, item (an item's number) of each position and mask of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, words in zip(b.column("item"), b.column("words"), strict=True):
                w = np.array(words.as_py(), np.int64).view(np.uint64)
                s = np.unique(np.concatenate([seeds(w, m) for m in range(len(MASKS))])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([item.as_py()] * len(s), pa.int64())], ["seed", "item"])

    return items.select("item", "words").mapInArrow(run, "seed long, item long")


def probes(seed: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's bits for each seed: PROBES places from two hashes of 64 bits."""
    again = mix(seed + _STEP)
    return [(x >> np.uint64(shift)) & np.uint64(bits - 1) for x in (seed, again) for shift in (0, 32)][:PROBES]


def _filter(item_seeds: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the seeds, of `bits` bits however many seeds there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in probes(b.column("seed").to_numpy(zero_copy_only=False).view(np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64))], ["at"])

    rows = item_seeds.select("seed").mapInArrow(run, "at long").groupBy(F.shiftright("at", 15).alias("block"))
    out = np.zeros(max(bits, 32768) // 8, np.uint8)
    for r in rows.agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits")).toLocalIterator():
        out[r["block"] * 4096 : r["block"] * 4096 + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _longest_stretch(same: np.ndarray, least: int, identity: float) -> tuple[int, int]:
    """Start and end of the longest stretch of `least` words or more of which the share `identity` agrees; (0, 0) if none does.

    Of several that long, the first of those with the most words that agree.
    """
    share = Fraction(str(identity))
    count = np.concatenate([[0], np.cumsum(same, dtype=np.int64)])
    total = count * share.denominator - np.arange(len(count)) * share.numerator  # whole numbers: no rounding at the share itself
    start = np.searchsorted(-np.minimum.accumulate(total), -total)  # the first place that is not above each end
    length = np.arange(len(count)) - start
    ends = np.flatnonzero(length == length.max())
    end = int(ends[np.argmax(count[ends] - count[start[ends]])])
    return (int(start[end]), end) if length[end] >= least else (0, 0)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 12, identity: float = 0.8) -> DataFrame:
    """Documents that hold a passage of a benchmark item, up to substituted words.

    One row per document id and item: doc_id, item_id, n_words (of the aligned
    stretch), n_same (words in it that agree), doc_start (its first word's
    place in the document). Words are runs of ASCII letters, digits and
    non-ASCII characters, A-Z lower-cased.

    1. Each task hashes its documents' words at every position under every mask
       and keeps the seeds that a filter of the benchmark's seeds has, with the words around
       them, in pieces of PIECE words at most. The filter is all that is broadcast, and
       its size is bounded (FILTER_BITS).
    2. A piece's different seeds join the items' different seeds, an ordinary join whose side
       Spark broadcasts only below its size threshold: however often a seed
       repeats in a text or an item, it is one row of each.
    3. Of each (document, item) that met, the pieces that the item can reach come together and are
       compared word by word along every alignment that shares a seed;
       a stretch counts if it has min_words words (or the whole item, if
       that is shorter, of 5 words at least) and the share `identity` of them
       agrees. The longest stretch of each alignment is found; of several alignments,
       the one with the most words that agree.

    Null texts have no words; null item or document ids are ids like others.
    Repeated rows give one result. Empty tables give no rows; other columns
    aren't read. A text of any length is worked on in slices that overlap, and its
    stretches don't end where a slice or a piece does.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.lit(0).cast("long").alias("also"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    held = _stretches(rows, benchmark, item_col, item_text_col, min_words, identity)
    best = F.max(F.struct("n_same", -F.col("n_words"), -F.col("doc_start"), "n_words", "doc_start")).alias("b")
    return held.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_words", "b.n_same", "b.doc_start")


def _stretches(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, min_words: int, identity: float) -> DataFrame:
    """overlaps() for each row (doc_id, also, text): doc_id, also, item_id, n_words, n_same, doc_start."""
    spark = rows.sparkSession
    items = materialise(_items(benchmark, item_col, item_text_col).withColumn("item", F.monotonically_increasing_id()), "benchmark-words")
    item_seeds = materialise(_item_seeds(items).distinct(), "benchmark-seeds")
    bits, n_seeds = 1 << 15, item_seeds.count()
    while bits < FILTER_BITS and bits < n_seeds * BITS_PER_SEED:
        bits *= 2
    told = spark.sparkContext.broadcast(_filter(item_seeds, bits))
    schema = pa.schema([("doc_id", pa.int64()), ("also", pa.int64()), ("row", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64()))])

    def hits(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, seed) of seeds in the filter that lie in one document, by position."""
        table_, at, found = told.value, [], []
        for m, mask in enumerate(MASKS):
            s = seeds(words, m)
            ok = np.arange(len(s))
            for n in range(PROBES):  # each looks at what the last one left
                p = probes(s[ok], bits)[n] if n else s & np.uint64(bits - 1)
                ok = ok[np.flatnonzero((table_[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)]
            ok = ok[doc[ok] == doc[ok + len(mask) - 1]]
            at.append(ok)
            found.append(s[ok])
        at, found = np.concatenate(at), np.concatenate(found)
        order = np.argsort(at, kind="stable")
        return at[order], found[order]

    def pieces(texts: list[bytes], ids: list[tuple[int | None, int | None, int]], offsets: list[int]) -> pa.RecordBatch:
        words, start = word_hashes(b" ".join(texts))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        doc = np.searchsorted(begins, start, "right") - 1
        first = np.searchsorted(start, begins)  # of each text's words
        last = np.append(first[1:], len(words))
        at, found = hits(words, doc)
        out = []
        cuts = np.flatnonzero((np.diff(at) > GAP) | (np.diff(doc[at]) != 0)) + 1 if len(at) else []
        for run in np.split(np.arange(len(at)), cuts) if len(at) else []:
            d = doc[at[run[0]]]
            shift = offsets[d] - first[d]  # to places in the whole text
            a, b = max(first[d], at[run[0]] - FLANK), min(last[d], at[run[-1]] + FLANK)
            for k in range(int(a + shift) // PIECE, int(b - 1 + shift) // PIECE + 1):
                x, y = max(a, k * PIECE - shift), min(b, (k + 1) * PIECE - shift)
                own = found[run[np.searchsorted(at[run], x) : np.searchsorted(at[run], y)]]
                out.append({"doc_id": ids[d][0], "also": ids[d][1], "row": ids[d][2], "piece": k, "start": int(x + shift), "words": words[x:y].view(np.int64), "seeds": np.unique(own).view(np.int64)})
        return pa.RecordBatch.from_pylist(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, offsets, size = [], [], [], 0
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for doc_id, also, text in zip(b.column("doc_id").to_pylist(), b.column("also").to_pylist(), b.column("text"), strict=True):
                data, offset, row = fold(text.as_py()), 0, row + 1
                while data is not None:
                    part, data, skip = _next_slice(data)
                    texts.append(part)
                    ids.append((doc_id, also, row))
                    offsets.append(offset)
                    offset += skip
                    size += len(part)
                    if size >= SLICE:
                        yield pieces(texts, ids, offsets)
                        texts, ids, offsets, size = [], [], [], 0
        if texts:
            yield pieces(texts, ids, offsets)

    found = rows.mapInArrow(run, "doc_id long, also long, row long, piece long, start long, words array<long>, seeds array<long>")
    found = materialise(found, "seed-hits")
    met = found.select("row", "piece", F.explode("seeds").alias("seed")).join(item_seeds, "seed").select("row", "piece", "item").distinct()
    sized = items.select(F.col("item").alias("_item"), F.ceil(F.size("words") / PIECE).alias("_reach"))
    near = met.join(sized, F.col("item") == F.col("_item")).select("row", "item", F.explode(F.sequence(F.col("piece") - F.col("_reach"), F.col("piece") + F.col("_reach"))).alias("piece")).distinct()
    # no more than the text's pieces that the item reaches
    told_pieces = near.join(found.select("row", "piece", "doc_id", "also", "start", "words"), ["row", "piece"])
    together = told_pieces.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.first("also").alias("also"), F.sort_array(F.collect_list(F.struct("start", "words"))).alias("pieces"))
    named = items.select(F.col("item").alias("_item"), "item_id", F.col("words").alias("item_words"))
    both = together.join(named, F.col("item") == F.col("_item")).select("doc_id", "also", "item_id", "pieces", "item_words")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "also", "item_id", "n_words", "n_same", "doc_start")}
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                item = r["item_words"].values.to_numpy()
                parts = r["pieces"].values
                starts, words = parts.field("start").to_numpy(), parts.field("words")
                for start, w in _joined(starts, [words[j].values.to_numpy() for j in range(len(words))]):
                    best = best_alignment(w, item, max(5, min(min_words, len(item))), identity)
                    if best:
                        n_words, n_same, at = best
                        for c, v in zip(out, (r["doc_id"].as_py(), r["also"].as_py(), r["item_id"].as_py(), n_words, n_same, int(start) + at), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    return both.mapInArrow(check, "doc_id long, also long, item_id long, n_words long, n_same long, doc_start long")


def _joined(starts: np.ndarray, words: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text, in order, as stretches of words without a gap; pieces may overlap."""
    held, first, end = [], 0, -1
    for start, w in zip(starts.tolist(), words, strict=True):
        if held and start <= end:
            held.append(w[end - start :])
        else:
            if held:
                yield first, np.concatenate(held)
            held, first = [w], start
        end = max(end, start + len(w)) if len(held) > 1 else start + len(w)
    if held:
        yield first, np.concatenate(held)


def best_alignment(words: np.ndarray, item: np.ndarray, least: int, identity: float) -> tuple[int, int, int] | None:
    """(n_words, n_same, start) of the stretch with the most words that agree, of the alignments that share a seed; fewer words, then the first, of equals.

    Every alignment's agreeing words are counted first; alignments are gone through from
    the most of these down, until none can hold more than what was found.
    """
    n, size = len(words), len(words) + len(item)
    seeded, agree = np.zeros(size + 1, bool), np.zeros(size + 1, np.int64)
    w, i = words.view(np.uint64), item.view(np.uint64)
    for own, other, mark in (*((seeds(w, m), seeds(i, m), True) for m in range(len(MASKS))), (w, i, False)):
        places = np.flatnonzero(np.isin(own, other))
        by = places[np.argsort(own[places], kind="stable")]
        lows, highs = (np.searchsorted(own[by], other, side) for side in ("left", "right"))
        for q in np.flatnonzero(highs > lows).tolist():
            at = by[lows[q] : highs[q]] - q + len(item)
            if mark:
                seeded[at] = True
            else:
                agree[at] += 1
    offsets = np.flatnonzero(seeded)
    best: tuple[int, int, int] | None = None
    for k in offsets[np.argsort(-agree[offsets], kind="stable")].tolist():
        o = k - len(item)
        a, e = max(0, o), min(n, o + len(item))
        if best and agree[k] < -best[0]:
            break
        if best and agree[k] == -best[0] == best[1] and a >= best[2]:
            continue  # as many words at most, none fewer, and no earlier
        same = words[a:e] == item[a - o : e - o]
        s, t = _longest_stretch(same, least, identity)
        if t:
            found = (-int(same[s:t].sum()), t - s, a + s)
            best = min(best, found) if best else found
    return (best[1], -best[0], best[2]) if best else None


def _next_slice(data: bytes) -> tuple[bytes, bytes | None, int]:
    """A slice of data, what is left with FLANK words before it again (None: nothing), and the words between both starts."""
    if len(data) <= SLICE:
        return data, None, 0
    end = data.rfind(b" ", 0, SLICE)
    end = end if end > SLICE // 2 else data.find(b" ", SLICE)
    if end < 0:
        return data, None, 0
    part = data[:end]
    back = end
    for _ in range(2 * FLANK):
        at = part.rfind(b" ", 0, back)
        if at <= end // 2:
            break
        back = at
    return part, data[back:], len(part[:back].split())


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's id and text: together they tell apart more rows than there will ever be."""
    values = docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return F.xxhash64(*values), F.xxhash64(F.lit("also"), *values)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12, identity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, in which overlaps() finds nothing.

    Rows are told apart by two hashes of id and text, so a row goes or stays by its own
    text, whether its id is null or repeats.
    """
    keys = row_keys(docs, id_col, text_col)
    rows = docs.select(keys[0].alias("doc_id"), keys[1].alias("also"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    bad = _stretches(rows, benchmark, "item_id", "text", min_words, identity).select(F.col("doc_id").alias("_bad"), F.col("also").alias("_bad_also")).distinct()
    return docs.join(bad, (keys[0] == bad["_bad"]) & (keys[1] == bad["_bad_also"]), "left_anti")


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
