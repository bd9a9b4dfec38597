"""How the tokens of two tokenizers lie over each other, and how many documents link each pair of ids."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_text, materialise, shared_dir, table
from ledgerlens.llm.pieces import MARK, model_path
from ledgerlens.llm.wavelet import TOKENIZER

#: Different words, words and documents of a chunk, at most about: what is aligned together.
CHUNK_WORDS, CHUNK_PLACES, CHUNK_DOCS = 250_000, 1_500_000, 50_000
#: What no tokenizer takes for white space.
SOLID = r"[^\s\x1c-\x1f\x85\u180e]"
#: Bytes of words that are encoded at a time, and characters of a long text that are cut into words at a time.
SLICE = 1 << 20
#: Pairs that a task counts before it sends them on.
PAIRS = 1 << 22

CHUNK = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, vocab binary, holders binary, held array<long>, places binary, times binary"


SHARD = "first long, name string, n long, a array<long>, docs array<long>"


class Aligner:
    """Token ids and byte lengths of words under a byte-level tokenizer (A) and a piece model (B), and how they overlap."""

    #: A word begins at a blank between two characters that no tokenizer takes for white space; neither A's nor B's tokens reach over it.
    WORD = re.compile(f"(?<={SOLID}) (?={SOLID})")
    #: A word that can stand beside others.
    PLAIN = re.compile(f" {SOLID}(?:.*{SOLID})?", re.DOTALL)

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        if path_a is None:
            import public_tokenizers

            path_a = public_tokenizers.path(TOKENIZER)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path(path_b))
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes these bytes as themselves
        self.byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
        n_a = self.a.get_vocab_size()
        entries = [bytes(self.byte.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(n_a)]
        texts = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.tables = [(np.frombuffer(b"".join(t), np.uint8), np.array([*map(len, t)], np.int64), np.cumsum([0, *map(len, t)])[:-1]) for t in (entries, texts)]
        self.names = np.array([str(i) for i in range(max(n_a, len(texts)))])

    def _bytes(self, which: int, ids: np.ndarray) -> np.ndarray:
        flat, size, begin = self.tables[which]
        n = size[ids]
        ends = np.cumsum(n)
        return flat[np.repeat(begin[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def words(self, words: list[str]) -> Aligned:
        """How each word is aligned; all but a single one are PLAIN, so that they stand beside each other as they would alone."""
        data = "".join(words)
        a = np.array(self.a.encode(data, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(data[1:]), np.int64) if data else a
        text = np.frombuffer(data.encode("utf-8", "surrogatepass"), np.uint8)
        same = [self._bytes(k, ids) for k, ids in ((0, a), (1, b))]
        if any(len(s) != len(text) or (s != text).any() for s in same):
            if len(words) == 1:  # a character that a tokenizer changes
                return Aligned.none()
            half = len(words) // 2  # find out which words are concerned
            return Aligned.joined([self.words(words[:half]), self.words(words[half:])])
        ends = np.cumsum([*map(len, map(str.encode, words))]) if words else np.zeros(0, np.int64)
        end_a, end_b = (np.cumsum(self.tables[k][1][ids]) for k, ids in ((0, a), (1, b)))
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        # tokens before each word's end, and groups; every word ends a group
        cut_a, cut_b, cut_g = (np.searchsorted(e, ends, "right") for e in (end_a, end_b, both))
        # an A token overlaps the B tokens from the one that holds its first byte to the one that holds its last
        first, last = np.searchsorted(end_b, end_a - self.tables[0][1][a], "right"), np.searchsorted(end_b, end_a, "left")
        n = last - first + 1
        begun = np.cumsum(n) - n
        link_b = np.repeat(first - begun, n) + np.arange(n.sum())
        links = np.repeat(a, n) << 32 | b[link_b]
        cut_l = np.append(begun, n.sum())[cut_a]
        sides = []
        for ids, end in ((a, end_a), (b, end_b)):
            cut = np.searchsorted(end, both, "right").tolist()
            name = self.names[ids].tolist()
            sides.append([",".join(name[i:j]) for i, j in pairwise([0, *cut])])
        groups = [f"{x}|{y}" for x, y in zip(*sides, strict=True)]
        texts = [";".join(groups[i:j]) for i, j in pairwise([0, *cut_g.tolist()])]
        return Aligned(np.ones(len(words), bool), *(np.diff(c, prepend=0) for c in (cut_a, cut_b, cut_g, cut_l)), links, texts)


class Aligned:
    """Words' counts of A and B tokens, groups and links, all links one after the other, and the groups as text."""

    def __init__(self, ok, n_a, n_b, n_groups, n_links, links, texts):
        self.ok, self.n_a, self.n_b, self.n_groups, self.n_links, self.links, self.texts = ok, n_a, n_b, n_groups, n_links, links, texts

    @classmethod
    def none(cls) -> Aligned:
        """Of one word whose bytes a tokenizer doesn't keep."""
        zero = np.zeros(1, np.int64)
        return cls(np.zeros(1, bool), zero, zero, zero, zero, zero[:0], [""])

    @classmethod
    def joined(cls, parts: list[Aligned]) -> Aligned:
        empty = np.zeros(0, np.int64)
        arrays = [np.concatenate([getattr(p, c) for p in parts]) if parts else empty for c in ("ok", "n_a", "n_b", "n_groups", "n_links", "links")]
        return cls(arrays[0].astype(bool), *arrays[1:], [t for p in parts for t in p.texts])


_aligners: dict[tuple[str | None, str | None], Aligner] = {}


def aligner(path_a: str | None, path_b: str | None) -> Aligner:
    """One for each Python worker."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _words(text: str) -> Iterator[list[str]]:
    """Words of a text, each with its leading blank, of a slice of the text at a time."""
    at = 0
    while at < len(text):
        cut = Aligner.WORD.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        part = text[at:end] if at else " " + text[:end]
        if part.isascii() and part.isprintable() and "  " not in part and part[-1] != " ":
            yield [" " + w for w in part[1:].split(" ")]
        else:
            pieces = Aligner.WORD.split(part)
            yield [pieces[0], *(" " + w for w in pieces[1:])]
        at = end


class _Chunk:
    """Documents by the places of their words in the chunk's list of different words."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.docs: list[list[np.ndarray]] = []
        self.n_places = 0

    def add(self, words: list[str]) -> None:
        place = self.place
        self.docs[-1].append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.uint32, len(words)))
        self.n_places += len(words)

    def full(self) -> bool:
        return len(self.place) >= CHUNK_WORDS or self.n_places >= CHUNK_PLACES or len(self.docs) >= CHUNK_DOCS


def _told(chunk: _Chunk, align: Aligner) -> dict:
    """A row of CHUNK: for every document its counts, its different pairs (as places in vocab) and how often it links each."""
    parts: list[Aligned] = []
    some: list[str] = []
    size = 0
    for w in chunk.place:
        plain = w[1:].isalnum() or Aligner.PLAIN.fullmatch(w) is not None and MARK not in w
        if some and (not plain or size >= SLICE):
            parts.append(align.words(some))
            some, size = [], 0
        if plain:
            some.append(w)
            size += len(w)
        else:
            parts.append(align.words([w]))
    al = Aligned.joined([*parts, align.words(some)] if some else parts)
    vocab, code = np.unique(al.links, return_inverse=True)
    began = np.cumsum(al.n_links) - al.n_links
    row: dict = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held")}
    holders, places, times = np.zeros(len(vocab), np.int64), [], []
    for doc in chunk.docs:
        where = np.concatenate(doc) if doc else np.zeros(0, np.uint32)
        if not al.ok[where].all():
            where = where[:0]
        for c in ("n_a", "n_b", "n_groups", "n_links"):
            row[c].append(int(getattr(al, c)[where].sum()))
        sha = hashlib.sha256()
        for i in range(0, len(where), 1 << 16):
            sha.update((";" * (i > 0) + ";".join([al.texts[k] for k in where[i : i + (1 << 16)].tolist()])).encode())
        row["groups_sha256"].append(sha.hexdigest() if len(where) else "")
        n = al.n_links[where]
        ends = np.cumsum(n)
        own, count = np.unique(code[np.repeat(began[where] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], return_counts=True)
        holders[own] += 1
        row["held"].append(len(own))
        places.append(np.diff(own, prepend=0).astype("<u4"))
        times.append(count.astype("<u4"))
    kinds = {"vocab": vocab.astype("<i8"), "holders": holders.astype("<i8"), "places": np.concatenate(places), "times": np.concatenate(times)}
    return row | {"doc_ids": chunk.ids} | {c: v.tobytes() for c, v in kinds.items()}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def aligned_chunks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Every document aligned, some documents a row, as a written table: texts are encoded once."""
    schema = _schema(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, chunk = aligner(path_a, path_b), _Chunk()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                chunk.ids.append(doc_id)
                chunk.docs.append([])
                for words in _words(text.as_py()):
                    chunk.add(words)
                if chunk.full():
                    yield pa.RecordBatch.from_pylist([_told(chunk, align)], schema)
                    chunk = _Chunk()
        if chunk.docs:
            yield pa.RecordBatch.from_pylist([_told(chunk, align)], schema)

    return materialise(docs.mapInArrow(run, CHUNK), "aligned-chunks", compression="zstd", maxRecordsPerFile="4")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id) and the number of documents that link it, sorted: range partitions in order.

    Each task adds up its chunks' pairs, so that a pair is one row a task. These
    rows are range-partitioned and sorted, and runs of equal pairs are summed; only
    a pair's own rows, one a task, meet in one task. Ranges are as many as the tasks
    that read the chunks, a fixed number: Spark would put small ones back together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pair, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pair, np.bincount(where, np.concatenate([n for _, n in held]), len(pair)).astype(np.int64)

        for b in batches:
            for i in range(b.num_rows):
                held.append(tuple(np.frombuffer(b.column(c)[i].as_buffer(), "<i8").copy() for c in ("vocab", "holders")))
                size += len(held[-1][0])
                if size >= PAIRS:
                    held = [summed()]
                    size = len(held[0][0])
                    if size >= PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "docs"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "docs"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_pair, last_docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            pair = np.concatenate([last_pair, b.column("pair").to_numpy()])
            docs = np.concatenate([last_docs, b.column("docs").to_numpy()])
            if not len(pair):
                continue
            begin = np.flatnonzero(np.diff(pair, prepend=pair[0] - 1))
            pair, docs = pair[begin], np.add.reduceat(docs, begin)
            last_pair, last_docs = pair[-1:], docs[-1:]  # its run may go on
            if len(pair) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(pair[:-1]), pa.array(docs[:-1])], ["pair", "docs"])
        yield pa.RecordBatch.from_arrays([pa.array(last_pair), pa.array(last_docs)], ["pair", "docs"])

    partial = chunks.select("vocab", "holders").mapInArrow(count, "pair long, docs long")
    ranges = max(1, chunks.rdd.getNumPartitions())
    return partial.repartitionByRange(ranges, "pair").sortWithinPartitions("pair").mapInArrow(runs, "pair long, docs long")


class CountShards:
    """Sorted counts in files of the shared folder, which tasks map into memory and search.

    Every range partition is a file of pairs followed by their counts, written
    under a name of its own attempt and then renamed, so that an attempt that is
    lost or comes twice changes nothing. Where the shared folder is no mounted one,
    Spark's own file distribution brings the same sorted counts to the executors.
    `highest` has the highest count of each A id, so it is as long as A's vocabulary at most.
    """

    def __init__(self, counts: DataFrame, mounted: bool | None = None):
        spark = counts.sparkSession
        base = f"{shared_dir(spark)}/pair-counts-{uuid.uuid4().hex}"
        self.folder = re.sub("^file:(//)?", "", base)
        self.mounted = base.startswith(("/", "file:")) if mounted is None else mounted
        self.shards: list[tuple[str, int]] = []
        if self.mounted:
            os.makedirs(self.folder, exist_ok=True)
            found = sorted(self._written(counts).collect())  # a row a partition, with a number for each A id in it
            self.shards = [(r["name"], r["n"]) for r in found]
            a, docs = (np.array([x for r in found for x in r[c]], np.int64) for c in ("a", "docs"))
        else:
            counts.write.parquet(base)
            spark.sparkContext.addFile(base, recursive=True)
            self.folder = base.rpartition("/")[2]
            found = spark.read.schema(counts.schema).parquet(base).groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("docs")).collect()
            a, docs = (np.array([r[c] for r in found], np.int64) for c in ("a", "docs"))
        self.highest = np.zeros(int(a.max(initial=0)) + 1, np.int64)
        np.maximum.at(self.highest, a, docs)

    def _written(self, counts: DataFrame) -> DataFrame:
        folder = self.folder

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = TaskContext.get()
            held = [[b.column(c).to_numpy() for c in ("pair", "docs")] for b in batches if b.num_rows]
            if held:
                pair, docs = (np.concatenate([h[k] for h in held]).astype("<i8") for k in (0, 1))
                name = f"{at.partitionId():08d}"
                own = f"{folder}/.{name}-{at.taskAttemptId()}"
                with open(own, "wb") as f:
                    f.write(pair.data)
                    f.write(docs.data)
                os.replace(own, f"{folder}/{name}")
                begin = np.flatnonzero(np.diff(pair >> 32, prepend=-1))
                row = {"first": int(pair[0]), "name": name, "n": len(pair), "a": (pair[begin] >> 32).tolist(), "docs": np.maximum.reduceat(docs, begin).tolist()}
                yield pa.RecordBatch.from_pylist([row], _schema(SHARD))

        return counts.mapInArrow(write, SHARD)

    def open(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(pairs, documents) of each shard, in order."""
        if self.mounted:
            maps = [(np.memmap(f"{self.folder}/{name}", "<i8", "r"), n) for name, n in self.shards]
            return [(m[:n], m[n:]) for m, n in maps]
        import pyarrow.parquet

        held = pyarrow.parquet.read_table(SparkFiles.get(self.folder)).sort_by("pair")
        return [(held.column("pair").to_numpy(), held.column("docs").to_numpy())] if held.num_rows else []

    @staticmethod
    def look_up(shards: list[tuple[np.ndarray, np.ndarray]], pairs: np.ndarray) -> np.ndarray:
        """The counts of sorted pairs, 0 where there is none."""
        found = np.zeros(len(pairs), np.int64)
        if not shards:
            return found
        starts = np.searchsorted(pairs, [s[0][0] for s in shards])
        for (own, docs), i, j in zip(shards, starts, [*starts[1:], len(pairs)], strict=True):
            at = np.minimum(np.searchsorted(own, pairs[i:j]), len(own) - 1)
            found[i:j] = np.where(own[at] == pairs[i:j], docs[at], 0)
        return found


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A blank and the text is encoded by the byte-level tokenizer A, the text by the
    piece model B, which puts a blank before it itself; strings of special tokens are
    plain text. Where tokens of both end at one byte a group ends. A link is an
    occurrence of an A token and one of a B token that share bytes; the count of
    their ids is the number of rows of docs with such a link. n_best counts links
    whose count is the highest of their A id's, count_sum adds up links' counts.

    A text that is null or empty, or whose tokens' bytes aren't those of the blank and
    the text (a U+2581 in it, say), has no tokens: zeros, and '' as groups_sha256.
    Null ids and repeated rows are rows like others. No rows give no rows; other
    columns are not read. What reaches every task is one number an A id; counts
    of pairs stay in files that are mapped. A task holds one chunk of documents, in
    which a long text is a list of 4 bytes a word; a text without blanks is encoded in one go.
    """
    chunks = aligned_chunks(id_text(docs, id_col, text_col), path_a, path_b)
    shards = CountShards(pair_counts(chunks))
    sent = docs.sparkSession.sparkContext.broadcast(shards.highest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = None
        for b in batches:
            for i in range(b.num_rows):
                maps = shards.open() if maps is None else maps
                pairs = np.frombuffer(b.column("vocab")[i].as_buffer(), "<i8")
                places, times = (np.frombuffer(b.column(c)[i].as_buffer(), "<u4") for c in ("places", "times"))
                docs_of = shards.look_up(maps, pairs)
                top = docs_of == sent.value[pairs >> 32] if len(pairs) else docs_of.astype(bool)
                held = np.array(b.column("held")[i].values, np.int64)
                n_best, count_sum, at = [], [], 0
                for n in held.tolist():
                    own, t = np.cumsum(places[at : at + n], dtype=np.int64), times[at : at + n].astype(np.int64)
                    n_best.append(int(t[top[own]].sum()))
                    count_sum.append(int((t * docs_of[own]).sum()))
                    at += n
                same = {c: b.column(c)[i].values for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[i].values, *(same[c] for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), same["groups_sha256"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return chunks.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))
