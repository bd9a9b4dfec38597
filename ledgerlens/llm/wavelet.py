"""Token ids in wavelet-matrix shards: access, count, rank and select from one compressed file."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_text, materialise, table
from ledgerlens.llm.decontaminate import word_hashes

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SHARD_TOKENS = 1 << 22
#: Bytes of text that a task encodes at a time.
SLICE = 1 << 23
#: Bits between two stored ranks.
RANK_STEP = 512
#: Words in a generation of each worker's cache.
CACHE = 100_000
#: Pieces that each worker keeps from one slice to the next, and bits of the table that finds them.
PIECES, TABLE_BITS = 1_000_000, 22
#: Places of the table that are looked at for a piece.
PROBES = 8
#: ASCII letters, digits, signs and line ends: the tokenizer cuts wherever one of these kinds meets another, if a line end
#: stands alone. An apostrophe may be part of what follows.
KIND = np.array([4 if c == 10 else 0 if c <= 32 or c >= 127 or c == 39 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)


class WaveletMatrix:
    """A sequence of ids as one bit-plane per bit, the highest first; each plane is followed by a stable sort on its bit."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        zeros, planes, ranks, now = [], [], [], ids
        for level in range(bits - 1, -1, -1):
            bit = (now >> ids.dtype.type(level)) & ids.dtype.type(1)
            one = bit.view(bool) if ids.itemsize == 1 else bit.astype(bool)
            packed = np.packbits(one, bitorder="little")
            steps = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), RANK_STEP // 8), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
            zeros.append(int(len(one) - steps.sum()))
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(steps)]).astype("<u4").tobytes())
            now = np.concatenate([now[~one], now[one]])
        return cls(len(ids), zeros, planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Set bits of the plane before i."""
        step = i // RANK_STEP
        part = self.planes[level][step * RANK_STEP // 8 : (i + 7) // 8]
        more = int(np.bitwise_count(part).sum())
        if i & 7:
            more -= (int(part[-1]) >> (i & 7)).bit_count()
        return int(self.ranks[level][step]) + more

    def access(self, i: int) -> int:
        """The id at i."""
        value = 0
        for level, z in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value, i = value << 1 | bit, z + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        for level, z in enumerate(self.zeros):
            a1, b1 = self._ones(level, a), self._ones(level, b)
            a, b = (z + a1, z + b1) if value >> (len(self.zeros) - 1 - level) & 1 else (a - a1, b - b1)
        return a, b

    def rank(self, value: int, i: int) -> int:
        """How often value occurs before i."""
        if value >> len(self.zeros):
            return 0
        a, b = self._range(value, i)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Where the plane's k-th (from 0) set or clear bit is."""
        lo, hi = 0, len(self.ranks[level]) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            ones = int(self.ranks[level][mid])
            lo, hi = (mid, hi) if (ones if bit else mid * RANK_STEP - ones) <= k else (lo, mid - 1)
        seen = int(self.ranks[level][lo])
        part = np.unpackbits(self.planes[level][lo * RANK_STEP // 8 : (lo + 1) * RANK_STEP // 8], bitorder="little")
        return lo * RANK_STEP + int(np.flatnonzero(part == bit)[k - (seen if bit else lo * RANK_STEP - seen)])

    def select(self, value: int, k: int) -> int:
        """Where value occurs for the k-th time, from 0; -1 if it doesn't."""
        if k >= self.count(value):
            return -1
        i = self._range(value, 0)[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, by undoing the sorts from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            before = np.empty_like(now)
            z = self.zeros[level]
            before[~one] = now[:z]
            before[one] = now[z:] | now.dtype.type(1 << (len(self.zeros) - 1 - level))
            now = before
        return now


class _Cache(dict):
    """What was made before. When full it becomes the older generation, from which what is still asked for comes back."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Odd(Exception):
    """A piece that white space touches: the text can't be cut there."""


def _eight(data: bytes) -> np.ndarray:
    """The 8 bytes at each place of data, as one integer."""
    return np.ndarray((len(data) + 1,), "<u8", np.frombuffer(data + bytes(8), np.uint8), strides=(1,))


def _same(data: bytes, start: np.ndarray, end: np.ndarray, other: bytes, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each piece data[start:end] has the bytes of the piece beside it, other[other_start:other_end]."""
    x, y, n = _eight(data), _eight(other), end - start
    ok = n == other_end - other_start
    i = np.flatnonzero(ok)
    for at in range(0, 64, 8):  # 8 bytes of each piece at a time
        spare = (np.maximum(0, 8 + at - n[i]) * 8).astype(np.uint64)
        ok[i] = (x[start[i] + at] ^ y[other_start[i] + at]) << spare == 0
        i = i[n[i] > at + 8]
    for j in i[ok[i]].tolist():
        ok[j] = data[start[j] : end[j]] == other[other_start[j] : other_end[j]]
    return ok


class _Pieces:
    """Pieces that were encoded before, in columns: hash, whether a blank goes before, bytes and ids end to end; found by a table of hashes."""

    def __init__(self, dtype: np.dtype):
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.hashed, self.blank = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.text, self.text_ends = b"", np.zeros(1, np.int64)
        self.ids, self.ids_ends = np.zeros(0, dtype), np.zeros(1, np.int64)

    def _slot(self, hashed: np.ndarray) -> np.ndarray:
        return (hashed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, hashed: np.ndarray, blank: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of each piece data[start:end], which has the same bytes; -1 if none is found."""
        row = np.full(len(hashed), -1)
        slot, left = self._slot(hashed), np.arange(len(hashed))
        for probe in range(PROBES if len(self.hashed) else 0):
            met = self.table[slot[left] + probe & len(self.table) - 1].astype(np.int64)
            hit = (met >= 0) & (self.hashed[met] == hashed[left])
            row[left[hit]] = met[hit]
            left = left[~hit & (met >= 0)]
        at = np.flatnonzero(row >= 0)
        met = row[at]
        same = _same(data, start[at], end[at], self.text, self.text_ends[met], self.text_ends[met + 1])
        row[at[~same | (self.blank[met] != blank[at])]] = -1
        return row

    def add(self, hashed: np.ndarray, blank: np.ndarray, pieces: list[bytes], codes: list[bytes]) -> np.ndarray:
        """The rows that the pieces get. One for which the table has no place isn't found later."""
        rows = np.arange(len(pieces)) + len(self.hashed)
        slot, left = self._slot(hashed), np.arange(len(rows))
        for probe in range(PROBES):
            at = slot[left] + probe & len(self.table) - 1
            free = self.table[at] < 0
            self.table[at[free]] = rows[left[free]]
            left = left[self.table[at] != rows[left]]
        self.hashed, self.blank = np.concatenate([self.hashed, hashed]), np.concatenate([self.blank, blank])
        self.text += b"".join(pieces)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(codes), self.ids.dtype)])
        self.text_ends = np.append(self.text_ends, self.text_ends[-1] + np.cumsum([len(p) for p in pieces], dtype=np.int64))
        self.ids_ends = np.append(self.ids_ends, self.ids_ends[-1] + np.cumsum([len(c) // self.ids.itemsize for c in codes], dtype=np.int64))
        return rows


class Encoder:
    """The tokenizer's ids of a text, as packed little-endian integers.

    Pre-tokens of this byte-level BPE never reach past a single space between
    two other characters, so a text is cut there and what was encoded before is
    looked up. Texts that hold the special token's string go to the tokenizer whole.
    """

    LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
    #: Characters for which the pattern below splits as the tokenizer does.
    PLAIN = re.compile(rf"[\x21-\x7e\n {LETTER[6:]}]+")
    SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")
    CUT = re.compile(r"(?<=\S)(?= \S)")
    #: Where any text can be cut, also one with special tokens or odd white space elsewhere.
    SAFE = re.compile(r"(?<=[^\W_])(?= [^\W_])")

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = [m.encode() for m in ("᠎", *self.special)]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes these bytes as themselves
        rest = [b for b in range(256) if b not in printed]
        self.bytes = {**{b: b for b in printed}, **{b: 256 + i for i, b in enumerate(rest)}}
        self.blank, self.code = chr(self.bytes[32]), "H" if self.bits <= 16 else "I"
        self.word = _Cache(self._word)
        self.pieces = _Pieces(self.dtype)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _word(self, word: str) -> bytes:
        known = word.replace(" ", self.blank) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.bytes)
        return self._pack([t.id for t in self.model.tokenize(known)])

    def _segment(self, text: str) -> bytes:
        if self.PLAIN.fullmatch(text):
            return b"".join(map(self.word.__getitem__, self.SPLIT.findall(text)))
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str, before: str = "") -> bytes:
        if piece.isalpha() and (piece.isascii() or max(piece) <= "ɏ"):  # one word
            return self.word[before + piece]
        head = piece[:-1]
        if head.isalpha() and piece[-1] in ".," and (head.isascii() or max(head) <= "ɏ"):
            return self.word[before + head] + self.word[piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Odd
        return self._segment(before + piece)

    def _new(self, piece: str, before: str) -> bytes:
        """A piece that isn't known yet; its own words needn't be kept twice."""
        return self._word(before + piece) if piece == "\n" or piece.isascii() and piece.isalpha() else self._piece(piece, before)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "᠎" in text or any(s in text for s in self.special):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = text.split(" ")
        try:
            return b"".join(chain([self._piece(pieces[0])], (self._piece(p, " ") for p in pieces[1:])))
        except _Odd:
            return b"".join(map(self._segment, self.CUT.split(text)))

    def long(self, text: str) -> bytes:
        """What the call gives, in parts of some SLICE characters."""
        parts, at = [], 0
        while at < len(text):
            cut = self.SAFE.search(text, at + SLICE)
            end = cut.start() if cut else len(text)
            parts.append(self(text[at:end]))
            at = end
        return b"".join(parts)

    def batch(self, texts: list[str]) -> list[bytes]:
        """What the call gives for each text, with one look-up for each distinct piece that no batch before had.

        Pieces go from blank to blank, and are cut where kinds of ASCII characters meet.
        They are found by a 64-bit hash and compared byte by byte with the first of
        that hash; where they disagree, or a text isn't plain, the text is encoded alone.
        """
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        odd = np.array([not d or any(m in d for m in self.marks) for d in data])
        b = np.frombuffer(b" ".join(data), np.uint8)
        begins = np.cumsum([0, *(len(d) + 1 for d in data)])[:-1]
        blank = b == 32
        twice = np.flatnonzero(blank[1:] & blank[:-1])
        odd[np.searchsorted(begins, np.concatenate([twice, twice + 1, twice + 2]), "right") - 1] = True
        if len(b) and blank[0]:
            odd[0] = True
        if len(b) and blank[-1]:
            odd[-1] = True
        kind = KIND[b]
        line = np.flatnonzero(kind == 4)
        beside = np.append(kind, 0)
        kind[line[(beside[line - 1] % 4 == 0) | (beside[line + 1] % 4 == 0)]] = 0
        inner = 1 + np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0))
        joined = np.insert(b, inner, 32).tobytes()  # a blank that isn't the text's own at each inner cut
        begins += np.searchsorted(inner, begins)
        hashed, start = word_hashes(joined)
        if not len(start):
            return [self(t) for t in texts]
        end = np.append(start[1:] - 1, len(joined))  # exact for all but odd texts
        doc = np.searchsorted(begins, start, "right") - 1
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        own = np.ones(len(joined) + 1, bool)  # whether a piece after this place has a blank of the text before it
        own[inner + np.arange(len(inner))] = False
        own = own[start - 1]
        own[cuts[:-1][cuts[:-1] < cuts[1:]]] = False
        hashed = np.where(own, hashed, ~hashed)
        if len(self.pieces.hashed) > PIECES:
            self.pieces = _Pieces(self.dtype)
        row = self.pieces.find(hashed, own, joined, start, end)
        new = np.flatnonzero(row < 0)
        _, first, where = np.unique(hashed[new], return_index=True, return_inverse=True)
        first = new[first]
        codes: list[bytes | None] = []
        found = [joined[a:e].rstrip(b" ") for a, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        for piece, before in zip(found, own[first].tolist(), strict=True):
            try:
                codes.append(self._new(piece.decode("utf-8", "surrogatepass"), " " if before else ""))
            except _Odd:
                codes.append(None)
        plain = np.array([c is not None for c in codes], bool)
        rows = np.full(len(first), -1)
        rows[plain] = self.pieces.add(hashed[first[plain]], own[first[plain]], [p for p, c in zip(found, codes, strict=True) if c is not None], [c for c in codes if c is not None])
        like = first[where]
        row[new] = np.where(_same(joined, start[new], end[new], joined, start[like], end[like]) & (own[new] == own[like]), rows[where], -1)
        odd[doc[row < 0]] = True
        began = self.pieces.ids_ends[row]
        n = np.where(row < 0, 0, self.pieces.ids_ends[row + 1] - began)
        ends = np.append(0, np.cumsum(n))
        all_ = self.pieces.ids[np.repeat(began - ends[:-1], n) + np.arange(ends[-1])]
        return [self(text) if odd[i] else all_[ends[cuts[i]] : ends[cuts[i + 1]]].tobytes() for i, text in enumerate(texts)]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One for each Python worker, with its caches."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(encode: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, packed ids) in order, of some SLICE bytes of text at a time."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            if len(text := text.as_py()) > SLICE:
                yield from zip(ids, encode.batch(texts) if texts else [], strict=True)
                ids, texts, size = [], [], 0
                yield doc_id, encode.long(text)
                continue
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= SLICE:
                yield from zip(ids, encode.batch(texts), strict=True)
                ids, texts, size = [], [], 0
    yield from zip(ids, encode.batch(texts) if texts else [], strict=True)


SHARD = "part int, shard int, n long, doc_ids array<long>, lengths array<long>, zeros array<long>, planes array<binary>, ranks array<binary>"


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode docs in ascending order of doc_id (null first) and write the shards; returns them as read back.

    A shard is a compressed Parquet file of one row in the shared folder: the ids of whole
    documents, each with END_ID after it, until there are shard_tokens or more,
    as a wavelet matrix. `part` and `shard` give the order of shards. A range
    partition holds each document's text, so nothing passes through one task;
    a task holds one Arrow batch and one shard. path names a tokenizer file that
    every executor has; by default that of the installed package.
    """
    ordered = id_text(docs, id_col, text_col).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "lengths", "zeros")), *((c, pa.list_(pa.binary())) for c in ("planes", "ranks"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part, shard = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        packed: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(packed), encode.dtype)
            m = WaveletMatrix.build(tokens, encode.bits)
            row = {"part": part, "shard": shard, "n": m.n, "doc_ids": ids, "lengths": [len(p) // encode.dtype.itemsize for p in packed], "zeros": m.zeros, "planes": [p.tobytes() for p in m.planes], "ranks": [r.tobytes() for r in m.ranks]}
            return pa.RecordBatch.from_pylist([row], schema)

        for doc_id, code in encoded(encode, batches):
            ids.append(doc_id)
            packed.append(code + encode.end)
            held += len(packed[-1]) // encode.dtype.itemsize
            if held >= shard_tokens:
                yield full()
                ids, packed, held, shard = [], [], 0, shard + 1
        if ids:
            yield full()

    return materialise(ordered.mapInArrow(run, SHARD), "token-shards", compression="zstd", maxRecordsPerFile="1")


def matrix(row) -> WaveletMatrix:
    """The wavelet matrix of one row of write_shards()."""
    return WaveletMatrix(row["n"], list(row["zeros"]), list(row["planes"]), list(row["ranks"]))


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32.

    Every shard is decoded from its planes. start counts the ids of all
    documents before it, in the order of shards; for that, only one sum per
    range partition meets in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("part", "shard", "n", "doc_ids", "lengths", "zeros", "planes", "ranks")}
                data = matrix(row).decode().astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crc = [zlib.crc32(memoryview(data)[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * k, pa.int32()), pa.array([row["shard"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = shards.mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "shard", "n")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard_start = sizes.select("part", "shard", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_start = sizes.groupBy("part").agg(F.sum("n").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_parts"))
    starts = shard_start.join(part_start, "part").select("part", "shard", (F.col("_in_part") + F.col("_parts")).alias("_start"))
    return found.join(starts, ["part", "shard"]).select("doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs as shards, read them back: one row per row of docs, with doc_id, start, n_tokens and ids_crc32.

    A null or empty text has END_ID only. Null ids come first; rows that repeat
    an id stand together, in the order of a hash of their texts. No rows give no
    rows; other columns are not read. A text that is larger than a shard makes a
    larger shard.
    """
    return read_documents(write_shards(docs, id_col, text_col, path, shard_tokens))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"))
