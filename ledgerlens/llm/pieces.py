"""Exact piece encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_text, table

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a blank in pieces.
MARK = "▁"
#: What the library decodes the unknown piece to.
UNKNOWN = " ⁇ ".encode()
#: Words that are encoded, and words that are put together, at a time.
WORDS, SLICE = 50_000, 1 << 22
#: Words and pairs of pieces that each worker remembers, about, before it starts anew.
CACHE, PAIRS = 700_000, 2_000_000
#: In place of an id: a character that no piece holds.
NONE = -1


def model_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return path


class _Index(dict):
    """A number for each different word; new ones are also listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class PieceEncoder:
    """The ids that a piece model of merges gives a text, without running its merges over the text.

    The model merges neighbours of best score first, the leftmost of equals. A
    sequence of pieces is its result if and only if every two neighbours stay as they
    are when their own text is merged alone: the first merge across a border would
    come in the pair as well, since the order of merges within two neighbours doesn't
    depend on the others. So pieces are laid down by longest match, each is held
    against the one before by re-merging the two (once for each pair of pieces),
    and where none fits the last piece is taken back for a shorter one; a bit for each place
    remembers that no sequence goes on from there.
    """

    def __init__(self, path: str | None = None):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        size = range(model.get_piece_size())
        special = {i for i in size if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.end = model.eos_id()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in size if model.is_byte(i)}
        self.text = [model.id_to_piece(i) for i in size]
        self.score = {self.text[i]: model.get_score(i) for i in size if i not in special and not model.is_byte(i)}
        self.id = {self.text[i]: i for i in size if self.text[i] in self.score}
        if len(self.bytes) < 256 or any(MARK in p.lstrip(MARK) for p in self.score) or any(c not in self.id for p in self.score for c in p):
            raise ValueError("not a model of merges with bytes for other characters and blanks only before words")
        self.skip = {i for i in size if model.is_control(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        # pieces that merges never make are no matches
        made = {p for p in self.score if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in made:
            self.automaton.add_word(p, (self.id[p], len(p)))
        self.automaton.make_automaton()
        # by id; the last place is that of a character that no piece holds, NONE
        self.length = [*map(len, self.text), 1]
        self.shorter = [*(next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in made), None) if p in made else None for p in self.text), None]
        self.fits: list[dict[int, bool]] = [{} for _ in self.length]
        self.tried = 0
        self.index = _Index()
        self.codes, self.sizes_of, self.begins_of, self.filled = np.zeros(1 << 16, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        data = [b"" if i in self.skip else UNKNOWN if i == model.unk_id() else bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(MARK, " ").encode() for i, p in enumerate(self.text)]
        self.flat = np.frombuffer(b"".join(data), np.uint8)
        self.sizes = np.array([len(d) for d in data], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score first, the leftmost of equals."""
        at = list(text)
        after, before = [*range(1, len(at) + 1)], [*range(-1, len(at) - 1)]
        live = [(-self.score[a + b], i, a, b) for i, (a, b) in enumerate(zip(at, at[1:])) if a + b in self.score]
        heapify(live)
        while live:
            _, i, a, b = heappop(live)
            j = after[i] if at[i] == a else len(at)
            if j == len(at) or at[j] != b:
                continue
            at[i], at[j], after[i] = a + b, "", after[j]
            if after[i] < len(at):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(at) and at[x] + at[y] in self.score:
                    heappush(live, (-self.score[at[x] + at[y]], x, at[x], at[y]))
        return [p for p in at if p]

    def fit(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their text is merged."""
        known = self.fits[left].get(right)
        if known is None:
            if self.tried >= PAIRS:
                for row in self.fits:
                    row.clear()
                self.tried = 0
            self.tried += 1
            known = self.fits[left][right] = NONE in (left, right) or self.merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
        return known

    def backtrack(self, text: str) -> list[int]:
        """The ids of a text (blanks as MARK); a character that no piece holds stands for its bytes."""
        n, length, shorter, fits = len(text), self.length, self.shorter, self.fits
        longest = [NONE] * n
        for stop, (piece, size) in self.automaton.iter(text):  # in the order of ends, so the longest of a place comes last
            longest[stop - size + 1] = piece
        dead = bytearray(n // 8 + 1)
        pieces: list[int] = []
        at, piece = 0, longest[0] if n else None
        while at < n:
            while piece is not None:
                stop = at + length[piece]
                if not dead[stop >> 3] >> (stop & 7) & 1:
                    if not pieces:
                        break
                    fit = fits[pieces[-1]].get(piece)
                    if fit or fit is None and self.fit(pieces[-1], piece):
                        break
                piece = shorter[piece]
            if piece is not None:
                pieces.append(piece)
                at = stop
                piece = longest[at] if at < n else None
            else:
                dead[at >> 3] |= 1 << (at & 7)
                piece = pieces.pop()  # there is a sequence, so this never runs out
                at -= length[piece]
        if NONE not in pieces:
            return pieces
        found, at = [], 0
        for piece in pieces:
            found += [piece] if piece != NONE else [self.bytes[b] for b in text[at].encode("utf-8", "surrogatepass")]
            at += length[piece]
        return found

    def words(self, words: list[str]) -> list[bytes]:
        """Packed ids of texts that each begin with MARK, followed by no other word.

        The longest matches of all words are found in one run; where all neighbours fit, they
        are the result. Only the other words are gone through one by one.
        """
        joined = "".join(words)
        hits = list(self.automaton.iter_long(joined))
        ends = np.array([e for e, _ in hits], np.int64) + 1
        ids, sizes = (np.array([v[k] for _, v in hits], np.int64) for k in (0, 1))
        begins = np.cumsum([0, *map(len, words)])
        of = np.searchsorted(begins, ends - sizes, "right") - 1
        # a word is plain if its matches leave no character out and every two neighbours fit
        plain = np.bincount(of, sizes, len(words)) == np.diff(begins)
        inner = np.flatnonzero((of[1:] == of[:-1]) & plain[of[1:]]) if len(of) else np.zeros(0, np.int64)
        pairs, where = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
        fit = np.fromiter((self.fit(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()), bool, len(pairs))
        plain[of[inner[~fit[where]]]] = False
        packed, cuts = ids.astype("<u4").tobytes(), np.searchsorted(of, np.arange(len(words) + 1)) * 4
        cut = cuts.tolist()
        out = []
        for i, ok in enumerate(plain.tolist()):
            out.append(packed[cut[i] : cut[i + 1]] if ok else np.array(self.backtrack(words[i]), "<u4").tobytes())
        return out

    #: Where a word begins: at a blank after something else. No piece reaches over such a place.
    WORD = re.compile(f"(?<=[^{MARK}])(?={MARK})")

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without the end id. Words that were met before are looked up."""
        index = self.index
        if len(index) > CACHE:
            index.clear()
            self.sizes_of, self.begins_of, self.filled = self.sizes_of[:0], self.begins_of[:0], 0
        rows = []
        for text in texts:
            if not text:
                words = []
            elif "  " in text or MARK in text or text[-1] == " " or text[0] == " ":
                words = self.WORD.split((MARK + text).replace(" ", MARK))
            else:
                words = text.split(" ")  # without their marks, which no other word is
            rows.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
        new = index.new
        for at in range(0, len(new), WORDS):
            codes = self.words([k if k[:1] == MARK else MARK + k for k in new[at : at + WORDS]])
            sizes = np.array([*map(len, codes)], np.int64) // 4
            more = np.frombuffer(b"".join(codes), "<u4")
            if self.filled + len(more) > len(self.codes):
                self.codes = np.concatenate([self.codes[: self.filled], np.zeros(self.filled + 2 * len(more), "<u4")])
            self.codes[self.filled : self.filled + len(more)] = more
            self.begins_of = np.append(self.begins_of, self.filled + np.cumsum(sizes) - sizes)
            self.sizes_of = np.append(self.sizes_of, sizes)
            self.filled += len(more)
        index.new = []
        out = []
        for where in rows:
            n = self.sizes_of[where]
            ends = np.cumsum(n)
            out.append(self.codes[np.repeat(self.begins_of[where] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes, marks as blanks, without the mark that was put before the text and control ids."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return ""
        data = self.flat[np.repeat(self.begins[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()
        first = int(ids[np.flatnonzero(n)[0]])
        data = data[first not in self.of_byte and self.text[first][0] == MARK :]
        inner = np.flatnonzero(n == 0)
        if len(inner) < 2 and (not len(inner) or inner[0] == len(ids) - 1):
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        return self._decode_runs(ids.tolist())

    def _decode_runs(self, ids: list[int]) -> str:
        """As the library does for bytes that are no characters: each is one mark of replacement; a control id ends a run of bytes."""
        out, run, held = [], bytearray(), True
        for i in [*ids, self.end]:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:k]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("\ufffd")
                    k = 1
                del run[:k]
                held = False
            if i not in self.skip:
                piece = self.text[i] if self.text[i] in self.score else UNKNOWN.decode()
                out.append(piece[held and piece[0] == MARK :].replace(MARK, " "))
                held = False
        return "".join(out)


_encoders: dict[str | None, PieceEncoder] = {}


def encoder(path: str | None) -> PieceEncoder:
    """One for each Python worker, with its words."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


#: Where a long text can be cut: the blank goes, since one is put before every part.
CUT = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


def parts(text: str, size: int) -> Iterator[str]:
    """A long text in parts of some `size` characters; a text without blanks stays whole."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, ids (array of int), the piece model's ids of the whole text and, with `end`, its end id.

    A null or empty text has the end id only. Null ids and repeated rows are rows
    like others. No rows give no rows; other columns are not read. A task holds one slice
    of texts and the words it has met lately. path names a model file that every
    executor has; by default that of the installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        last = np.array([e.end] * end, "<u4")
        held: list[int | None] = []
        texts: list[str] = []

        def told(codes: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.cumsum([0, *(len(c) + len(last) for c in codes)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([x for c in codes for x in (c, last)]).view("<i4")))
            return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), ids], ["doc_id", "ids"])

        size = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if len(text := text.as_py()) > SLICE:
                    if held:
                        yield told(e.batch(texts))
                    held, texts, size = [doc_id], [], 0
                    yield told([np.concatenate([e.batch([part])[0] for part in parts(text, SLICE)])])
                    held = []
                    continue
                held.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= SLICE:
                    yield told(e.batch(texts))
                    held, texts, size = [], [], 0
        if held:
            yield told(e.batch(texts))

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with a column `decoded`: the text of the ids, as the piece model's library gives it. Null ids give a null text."""
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = b.column(kept.index(ids_col))
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                texts = [None if i is None else e.decode(np.asarray(i, np.int64)) for i in (x.values.to_numpy() if x.is_valid else None for x in ids.slice(at, 256))]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, "decoded"])

    return encoded.select(*kept).mapInArrow(run, schema.add("decoded", "string"))


def op13_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decode(encode(table(spark, sf_dir, "documents")))
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
