"""Secrets in texts: fixed patterns, and a linear-chain conditional random field for what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import draw, id_text, table

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is found whole
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

B, I, O = 0, 1, 2
#: At most this many rows are learnt from, those with the least hash of id, and this many lines of them, each a stretch of so many characters.
TRAIN_ROWS, TRAIN_LINES, TRAIN_CHARS = 1500, 4000, 300
#: The share of lines without a secret that get a made-up one.
PLANTED = 0.3
#: Bytes of text that a task works on at a time.
SLICE = 1 << 19
NEAR = 1 << 12


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, leftmost and without overlaps within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _hex(text)]
    return sorted(out)


_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True


def _hex(text: str) -> Iterator[re.Match]:
    """HEX.finditer, unless no run can be there: one of 24 covers some multiple of 12 and the place 12 after it."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)[::12]
    is_hex = _HEX_BYTES[data]
    return HEX.finditer(text) if (is_hex[1:] & is_hex[:-1]).any() else iter(())


# Classes of bytes: upper, lower, digit, inner symbol, beyond ASCII; these make
# tokens. Other printed characters are tokens of their own.
_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"+/_-.", bytes(range(128, 256))), 1):
    _CLASS[list(_set)] = _i
_CLASS[[c for c in range(33, 127) if _CLASS[c] == 0]] = 6
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouAEIOU")] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

#: Offsets of the feature blocks in the weight table.
_SIZES = {"length": 12, "classes": 64, "turns": 8, "vowels": 8, "digits": 8, "shape": 64, "before": NEAR, "before2": NEAR, "after": NEAR, "tail": 8, "numbers": 8, "file_digits": 8, "file_symbols": 8, "file_length": 16, "bias": 1}
_AT = dict(zip(_SIZES, np.cumsum([0, *_SIZES.values()]).tolist(), strict=False))
FEATURES = sum(_SIZES.values())


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return np.minimum(x, n - 1).astype(np.int64)


def file_counts(data: bytes) -> tuple[int, int, int]:
    """Digits, symbols and bytes of a whole text, for the file features of its tokens."""
    c = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7)
    return int(c[3]), int(c[6]), len(data)


def tokens(data: bytes, begins: np.ndarray, files: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, line and features (tokens x features, as rows of the weight table) of texts laid end to end.

    begins: where each text begins. A line is what stands between newlines.
    files: file_counts() of the text that each is a part of, a row each; by default each is whole.
    """
    b = np.frombuffer(data, np.uint8)
    c = _CLASS[b]
    inner = (c > 0) & (c < 6)
    first = (c == 6) | (inner & ~np.concatenate([[False], inner[:-1]]))
    start = np.flatnonzero(first)
    if not len(start):
        return start, start, start, np.zeros((0, len(_SIZES)), np.int64)
    final = (c == 6) | (inner & ~np.concatenate([inner[1:], [False]]))
    end = np.flatnonzero(final) + 1
    sums = {k: np.concatenate([[0], np.cumsum(v, dtype=np.int32)]) for k, v in {**{i: c == i for i in range(1, 7)}, "v": _VOWEL[b], "t": np.concatenate([[False], c[1:] != c[:-1]]), "line": b == 10}.items()}
    n = end - start
    count = {k: sums[k][end] - sums[k][start] for k in (*range(1, 7), "v")}
    turns = sums["t"][end] - sums["t"][start + 1]
    # words by a sum of their lower-cased bytes, position by position, up to 8 bytes and the length
    word = n.astype(np.uint64)
    low = _LOWER[b].astype(np.uint64)
    for k in range(8):
        word = np.where(k < n, (word ^ low[np.minimum(start + k, len(b) - 1)]) * np.uint64(0x100000001B3), word)
    word ^= word >> np.uint64(23)
    word = (word % np.uint64(NEAR)).astype(np.int64)
    line = sums["line"][start].astype(np.int64)
    text = np.searchsorted(begins, start, "right") - 1
    line = line + text  # a text's end also ends the line
    same1, same2 = np.concatenate([[False], line[1:] == line[:-1]]), np.concatenate([[False, False], line[2:] == line[:-2]])[: len(line)]
    none = np.zeros(len(word), np.int64)
    before, before2, after = none.copy(), none.copy(), none.copy()
    before[1:][same1[1:]] = word[:-1][same1[1:]]
    before2[2:][same2[2:]] = word[:-2][same2[2:]]
    after[:-1][same1[1:]] = word[1:][same1[1:]]
    if files is None:
        bounds = np.append(begins, len(b))
        files = np.stack([*(sums[k][bounds[1:]] - sums[k][bounds[:-1]] for k in (3, 6)), np.diff(bounds)], 1)
    long = np.maximum(1, files[:, 2])
    share = {k: (files[:, i].astype(np.int64) * 40 // long)[text] for i, k in enumerate((3, 6))}
    masks = sum(((count[k] > 0).astype(np.int64) << (k - 1)) for k in range(1, 7))
    columns = {
        "length": _bucket(np.where(n < 8, n, 3 + np.log2(n) * 5 / 3), 12), "classes": masks, "turns": _bucket(turns, 8),
        "vowels": _bucket(count["v"] * 8 // n, 8), "digits": _bucket(count[3] * 8 // n, 8),
        "shape": _bucket(np.log2(n).astype(np.int64), 8) * 8 + _bucket(turns * 8 // n, 8),
        "before": before, "before2": before2, "after": after, "tail": c[end - 1].astype(np.int64),
        # of a token of digits and inner symbols alone, its parts, as of an address or a date
        "numbers": np.where((count[3] > 0) & (count[1] + count[2] + count[5] == 0), _bucket(1 + count[4], 8), 0),
        "file_digits": _bucket(share[3], 8), "file_symbols": _bucket(share[6], 8), "file_length": _bucket(np.log2(long)[text], 16), "bias": none,
    }
    return start, end, line, np.stack([columns[k] + _AT[k] for k in _SIZES], 1)


@dataclass
class Crf:
    weight: np.ndarray  # FEATURES x 3
    step: np.ndarray  # 3 x 3, from a tag to the next; -inf where it can't follow
    first: np.ndarray  # 3

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3), np.float32)
        for k in range(features.shape[1]):
            out += self.weight[features[:, k]]
        return out

    def viterbi(self, e: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best tags of each line. Lines where no token could gain by not being outside are left out of the recursion."""
        tags = np.full(len(e), O)
        if not len(e):
            return tags
        gain = max(0.0, float(np.max(self.step[np.isfinite(self.step)]) - self.step[O, O]), float(self.first[B] - self.first[O])) + max(0.0, float(self.step[:2, O].max() - self.step[O, O]))
        live = np.maximum(e[:, B], e[:, I]) - e[:, O] + gain > 0
        if not live.any():
            return tags
        at = np.flatnonzero(np.isin(line, np.unique(line[live])))
        own = line[at]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        lengths = np.diff(np.append(starts, len(own)))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = at[starts[order]], lengths[order]
        score = e[starts] + self.first
        back = []
        for t in range(1, lengths[0]):
            k = int(np.searchsorted(-lengths, -t, "left"))  # lines longer than t
            ways = score[:k, :, None] + self.step[None]
            back.append(ways.argmax(1).astype(np.int8))
            score[:k] = ways.max(1) + e[starts[:k] + t]
        last = score.argmax(1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            k = int(np.searchsorted(-lengths, -t, "left"))
            tags[starts[:k] + t] = last[:k]
            if t:
                last[:k] = back[t - 1][np.arange(k), last[:k]]
        return tags

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) in code points of what is tagged in each text. A text is worked on in slices of lines, or of words where a line is longer than that."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        held: list[tuple[int, int, bytes, tuple[int, int, int]]] = []  # text, code points before, bytes, file counts
        size = 0

        def work() -> None:
            begins = np.cumsum([0, *(len(d) + 1 for _, _, d, _ in held)])[:-1]
            start, end, line, features = tokens(b"\n".join(d for _, _, d, _ in held), begins, np.array([f for *_, f in held]))
            tags = self.viterbi(self.emissions(features), line)
            heads = np.flatnonzero(tags == B)
            for h in heads.tolist():
                t = h + 1
                while t < len(tags) and tags[t] == I and line[t] == line[h]:
                    t += 1
                k = int(np.searchsorted(begins, start[h], "right")) - 1
                i, before, own, _ = held[k]
                a, b = int(start[h] - begins[k]), int(end[t - 1] - begins[k])
                while b > a + 1 and own[b - 1] in b".,":
                    b -= 1
                b += len(own[b : b + 2]) - len(own[b : b + 2].lstrip(b"="))  # the filling of base64
                p = before + len(own[:a].decode("utf-8", "surrogatepass"))
                out[i].append((p, p + len(own[a:b].decode("utf-8", "surrogatepass"))))

        for i, text in enumerate(texts):
            data, before = text.encode("utf-8", "surrogatepass"), 0
            counts = file_counts(data)
            while data:
                part, data = _cut(data)
                if size and size + len(part) > SLICE:
                    work()
                    held, size = [], 0
                held.append((i, before, part, counts))
                size += len(part) + 1
                before += len(part.decode("utf-8", "surrogatepass")) if data else 0
        if held:
            work()
        return out


def _cut(data: bytes) -> tuple[bytes, bytes]:
    """SLICE bytes or less, up to the end of a line, or else of a word; a word that is longer stays whole."""
    if len(data) <= SLICE:
        return data, b""
    end = data.rfind(b"\n", 0, SLICE) + 1 or data.rfind(b" ", 0, SLICE) + 1 or data.find(b" ", SLICE) + 1 or len(data)
    return data[:end], data[end:]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def train(features: np.ndarray, line: np.ndarray, tags: np.ndarray, epochs: int = 40, rate: float = 0.15) -> Crf:
    """Maximum likelihood by forward-backward over lines padded to a matrix, with Adam and a small ridge."""
    never = np.array([[0, 0, 0], [0, 0, 0], [0, -np.inf, 0]])  # outside is never followed by inside
    weight = np.zeros((FEATURES, 3))
    weight[_AT["bias"]] = [-3, -3, 3]
    step, first = np.zeros((3, 3)), np.zeros(3)
    crf = Crf(weight.astype(np.float32), step + never, np.array([0, -np.inf, 0]))
    if not len(tags):
        return crf
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    lengths = np.diff(np.append(starts, len(line)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n, long = len(starts), int(lengths[0])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weight, step, first)]
    truth = np.zeros((len(tags), 3))
    truth[np.arange(len(tags)), tags] = 1
    for epoch in range(1, epochs + 1):
        e = np.zeros((len(tags), 3))
        for k in range(features.shape[1]):
            e += weight[features[:, k]]
        s, f = step + never, first + np.array([0, -np.inf, 0])
        ahead = np.zeros((len(tags), 3))
        ahead[starts] = e[starts] + f
        live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(long)]
        for t in range(1, long):
            k = live[t]
            ahead[starts[:k] + t] = _logsum(ahead[starts[:k] + t - 1][:, :, None] + s, 1) + e[starts[:k] + t]
        behind = np.zeros((len(tags), 3))
        total = np.zeros(n)
        g_step = np.zeros((3, 3))
        ends = starts + lengths - 1
        total = _logsum(ahead[ends], 1)
        for t in range(long - 1, 0, -1):
            k = live[t]
            at = starts[:k] + t
            joint = ahead[at - 1][:, :, None] + s + (e[at] + behind[at])[:, None, :]
            behind[at - 1] = _logsum(s + (e[at] + behind[at])[:, None, :], 2)
            g_step += np.exp(joint - total[:k, None, None]).sum(0)
        lines = np.repeat(np.arange(n), lengths)
        flat = np.concatenate([np.arange(a, a + m) for a, m in zip(starts, lengths, strict=True)])
        p = np.zeros((len(tags), 3))
        p[flat] = np.exp(ahead[flat] + behind[flat] - total[lines][:, None])
        d = p - truth
        g_weight = np.stack([np.bincount(features.ravel(), np.repeat(d[:, j], features.shape[1]), FEATURES) for j in range(3)], 1)
        pairs = np.zeros((3, 3))
        inside = line[1:] == line[:-1]
        np.add.at(pairs, (tags[:-1][inside], tags[1:][inside]), 1)
        grads = (g_weight + 0.5 * weight, g_step - pairs + 0.5 * step, d[starts].sum(0) + 0.5 * first)
        for param, grad, (m, v) in zip((weight, step, first), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            param -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-6)
    return Crf(weight.astype(np.float32), step + never, first + np.array([0, -np.inf, 0]))


def _made(rng: np.random.Generator) -> str:
    """A made-up secret, of one of the common shapes."""
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    body = lambda n: "".join(rng.choice(list(alphabets[rng.integers(len(alphabets))]), n))
    kind = rng.integers(4)
    if kind == 0:
        return ("sk_", "pk-", "ghp_", "xoxb-", "key-")[rng.integers(5)] + body(int(rng.integers(16, 40)))
    if kind == 1:
        return ".".join(body(int(rng.integers(12, 40))) for _ in range(3))
    return body(int(rng.integers(10, 64) if rng.random() < 0.7 else rng.integers(9, 16)))


def _harmless(rng: np.random.Generator, words: list[str]) -> str:
    """A made-up token that looks odd but is no secret: an address, a number, a name with digits or a long word."""
    n = lambda low, high: str(int(rng.integers(low, high)))
    word = lambda: words[rng.integers(len(words))] if words else "word"
    kind = rng.integers(11)
    if kind in (0, 8):
        return ".".join(n(1, 256) for _ in range(4))
    if kind == 9:
        return (".", "-", "/")[rng.integers(3)].join(n(0, (10, 100, 10000)[rng.integers(3)]) for _ in range(int(rng.integers(2, 7))))
    if kind == 1:
        return f"{word()}.{n(1, 100)}@{word()}{n(1, 10)}.example.com"
    if kind == 2:
        return f"({n(100, 1000)}) {n(100, 1000)}-{n(1000, 10000)}"
    if kind == 3:
        return "".join(n(0, 10) for _ in range(int(rng.integers(9, 20))))
    if kind == 4:
        return f"{n(1970, 2030)}-{n(10, 13)}-{n(10, 29)}T{n(10, 24)}:{n(10, 60)}"
    if kind == 5:
        return f"https://{word()}.example.org/{word()}/{word()}-{n(1, 1000)}.html"
    if kind == 6:
        return f"{word()}.{n(1, 100)}"
    long = "".join(word() for _ in range(int(rng.integers(2, 5))))
    return f"{long.upper()}!!" if rng.random() < 0.5 else long


def examples(texts: list[str], max_lines: int = TRAIN_LINES, max_chars: int = TRAIN_CHARS, planted: float = PLANTED, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features, line and tags to learn from: at most max_lines lines of the texts, a stretch of at most max_chars of each.

    Tags come from the values that the fixed patterns find, and from made-up
    secrets put into a share `planted` of the other lines, with a telling word
    before them or none, so that shape and neighbours are learnt and not the
    patterns. As many lines get an odd token that is no secret. File features
    are those of the whole text that a line is from.
    """
    rng = np.random.default_rng(seed)
    lead = ("password", "passphrase", "pwd", "secret", "key", "auth", "bearer", "credential", "private key", "client id", "access")
    made, spans, files = [], [], []
    counts = [file_counts(t.encode("utf-8", "surrogatepass")) for t in texts]
    lines = [(line, f) for t, f in zip(texts, counts, strict=True) for line in t.split("\n") if line.strip()]
    for i in rng.permutation(len(lines))[:max_lines].tolist():
        line, file = lines[i]
        if len(line) > max_chars:
            hit = next(iter(base_spans(line)), None)
            at = max(0, hit[0] - max_chars // 2) if hit else int(rng.integers(len(line) - max_chars))
            line = line[at : at + max_chars]
        held = [m.span(2) for m in ASSIGN.finditer(line) if len(m[2]) >= 6] + [(s, e) for s, kind, e in base_spans(line) if kind]
        chance = rng.random()
        at = line.find(" ", int(rng.integers(len(line))))
        at = len(line) if at < 0 else at
        if not held and planted <= chance < 2 * planted:
            line = f"{line[:at]} {_harmless(rng, [w for w in line.split() if w.isalpha()])}{line[at:]}"
        if not held and chance < planted:
            before = " " + (lead[rng.integers(len(lead))] + (" ", ": ", " = ", ' = "', " is ")[rng.integers(5)] if rng.random() < 0.7 else "")
            secret = _made(rng)
            held = [(at + len(before), at + len(before) + len(secret))]
            line = line[:at] + before + secret + line[at:]
        made.append(line)
        spans.append(held)
        files.append(file)
    data = [m.encode("utf-8", "surrogatepass") for m in made]
    begins = np.cumsum([0, *(len(d) + 1 for d in data)])[:-1]
    start, end, line, features = tokens(b"\n".join(data), begins, np.array(files).reshape(-1, 3))
    tags = np.full(len(start), O)
    for m, at, held in zip(made, begins.tolist(), spans, strict=True):
        for s, e in sorted(set(held)):
            a, b = at + len(m[:s].encode("utf-8", "surrogatepass")), at + len(m[:e].encode("utf-8", "surrogatepass"))
            i, j = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
            if i < j and (tags[i:j] == O).all():
                tags[i:j] = I
                tags[i] = B
    return features, line, tags


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAIN_ROWS, max_lines: int = TRAIN_LINES, max_chars: int = TRAIN_CHARS) -> Crf:
    """Learn from at most max_rows rows that have an id (common.draw), max_lines lines of them and max_chars of a line, whatever the size of docs."""
    rows = id_text(docs, id_col, text_col)
    got = draw(rows.where("text <> ''"), max_rows).toPandas()
    return train(*examples(got["text"].tolist(), max_lines, max_chars))


def scan(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of (start, kind, end) by start and kind.

    Kinds are places in KINDS; places are code points, the end exclusive. The
    fixed patterns' spans are all there; the field adds those of its own that
    meet none of them. The whole text is read, a null text as empty. Null ids
    and repeated rows are rows like others; other columns are not read.
    """
    told = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())])
        for b in batches:
            out = []
            for i in range(0, b.num_rows, 500):
                texts = b.column("text").slice(i, 500).to_pylist()
                for text, tagged in zip(texts, told.value.spans(texts), strict=True):
                    base = base_spans(text)
                    more = [(s, 3, e) for s, e in tagged if not any(s < f and a < e for a, _, f in base)]
                    out.append([{"start": s, "kind": k, "end": e} for s, k, e in sorted(base + more)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(kind))], ["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<start:long,kind:long,end:long>>")


def op1_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"], s["end"])), ",")

    def n(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n(3).alias("n_crf"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of base_spans()."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
