"""Stupid-backoff language-model scores from n-gram counts over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_text, table
from ledgerlens.llm.decontaminate import mix, word_hashes

ORDER, ALPHA = 3, 0.4
#: Words of a chunk, about: what is counted together before any gram is sent.
CHUNK = 1 << 21
#: Grams of the chunks that a range of hashes should get, about, and grams in a character of text.
PART_GRAMS, GRAMS_PER_CHARACTER = 1 << 22, 0.3
#: Bytes of a text that are cut into words at a time.
SLICE = 1 << 20
#: A-Z lower-cased; white space [\x20\x09-\x0D] as blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def _grams(words: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the last word) of each n-gram of an order that lies in one document."""
    n = max(0, len(words) - order + 1)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = mix(h * np.uint64(0x100000001B3) + words[k : k + n])
    ok = np.flatnonzero(doc[:n] == doc[order - 1 : order - 1 + n])
    return h[ok], ok + order - 1


def _runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One order for all that is counted: the places in the order of their hash, and where in it each hash begins, and each document's part of a hash (doc ascends)."""
    by = np.argsort(h, kind="stable").astype(np.uint32)
    h = h[by]
    fresh = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    began = np.flatnonzero(fresh).astype(np.uint32)
    d = doc[by]
    fresh[1:] |= d[1:] != d[:-1]
    return by, began, np.flatnonzero(fresh).astype(np.uint32)


def _words(text: str) -> np.ndarray:
    """The hash of each word, of a slice of the text at a time."""
    data, at, found = text.encode("utf-8", "surrogatepass").translate(FOLD), 0, []
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        found.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


_ZSTD = pa.Codec("zstd", 1)


def _pack(values: np.ndarray) -> bytes:
    """Integers compressed by planes of bytes."""
    return _ZSTD.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), asbytes=True) if len(values) else b""


def _unpack(data: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = _ZSTD.decompress(data, n * size, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(dtype).ravel()


BODY = "doc_ids array<long>, lengths array<long>, vocab binary, n_vocab int, places binary"


def _chunks(docs: DataFrame, parts: int) -> DataFrame:
    """Documents as word sequences, CHUNK words a row: chunk, body (ids, lengths, word hashes and, packed, each word's place in these).

    They are dealt out by chunk and stand in one column, so that all that is made of them reads the same shuffle.
    """
    body = pa.struct([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("vocab", pa.binary()), ("n_vocab", pa.int32()), ("places", pa.binary())])
    schema = pa.schema([("chunk", pa.int64()), ("body", body)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def full() -> pa.RecordBatch:
            vocab, seq, often = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            by = np.argsort(-often, kind="stable")  # frequent words get small places
            place = np.empty(len(by), "<u4")
            place[by] = np.arange(len(by))
            row = {"doc_ids": ids, "lengths": [len(w) for w in held], "vocab": vocab[by].astype("<u8").tobytes(), "n_vocab": len(vocab), "places": _pack(place[seq])}
            return pa.RecordBatch.from_pylist([{"chunk": at, "body": row}], schema)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids.append(doc_id)
                held.append(_words(text.as_py()))
                size += len(held[-1])
                if size >= CHUNK or len(held) >= 100_000:
                    yield full()
                    ids, held, size, at = [], [], 0, at + 1
        if ids:
            yield full()

    return docs.mapInArrow(run, f"chunk long, body struct<{', '.join(c.replace(' ', ': ', 1) for c in BODY.split(', '))}>").repartition(parts, "chunk")


def _sequence(body: dict) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array(body["lengths"], np.int64)
    words = np.frombuffer(body["vocab"], "<u8")[_unpack(body["places"], int(lengths.sum()), "<u4")]
    return words, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each chunk; reads whole rows, so that Spark finds the shuffle that is there."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(b.column("body")[i].as_py()["lengths"]) for i in range(b.num_rows)], pa.int64())], ["n"])


def _cuts(known: np.ndarray, ranges: int) -> np.ndarray:
    """Where ascending hashes are cut into ranges, from 0 to their number."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(known, edges), [len(known)]])


def gram_rows(chunks: DataFrame, order: int, ranges: int) -> DataFrame:
    """The n-grams of all orders that each chunk holds and how often, a row for each range of hashes: part, chunk, sizes (by order), grams, counts (both packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, doc = _sequence(b.column("body")[i].as_py())
                own = [np.unique(_grams(words, doc, k)[0], return_counts=True) for k in range(1, order + 1)]
                cuts = [_cuts(known, ranges) for known, _ in own]
                rows: list[list] = [[], [], [], []]
                for p in range(ranges):
                    grams, n = (np.concatenate([o[c][x[p] : x[p + 1]] for o, x in zip(own, cuts, strict=True)]) for c in (0, 1))
                    if len(grams):
                        for column, value in zip(rows, (p, [int(x[p + 1] - x[p]) for x in cuts], _pack(np.diff(grams, prepend=np.uint64(0)).astype("<u8")), _pack(n.astype("<u4"))), strict=True):
                            column.append(value)
                chunk = pa.array([b.column("chunk")[i].as_py()] * len(rows[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), chunk, pa.array(rows[1], pa.list_(pa.int32())), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], ["part", "chunk", "sizes", "grams", "counts"])

    return chunks.mapInArrow(run, "part int, chunk long, sizes array<int>, grams binary, counts binary")


def joined_counts(rows: DataFrame) -> DataFrame:
    """For each of gram_rows(): part, chunk, sizes, and `beyond`, how often other chunks hold each of its grams, in their order.

    A range's rows meet in one task, are exploded and summed to the range's count table, and joined with it by
    their whole 64-bit hash. A gram is one number a chunk there, however frequent it is.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes = [sum(x) for x in table.column("sizes").to_pylist()]
        ends = np.cumsum(sizes)
        grams, n = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32)
        for i, (size, end) in enumerate(zip(sizes, ends.tolist(), strict=True)):
            np.cumsum(_unpack(table.column("grams")[i].as_py(), size, "<u8"), dtype=np.uint64, out=grams[end - size : end])
            n[end - size : end] = _unpack(table.column("counts")[i].as_py(), size, "<u4")
        by = np.argsort(grams, kind="stable").astype(np.uint32)  # the count table's keys, and the join
        grams = grams[by]
        began = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        del grams
        total = np.repeat(np.add.reduceat(n[by], began, dtype=np.int64), np.diff(began, append=len(by)))
        beyond_all = np.empty(len(by), "<u8")
        beyond_all[by] = total
        del by, began, total
        beyond_all -= n
        beyond = np.split(beyond_all, ends[:-1])
        return pa.table([table.column("part"), table.column("chunk"), table.column("sizes"), pa.array([_pack(x) for x in beyond], pa.binary())], ["part", "chunk", "sizes", "beyond"])

    return rows.groupBy("part").applyInArrow(run, "part int, chunk long, sizes array<int>, beyond binary")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, leave_out: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, log_score (the sum of natural logarithms over its words).

    S(w | context) = c(context w) / c(context) if that gram is known, else alpha
    S(w | shorter context); S(w) = c(w) / N, or 1 / (N + 1) of an unknown word.
    c and N count in all documents of the corpus but the scored one (leave_out), so a
    document doesn't vouch for itself; with leave_out=False in all. Words are
    [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; grams don't reach over documents.

    1. Each task turns its documents into chunks of word hashes.
    2. Each chunk's grams, its count of each beside them, are dealt out by ranges of their
       64-bit hash. In a range they are summed to its count table and joined with it.
    3. What other chunks hold goes back to a chunk, and its documents' scores are summed.

    Grams travel in columns, a row for a chunk and a range, since a row for
    each gram is some 20 bytes, twice. Ranges grow with the corpus, so that none gets more than
    about PART_GRAMS grams. Null or empty texts have no words and score 0. Null ids and repeated
    rows are rows like others (a copy vouches for the other). No rows give no
    rows; other columns are not read. A text beyond a chunk's words makes a larger chunk.
    """
    given = id_text(docs, id_col, text_col)
    size = given.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, int(GRAMS_PER_CHARACTER * size / PART_GRAMS))
    chunks = _chunks(given, max(least, size // (4 * CHUNK)))
    beyond = joined_counts(gram_rows(chunks, order, ranges).repartition(ranges, "part"))

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        body = own.column("body")[0].as_py()
        words, doc = _sequence(body)
        lengths = np.array(body["lengths"], np.int64)
        others: list[list[np.ndarray]] = [[np.zeros(0, "<u8")] for _ in range(order)]
        parts = told.column("part").to_numpy()
        for i in np.argsort(parts).tolist():  # ranges in their order, as the chunk's own grams are
            sizes = told.column("sizes")[i].as_py()
            for mine, part in zip(others, np.split(_unpack(told.column("beyond")[i].as_py(), sum(sizes), "<u8"), np.cumsum(sizes)[:-1]), strict=True):
                mine.append(part)
        best = np.zeros(len(words))
        seen = np.zeros(len(words), np.int64)  # count elsewhere of the gram one shorter that ends at each word
        last, alone = np.full(len(words), True), np.full(len(words), False)  # words whose score comes down to the word alone, and known ones
        for k in range(1, order + 1):
            h, at = _grams(words, doc, k)
            by, began, own_began = _runs(h, doc[at])
            del h
            n, own_n = np.diff(began, append=len(by)), np.diff(own_began, append=len(by))
            told_n = np.repeat(np.concatenate(others[k - 1]).astype(np.int64) + n, n)
            others[k - 1] = []
            if leave_out:
                told_n -= np.repeat(own_n, own_n)
            c = np.empty_like(told_n)
            c[by] = told_n
            del by, began, own_began, n, own_n, told_n
            if k == 1:
                best[at] = np.log(np.maximum(c, 1))
                alone[at] = c > 0
            else:
                context = seen[at - 1]  # counts of the (k - 1)-gram before the word
                best[at] = np.where(c > 0, np.log(np.maximum(c, 1)) - np.log(np.maximum(context, 1)), np.log(alpha) + best[at])
                last[at[c > 0]] = False
            seen[:] = 0
            seen[at] = c
        known_words, unknown_words = (np.bincount(doc[m], minlength=len(lengths)) for m in (last & alone, last & ~alone))
        sums = np.bincount(doc, best, len(lengths)) if len(words) else np.zeros(len(lengths))
        return pa.table([pa.array(body["doc_ids"], pa.int64()), pa.array(lengths), pa.array(sums), pa.array(known_words), pa.array(unknown_words)], ["doc_id", "n_words", "_sum", "_known", "_unknown"])

    scored = chunks.groupBy("chunk").cogroup(beyond.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, _sum double, _known long, _unknown long")
    # words known or not by themselves alone are divided by the words of the rest
    total = chunks.mapInArrow(_lengths, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))
    rest = F.greatest(F.lit(1), F.col("_total") - (F.col("n_words") if leave_out else F.lit(0)))
    log_score = F.col("_sum") - F.col("_known") * F.ln(rest) - F.col("_unknown") * F.ln(rest + 1)
    return scored.crossJoin(F.broadcast(total)).select("doc_id", "n_words", log_score.alias("log_score"))


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0)
    return lm_scores(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"), F.round(mean, 5).alias("mean_log_score"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     p AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
     b AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u FROM p),
     d1 AS (SELECT r, w, count(*) AS n FROM p GROUP BY r, w),
     c1 AS (SELECT w, sum(n) AS n FROM d1 GROUP BY w),
     d2 AS (SELECT r, v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY r, v, w),
     c2 AS (SELECT v, w, sum(n) AS n FROM d2 GROUP BY v, w),
     d3 AS (SELECT r, u, v, w, count(*) AS n FROM b WHERE u IS NOT NULL GROUP BY r, u, v, w),
     c3 AS (SELECT u, v, w, sum(n) AS n FROM d3 GROUP BY u, v, w),
     l AS (SELECT r, count(*) AS n FROM p GROUP BY r),
     s AS (SELECT b.r, b.u, b.v, c1.n - d1.n AS n1, coalesce(c2.n - d2.n, 0) AS n2, coalesce(c3.n - d3.n, 0) AS n3,
                  cv.n - dv.n AS nv, cuv.n - duv.n AS nuv, greatest(1, (SELECT count(*) FROM p) - l.n) AS rest
           FROM b JOIN l USING (r) JOIN d1 USING (r, w) JOIN c1 USING (w)
           LEFT JOIN d2 ON d2.r = b.r AND d2.v = b.v AND d2.w = b.w
           LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w
           LEFT JOIN d3 ON d3.r = b.r AND d3.u = b.u AND d3.v = b.v AND d3.w = b.w
           LEFT JOIN c3 ON c3.u = b.u AND c3.v = b.v AND c3.w = b.w
           LEFT JOIN d2 duv ON duv.r = b.r AND duv.v = b.u AND duv.w = b.v LEFT JOIN c2 cuv ON cuv.v = b.u AND cuv.w = b.v
           LEFT JOIN d1 dv ON dv.r = b.r AND dv.w = b.v LEFT JOIN c1 cv ON cv.w = b.v),
     x AS (SELECT r, sum(CASE WHEN n3 > 0 THEN ln(n3 / nuv) ELSE
                  CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END +
                  CASE WHEN n2 > 0 THEN ln(n2 / nv) ELSE
                    CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN n1 > 0 THEN ln(n1 / rest) ELSE ln(1 / (rest + 1)) END END END) AS log_score
           FROM s GROUP BY r)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, round(coalesce(x.log_score, 0), 5) AS log_score,
       round(CASE WHEN len(t.ws) > 0 THEN x.log_score / len(t.ws) ELSE 0 END, 5) AS mean_log_score
FROM t LEFT JOIN x USING (r)
"""
