"""Product codes of vectors: integer codebooks learnt by a reduction tree over columnar blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, at most, and of the distances that are held at a time.
BLOCK, STEP = 1 << 14, 1 << 12

#: Block columns: the vectors' values as little-endian int32, one dimension after the other.
BLOCKS = "vec_ids array<long>, labels array<string>, n int, parts binary"


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, label (as text) and vector (doubles) of the rows whose vector is neither null nor holds a null, NaN or infinite component."""
    label = vectors[label_col].cast("string") if label_col else F.lit(None).cast("string")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), label.alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    return rows.where(_finite(F.col("vector")))


def bound(dim: int) -> int:
    """What a component's size is held to, so that a vector's squared distance fits 64 bits."""
    return isqrt(2**61 // max(dim, 1))


def to_integers(values: np.ndarray, dim: int) -> np.ndarray:
    """floor(SCALE * x), within the bound."""
    return np.clip(np.floor(values * float(SCALE)), -bound(dim), bound(dim)).astype(np.int32)


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors block[width, n] of one part and its codebook[entries, width]: the nearest entry's index, the lower of equals, and its squared distance."""
    n = block.shape[1]
    at, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(0, n, STEP):
        part = block[:, i : i + STEP].astype(np.int64)
        far = np.zeros((len(book), part.shape[1]), np.int64)
        for j in range(len(part)):  # one dimension after the other
            d = part[j] - book[:, j, None]
            d *= d
            far += d
        at[i : i + STEP] = far.argmin(0)
        least[i : i + STEP] = far.min(0)
    return at, least


def _unpack(parts: bytes, n: int, dim: int, n_parts: int) -> np.ndarray:
    return np.frombuffer(parts, "<i4").reshape(n_parts, dim // n_parts, n)


class ProductCodes:
    """Codebooks[part, entry, place] of vectors of `dim` components; without entries nothing is coded."""

    def __init__(self, books: np.ndarray, dim: int):
        self.books, self.dim = books, dim

    def sha256(self) -> str:
        """Of all entries' decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def blocks(kept: DataFrame, dim: int, n_parts: int = PARTS) -> DataFrame:
    """Kept vectors of dim components as columnar blocks, written once to the shared folder; vectors of another length make rows of n = 0."""
    schema = pa.schema([("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("n", pa.int32()), ("parts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                vector = b.column("vector")
                fits = (np.diff(vector.offsets.to_numpy()) == dim) & (dim > 0)
                for mask in (fits, ~fits):
                    if not mask.any():
                        continue
                    rows = b.filter(pa.array(mask))
                    n = rows.num_rows if mask is fits else 0
                    values = to_integers(rows.column("vector").flatten().to_numpy().reshape(n, dim), dim).T if n else np.zeros(0, np.int32)
                    row = [rows.column(c).to_pylist() for c in ("vec_id", "label")] + [n, np.ascontiguousarray(values).astype("<i4").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    return materialise(kept.mapInArrow(run, BLOCKS), "vector-blocks", compression="zstd", maxRecordsPerFile="64")


def first_vectors(kept: DataFrame, n_parts: int = PARTS, entries: int = ENTRIES) -> tuple[np.ndarray, int]:
    """The starting codebooks, of the `entries` smallest vec_ids (a bounded number of rows), and the vectors' length."""
    able = kept.where("vec_id is not null").where((F.size("vector") > 0) & (F.size("vector") % n_parts == 0))
    length = able.select(F.min(F.struct("vec_id", F.col("vector"))).alias("first")).select(F.size("first.vector")).first()[0]
    if length is None or length <= 0:
        return np.zeros((n_parts, 0, 0), np.int64), 0
    rows = able.where(F.size("vector") == length).orderBy("vec_id", "vector").limit(entries).collect()
    values = to_integers(np.array([r["vector"] for r in rows], float).reshape(len(rows), length), length)
    return values.reshape(len(rows), n_parts, length // n_parts).transpose(1, 0, 2).astype(np.int64), length


def fit(vectors: DataFrame, books: np.ndarray, dim: int, rounds: int = ROUNDS) -> ProductCodes:
    """Codebooks after `rounds` of assigning all parts of the blocks and moving each entry to the floor of its parts' mean.

    A task holds one block and the sums and counts of all entries, parts x entries
    x (width + 1) integers; these merge through a tree of tasks, and only the last
    of them reaches the driver. What a lost executor held is computed anew.
    """
    n_parts, entries, width = books.shape
    rows = vectors.where("n > 0").select("n", "parts").rdd
    context = vectors.sparkSession.sparkContext
    parts = max(1, rows.getNumPartitions())
    depth = 2 if parts < 512 else 3

    for _ in range(rounds if entries else 0):
        sent = context.broadcast(books)

        def add(total: tuple[np.ndarray, np.ndarray] | None, row, sent=sent):
            sums, counts = total or (np.zeros((n_parts, entries, width), np.int64), np.zeros((n_parts, entries), np.int64))
            block = _unpack(row["parts"], row["n"], dim, n_parts)
            for p in range(n_parts):
                at, _ = nearest(block[p], sent.value[p])
                np.add.at(counts[p], at, 1)
                for j in range(width):
                    np.add.at(sums[p, :, j], at, block[p, j])
            return sums, counts

        def merge(a, b):
            return (a[0] + b[0], a[1] + b[1]) if a and b else a or b

        total = rows.treeAggregate(None, add, merge, depth)
        if total:
            sums, counts = total
            books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        sent.unpersist()
    return ProductCodes(books, dim)


def encode(vectors: DataFrame, codes: ProductCodes) -> DataFrame:
    """vec_id, label, code, error of every vector of the blocks; code and error are null where the codebooks are for another length."""
    n_parts, entries, _ = codes.books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(codes.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, ids, labels = b.column("n")[i].as_py(), b.column("vec_ids")[i].values, b.column("labels")[i].values
                code, error = pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64())
                if n and entries:
                    block = _unpack(b.column("parts")[i].as_py(), n, codes.dim, n_parts)
                    at = np.empty((n, n_parts), np.uint8)
                    far = np.zeros(n, np.int64)
                    for p in range(n_parts):
                        at[:, p], least = nearest(block[p], sent.value[p])
                        far += least
                    hexed = at.tobytes().hex()
                    code = pa.array([hexed[k : k + 2 * n_parts] for k in range(0, len(hexed), 2 * n_parts)], pa.string())
                    error = pa.array(far)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), labels.cast(pa.string()), code, error], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, "vec_id long, label string, code string, error long")


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", n_parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept row of vectors: vec_id, code, error, label_error, codebooks_sha256.

    Each component becomes floor(256 x) and each vector n_parts parts, coded by
    the nearest of a part's `entries` (256 at most). error is the squared distance summed over the
    parts, label_error its sum over the rows of an equal label, null being a label of its own.

    Rows whose vector is null or holds a null, NaN or infinite component are left
    out. Codebooks start from the least vec_ids, rows of one id going by their
    vectors; a null id is coded but starts none. With fewer rows than entries there
    are as many entries as rows. The least id whose vector divides into parts gives
    the length; vectors of another length (an empty one too) come out with null code and
    error. Components are held to bound(dim), 741455 for 64 of them, before squares.
    A sum beyond 64 bits is null. Rows that repeat are rows like others. No rows give no
    rows; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold at most 256 entries")
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    books, dim = first_vectors(kept, n_parts, entries)
    held = blocks(kept, dim, n_parts)
    codes = fit(held, books, dim, rounds)
    coded = materialise(encode(held, codes).withColumn("_label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("-"))), "vector-codes", compression="zstd")
    labels = coded.groupBy("_label").agg(F.count(F.lit(1)).alias("_rows"), F.try_sum("error").alias("label_error"))
    n_rows = coded.count()
    told = attach(coded, labels, "_label", "_rows", n_rows, ["vec_id", "code"])
    return told.select("vec_id", "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(table(spark, sf_dir, "embeddings"))


_ASSIGN = """
{d} AS (SELECT v.vec_id, v.p, b.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda j: (v.x[j] - b.x[j]) * (v.x[j] - b.x[j]))) AS far FROM parts v JOIN {book} b USING (p)),
{a} AS (SELECT vec_id, p, min(struct_pack(far := CAST(far AS BIGINT), e := e)) AS best FROM {d} GROUP BY vec_id, p)"""
_MOVE = """
{m} AS (SELECT v.p, a.best.e AS e, j, CAST(floor(sum(v.x[j]) / count(*)) AS BIGINT) AS x FROM parts v JOIN {a} a USING (vec_id, p), (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM parts))) AS j) GROUP BY ALL),
{book} AS (SELECT o.p, o.e, coalesce(n.x, o.x) AS x FROM {old} o LEFT JOIN (SELECT p, e, list(x ORDER BY j) AS x FROM {m} GROUP BY p, e) n USING (p, e))"""

ORACLE = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p)),
starts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
b0 AS (SELECT p, e, x FROM parts JOIN starts USING (vec_id)),
{_ASSIGN.format(d="d1", a="a1", book="b0")}, {_MOVE.format(m="m1", a="a1", book="b1", old="b0")},
{_ASSIGN.format(d="d2", a="a2", book="b1")}, {_MOVE.format(m="m2", a="a2", book="b2", old="b1")},
{_ASSIGN.format(d="d3", a="a3", book="b2")},
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a3 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""
