"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only."""

from __future__ import annotations

import uuid
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, id_text, materialise, shared_dir, table

#: Bits of one filter block: what one bitmap of Spark's bitmap functions holds (4 KB).
BLOCK_BITS = 32768


def repeated_cells(hashes: DataFrame, n_rows: int, bits_per_row: int = 16, max_blocks: int = 8192) -> tuple[DataFrame, int]:
    """First pass over a column `hash` (binary): the filter as (_block, _bits), and how many blocks it may have.

    Each hash sets two cells of a blocked Bloom filter; cells that are set twice go
    into the block's bitmap. Cells, and not rows, are what is shuffled, once for
    each task that has them. max_blocks bounds the bitmaps (8192 x 4 KB = 32 MB)
    whatever the number of rows.
    """
    blocks = 1
    while blocks < max_blocks and blocks * BLOCK_BITS < n_rows * bits_per_row:
        blocks *= 2
    block, p1, p2 = _cells(blocks)
    # one long for each cell: its place in the whole filter
    cells = hashes.select(F.explode(F.array(*[block.cast("long") * BLOCK_BITS + p for p in (p1, p2)])).alias("_cell"))
    twice = cells.groupBy("_cell").count().where("count > 1")
    bitmaps = twice.groupBy(F.floor(F.col("_cell") / BLOCK_BITS).cast("int").alias("_block")).agg(F.bitmap_construct_agg(F.pmod("_cell", F.lit(BLOCK_BITS))).alias("_bits"))
    return materialise(bitmaps, "repeated-cells"), blocks


def filter_of(keys: DataFrame, n_rows: int, bits_per_row: int = 16, max_blocks: int = 8192) -> tuple[DataFrame, int]:
    """A filter of the column `hash` of keys, for possibly_repeated(): false is told only of what is none of them. Bounded like repeated_cells()."""
    blocks = 1
    while blocks < max_blocks and blocks * BLOCK_BITS < n_rows * bits_per_row:
        blocks *= 2
    block, p1, p2 = _cells(blocks)
    cells = keys.select(block.alias("_block"), F.explode(F.array(p1, p2)).alias("_p"))
    return materialise(cells.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_p").cast("long")).alias("_bits")), "key-filter"), blocks


def _cells(blocks: int) -> tuple[Column, Column, Column]:
    """Block and two cells in it of a column `hash`."""
    h = F.xxhash64("hash")
    return F.pmod(h, F.lit(blocks)).cast("int"), F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(BLOCK_BITS - 1)), F.shiftrightunsigned(h, 49).bitwiseAND(F.lit(BLOCK_BITS - 1))


def possibly_repeated(rows: DataFrame, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """Second pass: add `maybe` to rows with a column `hash`: false only where no other row has the same hash.

    The bitmaps are broadcast, since repeated_cells() bounds them. With more rows
    than that filter serves, more rows are called possibly repeated, never fewer.
    """
    block, p1, p2 = _cells(blocks)
    cells = rows.withColumns({"_at": block, "_p1": p1, "_p2": p2})

    def is_set(p: str):
        byte = F.conv(F.hex(F.substring("_bits", (F.col(p) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.floor(byte / F.pow(F.lit(2), F.col(p) % 8)), F.lit(2)) == 1

    maybe = F.coalesce(is_set("_p1") & is_set("_p2"), F.lit(False)).alias("maybe")
    return cells.join(F.broadcast(bitmaps), F.col("_at") == F.col("_block"), "left").select(*rows.columns, maybe)


def by_filters(hashed: DataFrame, n_rows: int, bits_per_row: int = 16, max_blocks: int = 8192) -> DataFrame:
    """hashed (a table with a column `hash`) with `maybe`, by as many filters of bounded size as the rows need.

    Each filter is of a range of hashes, and clears the rows of that range like any other; ranges go one after
    the other into one table. The table is sorted by hash within its files, so that a
    range's pass skips the pages of others.
    """
    passes = max(1, -(-n_rows * bits_per_row // (max_blocks * BLOCK_BITS)))
    if passes == 1:
        return possibly_repeated(hashed, *repeated_cells(hashed, n_rows, bits_per_row, max_blocks))
    path = f"{shared_dir(hashed.sparkSession)}/tested-{uuid.uuid4().hex}"
    edges = [None, *(F.lit(((i << 64) // passes).to_bytes(8, "big")) for i in range(1, passes)), None]
    for low, high in pairwise(edges):
        part = hashed if low is None else hashed.where(F.col("hash") >= low)
        part = part if high is None else part.where(F.col("hash") < high)
        out = possibly_repeated(part, *repeated_cells(part, -(-n_rows // passes), bits_per_row, max_blocks))
        out.write.mode("append").parquet(path)
    return hashed.sparkSession.read.schema(out.schema).parquet(path)


def text_hash(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_blocks: int = 8192) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical (a null text is empty); of equal texts the
    row with the largest doc_id stays. Texts are read once, into a table of ids
    and hashes. Rows that the filter clears (see by_filters()) pass straight through; of the others
    only (hash, doc_id) is shuffled, counted per task first.

    Null ids rank below all others; a group of null ids only has keep_id null.
    Of rows that repeat both id and text, one is kept. No rows give no rows;
    other columns of docs are not read, so their names cannot clash.
    """
    hashed = materialise(id_text(docs, id_col, text_col).select("doc_id", text_hash(F.col("text")).alias("hash")).sortWithinPartitions("hash"), "text-hashes")
    n = hashed.count()
    rows = by_filters(hashed, n, bits_per_row, max_blocks)
    single = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "hash")
    pairs = materialise(rows.where("maybe").groupBy("hash", "doc_id").agg(F.count(F.lit(1)).alias("_copies")), "maybe-repeated")
    groups = pairs.groupBy("hash").agg(F.max("doc_id").alias("keep_id"), F.sum("_copies").alias("group_size"))
    told = attach(pairs, groups, "hash", "group_size", n, ["doc_id"])
    repeated = told.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "hash"
    )
    return single.unionByName(repeated).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("hash")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_blocks: int = 8192) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Rows that the filter clears are not shuffled; each task sends one candidate
    per repeated hash at most, so a hot text never gathers its rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_hash(F.col(f"`{text_col}`")).alias("hash"))
    told = by_filters(rows, docs.count(), bits_per_row, max_blocks)
    best = told.where("maybe").groupBy("hash").agg(F.max_by("_row", F.coalesce(F.col(f"_row.`{id_col}`").cast("long"), F.lit(-(2**63)))).alias("_row"))
    return told.where(~F.col("maybe")).select("_row.*").unionByName(best.select("_row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
     w AS (SELECT doc_id, text_sha256,
                  max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  row_number() OVER (PARTITION BY text_sha256, doc_id) AS i
           FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AND i = 1 AS kept, text_sha256 FROM w
"""
