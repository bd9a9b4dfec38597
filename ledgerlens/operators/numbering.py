"""What tells the rows of a whole table apart, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, name: str, key: Column | None = None, buckets: int | None = None) -> DataFrame:
    """df with a column `name`, 1 to n, in the order of `key` and then of the rows' values.

    key is a whole number of 64 bits, spread evenly over their range: a hash of the row's values if it isn't given.

    Two levels: equal rows are first one, with a count, so that a row that repeats
    often is no load; the hash's range is cut into `buckets` of like size, rows are
    numbered within each, and a bucket's numbers begin after the counts of those before
    it (one small row a bucket is broadcast). Null is a value like others, so rows that differ
    only in where a null stands are different. A row has the same number whenever it
    is computed again from the same rows; of equal rows it doesn't matter which has which.
    """
    values = df.columns
    buckets = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.groupBy(*[F.col(f"`{c}`") for c in values]).agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in values]) if key is None else key)
    # a bucket holds a range of hashes
    rows = rows.withColumn("_bucket", F.floor(F.col("_hash") / F.lit(2.0**64 / buckets)))
    sizes = rows.groupBy("_bucket").agg(F.sum("_copies").alias("_size"))
    before = sizes.select(F.col("_bucket").alias("_b"), (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_before"))
    within = Window.partitionBy("_bucket").orderBy("_hash", *[F.col(f"`{c}`") for c in values]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.sum("_copies").over(within)).join(F.broadcast(before), F.col("_bucket") == F.col("_b"))
    first = F.col("_before") + F.col("_last") - F.col("_copies")
    return rows.select(*[F.col(f"`{c}`") for c in values], F.explode(F.sequence(first + 1, first + F.col("_copies"))).alias(name))


def identify_rows(df: DataFrame, name: str) -> DataFrame:
    """df with a column `name` that no two rows share: 128 bits of hashes of the row's values and, among equal rows, a number from 1.

    Equal rows are first one, with a count; where df is already dealt out by one of its columns that needs no shuffle. Where nulls
    stand is hashed as well. A row has the same id whenever it is computed again from the same rows.
    """
    values = [F.col(f"`{c}`") for c in df.columns]
    rows = df.groupBy(*values).agg(F.count(F.lit(1)).alias("_copies"))
    nulls = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")
    rows = rows.select(*values, F.xxhash64(nulls, *values).alias("_high"), F.xxhash64(F.lit(1), nulls, *values).alias("_low"), copies)
    return rows.select(*values, F.struct("_high", "_low", "_copy").alias(name))
