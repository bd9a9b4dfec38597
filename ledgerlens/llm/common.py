"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many groups are ever broadcast by `attach`.
MAX_HOT_GROUPS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one of our own.

    A folder of our own is only made where all tasks run in the driver's process;
    on a cluster the setting is required, since executors share no local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
    return context.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back; this cuts the lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the operators read, under fixed names; a null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def draw(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows of rows (doc_id, text, ...): those of the ids with the least hash, one row for each id.

    An id that repeats gives the row with the least hash of its other columns; null
    ids are left out. Ids are drawn first, from those below a bound on their
    hash that is raised until enough are found, so that a task neither sorts nor
    sends more than it must, and no texts but those of the ids that are drawn.
    """
    rows = rows.where("doc_id is not null").withColumn("_h", F.xxhash64("doc_id"))
    share = 4 * max_rows / max(1, rows.count())
    while True:
        low = rows if share >= 1 else rows.where(F.col("_h") < F.lit(int(share * 2**64) - 2**63))
        ids = low.select("_h", "doc_id").distinct().orderBy("_h", "doc_id").limit(max_rows)
        if share >= 1 or ids.count() == max_rows:
            break
        share *= 16
    drawn = F.broadcast(ids.select(F.col("doc_id").alias("_id")))
    met = rows.join(drawn, F.col("doc_id") == F.col("_id"), "left_semi")
    others = [c for c in rows.columns if c not in ("doc_id", "_h")]
    row = F.struct(*[F.col(c) for c in others])
    one = met.groupBy("_h", "doc_id").agg(F.min_by(row, F.xxhash64(*others)).alias("_row"))
    return one.orderBy("_h", "doc_id").select("doc_id", "_row.*")


def hot_share(n_rows: int) -> int:
    """The size from which a group counts as hot: of disjoint groups, at most MAX_HOT_GROUPS reach it."""
    return max(200, -(-n_rows // MAX_HOT_GROUPS))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, spread: Iterable[Column | str], merge: bool = False) -> DataFrame:
    """Left-join to `rows` what `groups` says of their key, without gathering a key's rows in one task.

    groups has one row per key, whose column `size` counts that key's rows of
    the n_rows. Keys of at least hot_share(n_rows) rows are at most
    MAX_HOT_GROUPS, so these are broadcast; the rows of the others are joined by
    a shuffle, in which the hot rows are dealt out by `spread` and match nothing.
    Small other groups are broadcast if Spark sees fit, unless `merge` rules it out:
    a loop of many joins would hold as many hash tables in each executor.
    """
    values = [c for c in groups.columns if c != key]
    least = hot_share(n_rows)
    told = groups.select(F.col(key).alias("_key"), F.struct(*values).alias("_told"))
    hot = told.where(F.col(f"_told.{size}") >= least).select(F.col("_key").alias("_hot_key"), F.col("_told").alias("_hot"))
    # one expression, so that the groups' own partitioning by key can't serve the join
    cold = told.where(F.col(f"_told.{size}") < least).select(F.struct("_key", F.lit(0).alias("_salt")).alias("_cold_key"), F.col("_told").alias("_cold"))
    cold = cold.hint("merge") if merge else cold
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(1_000_000))).cast("int")
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_salted", F.struct(F.col(key).alias("_key"), salt.alias("_salt"))).join(cold, F.col("_salted") == F.col("_cold_key"), "left")
    told = F.coalesce("_hot", "_cold")
    return out.select(*rows.columns, *[told[c].alias(c) for c in values])
