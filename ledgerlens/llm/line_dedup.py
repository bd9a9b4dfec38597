"""Dropping lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import attach, id_text, materialise, table
from ledgerlens.llm.exact_dedup import filter_of, possibly_repeated

#: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, text (the lines that stay, joined by newlines).

    A key of min_chars code points or more that min_docs documents hold loses
    its lines in all of them but that with the largest id. Lines travel as
    128-bit hashes and positions. A text is shuffled, to meet the positions
    that it loses, only if a filter of bounded size of those that lose any has it; the others
    pass straight through. Keys in very many lines are joined by broadcast (common.attach).

    A null or empty text is one empty line. Rows with the same id are one
    document for the count; null ids are one document with the smallest id. No
    rows give no rows; other columns are not read.
    """
    split = id_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), "doc_id", F.xxhash64("text").alias("_text"), F.split("text", "\n").alias("_lines")
    )
    lines = (
        split.select("_id", "_text", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_text", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
        .select("_id", "_text", "_pos", F.unhex(F.md5("_key")).alias("_hash"))
    )
    lines = materialise(lines, "line-hashes")
    common = lines.groupBy("_hash", "_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("_hash").agg(
        F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_keeper"), F.sum("_n").alias("_size")
    ).where(F.col("_docs") >= min_docs)
    # lines whose key is common stay few: a null _keeper marks the others
    gone = attach(lines, common, "_hash", "_size", lines.count(), ["_id", "_pos"]).where(F.col("_keeper") != F.col("_id"))
    gone = materialise(gone.groupBy("_id", "_text").agg(F.collect_set("_pos").alias("_gone")).withColumn("hash", F.xxhash64("_id", "_text")), "dropped-lines")
    tested = possibly_repeated(split.withColumn("hash", F.xxhash64("_id", "_text")), *filter_of(gone, gone.count()))
    whole = tested.where(~F.col("maybe")).select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.array_join("_lines", "\n").alias("text"))
    met = tested.where("maybe").select("_id", "_text", "doc_id", "_lines").join(gone.drop("hash"), ["_id", "_text"], "left")
    none = F.array().cast("array<int>")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", none))
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get("_lines", i)))
    cut = met.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.size(F.coalesce("_gone", none)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))
    return whole.unionByName(cut)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
           GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone
           FROM k LEFT JOIN c ON k.key = c.key AND length(k.key) >= 40)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
