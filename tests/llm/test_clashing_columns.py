"""Operators that keep rows keep all their columns, whatever these are called."""

from ledgerlens.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from tests.llm.cases import clashing, docs

NAMES = ["_id", "_h", "_first", "_bad", "_row", "_item", "component_id", "h", "taken", "toxic", "seed"]


def test_row_operators(spark):
    from pyspark.sql import functions as F

    wide = clashing(docs(spark))
    wide = wide.select("*", *[F.lit("x").alias(n) for n in NAMES if n not in wide.columns])
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "word " * 20)], "item_id long, text string")
    for kept in (exact_dedup.drop_duplicates(wide), simhash.keep_one_of_each(wide), decontaminate.drop_contaminated(wide, benchmark), toxicity.drop_toxic(wide, labels), mixing.mixed_documents(wide)):
        assert kept.columns == wide.columns
        assert 0 < kept.count()
    for empty in (exact_dedup.drop_duplicates(wide.limit(0)), simhash.keep_one_of_each(wide.limit(0)), decontaminate.drop_contaminated(wide.limit(0), benchmark), toxicity.drop_toxic(wide.limit(0), labels.limit(0)), mixing.mixed_documents(wide.limit(0))):
        assert empty.columns == wide.columns and empty.count() == 0
