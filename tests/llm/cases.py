"""Small document tables with the cases that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    (1, "One line that is long enough to be counted as a shared line, surely.", "en", "b", 1),
    (2, "one LINE that is long enough to be counted as a shared line, surely. \nother", "en", "a", 1),
    (2, "one LINE that is long enough to be counted as a shared line, surely. \nother", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "", "en", None, 0),
    (6, " \t\n ", "fr", "a", 3),
    (None, "password = hunter2hunter2 and more words here", None, "a", None),
    (None, None, None, None, None),
    (7, "ünï çödé 𝔘𝔫𝔦 <|endoftext|> don't  two  spaces   x\r\n\r\n end ", "de", "𐀀", 1),
    (8, "word " * 5000, "en", "a", 25000),
    (9, "x" * 50000, "en", "c", 50000),
]


def docs(spark, rows=ODD, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def clashing(df):
    """The same rows with more columns, whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["keep_id", "group_size", "kept", "_key", "_salt", "maybe", "node", "f0", "key", "pop", "part", "shard", "region", "item_id", "words", "size", "score", "_id", "_text", "_lines"]
    return df.select("*", *[F.lit(1).alias(n) for n in names])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
