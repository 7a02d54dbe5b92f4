"""Rows that every operator must take: nulls, blanks, long texts, repeats, ties, and columns of clashing names."""

from pyspark.sql import types as T

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of"]
LONG = " ".join(WORDS[i * i % 6] + str(i % 97) for i in range(12_000)) + "\n" + "x" * 5_000
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t\n", None, None),
    (4, LONG, "en", "a"),
    (5, "The same text stands here twice, word by word, and has a line.\nAnother line of it.", "en", "b"),
    (5, "The same text stands here twice, word by word, and has a line.\nAnother line of it.", "en", "b"),
    (6, "The same text stands here twice, word by word, and has a line.\nAnother line of it.", "de", "b"),
    (None, "Ein Text ohne Nummer, é à ü ß 日本語 ▁ <|endoftext|> İK", "de", "b"),
    (7, "one two", None, "a"),
    (8, "token = \"24be64439e3e49cf46b2d7c9\" mail a.b@mail.example.com +1 (017) 555-7713 or 10.0.0.255", "en", None),
]
CLASHES = "n_words n_chars f0 node component_id label labels content term ids spans bucket kept removed score quality first line".split()


def docs(spark, rows=ROWS):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(c, T.LongType()) for c in CLASHES)])
    return spark.createDataFrame([(*r, *([7] * len(CLASHES))) for r in rows], schema)


def empty(spark):
    return docs(spark, [])
