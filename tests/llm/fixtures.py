"""Small tables with the awkward cases every operator has to take."""

from pyspark.sql import types as T

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long").add("score", "string").add("Shard", "string").add("size", "string").add("ids", "string").add("words", "string")

SENTENCE = "The quick brown fox jumps over the lazy dog while the patient farmer counts seven hundred white sheep near a slow river. "
LONG = "".join(f"Line {i} of a very long report mentions item {i * 7919 % 1000} and {SENTENCE.upper()}\n" for i in range(900))

ROWS = [
    (1, "Hello world, this is a plain text.", "en", "web", None),
    (2, None, "en", "web", None),
    (3, "", None, None, None),
    (4, LONG, "en", "web", len(LONG)),
    (5, SENTENCE * 3, "en", "books", 1),
    (6, SENTENCE * 3, "en", "books", 1),
    (6, SENTENCE * 3, "en", "books", 1),
    (7, SENTENCE * 3 + "An ending of its own.", "de", "web", 1),
    (None, "A row without an id, " + SENTENCE, "en", "web", 1),
    (8, "日本語のテキスト 😀 Ünïcödé   Σίσυφος ß " * 4, "ja", "forum", 1),
    (9, " \t\n ", "en", "web", 1),
    (10, "word", "en", None, 1),
    (11, "\x00\x01 control \x7f bytes <|endoftext|> don't 1234 5'S", "en", "web", 1),
    (12, "a" * 5000, "xx", "junk", 1),
]


def awkward(spark, copies: int = 1):
    return spark.createDataFrame([(*r, "x", "y", "z", "i", "w") for r in ROWS * copies], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
