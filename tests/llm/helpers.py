"""Small tables and plain versions of the operators."""

import re

from pyspark.sql import types as T

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank at dusk"


def table(spark, rows):
    """(doc_id, text[, lang, source]) as documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [
    (1, "A b\t\nc"), (2, "A b c"), (3, None), (4, ""), (5, "a b c"), (6, "A  b c "), (7, "naïve Straße 数学 ١٢  x 😀 don't we'll"),
    (8, "word " * 20000), (9, "x" * 3000), (10, "\n\n  leading\r\nand trailing  \n"), (11, None, None, None), (12, " "), (13, BASE), (14, BASE + " again"), (2, "A b c"),
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))
