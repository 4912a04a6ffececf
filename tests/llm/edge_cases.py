"""The rows that every operator must handle."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])
LONG = "lorem ipsum dolor sit amet " * 40_000
EDGE = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t ", None),
    (4, "one", "en"),
    (5, "the quick brown fox jumps over the lazy dog and runs away", "en"),
    (5, "the quick brown fox jumps over the lazy dog and runs away", "en"),
    (5, "der hund und die katze schlafen auf dem sofa im haus", "de"),
    (None, "der hund und die katze schlafen auf dem sofa im haus", "de"),
    (None, None, None),
    (6, "éé ßß 漢字 🙂 \x00 end", None),
    (7, LONG, "en"),
    (-8, "mail a.b@c.de or 10.0.0.1 now", "en"),
]
