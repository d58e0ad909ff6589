import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text[, source]) rows, with extra columns whose names operators use inside."""
    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            for name in ("size", "hash", "cell", "shard", "slot", "row", "score", "rep", "component_id", "kept", "part", "value", "stretch", "mix", "label", "n"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


#: Nulls, empty texts, repeated rows, white space of other kinds, a long text, letters beyond ASCII.
EDGES = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one two three"), (4, "one two three"), (5, "ONE  two\nthree"), (6, "É é \u00a0x \u2028y"), (None, "no id"), (7, None),
    (8, "word " * 30_000), (9, "x" * 20_000), (10, "a"), (11, "the quick brown fox jumps over the lazy dog again and again"),
]
