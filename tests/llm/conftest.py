import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text[, lang, source]) rows, with columns whose names the operators use themselves."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("n", "key", "signature", "hashes", "component", "token", "ids", "decoded", "size", "target", "kept", "row", "gone", "bits"):
                df = df.withColumn(name, F.lit(name))
        return df

    return make


def edge_rows():
    """Null and empty texts, white space, ties, repeated rows, one very long text."""
    return [(900, None), (901, ""), (902, " \n\t "), (903, "word"), (904, "word"), (905, "a b c d e f"), (905, "a b c d e f"), (906, "long " * 30_000 + "end"), (None, "no id here at all"), (907, "Ünï çødé ｔｅｘｔ 😀 x", None, None)]
