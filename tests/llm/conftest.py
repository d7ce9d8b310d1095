import pytest


@pytest.fixture
def documents(spark):
    """Documents as the tables have them, with columns named like those that operators use for themselves."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in ((*r, "src0")[:3] for r in rows)]
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F

        return df.withColumns({"n_words": F.lit("clash"), "spans": F.lit(1), "_row": F.lit(7)} | dict.fromkeys(("_nth", "_pii_id", "_pii_key", "_order", "order"), F.lit(2)))

    return make
