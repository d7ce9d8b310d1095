"""Small builders shared by the tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.schema import ARTICLE

WHEN = dt.datetime(2024, 1, 1)


def article(**over):
    base = {
        "title": "Test Article Title",
        "content": "This is a test article content with some sample text.",
        "url": "https://example.com/test-article",
        "source": "Test Source",
        "published_date": WHEN,
        "scraped_date": WHEN,
        "author": "Test Author",
        "summary": None,
        "keywords": ["test", "article", "sample"],
        "category": None,
        "source_type": "website",
        "sentiment": None,
        "metadata": {},
    }
    return base | over


def articles(spark, rows):
    """ARTICLE rows with ``seq`` in list order."""
    rows = [article(**r) for r in rows]
    schema = T.StructType([*ARTICLE.fields, T.StructField("seq", T.LongType())])
    data = [[r[f] for f in ARTICLE.names] + [i] for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "seq long, content string")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("seq").collect()]


def as_of():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")
