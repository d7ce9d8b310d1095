"""Table schemas and closed value domains."""

from __future__ import annotations

from pyspark.sql import types as T

# Label and source-type domains, and the length limits of the stored table.
LABELS = ("positive", "negative", "neutral")
SOURCE_TYPES = ("rss", "api", "website")
LENGTH_LIMITS = {
    "title": 1000,
    "url": 2000,
    "source": 200,
    "author": 300,
    "category": 100,
    "source_type": 50,
    "sentiment_label": 20,
    "sentiment_model": 100,
}

SENTIMENT = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("model_used", T.StringType()),
    ]
)

ARTICLE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("published_date", T.TimestampType()),
        T.StructField("scraped_date", T.TimestampType()),
        T.StructField("author", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("category", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("sentiment", SENTIMENT),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

STORED = T.StructType(
    [f for f in ARTICLE.fields if f.name not in ("sentiment", "metadata")]
    + [
        T.StructField("sentiment_label", T.StringType()),
        T.StructField("sentiment_confidence", T.DoubleType()),
        T.StructField("sentiment_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("sentiment_model", T.StringType()),
        T.StructField("article_metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("reading_time", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

INGEST_LOG = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("scraping_time", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("article_count", T.LongType()),
    ]
)
