"""JSON payloads of news APIs and aggregators to articles, and the source catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.functions.dates import parse_date, parse_iso
from newsmood.functions.text import clean_text, first_filled, or_empty
from newsmood.operators.textjobs import frequent_keywords
from newsmood.schema import ARTICLE

API_RESPONSE = """
    status string, message string,
    articles array<struct<
        title string, url string, content string, description string,
        source struct<id string, name string>, publishedAt string, author string, urlToImage string>>
"""
CATALOG_RESPONSE = """
    status string, message string,
    sources array<struct<
        id string, name string, description string, url string,
        category string, language string, country string>>
"""
FEED_ITEM = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "title", "url", "published date", "published", "published_at", "description", "snippet",
        )
    ]
    + [
        T.StructField("publisher", T.StructType([T.StructField("title", T.StringType())])),
        T.StructField("source", T.StringType()),
    ]
)
FEED_ITEMS = T.ArrayType(FEED_ITEM)


def _no_sentiment() -> Column:
    return F.lit(None).cast(ARTICLE["sentiment"].dataType).alias("sentiment")


def parse_responses(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``response`` (parsed), ``ok`` and ``error_message`` to landed API responses."""
    response = F.explode(F.array(F.from_json(F.col(payload), API_RESPONSE))).alias("response")
    status = F.col("response.status")
    return (
        payloads.select(*[c for c in payloads.columns if c != payload], response)
        .withColumn("ok", F.coalesce(status == "ok", F.lit(False)))
        .withColumn(
            "error_message",
            F.when(
                ~F.col("ok"),
                F.concat(
                    F.lit("News API error: "),
                    F.coalesce(F.col("response.message"), F.lit("Unknown error")),
                ),
            ),
        )
    )


def responses_to_articles(responses: DataFrame, as_of: Column, *keep: str) -> DataFrame:
    """Articles of the successful responses; those without title or URL are dropped.

    Content that is missing or cut short gives way to the description.
    """
    items = responses.where("ok").select(
        *keep, F.posexplode("response.articles").alias("item_pos", "a")
    )
    a = F.col("a")
    title = clean_text(a["title"])
    content, description = clean_text(a["content"]), clean_text(a["description"])
    cut = (content == "") | content.endswith("[+") | content.endswith("...")
    return (
        items.where((title != "") & (or_empty(a["url"]) != ""))
        .select(
            title.alias("title"),
            F.when(cut, description).otherwise(content).alias("content"),
            a["url"].alias("url"),
            F.coalesce(a["source"]["name"], F.lit("Unknown")).alias("source"),
            F.coalesce(parse_iso(a["publishedAt"]), as_of).alias("published_date"),
            as_of.alias("scraped_date"),
            a["author"].alias("author"),
            description.alias("summary"),
            F.lit(None).cast("string").alias("category"),
            F.lit("api").alias("source_type"),
            _no_sentiment(),
            F.create_map(
                F.lit("api_source"), F.lit("newsapi"),
                F.lit("source_id"), or_empty(a["source"]["id"]),
                F.lit("url_to_image"), or_empty(a["urlToImage"]),
            ).alias("metadata"),
            "item_pos",
            *keep,
        )
        .withColumn("keywords", frequent_keywords(first_filled(F.col("content"), F.col("summary")), 5))
    )


def feed_items_to_articles(payloads: DataFrame, as_of: Column, *keep: str, payload: str = "payload") -> DataFrame:
    """Articles of aggregator results (a JSON array of items per payload)."""
    items = payloads.select(
        *keep, F.posexplode(F.from_json(F.col(payload), FEED_ITEMS)).alias("item_pos", "a")
    )
    a = F.col("a")
    title = clean_text(a["title"])
    description = clean_text(first_filled(a["description"], a["snippet"]))
    date = first_filled(a["published date"], a["published"], a["published_at"])
    return (
        items.where((title != "") & (or_empty(a["url"]) != ""))
        .select(
            title.alias("title"),
            a["url"].alias("url"),
            F.coalesce(
                first_filled(a["publisher"]["title"], a["source"]), F.lit("Google News")
            ).alias("source"),
            F.coalesce(parse_date(date), as_of).alias("published_date"),
            as_of.alias("scraped_date"),
            F.lit(None).cast("string").alias("author"),
            description.alias("summary"),
            F.lit(None).cast("string").alias("category"),
            F.lit("api").alias("source_type"),
            _no_sentiment(),
            F.create_map(F.lit("api_source"), F.lit("gnews")).alias("metadata"),
            "item_pos",
            *keep,
        )
        .withColumns(
            {
                "content": first_filled(F.col("summary"), F.col("title")),
                "keywords": frequent_keywords(F.concat_ws(" ", "title", "summary"), 5),
            }
        )
    )


def source_catalog(
    payloads: DataFrame,
    category: str | None = None,
    language: str | None = "en",
    country: str | None = None,
    payload: str = "payload",
) -> DataFrame:
    """Sources listed by successful catalog responses, filtered by what is given."""
    r = F.explode(F.array(F.from_json(F.col(payload), CATALOG_RESPONSE)))
    rows = (
        payloads.select(r.alias("r"))
        .where("r.status = 'ok'")
        .select(F.explode("r.sources").alias("s"))
        .select("s.*")
    )
    for name, value in (("category", category), ("language", language), ("country", country)):
        if value:
            rows = rows.where(F.col(name) == value)
    return rows
