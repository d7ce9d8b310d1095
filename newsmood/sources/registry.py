"""Parsers by payload kind, and the log of ingest runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.functions.text import clean_text, or_empty
from newsmood.sources.api import FEED_ITEMS, feed_items_to_articles, parse_responses, responses_to_articles
from newsmood.sources.feeds import explode_feeds, feed_items, items_to_articles
from newsmood.sources.pages import extract_articles, usable_articles

Parser = Callable[[DataFrame, Column], DataFrame]
_PARSERS: dict[str, Parser] = {}


def register_parser(kind: str, parser: Parser) -> None:
    """Add a parser: landed payload rows and ``as_of`` in, ARTICLE rows out."""
    _PARSERS[kind] = parser


def remove_parser(kind: str) -> bool:
    return _PARSERS.pop(kind, None) is not None


def parser_kinds() -> list[str]:
    return list(_PARSERS)


def parse(kind: str, payloads: DataFrame, as_of: Column) -> DataFrame:
    if kind not in _PARSERS:
        raise KeyError(f"no parser for {kind!r}; known: {', '.join(_PARSERS)}")
    return _PARSERS[kind](payloads, as_of)


# Parsers keep ``item_pos``, the place of an article in its payload.
register_parser("rss", lambda df, as_of: items_to_articles(explode_feeds(df), as_of, "item_pos"))
register_parser("newsapi", lambda df, as_of: responses_to_articles(parse_responses(df), as_of))
register_parser("gnews", lambda df, as_of: feed_items_to_articles(df, as_of))
register_parser("web", lambda df, as_of: extract_articles(df, as_of).withColumn("item_pos", F.lit(0)))


def _usable(items: Column, link: str) -> Column:
    """Items that a parser keeps: those with a title and a link."""
    kept = F.filter(items, lambda i: (clean_text(i["title"]) != "") & (or_empty(i[link]) != ""))
    return F.coalesce(F.size(kept), F.lit(0))


def feed_responses(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Landed feeds with ``ok``, ``error_message`` and ``n_articles``, for ``ingest_log``."""
    items = payloads.withColumn("_items", feed_items(F.col(payload)))
    return _judged(items, _usable(F.col("_items"), "link"), "Feed error: not a feed")


def item_responses(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Landed aggregator results with ``ok``, ``error_message`` and ``n_articles``."""
    items = payloads.withColumn("_items", F.from_json(F.col(payload), FEED_ITEMS))
    return _judged(items, _usable(F.col("_items"), "url"), "Aggregator error: no list of items")


def page_responses(payloads: DataFrame, html: str = "html") -> DataFrame:
    """Landed pages with ``ok``, ``error_message`` and ``n_articles``: a page without an article is a
    page that could not be read."""
    n = usable_articles(payloads, html)
    return payloads.withColumn("n_articles", n).withColumns(
        {"ok": F.col("n_articles") > 0, "error_message": F.when(F.col("n_articles") == 0, F.lit("Page error: no article"))}
    )


def _judged(rows: DataFrame, n: Column, message: str) -> DataFrame:
    ok = F.col("_items").isNotNull()
    return rows.withColumns({"ok": ok, "error_message": F.when(~ok, F.lit(message)), "n_articles": n}).drop("_items")


def ingest_log(
    responses: DataFrame,
    as_of: Column,
    source: str = "source",
    source_type: Column | None = None,
    articles: Column | None = None,
) -> DataFrame:
    """One log row per source from parsed payloads with ``ok`` and ``error_message``.

    A source succeeds when none of its payloads failed; otherwise the first message
    by payload text order is kept. Articles are those that the parser keeps: ``articles`` for a
    payload, or else the usable items of its API response. Counts are partial sums, so a busy
    source is fine.
    """
    n = articles if articles is not None else _usable(F.col("response.articles"), "url")
    return responses.groupBy(source).agg(
        (source_type if source_type is not None else F.lit("api")).alias("source_type"),
        F.min("ok").alias("success"),
        F.min("error_message").alias("error_message"),
        F.lit(0.0).alias("scraping_time"),
        as_of.alias("timestamp"),
        F.coalesce(F.sum(F.when(F.col("ok"), n)), F.lit(0)).cast("long").alias("article_count"),
    )
