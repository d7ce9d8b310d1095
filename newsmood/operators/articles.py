"""Cleaning, dedup, filters, ranking and stored-row conversion of article tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmood.functions.text import first_filled, or_empty, reading_minutes, strip, word_count
from newsmood.schema import LENGTH_LIMITS, SOURCE_TYPES

# Rounds of a per-key limit: about the square root of the largest number of input
# partitions, so that no task of any round sees more than that many times n rows of a key.
LIMIT_SALTS = 1024
# Spark pushes rank limits up to this size below the shuffle by default.
PUSHED_LIMIT = 1000
COPY_SALTS = 32


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = LIMIT_SALTS
) -> DataFrame:
    """First ``n`` rows per key.

    A key may own a third of the table. Every task first keeps only its own best
    ``n``: Spark pushes the rank limit below the shuffle, and for an ``n`` it does not
    push, a round per input partition does the same. A salted round then spreads the
    survivors of a hot key before the last one. One row per key needs no salt.
    """
    rank = F.row_number()

    def limit(rows: DataFrame, *by: str) -> DataFrame:
        spec = W.partitionBy(*keys, *by).orderBy(*order)
        return rows.select("*", rank.over(spec).alias("_rank")).where(F.col("_rank") <= n).drop("_rank")

    if n > 1:
        df = df.select("*", F.spark_partition_id().alias("_part"))
        if n > PUSHED_LIMIT:
            df = limit(df, "_part")
        df = limit(df.withColumn("_salt", F.col("_part") % salts), "_salt").drop("_part", "_salt")
    return limit(df)


def first_by_url(df: DataFrame, *order: str) -> DataFrame:
    """One row per URL: the first in the given order (``seq`` by default).

    Rows of one URL never meet in one task: each task forwards a single row per URL.
    """
    return top_n_per_group(df, ["url"], [F.col(c) for c in order or ("seq",)], 1)


def tidy(df: DataFrame) -> DataFrame:
    """Drop rows without title, content or URL, then strip title and content.

    Emptiness is tested before stripping, so blank-only values pass. Narrow.
    """
    filled = [or_empty(F.col(c)) != "" for c in ("title", "content", "url")]
    return df.where(filled[0] & filled[1] & filled[2]).withColumns(
        {"title": strip(F.col("title")), "content": strip(F.col("content"))}
    )


def clean_articles(df: DataFrame, *order: str) -> DataFrame:
    """``tidy`` and the first article per URL in input order.

    When a scorer or other narrow projection follows, prefer ``tidy`` -> projection ->
    ``first_by_url``: the result is the same and texts stay out of the shuffle.
    """
    return first_by_url(tidy(df), *order)


def check_lengths(df: DataFrame) -> DataFrame:
    """Adds ``too_long``: names of the columns above the stored table's limits."""
    over = [
        F.when(F.length(F.col(c)) > n, F.lit(c)) for c, n in LENGTH_LIMITS.items() if c in df.columns
    ]
    return df.withColumn("too_long", F.array_compact(F.array(*over)))


def has_keywords(keywords: Sequence[str], title: str = "title", content: str = "content") -> Column:
    """Any keyword occurs, ignoring case, in ``title content`` (a literal substring).

    Each keyword is one pass over the text; for a table of them use ``keywords.keyword_semi_join``.
    """
    wanted = list(dict.fromkeys(k.lower() for k in keywords))
    text = F.lower(F.concat(or_empty(F.col(title)), F.lit(" "), or_empty(F.col(content))))
    # Through a one-element array the lower-cased text is made once, not per keyword.
    return F.exists(F.array(text), lambda t: F.exists(F.lit(wanted), lambda k: F.contains(t, k)) if wanted else F.lit(False))


def filter_by_keywords(df: DataFrame, keywords: Sequence[str] | None) -> DataFrame:
    return df.where(has_keywords(keywords)) if keywords else df


def query_articles(
    df: DataFrame,
    keywords: Sequence[str] | None = None,
    sentiment: str | None = None,
    source: str | None = None,
    start=None,
    end=None,
    limit: int | None = None,
    mode: str = "like",
    min_confidence: float | None = None,
    order: bool = True,
) -> DataFrame:
    """Stored rows by optional filters, newest first.

    ``mode="like"`` is case-sensitive and lets ``%`` and ``_`` in a keyword act as
    wildcards; ``mode="ci"`` is the literal case-insensitive test. Both date bounds
    are inclusive; a limit of 0 or None means no limit.
    """
    if keywords and mode == "ci":
        df = df.where(has_keywords(keywords))
    elif keywords and mode == "like":
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.col("content").like(f"%{k}%") | F.col("title").like(f"%{k}%")
        df = df.where(hit)
    elif keywords:
        raise ValueError(f"unknown keyword mode: {mode}")
    if sentiment:
        df = df.where(F.col("sentiment_label") == sentiment)
    if source:
        df = df.where(F.col("source") == source)
    if start is not None:
        df = df.where(F.col("published_date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("published_date") <= F.lit(end))
    if min_confidence is not None:
        df = df.where(F.col("sentiment_confidence") >= min_confidence)
    if order or limit:
        df = df.orderBy(F.desc("published_date"), "url")
    return df.limit(limit) if limit else df


def article_by_url(df: DataFrame, url: str) -> DataFrame:
    return df.where(F.col("url") == url)


def cap_per_source(
    df: DataFrame,
    n: int | None,
    keywords: Sequence[str] | None = None,
    cap_mode: str = "before",
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """At most ``n`` rows per source in input order; the keyword filter runs after
    the cap (``before``: cap first) or ahead of it (``after``)."""
    if cap_mode not in ("before", "after"):
        raise ValueError(f"unknown cap mode: {cap_mode}")
    if cap_mode == "after":
        df = filter_by_keywords(df, keywords)
    if n:
        df = top_n_per_group(df, ["source"], [F.col(c) for c in order], n)
    return filter_by_keywords(df, keywords) if cap_mode == "before" else df


def select_sources(
    sources: DataFrame,
    tokens: Sequence[str] | None = None,
    types: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of a ``(name, type, url)`` registry picked by type list or selector tokens.

    Tokens: ``rss`` and ``web`` pick a type, ``newsapi`` and ``gnews`` an exact name,
    and every token picks names that contain it. No usable token picks nothing.
    """
    if types is not None:
        unknown = set(types) - set(SOURCE_TYPES)
        if unknown:
            raise ValueError(f"unknown source types: {sorted(unknown)}")
        sources = sources.where(F.col("type").isin(*types)) if types else sources.where(F.lit(False))
    if tokens is None:
        return sources
    name = F.lower("name")
    hit = F.lit(False)
    for tok in {t.strip().lower() for t in tokens if t and t.strip()}:
        hit = hit | F.contains(name, F.lit(tok))
        if tok == "rss":
            hit = hit | (F.col("type") == "rss")
        elif tok == "web":
            hit = hit | (F.col("type") == "website")
    return sources.where(hit)


def to_stored(df: DataFrame, as_of: Column) -> DataFrame:
    """ARTICLE rows to stored rows: sentiment flattened, counts cached, audit times set."""
    n_words = word_count(F.col("content"))
    return df.select(
        *[c for c in df.columns if c not in ("sentiment", "metadata")],
        F.col("sentiment.label").alias("sentiment_label"),
        F.col("sentiment.confidence").alias("sentiment_confidence"),
        F.col("sentiment.scores").alias("sentiment_scores"),
        F.col("sentiment.model_used").alias("sentiment_model"),
        F.col("metadata").alias("article_metadata"),
        n_words.alias("word_count"),
        reading_minutes(n_words).alias("reading_time"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )


def from_stored(df: DataFrame) -> DataFrame:
    """Stored rows back to ARTICLE rows; absent arrays, maps and confidence get defaults."""
    no_scores = F.create_map().cast("map<string,double>")
    no_metadata = F.create_map().cast("map<string,string>")
    sentiment = F.struct(
        F.col("sentiment_label").alias("label"),
        F.coalesce("sentiment_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("sentiment_scores", no_scores).alias("scores"),
        or_empty(F.col("sentiment_model")).alias("model_used"),
    )
    gone = {
        "sentiment_label", "sentiment_confidence", "sentiment_scores", "sentiment_model",
        "article_metadata", "word_count", "reading_time", "created_at", "updated_at", "keywords",
    }
    return df.select(
        *[c for c in df.columns if c not in gone],
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.when(first_filled(F.col("sentiment_label")).isNotNull(), sentiment).alias("sentiment"),
        F.coalesce("article_metadata", no_metadata).alias("metadata"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of several ingest frames; columns a frame lacks are NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
