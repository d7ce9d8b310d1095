"""Composed jobs: ingest to summary, ingest only, re-analysis, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.operators.articles import (
    cap_per_source,
    first_by_url,
    from_stored,
    tidy,
    to_stored,
    union_sources,
)
from newsmood.operators.ensemble import analyze_with
from newsmood.operators.sentiment import analyze
from newsmood.operators.stats import (
    analysis_summary,
    sentiment_stats,
    source_registry_stats,
)
from newsmood.operators.store import upsert
from newsmood.sources.files import write_articles
from newsmood.sources.registry import parse

# The keywords a run looks for when none are given.
DEFAULT_KEYWORDS = (
    "technology", "artificial intelligence", "machine learning", "cryptocurrency", "blockchain",
    "climate change", "politics", "economy", "healthcare", "science",
)


@dataclass(frozen=True)
class RunResult:
    """Frames of a run; nothing is computed until one of them is used."""

    articles: DataFrame
    stored: DataFrame
    summary: DataFrame


def ingest(
    payloads: dict[str, DataFrame],
    as_of: Column,
    keywords: Sequence[str] | None = None,
    max_per_source: int | None = None,
    order: Sequence[str] = ("item_pos", "url"),
) -> DataFrame:
    """Parse every payload kind, cap each source to its first articles in feed order, keep keyword
    matches, union."""
    frames = [
        cap_per_source(parse(kind, df, as_of), max_per_source, keywords, "before", order).drop("item_pos")
        for kind, df in payloads.items()
    ]
    return union_sources(*frames)


def ingest_to_summary(
    found: DataFrame,
    as_of: Column,
    analyzer: str | Sequence[str] = "lexicon",
    store: DataFrame | None = None,
    order: Sequence[str] = ("seq",),
) -> RunResult:
    """Clean, score and dedup articles, upsert them into ``store``, summarise.

    Scoring is narrow and comes before the dedup shuffle; the summary counts the
    same scored rows and leaves texts out of its own shuffle by column pruning.
    """
    ready = tidy(found)
    scored = analyze(ready, analyzer) if isinstance(analyzer, str) else analyze_with(ready, analyzer)
    unique = first_by_url(scored, *order)
    rows = to_stored(unique, as_of)
    saved = rows if store is None else upsert(store, rows, "updated_at")
    summary = analysis_summary(
        unique.select(
            F.col("sentiment.label").alias("sentiment_label"),
            F.col("sentiment.confidence").alias("sentiment_confidence"),
        )
    )
    return RunResult(unique, saved, summary)


def save_run(result: RunResult, store_path: str, export_path: str | None = None, fmt: str = "json") -> int:
    """Write the stored table to a new place and export from what was written.

    The run is computed once. An existing ``store_path`` is an error, as the run may read it.
    """
    result.stored.write.mode("error").parquet(store_path)
    written = result.stored.sparkSession.read.parquet(store_path)
    return written.count() if export_path is None else write_articles(from_stored(written), export_path, fmt)


def system_stats(store: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store counts and source counts."""
    return sentiment_stats(store), source_registry_stats(sources)
