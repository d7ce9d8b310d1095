"""Counts, shares and report rows. Each is one scan with partial aggregation.

Confidences are summed as decimals, so a mean is the same for every row order and retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmood.schema import LABELS


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def sentiment_stats(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """One row: total, analyzed, and a count for each of the three labels, zeros included."""
    c = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count(c).alias("analyzed_articles"),
        *[_n(c == name).alias(name) for name in LABELS],
    )


def analysis_summary(
    df: DataFrame, label: str = "sentiment_label", confidence: str = "sentiment_confidence"
) -> DataFrame:
    """Rows ``(label, n, articles_processed, average_confidence)`` for the labels present; without
    any scored article one row of zeros with no label."""
    by_label = (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(confidence).cast("decimal(20,12)")).alias("s"),
        )
    )
    # The window runs over the counts, one row per label.
    every = W.partitionBy()
    # A row of zeros goes along and stays only if it is alone.
    none = by_label.sparkSession.range(1).select(F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(30,12)").alias("s"))
    rows = by_label.unionByName(none)
    total = F.sum("n").over(every)
    return rows.select(
        "label",
        "n",
        total.alias("articles_processed"),
        F.coalesce(F.try_divide(F.sum("s").over(every).cast("double"), total), F.lit(0.0)).alias("average_confidence"),
    ).where("label IS NOT NULL OR articles_processed = 0")


def articles_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n_articles")).orderBy("source")


def sentiment_by_source(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Label counts and percentages per source over the analyzed rows."""
    c = F.col(label)
    counts = df.where(c.isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), *[_n(c == name).alias(f"n_{name}") for name in LABELS]
    )
    return counts.select(
        "*",
        *[(F.col(f"n_{name}") / F.col("total") * 100).alias(f"pct_{name}") for name in LABELS],
    )


def sentiment_share(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Count and percentage of each label present."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).count()
    total = F.sum("count").over(W.partitionBy())  # over the counts, one row per label
    return counts.select(
        "label", F.col("count").alias("n"), (F.col("count") / total * 100).alias("pct")
    )


def top_confident(
    df: DataFrame,
    label: str = "sentiment_label",
    confidence: str = "sentiment_confidence",
    order: str = "seq",
) -> DataFrame:
    """The most confident positive and negative article; the first in input order wins ties."""
    best = F.max_by(
        F.struct("title", "url", F.col(confidence).alias("confidence"), order),
        F.struct(F.col(confidence), -F.col(order)),
    )
    return (
        df.where(F.col(label).isin("positive", "negative"))
        .groupBy(F.col(label).alias("label"))
        .agg(best.alias("b"))
        .select("label", "b.*")
    )


def report_summary(
    df: DataFrame, label: str = "sentiment_label", confidence: str = "sentiment_confidence"
) -> DataFrame:
    """Long form ``(metric, value)`` of the report's summary sheet, numbers unformatted.

    Without any analyzed row only the first three metrics are reported; labels
    that do not occur are left out.
    """
    c = F.col(label)
    # Sources are counted from partial counts, so a distinct set is never built per task.
    per_source = df.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(c).alias("analyzed"),
        *[_n(c == name).alias(name) for name in LABELS],
        F.sum(F.when(c.isNotNull(), F.col(confidence)).cast("decimal(20,12)")).alias("conf"),
    )
    one = per_source.agg(
        F.sum("total").alias("total"),
        F.sum("analyzed").alias("analyzed"),
        *[F.sum(name).alias(name) for name in LABELS],
        F.sum("conf").cast("double").alias("conf"),
        F.count(F.lit(1)).alias("n_sources"),
    )
    some = F.col("analyzed") > 0

    def metric(name: str, value: Column, present: Column) -> Column:
        row = F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
        return F.when(present, row)

    analyzed = F.col("analyzed")
    rows = [
        metric("Total Articles", F.col("total"), F.col("total") > 0),
        metric("Analyzed Articles", analyzed, F.col("total") > 0),
        metric("Analysis Coverage", F.try_divide(analyzed, F.col("total")) * 100, F.col("total") > 0),
    ]
    for name in LABELS:
        title = f"{name.title()} Sentiment"
        rows.append(metric(title, F.col(name), F.col(name) > 0))
        rows.append(
            metric(f"{title} Percent", F.try_divide(F.col(name), analyzed) * 100, F.col(name) > 0)
        )
    rows.append(metric("Average Confidence", F.try_divide(F.col("conf"), analyzed), some))
    rows.append(metric("Number of Sources", F.col("n_sources"), some))
    return one.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def source_registry_stats(sources: DataFrame) -> DataFrame:
    """Sources per type, with a ``total`` row."""
    return sources.rollup("type").agg(F.count(F.lit(1)).alias("n_sources")).select(
        F.coalesce("type", F.lit("total")).alias("type"), "n_sources"
    )


def ingest_run_totals(log: DataFrame) -> DataFrame:
    """One row over an ingest log: sources, successful sources, articles."""
    return log.agg(
        F.count(F.lit(1)).alias("total_sources"),
        _n(F.col("success")).alias("successful_sources"),
        F.coalesce(F.sum("article_count"), F.lit(0)).alias("total_articles"),
    )
