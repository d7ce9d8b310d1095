"""Model scoring of texts through Spark ML or any pluggable scorer."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmood.functions.scores import map_model_label
from newsmood.functions.text import NOT_WS, analysis_words
from newsmood.operators.sentiment import Analyzer, sentiment_struct
from newsmood.operators.textjobs import chunks
from newsmood.session import work_path

# A scorer maps a frame with a ``text`` column to the same rows plus ``scores``
# (label -> probability).
Scorer = Callable[[DataFrame], DataFrame]

_SCORES = T.MapType(T.StringType(), T.DoubleType())


def train(df: DataFrame, label: str, features: int = 1 << 16, max_iter: int = 20) -> PipelineModel:
    """A TF-IDF logistic regression over ``text``; ``label`` is 0-based.

    Trained by distributed passes; the model held on the driver is ``features`` weights.
    """
    counts = Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_w", pattern=f"{NOT_WS}+", gaps=False),
            HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features),
        ]
    ).fit(df)
    fitted = Pipeline(
        stages=[
            IDF(inputCol="_tf", outputCol="_x"),
            LogisticRegression(featuresCol="_x", labelCol=label, maxIter=max_iter),
        ]
    )
    # Both passes read the words' counts; the texts are split once for the two.
    path = work_path(df.sparkSession, "model-counts")
    counts.transform(df).select(label, "_tf").write.parquet(path)
    return PipelineModel([*counts.stages, *fitted.fit(df.sparkSession.read.parquet(path)).stages])


def ml_scorer(model: PipelineModel, labels: Sequence[str]) -> Scorer:
    """Scorer of a fitted pipeline; ``labels[i]`` names class ``i``."""

    def run(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        p = vector_to_array("probability")
        pairs = [x for i, name in enumerate(labels) for x in (F.lit(name), p[i])]
        return out.withColumn("scores", F.create_map(*pairs)).select(*df.columns, "scores")

    return run


def udf_scorer(udf: Callable[[Column], Column]) -> Scorer:
    """Scorer of a (pandas or ``predict_batch_udf``) function ``text -> map<string,double>``.

    Batching is Arrow's: ``spark.sql.execution.arrow.maxRecordsPerBatch``, or the
    ``batch_size`` of ``predict_batch_udf``.
    """
    return lambda df: df.withColumn("scores", udf(F.col("text")))


#: Scores of some texts, each label -> probability. It may raise, or give None for a text.
ScoreTexts = Callable[[list[str]], list[dict[str, float] | None]]


def batch_scorer(make: Callable[[], ScoreTexts], batch_size: int = 8, error: str | None = None) -> Scorer:
    """Scorer of any Python model: ``make`` loads it once in a task, which then scores ``batch_size``
    texts at a time.

    A batch that fails is halved until the texts that fail stand alone; those alone are left without
    scores, which ``score_texts`` and ``chunk_scores`` take for neutral with confidence 0 and for
    nothing, and the others keep theirs. A column named ``error`` gets what was raised. Results of
    the wrong number, and scores that are no finite numbers, are failures too. Texts go to Python in
    Arrow batches, only the column they are in.
    """
    answer = T.StructType([T.StructField("scores", _SCORES), T.StructField("error", T.StringType())])

    @F.pandas_udf(answer)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()

        def tried(texts: list[str]) -> list[tuple[dict | None, str | None]]:
            try:
                found = list(model(texts))
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} results for {len(texts)} texts")
                return [_checked(f) for f in found]
            except Exception as problem:  # a model may raise anything
                if len(texts) == 1:
                    return [(None, f"{type(problem).__name__}: {problem}")]
                half = len(texts) // 2
                return tried(texts[:half]) + tried(texts[half:])

        for texts in parts:
            values = texts.fillna("").tolist()
            rows = [r for at in range(0, len(values), batch_size) for r in tried(values[at : at + batch_size])]
            yield pd.DataFrame({"scores": [r[0] for r in rows], "error": [r[1] for r in rows]}, dtype=object)

    # Called non-deterministic, it is not evaluated once for each use of its answer.
    once = score.asNondeterministic()

    def run(df: DataFrame) -> DataFrame:
        out = df.withColumn("_answer", once("text")).withColumn("scores", F.col("_answer.scores"))
        if error is not None:
            out = out.withColumn(error, F.col("_answer.error"))
        return out.drop("_answer")

    return run


def _checked(found: dict[str, float] | None) -> tuple[dict | None, str | None]:
    if not found:
        return None, "no scores"
    scores = {str(k).lower(): float(v) for k, v in found.items()}
    bad = [k for k, v in scores.items() if not math.isfinite(v)]
    return (None, f"no number for {bad[0]}") if bad else (scores, None)


def best_label(scores: Column) -> Column:
    """Label of the highest score (ties: by name); NULL for an empty map."""
    ranked = F.transform(
        F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))
    )
    return F.get(F.sort_array(ranked), F.lit(0))["k"]


def score_texts(df: DataFrame, scorer: Scorer, model: str = "model") -> DataFrame:
    """Sentiment of a ``text`` column as it is: no truncation, no chunks.

    Rows the scorer returns no scores for are neutral with confidence 0.
    """
    no_scores = F.create_map().cast("map<string,double>")
    scores = F.coalesce("scores", no_scores)
    best = best_label(scores)
    return (
        scorer(df)
        .withColumn(
            "sentiment",
            sentiment_struct(
                F.when(best.isNull(), "neutral").otherwise(map_model_label(best)),
                F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0)),
                scores,
                model,
            ),
        )
        .drop("scores")
    )


def chunk_scores(
    df: DataFrame,
    scorer: Scorer,
    key: str,
    max_length: int = 512,
    overlap: int | None = 50,
    model: str = "model",
) -> DataFrame:
    """``(key, sentiment, n_parts)`` of title and content, long texts scored in parts.

    ``key`` identifies a row; parts without scores do not count. Scores are added as decimals by (key, label) where the
    parts were scored, so sums are small and the same in any order.
    """
    tokens = analysis_words(F.col("title"), F.col("content"))
    parts = df.select(key, F.posexplode(chunks(tokens, max_length, overlap)).alias("part", "text"))
    # A part's count and best score ride along as one more row without a label, so one
    # sum per (key, label) covers labels that are missing from some parts.
    entry = lambda label, score: F.struct(label.alias("label"), score.cast(_SUM).alias("score"))
    of_labels = F.transform(F.map_entries("scores"), lambda e: entry(e["key"], e["value"]))
    of_part = F.array(entry(F.lit(None).cast("string"), F.array_max(F.map_values("scores"))))
    sums = (
        scorer(parts)
        .where(F.size("scores") > 0)
        .select(key, F.explode(F.concat(of_labels, of_part)).alias("e"))
        .groupBy(key, "e.label")
        .agg(F.sum("e.score").alias("total"), F.count(F.lit(1)).alias("n"))
    )
    # One group holds the labels of the model, not the rows of a source.
    named = F.when(F.col("label").isNotNull(), F.struct("label", F.col("total").cast("double")))
    alone = F.col("label").isNull()
    totals = sums.groupBy(key).agg(
        F.map_from_entries(F.collect_list(named)).alias("t"),
        F.max(F.when(alone, F.col("total"))).cast("double").alias("best"),
        F.max(F.when(alone, F.col("n"))).alias("n"),
    )
    means = F.transform_values("t", lambda k, v: v / F.col("n"))
    return totals.withColumn("m", means).select(
        key,
        sentiment_struct(
            map_model_label(best_label(F.col("m"))), F.col("best") / F.col("n"), F.col("m"), model
        ).alias("sentiment"),
        F.col("n").alias("n_parts"),
    )


#: Scores are added exactly to twelve places.
_SUM = "decimal(28,12)"


def model_analyzer(scorer: Scorer, key: str, max_length: int = 512, overlap: int | None = 50, model: str = "model") -> Analyzer:
    """The scorer as an analyzer for ``register_analyzer``; blank texts are neutral."""

    def run(df: DataFrame) -> DataFrame:
        scores = chunk_scores(df, scorer, key, max_length, overlap, model).drop("n_parts")
        neutral = sentiment_struct(
            F.lit("neutral"), F.lit(0.0), F.create_map().cast("map<string,double>"), model
        )
        return (
            df.drop("sentiment")
            .join(scores, key, "left")
            .withColumn("sentiment", F.coalesce("sentiment", neutral))
        )

    return run


# Executors get the code of the tasks with the tasks and need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
