"""Votes of several analyzers, and scores of long texts in parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.functions.scores import map_model_label
from newsmood.functions.text import let
from newsmood.operators.sentiment import Analyzer, analyze, get_analyzer, sentiment_struct, with_votes


def combine(votes: dict[str, Column]) -> Column:
    """Majority label of aligned sentiment structs, in analyzer order.

    A tie goes to the label seen first. Confidence is the votes' mean weighted by
    itself, dissenting votes at half. Absent (NULL) votes do not count; without
    any vote the result is NULL. All score maps are merged under ``analyzer_score``.
    """
    entry = lambda name, s: F.when(
        s.isNotNull(),
        F.struct(
            F.lit(name).alias("name"),
            s["label"].alias("label"),
            s["confidence"].alias("confidence"),
            F.transform_keys(s["scores"], lambda k, _: F.concat(F.lit(f"{name}_"), k)).alias("scores"),
        ),
    )

    def pick(v: Column) -> Column:
        labels = F.transform(v, lambda x: x["label"])
        tally = lambda name: F.size(F.filter(labels, lambda y: y == name))
        ranked = F.transform(
            F.array_distinct(labels),
            lambda name, i: F.struct((-tally(name)).alias("neg_n"), i.alias("i"), name.alias("label")),
        )
        return F.get(F.sort_array(ranked), F.lit(0))

    def finish(v: Column, win: Column) -> Column:
        zero = F.lit(0.0)
        weight = F.aggregate(v, zero, lambda a, x: a + x["confidence"])
        agreed = F.aggregate(
            v,
            zero,
            lambda a, x: a
            + x["confidence"] * F.when(x["label"] == win["label"], 1.0).otherwise(0.5),
        )
        ratio = F.when(weight > 0, agreed / weight).otherwise(0.0)

        def build(conf: Column) -> Column:
            own = F.create_map(
                F.lit("consensus_confidence"),
                conf,
                F.lit("analyzer_agreement"),
                -win["neg_n"] / F.size(v),
            )
            # Of equal names the later analyzer's score stays.
            others = lambda a, x: F.map_filter(a, lambda k, _: ~F.map_contains_key(x["scores"], k))
            merged = F.aggregate(v, own, lambda a, x: F.map_concat(others(a, x), x["scores"]))
            names = F.array_join(F.transform(v, lambda x: x["name"]), "+")
            return F.struct(
                win["label"].alias("label"),
                conf.alias("confidence"),
                merged.alias("scores"),
                F.concat(F.lit("ensemble_"), names).alias("model_used"),
            )

        return let(ratio, build)

    entries = F.array_compact(F.array(*[entry(n, s) for n, s in votes.items()]))
    return let(
        entries,
        lambda v: F.when(F.size(v) > 0, let(pick(v), lambda win: finish(v, win))),
    )


def analyze_with(df: DataFrame, analyzers: Sequence[str | tuple[str, Analyzer]]) -> DataFrame:
    """Run several analyzers over the same rows and set ``sentiment`` to their vote.

    Votes sit side by side in the row, so nothing is joined or grouped. Those by functions of the
    analysis text share it and its words.
    """
    votes, of_text = {}, {}
    out = df.drop("sentiment")
    for item in analyzers:
        name, run = item if isinstance(item, tuple) else (item, get_analyzer(item))
        votes[name] = F.col(f"_vote_{name}")
        if hasattr(run, "expr"):
            of_text[f"_vote_{name}"] = run.expr
        else:
            out = analyze(out, run).withColumnRenamed("sentiment", f"_vote_{name}")
    if of_text:
        out = with_votes(out, of_text)
    return out.withColumn("sentiment", combine(votes)).drop(*[f"_vote_{n}" for n in votes])


def combine_votes(
    votes: DataFrame, key: str = "url", order: str = "ord"
) -> DataFrame:
    """The same vote over long rows ``(key, ord, label, confidence)``.

    For votes that arrive as a table. Counts and sums are grouped by key and label
    first, so any number of copies of a key is pre-aggregated before the shuffle.
    """
    conf = F.col("confidence").cast("decimal(20,12)")
    per_label = votes.groupBy(key, "label").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.sum(conf).alias("s")
    )
    win = F.min_by(F.struct("label", "n", "s"), F.struct(-F.col("n"), F.col("first")))
    out = per_label.groupBy(key).agg(
        win.alias("w"), F.sum("n").alias("n"), F.sum("s").alias("s")
    )
    agreed = (F.col("w.s") + (F.col("s") - F.col("w.s")) * F.lit(0.5).cast("decimal(2,1)")).cast("double")
    return out.select(
        key,
        F.col("w.label").alias("label"),
        F.when(F.col("s") > 0, agreed / F.col("s").cast("double")).otherwise(0.0).alias("confidence"),
        (F.col("w.n") / F.col("n")).alias("analyzer_agreement"),
    )


def combine_parts(parts: Column, model: str) -> Column:
    """Combine an array of score maps (one per chunk) into one sentiment struct.

    Mean score per label over all chunks (absent labels count as 0), mean of the
    chunks' best scores as confidence, label of the best mean (ties: by name).
    """
    zero = F.lit(0.0)

    def means(p: Column) -> Column:
        labels = F.array_sort(F.array_distinct(F.flatten(F.transform(p, F.map_keys))))
        mean = lambda k: F.aggregate(
            p, zero, lambda a, m: a + F.coalesce(F.element_at(m, k), zero)
        ) / F.size(p)
        return F.transform(labels, lambda k: F.struct((-mean(k)).alias("neg"), k.alias("label")))

    def build(p: Column) -> Column:
        conf = F.aggregate(p, zero, lambda a, m: a + F.array_max(F.map_values(m))) / F.size(p)
        return let(
            means(p),
            lambda m: F.struct(
                map_model_label(F.get(F.sort_array(m), F.lit(0))["label"]).alias("label"),
                conf.alias("confidence"),
                F.map_from_entries(
                    F.transform(m, lambda x: F.struct(x["label"].alias("k"), (-x["neg"]).alias("v")))
                ).alias("scores"),
                F.lit(model).alias("model_used"),
            ),
        )

    no_scores = F.create_map().cast("map<string,double>")
    neutral = sentiment_struct(F.lit("neutral"), zero, no_scores, model)
    return let(parts, lambda p: F.when(F.size(p) == 0, neutral).otherwise(build(p)))


def chunked(scores: Callable[[Column], Column], chunk_array: Column, model: str) -> Column:
    """Sentiment of a long text: score every chunk with ``scores`` (text -> map), then combine."""
    return combine_parts(F.transform(chunk_array, scores), model)
