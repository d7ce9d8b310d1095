"""Analyzers: DataFrame in, the same rows with a ``sentiment`` struct out.

The rule analyzers are narrow. They read title and content, add one struct and
move no rows, so a following dedup or count shuffles labels instead of texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.functions import scores as S
from newsmood.functions.lexicon import TERM_FIELDS, Lexicon
from newsmood.functions.text import analysis_text, collapse, let, sentences, word_count
from newsmood.session import built_once, work_path

Analyzer = Callable[[DataFrame], DataFrame]
_ANALYZERS: dict[str, Analyzer] = {}


def score_map(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def sentiment_struct(label: Column, confidence: Column, scores: Column, model: str) -> Column:
    return F.struct(
        label.alias("label"),
        confidence.cast("double").alias("confidence"),
        scores.alias("scores"),
        F.lit(model).alias("model_used"),
    )


def lexicon_sentiment(text: Column, lexicon: Lexicon | None = None, hits: Column | None = None, words: Column | None = None) -> Column:
    """Rule-lexicon sentiment of a collapsed text; empty text is neutral with confidence 0.

    ``hits`` are the text's listed words, where the lists are tables (``analyze_by_terms``);
    ``words`` its ``scores.listed_words``, where several analyzers look at them."""
    lexicon = lexicon or Lexicon()

    def scored(s: Column) -> Column:
        return sentiment_struct(
            S.compound_label(s["compound"]),
            S.lexicon_confidence(s["compound"], s["pos"], s["neg"], s["neu"]),
            score_map(positive=s["pos"], negative=s["neg"], neutral=s["neu"], compound=s["compound"]),
            "lexicon",
        )

    def build(t: Column) -> Column:
        zero = F.lit(0.0)
        empty = sentiment_struct(
            F.lit("neutral"),
            zero,
            score_map(positive=zero, negative=zero, neutral=F.lit(1.0), compound=zero),
            "lexicon",
        )
        return F.when(t == "", empty).otherwise(let(S.rule_scores(t, lexicon, hits, words), scored))

    return let(text, build)


def polarity_sentiment(text: Column, lexicon: Lexicon | None = None, hits: Column | None = None, words: Column | None = None) -> Column:
    """Polarity sentiment of a collapsed text, always with the same five scores."""
    lexicon = lexicon or Lexicon()

    def scored(s: Column) -> Column:
        p = s["polarity"]
        return sentiment_struct(
            S.threshold_label(p, S.POLARITY_CUT, -S.POLARITY_CUT),
            F.when(s["empty"], 0.0).otherwise(S.polarity_confidence(p, s["subjectivity"])),
            score_map(
                polarity=p,
                subjectivity=s["subjectivity"],
                positive=F.greatest(F.lit(0.0), p),
                negative=F.greatest(F.lit(0.0), -p),
                neutral=F.lit(1.0) - F.abs(p),
            ),
            "polarity",
        )

    return let(
        text,
        lambda t: let(
            let(
                S.polarity_scores(t, lexicon, hits, words),
                lambda s: F.struct(
                    s["polarity"].alias("polarity"),
                    s["subjectivity"].alias("subjectivity"),
                    (t == "").alias("empty"),
                ),
            ),
            scored,
        ),
    )


def register_analyzer(name: str, analyzer: Analyzer) -> None:
    """Add an analyzer: it must keep every input row and column and set ``sentiment``."""
    _ANALYZERS[name] = analyzer


def analyzer_names() -> list[str]:
    return list(_ANALYZERS)


def get_analyzer(name: str) -> Analyzer:
    if name not in _ANALYZERS:
        raise KeyError(f"unknown analyzer {name!r}; known: {', '.join(_ANALYZERS)}")
    return _ANALYZERS[name]


def column_analyzer(expr: Callable[[Column], Column]) -> Analyzer:
    """An analyzer from a function of the analysis text (title, then content).

    A pandas UDF that returns the sentiment struct fits as well.
    """

    def make() -> Column:
        return expr(analysis_text(F.col("title"), F.col("content")))

    def run(df: DataFrame) -> DataFrame:
        return df.withColumn("sentiment", built_once(df, ("analyzer", expr), make))

    run.expr = expr
    return run


def with_votes(df: DataFrame, exprs: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """A column for each of several functions of the analysis text, which is made once, and split
    once for the rule analyzers."""
    text, words = F.col("_analysis_text"), F.col("_analysis_words")
    ruled = {lexicon_sentiment, polarity_sentiment} & set(exprs.values())
    out = df.withColumn("_analysis_text", analysis_text(F.col("title"), F.col("content")))
    if ruled:
        out = out.withColumn("_analysis_words", built_once(df, ("listed words",), lambda: S.listed_words(text, Lexicon())))

    def vote(expr: Callable[[Column], Column]) -> Column:
        return built_once(df, ("vote", expr), lambda: expr(text, words=words) if expr in ruled else expr(text))

    return out.withColumns({name: vote(expr) for name, expr in exprs.items()}).drop("_analysis_text", "_analysis_words")


register_analyzer("lexicon", column_analyzer(lexicon_sentiment))
register_analyzer("polarity", column_analyzer(polarity_sentiment))


_BY_TERMS = {"lexicon": lexicon_sentiment, "polarity": polarity_sentiment}


def term_hits(df: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """``key, hits``: the words of title and content that a table of terms lists, with their places.

    Terms are first cut to the distinct words of the corpus, so what the words meet is bounded by
    the vocabulary; Spark broadcasts it if it is small and shuffles the words if not. Both are
    written, so the texts are split twice, however many lists the terms are made of, and no condition
    of the lists is asked of every word.
    """
    spark = df.sparkSession
    words = df.select(key, F.posexplode(S.bare_words(analysis_text(F.col("title"), F.col("content")))).alias("pos", "term")).where("term <> ''")
    vocabulary, used = work_path(spark, "vocabulary"), work_path(spark, "used-terms")
    words.select("term").distinct().write.parquet(vocabulary)
    terms.join(spark.read.parquet(vocabulary), "term", "left_semi").write.parquet(used)
    used = spark.read.schema(terms.schema).parquet(used)
    hit = F.struct("pos", *TERM_FIELDS)
    return words.join(used, "term").groupBy(key).agg(F.sort_array(F.collect_list(hit)).alias("hits"))


def analyze_by_terms(df: DataFrame, key: str, terms: DataFrame, method: str = "lexicon", hits: DataFrame | None = None) -> DataFrame:
    """The rows with a ``sentiment`` by word lists that are a table (``lexicon.term_table``).

    ``key`` identifies a row. The rules are those of the method's analyzer; where the analyzers look
    words up in constants, the table is joined, whatever its size. Several methods over the same rows
    share the ``hits`` that ``term_hits`` found.
    """
    if method not in _BY_TERMS:
        raise KeyError(f"no analyzer {method!r} by terms; known: {', '.join(_BY_TERMS)}")
    found = (term_hits(df, key, terms) if hits is None else hits).withColumnRenamed("hits", "_hits")
    text = analysis_text(F.col("title"), F.col("content"))
    empty = F.array().cast(found.schema["_hits"].dataType)
    sentiment = let(F.coalesce("_hits", empty), lambda h: _BY_TERMS[method](text, hits=h))
    return df.drop("sentiment").join(found, key, "left").withColumn("sentiment", sentiment).drop("_hits")


def analyze(df: DataFrame, analyzer: str | Analyzer = "lexicon") -> DataFrame:
    """Score title and content of every row with one analyzer."""
    run = get_analyzer(analyzer) if isinstance(analyzer, str) else analyzer
    return run(df)


def sentence_polarity(
    df: DataFrame, text: str = "content", keys: tuple[str, ...] = ("seq",), lexicon: Lexicon | None = None
) -> DataFrame:
    """One row per sentence: ``keys, idx, sentence, polarity, subjectivity``."""
    lexicon = lexicon or Lexicon()
    exploded = df.select(*keys, F.posexplode(sentences(F.col(text))).alias("idx", "sentence"))
    score = S.polarity_scores(collapse(F.col("sentence")), lexicon)
    return exploded.withColumn("s", score).select(*keys, "idx", "sentence", "s.polarity", "s.subjectivity")


def document_polarity(
    df: DataFrame, text: str = "content", lexicon: Lexicon | None = None
) -> DataFrame:
    """Adds ``n_sentences, n_words, polarity, subjectivity, mean_sentence_polarity``.

    The sentence mean is taken inside the row; a text without sentences has mean 0.
    """
    lexicon = lexicon or Lexicon()
    per_sentence = F.transform(
        sentences(F.col(text)), lambda s: S.polarity_scores(collapse(s), lexicon)["polarity"]
    )
    mean = let(
        per_sentence,
        lambda p: F.struct(
            F.size(p).alias("n"),
            F.coalesce(
                F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), F.size(p)), F.lit(0.0)
            ).alias("mean"),
        ),
    )
    whole = S.polarity_scores(collapse(F.col(text)), lexicon)
    return (
        df.withColumn("_sent", mean)
        .withColumn("_whole", whole)
        .withColumns(
            {
                "n_sentences": F.col("_sent.n"),
                "n_words": word_count(F.col(text)),
                "polarity": F.col("_whole.polarity"),
                "subjectivity": F.col("_whole.subjectivity"),
                "mean_sentence_polarity": F.col("_sent.mean"),
            }
        )
        .drop("_sent", "_whole")
    )
