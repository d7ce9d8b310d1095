from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from helpers import articles, column
from pyspark.sql import functions as F

from newsmood.functions import scores as S
from newsmood.functions.lexicon import Lexicon, term_table
from newsmood.operators import ensemble as E
from newsmood.operators import model as M
from newsmood.operators import sentiment as A


def scored(spark, lines, analyzer="lexicon", title="News"):
    df = A.analyze(articles(spark, [{"title": title, "content": x} for x in lines]), analyzer)
    return column(df.select("seq", F.col("sentiment").alias("v")))


def test_polar_sentences(spark):
    good, bad, plain = scored(
        spark,
        [
            "What a wonderful concert, we were happy with a great evening.",
            "The service was awful and the food terrible, we hate it.",
            "A bus leaves from platform four.",
        ],
    )
    assert good.label == "positive" and good.confidence > 0
    assert bad.label == "negative" and bad.confidence > 0
    assert plain.label == "neutral"
    assert set(good.scores) == {"positive", "negative", "neutral", "compound"}
    for s in (good, bad, plain):
        assert math.isclose(s.scores["positive"] + s.scores["negative"] + s.scores["neutral"], 1.0)


def test_title_counts(spark):
    (s,) = scored(
        spark,
        ["The team showed amazing progress on the new bridge."],
        title="Great week for builders",
    )
    assert s.label == "positive"


def compound(spark, lines):
    return [s.scores["compound"] for s in scored(spark, lines)]


def test_rules_move_the_score(spark):
    base, very, barely, negated, shout, bang, but = compound(
        spark,
        [
            "it was good", "it was very good", "it was barely good", "it was not good", "it was GOOD", "it was good!!",
            "good but bad",
        ],
    )
    assert barely < base < very and base < shout and base < bang
    assert negated < 0 < base
    assert but < compound(spark, ["bad but good"])[0]


def test_lexicon_value_is_the_published_form(spark):
    v = Lexicon().valence["good"] / 10
    (got,) = compound(spark, ["it was good"])
    assert math.isclose(got, v / math.sqrt(v * v + 15), rel_tol=1e-12)


def test_whole_texts_are_scored(spark):
    """Word 5,000 of a text that says nothing else decides the label."""
    for analyzer in ("lexicon", "polarity"):
        late, early = scored(spark, ["word " * 4999 + "terrible", "terrible " + "word " * 4999], analyzer)
        assert late.label == early.label == "negative"


def test_a_limit_cuts_the_analysis_text(spark):
    from newsmood.functions.text import analysis_text

    df = articles(spark, [{"title": "t", "content": "word " * 2000 + "end", "url": "u"}])
    cut, whole = df.select(analysis_text("title", "content", 1000), analysis_text("title", "content")).first()
    assert len(cut.split()) == 1000 and whole.endswith("end")


def test_own_lexicon(spark):
    lex = Lexicon(valence={"gelb": 30, "rot": -30})
    A.register_analyzer("colours", A.column_analyzer(lambda t: A.lexicon_sentiment(t, lex)))
    assert [s.label for s in scored(spark, ["gelb", "rot", "good"], "colours")] == ["positive", "negative", "neutral"]
    assert "colours" in A.analyzer_names()


def as_tables(spark, lex):
    valence = spark.createDataFrame(list(lex.valence.items()), "term string, valence int")
    polarity = spark.createDataFrame([(t, *v) for t, v in lex.polarity.items()], "term string, polarity int, subjectivity int")
    boost = spark.createDataFrame(list(lex.boost.items()), "term string, delta int")
    negation = spark.createDataFrame([(t,) for t in lex.negation], "term string")
    return valence, polarity, boost, negation


@pytest.mark.parametrize("method", ["lexicon", "polarity"])
def test_tables_score_as_constants_do(spark, method):
    """The seed lists as tables, also as two rows a term, over texts that need every rule."""
    rng = random.Random(4)
    lex = Lexicon()
    pool = [*lex.valence, *lex.polarity, *lex.boost, *lex.negation, "but", "plain", "GOOD", "Bad!", "(great)", "not", "very", "!", "??", ""]
    lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(120)] + ["", "ALL GOOD", "very very not so good"]
    df = articles(spark, [{"title": rng.choice(["", "Very", "not"]), "content": x} for x in lines])
    tables = [t.unionByName(t) for t in as_tables(spark, lex)]
    terms = term_table(*tables)
    got = A.analyze_by_terms(df, "seq", terms, method).orderBy("seq").collect()
    want = A.analyze(df, method).orderBy("seq").collect()
    assert [r.sentiment for r in got] == [r.sentiment for r in want] and len(got) == len(lines)


def test_tables_of_many_terms(spark):
    """More terms than a plan could hold; one list alone is enough; unknown methods raise."""
    many = spark.range(150_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"), F.lit(25).alias("valence"))
    bad = spark.createDataFrame([("awful", -30), ("awful", -20), ("", 9), (None, 9)], "term string, valence int")
    df = articles(spark, [{"content": x} for x in ("w77 w149999", "awful", "w150000")])
    found = A.analyze_by_terms(df, "seq", term_table(many.unionByName(bad))).orderBy("seq").collect()
    assert [r.sentiment.label for r in found] == ["positive", "negative", "neutral"]
    assert A.analyze_by_terms(df, "seq", term_table(bad).where("false")).where("sentiment.label = 'neutral'").count() == 3
    with pytest.raises(KeyError):
        A.analyze_by_terms(df, "seq", term_table(bad), "nope")
    with pytest.raises(ValueError):
        term_table()


def test_unknown_analyzer_raises(spark):
    with pytest.raises(KeyError):
        A.analyze(articles(spark, [{}]), "nope")


def test_pandas_udf_analyzer(spark):
    from newsmood.schema import SENTIMENT

    @F.pandas_udf(SENTIMENT)
    def by_length(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "label": text.map(lambda t: "positive" if len(t) > 20 else "negative"),
                "confidence": 0.5,
                "scores": text.map(lambda t: {"n": float(len(t))}),
                "model_used": "length",
            }
        )

    A.register_analyzer("length", A.column_analyzer(by_length))
    assert [s.label for s in scored(spark, ["x", "x" * 40], "length")] == ["negative", "positive"]


def test_polarity_scores_and_band(spark):
    s = scored(spark, ["best worst", "good", "nothing here", "hate"], "polarity")
    assert [x.label for x in s] == ["neutral", "positive", "neutral", "negative"]
    assert all(set(x.scores) == {"polarity", "subjectivity", "positive", "negative", "neutral"} for x in s)
    assert math.isclose(s[1].scores["polarity"], 0.6) and math.isclose(s[1].confidence, 1.0)


def test_lexicon_confidence_steps(spark):
    rows = [(0, 0.6, 0.7, 0.2, 0.1), (1, 0.1, 0.5, 0.3, 0.2), (2, 0.0, 0.4, 0.3, 0.3), (3, -0.5, 0.1, 0.2, 0.6)]
    df = spark.createDataFrame(rows, "seq long, c double, p double, n double, u double")
    got = column(df.select("seq", S.lexicon_confidence(F.col("c"), F.col("p"), F.col("n"), F.col("u")).alias("v")))
    assert [round(x, 6) for x in got] == [1.0, 0.7, 0.4, 0.9]


def test_validity_margin_and_labels(spark):
    df = spark.createDataFrame(
        [(0, "positive", 0.5, {"a": 1.0}), (1, "odd", 0.5, {}), (2, "neutral", 1.5, {}), (3, "neutral", 0.2, None)],
        "seq long, label string, conf double, scores map<string,double>",
    )
    assert column(df.select("seq", S.is_valid_score(F.col("label"), F.col("conf"), F.col("scores")).alias("v"))) == [
        True, False, False, False]
    maps = spark.createDataFrame(
        [(0, {"a": 0.7, "b": 0.2}), (1, {"a": 0.4}), (2, {}), (3, {"a": -3.0, "b": -3.0}), (4, {"a": 5.0, "b": 1.0})],
        "seq long, m map<string,double>",
    )
    got = column(maps.select("seq", S.margin_confidence(F.col("m")).alias("v")))
    assert [round(x, 9) for x in got] == [0.5, 0.4, 0.0, 0.0, 1.0]
    names = ["POS", "label_0", "1", "very good", "badly", "LABEL_9"]
    labels = spark.createDataFrame(list(enumerate(names)), "seq long, l string")
    assert column(labels.select("seq", S.map_model_label(F.col("l")).alias("v"))) == [
        "positive", "negative", "neutral", "positive", "negative", "neutral"]


def combine_plain(votes):
    """votes: list of (label, confidence) in analyzer order."""
    counts = {}
    for label, _ in votes:
        counts[label] = counts.get(label, 0) + 1
    win = max(counts, key=lambda k: counts[k])
    total = sum(c for _, c in votes)
    conf = sum(c * (1 if label == win else 0.5) for label, c in votes) / total if total else 0.0
    return win, conf, counts[win] / len(votes)


VOTES = [
    [("positive", 0.9), ("negative", 0.8), ("negative", 0.1)],
    [("neutral", 0.4), ("positive", 0.9)],
    [("negative", 0.0), ("neutral", 0.0), ("positive", 0.0)],
    [("positive", 0.3)],
]


def test_ensemble_vote(spark):
    def vote(i):
        def run(df):
            cases = F.lit(None).cast("struct<label:string,confidence:double,scores:map<string,double>,model_used:string>")
            for seq, v in enumerate(VOTES):
                if i < len(v):
                    s = A.sentiment_struct(F.lit(v[i][0]), F.lit(v[i][1]), A.score_map(x=F.lit(float(i))), "m")
                    cases = F.when(F.col("seq") == seq, s).otherwise(cases)
            return df.withColumn("sentiment", cases)

        return run

    df = articles(spark, [{} for _ in range(len(VOTES) + 1)])
    out = column(E.analyze_with(df, [("a", vote(0)), ("b", vote(1)), ("c", vote(2))]).select("seq", F.col("sentiment").alias("v")))
    assert out[-1] is None
    for got, votes in zip(out, VOTES):
        label, conf, agreement = combine_plain(votes)
        assert got.label == label and math.isclose(got.confidence, conf)
        assert math.isclose(got.scores["analyzer_agreement"], agreement)
        assert got.model_used == "ensemble_" + "+".join("abc"[: len(votes)])
        assert got.scores["a_x"] == 0.0 and math.isclose(got.scores["consensus_confidence"], conf)


def test_voters_share_the_text(spark):
    lines = ["Not a GREAT day, but the best !!", "an awful, terrible idea?", "", None, "plain words", "  very happy\n(happy) hate-free no"]
    df = articles(spark, [{"title": t, "content": x} for x in lines for t in ("Good", None)])
    names = ["lexicon", "polarity"]
    marks = A.column_analyzer(lambda t: A.sentiment_struct(F.lit("neutral"), F.lit(0.5), A.score_map(n=F.length(t).cast("double")), "m"))
    alone = df
    for name in names:
        alone = A.analyze(alone, name).withColumnRenamed("sentiment", name)
    alone = A.analyze(alone, marks).withColumnRenamed("sentiment", "marks")
    want = alone.select("seq", E.combine({n: F.col(n) for n in (*names, "marks")}).alias("v"))
    got = E.analyze_with(df, [*names, ("marks", marks)]).select("seq", F.col("sentiment").alias("v"))
    assert column(got) == column(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(coalesce(title") == 1


def test_combine_votes_agrees_with_rows(spark):
    rows = [(f"u{i}", n, label, conf) for i, v in enumerate(VOTES) for n, (label, conf) in enumerate(v)]
    df = spark.createDataFrame(rows, "url string, ord int, label string, confidence double")
    got = {r.url: r for r in E.combine_votes(df).collect()}
    for i, votes in enumerate(VOTES):
        label, conf, agreement = combine_plain(votes)
        r = got[f"u{i}"]
        assert r.label == label and math.isclose(r.confidence, conf) and math.isclose(r.analyzer_agreement, agreement)


def test_combine_parts(spark):
    df = spark.createDataFrame(
        [(0, [{"pos": 0.9, "neg": 0.1}, {"neg": 0.6}]), (1, []), (2, [{"a": 0.5, "b": 0.5}])],
        "seq long, parts array<map<string,double>>",
    )
    a, b, c = column(df.select("seq", E.combine_parts(F.col("parts"), "m").alias("v")))
    assert a.label == "positive" and math.isclose(a.confidence, 0.75)
    assert math.isclose(a.scores["pos"], 0.45) and math.isclose(a.scores["neg"], 0.35)
    assert b.label == "neutral" and b.confidence == 0.0 and b.scores == {}
    assert c.label == "neutral" and c.confidence == 0.5


def test_chunk_scores_equals_row_form(spark):
    """The exploded form (for model scorers) agrees with combining inside the row."""
    lines = ["good " * 30 + "bad " * 7, "nothing to see", "", "hate " * 45 + "love"]
    df = articles(spark, [{"title": "t", "content": x, "url": f"u{i}"} for i, x in enumerate(lines)])

    def scores(text):
        s = S.rule_scores(text, Lexicon())
        return A.score_map(neg=s["neg"], neutral=s["neu"], pos=s["pos"])

    from newsmood.functions.text import analysis_words
    from newsmood.operators.textjobs import chunks

    parts = chunks(analysis_words(F.col("title"), F.col("content")), 22, 5)
    row = column(df.select("seq", E.chunked(scores, parts, "m").alias("v")))
    exploded = column(
        M.chunk_scores(df, lambda x: x.withColumn("scores", scores(F.col("text"))), "seq", 22, 5).select(
            "seq", F.col("sentiment").alias("v")
        )
    )
    for a, b in zip(row, exploded):
        assert a.label == b.label and math.isclose(a.confidence, b.confidence)
        assert all(math.isclose(a.scores[k], b.scores[k]) for k in a.scores)


def test_score_texts_and_analyzer(spark):
    @F.pandas_udf("map<string,double>")
    def toy(text: pd.Series) -> pd.Series:
        return text.map(lambda t: {"LABEL_2": 0.9, "LABEL_0": 0.1} if "up" in t else {"LABEL_2": 0.2, "LABEL_0": 0.8})

    df = spark.createDataFrame([(0, "up"), (1, "down")], "seq long, text string")
    a, b = column(M.score_texts(df, M.udf_scorer(toy)).select("seq", F.col("sentiment").alias("v")))
    assert (a.label, a.confidence, b.label, b.confidence) == ("positive", 0.9, "negative", 0.8)
    run = M.model_analyzer(M.udf_scorer(toy), "seq")
    assert [s.label for s in scored(spark, ["up we go", "down"], run)] == ["positive", "negative"]


def test_trained_scorer(spark):
    rows = [("good fine great text", 0.0), ("bad sad poor text", 1.0)] * 10
    model = M.train(spark.createDataFrame(rows, "text string, y double"), "y", features=256)
    scorer = M.ml_scorer(model, ["positive", "negative"])
    df = spark.createDataFrame([(0, "great fine"), (1, "sad bad")], "seq long, text string")
    assert [s.label for s in column(M.score_texts(df, scorer).select("seq", F.col("sentiment").alias("v")))] == [
        "positive", "negative"]


def test_training_reads_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    rows = [("good fine great text", 0.0), ("bad sad poor text", 1.0)] * 10
    df = spark.createDataFrame(rows, "text string, y double").withColumn("text", F.udf(counted, "string")("text"))
    assert len(M.train(df, "y", features=256).stages) == 4
    assert seen.value == len(rows)


def test_sentences(spark):
    df = articles(spark, [{"content": "Good day. Bad day! Nothing"}, {"content": ""}])
    rows = A.sentence_polarity(df).orderBy("seq", "idx").collect()
    assert [(r.idx, r.sentence, r.polarity) for r in rows] == [(0, "Good day", 0.6), (1, "Bad day", -0.7), (2, "Nothing", 0.0)]
    whole = A.document_polarity(df).orderBy("seq").collect()
    assert math.isclose(whole[0].mean_sentence_polarity, (0.6 - 0.7 + 0.0) / 3)
    assert whole[1].n_sentences == 0 and whole[1].mean_sentence_polarity == 0.0


def test_failing_texts_alone_are_neutral(spark):
    sizes = spark.sparkContext.accumulator(0)

    def load():
        def score(batch):
            sizes.add(1)
            if any("bad" in t for t in batch):
                raise RuntimeError("no")
            return [None if t == "none" else {"Positive": math.nan if t == "nan" else 0.9, "NEGATIVE": 0.1} for t in batch][: 1 if batch == ["a", "b"] else None]

        return score

    lines = ["fine", "bad one", "good", None, "none", "nan", "bad", *["plain"] * 30]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, text string").coalesce(1)
    rows = M.score_texts(df, M.batch_scorer(load, 8, "error")).collect()
    failed = {1: "RuntimeError: no", 4: "no scores", 5: "no number for positive", 6: "RuntimeError: no"}
    assert {r.seq: r.error for r in rows if r.error} == failed
    for r in rows:
        want = ("neutral", 0.0, {}) if r.seq in failed else ("positive", 0.9, {"positive": 0.9, "negative": 0.1})
        assert (r.sentiment.label, r.sentiment.confidence, r.sentiment.scores) == want
    assert sizes.value <= 4 + 2 * 8  # the batches without failures are asked once
    short = M.score_texts(spark.createDataFrame([(0, "a"), (1, "b")], "seq long, text string").coalesce(1), M.batch_scorer(load, 2))
    assert [r.sentiment.label for r in short.collect()] == ["positive", "positive"] and "error" not in short.columns


def test_parts_that_fail_do_not_count(spark):
    def load():
        def score(batch):
            if any("bad" in t for t in batch):
                raise RuntimeError("no")
            return [{"pos": 0.8, "neg": 0.2} for _ in batch]

        return score

    long = " ".join(["w"] * 600) + " bad"
    df = articles(spark, [{"title": "T", "content": x} for x in ("ok", long, "bad")])
    found = {r.seq: (r.n_parts, r.sentiment.label) for r in M.chunk_scores(df, M.batch_scorer(load), "seq").collect()}
    assert found == {0: (1, "positive"), 1: (1, "positive")}
    analyzed = M.model_analyzer(M.batch_scorer(load), "seq")(df)
    assert [s.label for s in column(analyzed.select("seq", F.col("sentiment").alias("v")))] == ["positive", "positive", "neutral"]
