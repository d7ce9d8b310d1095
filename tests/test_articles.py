from __future__ import annotations

import datetime as dt
import random

import pytest
from helpers import WHEN, article, articles, as_of, column
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsmood.operators import articles as R
from newsmood.operators import keywords as K
from newsmood.operators import stats
from newsmood.operators import store as U
from newsmood.operators.sentiment import analyze
from newsmood.session import work_path

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_model_fields_and_word_count(spark):
    row = articles(spark, [{}]).first()
    want = article()
    assert (row.title, row.url, row.keywords) == (want["title"], want["url"], want["keywords"])
    stored = R.to_stored(articles(spark, [{}]), as_of()).first()
    assert (stored.word_count, stored.reading_time, stored.sentiment_label) == (10, 1, None)


def test_keyword_filter(spark):
    df = articles(spark, [{}])
    assert R.filter_by_keywords(df, ["TEST"]).count() == 1
    assert R.filter_by_keywords(df, ["article"]).count() == 1
    assert R.filter_by_keywords(df, ["nonexistent"]).count() == 0
    assert R.filter_by_keywords(df, None).count() == 1
    assert R.filter_by_keywords(df, []).count() == 1


WORDS = ["alpha", "beta", "a.b", "c+", "(x)", "gamma delta", "é", "longerword", "longerwords", "[z]", "lo"]


@SLOW
@given(st.lists(st.text(alphabet="abcé.+(x)[z] gmlonerwds", max_size=30), min_size=1, max_size=8))
def test_many_keywords_equal_one_by_one(spark, lines):
    many = WORDS + [f"unused{i}" for i in range(60)]
    df = articles(spark, [{"title": "T", "content": x} for x in lines])
    want = [i for i, x in enumerate(lines) if any(k in ("T " + x).lower() for k in many)]
    assert seqs(R.filter_by_keywords(df, many)) == want


def test_keyword_table_equals_one_by_one(spark):
    """Keywords shorter than a gram, of blanks alone, with blanks at the ends, and long ones."""
    rng = random.Random(5)
    letters = ["a", "b", "É", "gram", "x-y", ".", "(", " ", "  ", "\n", "\u00a0"]
    noise = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    lines = [noise(14) for _ in range(150)] + ["", "gram gram gram", "copy of a line"] + ["copy of a line"] * 40 + ["x" * 5000 + " needle " + "y" * 5000]
    df = articles(spark, [{"title": rng.choice(["T", ""]), "content": x, "url": f"u{i % 90}"} for i, x in enumerate(lines)] + [{"title": None, "content": None}])
    texts = {r.seq: ((r.title or "") + " " + (r.content or "")).lower() for r in df.collect()}
    for many in (
        ["gram a", "É", "  b", "needle", "Y" * 20],
        [noise(6) for _ in range(40)] + ["", None, "x needle y", "x needle yy"],
        ["\n  ", "copy of", "a line"],
        [" ", "absent"],
        ["absent", "gramgramgramgramgram absent"],
        [None],
    ):
        want = sorted(i for i, t in texts.items() if any(k and k.lower() in t for k in many))
        table = spark.createDataFrame([(k,) for k in [*many, *many]], "keyword string")
        assert seqs(K.keyword_semi_join(df, table)) == want, many
    assert K.keyword_semi_join(df, table.where("false")).count() == 0
    assert K.keyword_semi_join(df.where("false"), table).count() == 0


def test_long_keywords_meet_texts_by_neighbouring_words(spark, monkeypatch):
    rng = random.Random(5)
    blank = [" ", "  ", "\n", "\u2003"]
    text = lambda n: "".join(rng.choice(["ab", "B", "abc", "ΣΑΣ", "x,", "é"]) + rng.choice(blank[: rng.randint(1, 4)]) for _ in range(n))
    lines = [text(rng.randint(0, 30)) for _ in range(60)] + [None, ""]
    df = articles(spark, [{"title": "T", "content": x} for x in lines])
    cuts = [x[i : i + rng.randint(6, 24)] for x in lines if x for i in (rng.randrange(len(x)),)]
    long = [k for k in cuts if len(k.split()) > 3] + ["ab  ab B ab ab", "none of these words is there"]
    paths = []
    monkeypatch.setattr(K, "work_path", lambda spark, name: paths.append(name) or work_path(spark, name))
    for keywords in (long, cuts + long):
        table = spark.createDataFrame([(k,) for k in keywords], "keyword string")
        low = df.select("seq", F.lower(F.concat(F.lit("T "), F.coalesce("content", F.lit("")))).alias("t"))
        want = low.join(table.select(F.lower("keyword").alias("k")).where("k <> ''"), F.expr("contains(t, k)")).select("seq").distinct()
        assert seqs(K.keyword_semi_join(df, table)) == seqs(want)
        # Only keywords without neighbouring words inside need the runs of all texts.
        assert ("keyword-vocabulary" in paths) == (keywords is not long)
    assert len(seqs(want)) > 5


def test_keywords_are_parts_of_words(spark):
    many = [f"keyword{i}" for i in range(60)]
    lines = ["x keyword7 y", "xkeyword59y", "key word7", "KEYWORD3.", "keyword keywor d7"]
    df = articles(spark, [{"title": "T", "content": x} for x in lines])
    assert seqs(R.filter_by_keywords(df, many)) == [0, 1, 3]


def test_clean_articles(spark):
    rows = [
        {"url": "a", "title": " A "}, {"url": "a", "title": "again"}, {"url": "b", "title": ""}, {"url": "b", "content": None},
        {"url": "", "title": "x"}, {"url": "c", "title": " \t", "content": " body\n"},
    ]
    out = {r.url: r for r in R.clean_articles(articles(spark, rows)).collect()}
    assert set(out) == {"a", "c"}
    assert out["a"].title == "A" and out["c"].title == "" and out["c"].content == "body"
    again = R.clean_articles(R.clean_articles(articles(spark, [{"url": "a"}, {"url": "a"}])))
    assert again.count() == 1


@SLOW
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), min_size=1, max_size=40), st.integers(1, 5))
def test_cap_per_source_is_the_first_rows(spark, rows, n):
    df = articles(spark, [{"source": f"s{s}", "content": "hit" if h else "miss"} for s, h in rows])

    def first(items):
        seen, out = {}, []
        for i in items:
            s = rows[i][0]
            seen[s] = seen.get(s, 0) + 1
            if seen[s] <= n:
                out.append(i)
        return out

    every = list(range(len(rows)))
    hit = [i for i in every if rows[i][1]]
    assert seqs(R.cap_per_source(df, n)) == first(every)
    assert seqs(R.cap_per_source(df, n, ["hit"], "before")) == [i for i in first(every) if i in hit]
    assert seqs(R.cap_per_source(df, n, ["hit"], "after")) == first(hit)
    with pytest.raises(ValueError):
        R.cap_per_source(df, n, None, "between")


def test_query_articles(spark):
    day = lambda n: WHEN + dt.timedelta(days=n)
    rows = [{"url": f"u{i}", "published_date": day(i), "source": "s" + str(i % 2), "content": x}
            for i, x in enumerate(["AI here", "ai there", "50% off", "5000 off", "title only"])]
    df = R.to_stored(analyze(articles(spark, rows)), as_of())
    urls = lambda q: [r.url for r in q.collect()]
    assert urls(R.query_articles(df)) == ["u4", "u3", "u2", "u1", "u0"]
    assert urls(R.query_articles(df, limit=2)) == ["u4", "u3"] and len(urls(R.query_articles(df, limit=0))) == 5
    assert urls(R.query_articles(df, keywords=["AI"])) == ["u0"]
    assert urls(R.query_articles(df, keywords=["AI"], mode="ci")) == ["u1", "u0"]
    assert urls(R.query_articles(df, keywords=["50% off"])) == ["u3", "u2"]
    assert urls(R.query_articles(df, source="s1", start=day(1), end=day(3))) == ["u3", "u1"]
    assert urls(R.query_articles(df, sentiment="positive")) == []
    assert urls(R.article_by_url(df, "u2")) == ["u2"]
    with pytest.raises(ValueError):
        R.query_articles(df, keywords=["x"], mode="fuzzy")


def test_select_sources(spark):
    df = spark.createDataFrame(
        [("Cnn", "rss", "u1"), ("Bbc", "website", "u2"), ("NewsAPI", "api", "u3"), ("GNews", "api", "u4"), ("Webber", "api", "u5")],
        "name string, type string, url string",
    )
    names = lambda q: sorted(r.name for r in q.collect())
    assert names(R.select_sources(df, ["rss"])) == ["Cnn"]
    assert names(R.select_sources(df, ["WEB "])) == ["Bbc", "Webber"]
    assert names(R.select_sources(df, ["newsapi", "nn"])) == ["Cnn", "NewsAPI"]
    assert names(R.select_sources(df, ["news"])) == ["GNews", "NewsAPI"]
    assert names(R.select_sources(df, ["", " "])) == []
    assert names(R.select_sources(df, types=["api", "rss"])) == ["Cnn", "GNews", "NewsAPI", "Webber"]
    got = {r.type: r.n_sources for r in stats.source_registry_stats(df).collect()}
    assert got == {"rss": 1, "website": 1, "api": 3, "total": 5}


def test_lengths(spark):
    row = R.check_lengths(articles(spark, [{"title": "x" * 1001, "source": "s"}])).first()
    assert row.too_long == ["title"]


def test_stored_roundtrip(spark):
    df = analyze(articles(spark, [{"content": "good"}]))
    back = R.from_stored(R.to_stored(df, as_of())).first()
    assert back.sentiment == df.first().sentiment and back.keywords == ["test", "article", "sample"]
    bare = R.to_stored(articles(spark, [{"keywords": None, "metadata": None}]), as_of())
    empty = R.from_stored(bare).first()
    assert empty.sentiment is None and empty.keywords == [] and empty.metadata == {}


def stored(spark, rows, day):
    when = F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")
    return R.to_stored(articles(spark, rows), when)


@SLOW
@given(
    st.lists(st.tuples(st.integers(0, 4), st.text("ab", max_size=2)), min_size=1, max_size=8),
    st.lists(st.tuples(st.integers(0, 4), st.text("ab", max_size=2)), min_size=1, max_size=8),
)
def test_upsert_last_wins_and_is_idempotent(spark, first, second):
    as_rows = lambda xs: [{"url": f"u{u}", "title": "t" + t} for u, t in xs]
    store = U.last_by_url(stored(spark, as_rows(first), 1))
    incoming = stored(spark, as_rows(second), 2)
    once = U.upsert(store, incoming)
    want = {f"u{u}": "t" + t for u, t in first} | {f"u{u}": "t" + t for u, t in second}
    rows = {r.url: r for r in once.collect()}
    assert {u: r.title for u, r in rows.items()} == want and len(rows) == once.count()
    old, new = {f"u{u}" for u, _ in first}, {f"u{u}" for u, _ in second}
    for u, r in rows.items():
        assert r.created_at.day == (1 if u in old else 2) and r.updated_at.day == (2 if u in new else 1)
    assert sorted(map(str, U.upsert(once, incoming).collect())) == sorted(map(str, once.collect()))
    counts = U.upsert_counts(store, incoming).first()
    assert (counts.saved, counts.urls, counts.inserted, counts.updated, counts.total) == (
        len(second), len(new), len(new - old), len(new & old), len(new | old))


def test_saving_counts_while_it_writes(spark):
    store = stored(spark, [{"url": "a"}, {"url": "b"}], 1)
    incoming = stored(spark, [{"url": "b"}, {"url": "c"}, {"url": "c"}, {"url": "d"}], 2)
    path = work_path(spark, "saved")
    counts = U.save_upsert(store, incoming, path)
    assert counts == {"saved": 4, "urls": 3, "inserted": 2, "updated": 1, "total": 4}
    saved = spark.read.parquet(path)
    assert counts == U.upsert_counts(store, incoming).first().asDict() and saved.columns == store.columns
    assert {r.url: r.created_at.day for r in saved.collect()} == {"a": 1, "b": 1, "c": 2, "d": 2}
    none = U.save_upsert(store, incoming.where("false"), work_path(spark, "saved"))
    assert none == {"saved": 0, "urls": 0, "inserted": 0, "updated": 0, "total": 2}


def test_purge(spark):
    cut = dt.datetime(2024, 1, 31)
    rows = [{"url": "old", "scraped_date": cut - dt.timedelta(seconds=1)}, {"url": "edge", "scraped_date": cut},
            {"url": "none", "scraped_date": None}]
    df = stored(spark, rows, 1)
    assert sorted(r.url for r in U.purge(df, as_of(), 30).collect()) == ["edge", "none"]
    assert tuple(U.purge_counts(df, as_of(), 30).first()) == (1, 2)


def test_reanalyze(spark):
    df = stored(spark, [{"url": "a", "content": "good"}, {"url": "b", "content": "bad thing"}], 1)
    some = {r.url: r.sentiment_label for r in U.reanalyze(df, as_of(), keywords=["thing"]).collect()}
    assert some == {"a": None, "b": "negative"}
    limited = {r.url: r.sentiment_label for r in U.reanalyze(df, as_of(), limit=1).collect()}
    assert limited == {"a": "positive", "b": None}


def test_stats(spark):
    df = spark.createDataFrame(
        [(0, "t0", "u0", "x", "positive", 0.5), (1, "t1", "u1", "x", "negative", 0.9), (2, "t2", "u2", "y", "positive", 0.5),
         (3, "t3", "u3", "y", None, None)],
        "seq long, title string, url string, source string, sentiment_label string, sentiment_confidence double",
    )
    assert tuple(stats.sentiment_stats(df).first()) == (4, 3, 2, 1, 0)
    summary = {r.label: r for r in stats.analysis_summary(df).collect()}
    assert set(summary) == {"positive", "negative"} and summary["positive"].n == 2
    assert round(summary["negative"].average_confidence, 9) == round(1.9 / 3, 9)
    by = {r.source: r for r in stats.sentiment_by_source(df).collect()}
    assert by["x"].total == 2 and by["x"].pct_positive == 50.0 and by["y"].total == 1
    top = {r.label: r for r in stats.top_confident(df).collect()}
    assert top["positive"].seq == 0 and top["negative"].url == "u1"
    report = {r.metric: r.value for r in stats.report_summary(df).collect()}
    assert report["Total Articles"] == 4 and report["Analysis Coverage"] == 75.0 and report["Number of Sources"] == 2
    assert "Neutral Sentiment" not in report
    none = {r.metric: r.value for r in stats.report_summary(df.where("seq = 3")).collect()}
    assert none == {"Total Articles": 1.0, "Analyzed Articles": 0.0, "Analysis Coverage": 0.0}
    assert [tuple(r) for r in stats.analysis_summary(df.where("seq = 3")).collect()] == [(None, 0, 0, 0.0)]
    share = {r.label: r.pct for r in stats.sentiment_share(df).collect()}
    assert round(share["positive"], 6) == 66.666667


def test_union_sources_fills_missing_columns(spark):
    df = articles(spark, [{}, {}])
    out = R.union_sources(df, df.drop("author"))
    assert out.count() == 4 and out.where("author IS NULL").count() == 2


def test_column_helper(spark):
    assert column(articles(spark, [{"title": "a"}, {"title": "b"}]), "title") == ["a", "b"]
