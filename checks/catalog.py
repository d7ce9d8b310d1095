"""Registered queries: one per operator, each over its whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import adapters as A
from newsmood.functions import scores as S
from newsmood.functions import text as T
from newsmood.functions.dates import is_date, iso_text, parse_date
from newsmood.functions.html import clean_html
from newsmood.functions.lexicon import term_table
from newsmood.functions.urls import is_article_url, source_name
from newsmood.operators import articles as R
from newsmood.operators import ensemble as E
from newsmood.operators import keywords as K
from newsmood.operators import sentiment as M
from newsmood.operators import stats
from newsmood.operators import store as U
from newsmood.operators import textjobs as J
from newsmood.operators.model import batch_scorer, chunk_scores, ml_scorer, score_texts, train
from newsmood.plans import jobs, runs
from newsmood.session import spread, work_path
from newsmood.sources import api, feeds, files, pages
from newsmood.sources.registry import feed_responses, item_responses, page_responses
from newsmood.sources.registry import ingest_log as log_of
from newsmood.streaming import jobs as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

c = F.col


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


def digest(column: str) -> Column:
    """Long texts are compared by hash; every character counts."""
    return F.md5(c(column).cast("binary")).alias(column)


def labelled(df: DataFrame) -> DataFrame:
    """Stored-style label and confidence columns of scored articles."""
    return df.withColumns(
        {"sentiment_label": c("sentiment.label"), "sentiment_confidence": c("sentiment.confidence")}
    )


def scored_unique(spark: SparkSession, d: str) -> DataFrame:
    """Tidied, scored, one row per URL. Scoring comes first and stays narrow."""
    scored = labelled(M.analyze(R.tidy(A.articles(spark, d))))
    return R.first_by_url(
        scored.select("title", "url", "source", "category", "seq", "sentiment_label", "sentiment_confidence")
    )


# --- sentiment by source and other counts ---------------------------------------------------


@query
def sentiment_by_source(spark, d):
    rows = scored_unique(spark, d).select("url", "seq", "source", "sentiment_label")
    return stats.sentiment_by_source(rows)


@query
def sentiment_stats(spark, d):
    return stats.sentiment_stats(A.stored(spark, d))


@query
def analysis_summary(spark, d):
    return stats.analysis_summary(A.stored(spark, d))


@query
def articles_by_source(spark, d):
    return stats.articles_by_source(A.articles(spark, d))


@query
def sentiment_share(spark, d):
    return stats.sentiment_share(scored_unique(spark, d))


@query
def top_confident(spark, d):
    return stats.top_confident(scored_unique(spark, d))


@query
def report_summary(spark, d):
    return stats.report_summary(A.stored(spark, d))


@query
def source_registry_stats(spark, d):
    return stats.source_registry_stats(A.source_registry(A.articles(spark, d)))


@query
def validate_scores(spark, d):
    rows = A.articles(spark, d).select(
        "source",
        F.when(c("seq") % 5 == 0, "mixed").when(c("seq") % 5 == 1, "positive").otherwise("neutral").alias("label"),
        (F.length("content") / 3000.0).alias("confidence"),
        F.when(c("seq") % 7 != 0, F.create_map(F.lit("neutral"), F.lit(1.0))).alias("scores"),
    )
    valid = S.is_valid_score(c("label"), c("confidence"), c("scores"))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid")
    )


# --- filters, dedup, ranking -----------------------------------------------------------------


@query
def clean_articles(spark, d):
    raw = A.articles(spark, d).withColumns(
        {
            "title": F.when(c("seq") % 29 == 0, "").otherwise(F.concat(F.lit("\t "), c("title"), F.lit(" "))),
            "content": F.when(c("seq") % 31 == 0, None).otherwise(c("content")),
        }
    )
    return R.clean_articles(raw).select("seq", "url", "title", digest("content"), "source")


@query
def keyword_filter_ci(spark, d):
    wanted = ["WORTHLESS", "license", "an entanglement", "Étre", "100%"]
    return R.filter_by_keywords(A.articles(spark, d), wanted).select("seq", "source")


@query
def keyword_semi_join(spark, d):
    """Articles that contain any word or any whole item of the benchmark."""
    bench = A.table(spark, d, "benchmark")
    keywords = bench.select(F.explode(F.concat(T.words(c("text")), F.array("text"))).alias("keyword"))
    return K.keyword_semi_join(A.articles(spark, d), keywords).select("seq", "source")


@query
def keyword_semi_join_items(spark, d):
    """Articles that contain a whole item of the benchmark, or any five of its words in a row."""
    bench = A.table(spark, d, "benchmark").select(T.words(c("text")).alias("w"), "text")
    fives = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 4)), lambda i: F.array_join(F.slice("w", i, 5), " "))
    keywords = bench.select(F.explode(F.concat(fives, F.array("text"))).alias("keyword"))
    return K.keyword_semi_join(A.articles(spark, d), keywords).select("seq", "source")


@query
def query_articles(spark, d):
    return R.query_articles(
        A.stored(spark, d),
        keywords=["est", "the%ing", "_or "],
        sentiment="negative",
        start="2024-01-02 00:00:00",
        end="2024-09-30 23:00:00",
        limit=50,
    ).select("url", "seq", "source", "published_date", "sentiment_confidence")


@query
def article_by_url(spark, d):
    """The article behind the first URL in order: a point lookup in the stored table."""
    path = work_path(spark, "store")
    A.stored(spark, d).write.parquet(path)
    store = spark.read.parquet(path)
    first = store.agg(F.min("url")).first()[0]
    return R.article_by_url(store, first).select("url", "seq", "source", "word_count")


@query
def valid_article_urls(spark, d):
    hrefs = A.pages(spark, d).select("page_id", "url", F.regexp_extract_all("html", F.lit('href="([^"]*)"')).alias("h"))
    urls = hrefs.select(
        "page_id",
        F.explode(F.concat(F.array("url"), F.transform("h", lambda h: F.concat(c("url"), F.lit("#"), h)),
                           F.transform("h", lambda h: F.concat(F.lit("https://x.example.org/Page"), h, F.lit(".PDF"))),
                           F.transform("h", lambda h: F.concat(F.lit("https://x.example.org/news"), h)))).alias("link"),
    )
    return urls.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_links"), F.count_if(is_article_url(c("link"))).alias("n_valid")
    )


@query
def select_sources(spark, d):
    registry = A.source_registry(A.articles(spark, d))
    by_token = R.select_sources(registry, tokens=[" RSS ", "newsapi", "gnews", "RC1", ""])
    by_type = R.select_sources(registry, types=["website"])
    return by_token.select(F.lit("token").alias("rule"), "*").unionByName(
        by_type.select(F.lit("type").alias("rule"), "*")
    )


@query
def cap_per_source(spark, d):
    capped = R.cap_per_source(A.articles(spark, d), 20, ["est", "the"], "before")
    after = R.cap_per_source(A.articles(spark, d), 20, ["est", "the"], "after")
    return capped.select(F.lit("before").alias("mode"), "source", "seq").unionByName(
        after.select(F.lit("after").alias("mode"), "source", "seq")
    )


# --- text jobs --------------------------------------------------------------------------------


@query
def word_reading_stats(spark, d):
    n = T.word_count(c("content"))
    return A.articles(spark, d).select("seq", n.alias("word_count"), T.reading_minutes(n).alias("reading_time"))


@query
def clean_text(spark, d):
    raw = F.concat(c("title"), F.lit(" Read  more "), c("content"), F.lit(" Click\there Subscribe to Sign up"))
    return A.articles(spark, d).select("seq", T.clean_text(raw).alias("text")).select("seq", digest("text"))


@query
def scrub_pii(spark, d):
    raw = F.concat(c("content"), F.lit(" see https://example.org/a?b=1%20c; or mail x.y@example.org "))
    return A.articles(spark, d).select("seq", T.scrub(raw).alias("text")).select("seq", digest("text"))


@query
def strip_html(spark, d):
    pages_in = A.pages_with_references(spark, d)
    return pages_in.select("page_id", clean_html(c("html")).alias("text")).select("page_id", digest("text"))


@query
def analysis_text(spark, d):
    text = T.analysis_text(c("title"), c("content"), limit=1000)
    return A.articles(spark, d).select("seq", text.alias("text")).select("seq", digest("text"))


@query
def extract_entities(spark, d):
    """Entities of the documents, each with a line of dates and amounts derived from it."""
    seq = c("seq").cast("string")
    extra = F.concat(
        F.lit(". On "), F.date_format("published_date", "MMMM d, yyyy"), F.lit(" or "),
        F.date_format("published_date", "M/d/yyyy"), F.lit(" ("), F.date_format("published_date", "yyyy-MM-dd"),
        F.lit("), Acme "), F.initcap("source"), F.lit(" & Sons Group paid $"), seq, F.lit(".50 and "), seq,
        F.lit(" dollars in Old Town City, see http://example.org/"), seq, F.lit(" or a"), seq, F.lit("@example.org."),
    )
    df = A.articles(spark, d).withColumn("content", F.concat("content", extra))
    return J.entity_rows(df)


@query
def summarize(spark, d):
    return A.articles(spark, d).select("seq", J.summarize(c("content")).alias("summary")).select(
        "seq", digest("summary")
    )


@query
def keywords_tfidf(spark, d):
    return J.keyword_rows(A.articles(spark, d), J.weighted_words(c("content"), 10)).select("seq", "rank", "word", "n")


@query
def keywords_frequency(spark, d):
    return J.keyword_rows(A.articles(spark, d), J.frequent_words(c("content"), 10)).select("seq", "rank", "word", "n")


@query
def readability(spark, d):
    return A.articles(spark, d).select("seq", J.readability(c("content")).alias("r")).select("seq", "r.*")


@query
def chunk_text(spark, d):
    words = T.analysis_words(c("title"), c("content"))
    both = F.array(
        F.struct(F.lit("overlap").alias("mode"), J.chunks(words, 512, 50).alias("parts")),
        F.struct(F.lit("side by side").alias("mode"), J.chunks(words, 512, None).alias("parts")),
    )
    return (
        A.articles(spark, d)
        .select("seq", F.explode(both).alias("b"))
        .select("seq", "b.mode", F.posexplode("b.parts").alias("part", "text"))
        .select("seq", "mode", "part", digest("text"))
    )


# --- sentiment --------------------------------------------------------------------------------


def _sentiment_columns(df: DataFrame, names: list[str], *keys: str) -> DataFrame:
    s = c("sentiment")
    return df.select(
        *keys,
        s["label"].alias("label"),
        s["confidence"].alias("confidence"),
        *[F.element_at(s["scores"], n).alias(n) for n in names],
    )


@query
def lexicon_sentiment(spark, d):
    return _sentiment_columns(
        M.analyze(A.articles(spark, d)), ["compound", "positive", "negative", "neutral"], "seq"
    )


@query
def lexicon_confidence(spark, d):
    """Confidence rule over conversation turns, the second short-text input."""
    turns = A.table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("role").alias("title"), F.col("text").alias("content")
    )
    return _sentiment_columns(M.analyze(spread(turns)), ["compound"], "conv_id", "turn")


@query
def polarity_sentiment(spark, d):
    return _sentiment_columns(
        M.analyze(A.articles(spark, d), "polarity"),
        ["polarity", "subjectivity", "positive", "negative", "neutral"],
        "seq",
    )


@query
def polarity_confidence(spark, d):
    """The rule over polarity and subjectivity derived from text lengths (a dense grid)."""
    p = (F.length("content") % 201 - 100) / 100.0
    s = (F.length("content") % 101) / 100.0
    return A.articles(spark, d).select("seq", S.polarity_confidence(p, s).alias("confidence"))


@query
def subjectivity_band(spark, d):
    s = (F.length("content") % 101) / 100.0
    rows = A.articles(spark, d).select(S.subjectivity_band(s).alias("band"))
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query
def normalize_label(spark, d):
    score = (F.length("content") % 41 - 20) / 20.0
    return A.articles(spark, d).select(
        "seq", S.normalize_label(score).alias("label"), S.normalize_label(score, 0.5, -0.25).alias("wide_label")
    )


@query
def map_model_labels(spark, d):
    raw = F.element_at(
        F.array(
            F.concat(F.lit("LABEL_"), (c("seq") % 4).cast("string")), F.lit("POS"), F.upper("category"),
            F.lit("very_bad"), F.lit("Goodish"), F.lit("Neg."), F.lit("neutral"), (c("seq") % 5).cast("string"),
        ),
        (c("seq") % 8 + 1).cast("int"),
    )
    rows = A.articles(spark, d).select(raw.alias("model_label"))
    return rows.select("model_label", S.map_model_label(c("model_label")).alias("label")).groupBy(
        "model_label", "label"
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def sentence_polarity(spark, d):
    return M.sentence_polarity(A.articles(spark, d)).select(
        "seq", "idx", digest("sentence"), "polarity", "subjectivity"
    )


@query
def document_polarity(spark, d):
    return M.document_polarity(A.articles(spark, d)).select(
        "seq", "n_sentences", "n_words", "polarity", "subjectivity", "mean_sentence_polarity"
    )


@query
def margin_confidence(spark, d):
    """Margins of the lexicon's three shares, of one score only, and of none."""
    df = M.analyze(A.articles(spark, d)).select("seq", c("sentiment.scores").alias("s"))
    three = F.map_filter("s", lambda k, v: k != "compound")
    picked = F.when(c("seq") % 10 == 0, F.map_filter("s", lambda k, v: k == "positive")).when(
        c("seq") % 10 == 1, F.map_filter("s", lambda k, v: k == "")
    ).otherwise(three)
    return df.select("seq", S.margin_confidence(picked).alias("confidence"))


def _marks(text: Column) -> Column:
    """A third voter: many symbols are negative, none positive."""
    n = F.regexp_count(text, F.lit(A.MARKS))
    label = F.when(n > 20, "negative").when(n > 0, "neutral").otherwise("positive")
    return M.sentiment_struct(label, F.lit(0.6), F.create_map(F.lit("count"), n.cast("double")), "marks")


@query
def ensemble_vote(spark, d):
    """Three voters, so that majorities, ties and dissent occur."""
    return _sentiment_columns(
        E.analyze_with(A.articles(spark, d), ["lexicon", "polarity", ("marks", M.column_analyzer(_marks))]),
        ["consensus_confidence", "analyzer_agreement", "lexicon_compound", "polarity_polarity", "marks_count"],
        "seq",
    )


@query
def chunk_combine(spark, d):
    """Lexicon shares of overlapping parts of each document, combined."""
    parts = J.chunks(T.analysis_words(c("title"), c("content")), 102, 20)

    def score(text: Column) -> Column:
        s = S.rule_scores(text, M.Lexicon())
        return T.let(s, lambda x: M.score_map(neg=x["neg"], neutral=x["neu"], pos=x["pos"]))

    df = A.articles(spark, d).withColumn("sentiment", E.chunked(score, parts, "parts"))
    return _sentiment_columns(df, ["neg", "neutral", "pos"], "seq")


def _term_lists(spark, d):
    """Word lists as large as the corpus: every word has a value by its checksum, and so has a
    longer form of it; one in seventeen is a degree word, one in nineteen negates."""
    words = A.table(spark, d, "documents").select(F.explode(S.bare_words(T.collapse(c("text")))).alias("w")).where("w <> ''").distinct()
    words = spark.read.parquet(_landed(spark, words, "term-words"))  # each list reads them
    terms = words.select(F.explode(F.array("w", F.concat("w", F.lit("-x")), F.concat("w", F.lit("-y")))).alias("term"))
    h = F.conv(F.substring(F.md5(c("term").cast("binary")), 1, 8), 16, 10).cast("long")
    sign = F.when(h % 2 == 0, 1).otherwise(-1)
    valence = terms.where(h % 5 < 2).select("term", (sign * (h % 40 + 1)).alias("valence"))
    polarity = terms.where(h % 7 < 3).select("term", (sign * (h % 101)).alias("polarity"), (h % 89).alias("subjectivity"))
    return term_table(valence, polarity, terms.where(h % 17 == 0).select("term", sign.alias("delta")), terms.where(h % 19 == 0))


@query
def lexicon_table(spark, d):
    """Rule and polarity scores by word lists that are tables of some hundred thousand terms."""
    terms = _term_lists(spark, d)
    df = A.articles(spark, d).select("seq", "title", "content")
    hits = M.term_hits(df, "seq", terms)
    rule = M.analyze_by_terms(df, "seq", terms, hits=hits).select(c("seq"), c("sentiment").alias("r"))
    both = M.analyze_by_terms(df, "seq", terms, "polarity", hits).join(rule, "seq")
    return both.select(
        "seq", c("r.label"), c("r.confidence"), c("r.scores")["compound"].alias("compound"),
        c("sentiment.label").alias("polar"), c("sentiment.scores")["polarity"].alias("polarity"),
        c("sentiment.scores")["subjectivity"].alias("subjectivity"),
    )


@query
def model_chunks(spark, d):
    """A linear scorer with fixed word weights, applied to the parts of whole documents."""
    weights = F.create_map(*[F.lit(x) for pair in A.WEIGHTS.items() for x in pair])

    def scorer(parts: DataFrame) -> DataFrame:
        found = F.transform(T.words(F.lower("text")), lambda w: F.coalesce(F.try_element_at(weights, w), F.lit(0)))
        total = F.aggregate(found, F.lit(0), lambda a, x: a + x).cast("double")
        good = (total / (F.abs(total) + 1) + 1) / 2
        return parts.withColumn("scores", T.let(good, lambda g: F.create_map(F.lit("positive"), g, F.lit("negative"), 1 - g)))

    found = chunk_scores(A.articles(spark, d), scorer, "seq")
    return found.select("seq", "sentiment.label", "sentiment.confidence", c("sentiment.scores")["positive"].alias("positive"))


@query
def model_sentiment(spark, d):
    """A text classifier fitted on the labelled documents, applied in parts to all of them."""
    docs = A.articles(spark, d)
    labels = A.table(spark, d, "labels").select(c("doc_id").alias("seq"), c("toxic").cast("double"))
    text = T.analysis_text(c("title"), c("content"))
    model = train(docs.join(labels, "seq").select(text.alias("text"), "toxic"), "toxic", features=1 << 14)
    scorer = ml_scorer(model, ["positive", "negative"])
    found = chunk_scores(docs, scorer, "seq")
    # The weights are fitted: what can be told without them is which rows and parts are scored, and
    # that label and scores agree.
    scores, best = c("sentiment.scores"), c("sentiment.confidence")
    return found.select(
        "seq",
        "n_parts",
        c("sentiment.label").isin("positive", "negative").alias("known_label"),
        ((best >= 0.5) & (best <= 1)).alias("bounded"),
        (F.abs(scores["positive"] + scores["negative"] - 1) < 1e-9).alias("adds_up"),
        ((c("sentiment.label") == "positive") == (scores["positive"] > scores["negative"])).alias("agrees"),
    )


@query
def model_batches(spark, d):
    """A Python model that fails on every batch with a ``#`` in it: those texts alone are neutral."""
    texts = A.articles(spark, d).select("seq", T.analysis_text(c("title"), c("content")).alias("text"))
    weights = dict(A.WEIGHTS)

    def load():
        def score(batch):
            if any("#" in text for text in batch):
                raise ValueError("cannot read this")
            totals = [sum(weights.get(w, 0) for w in text.lower().split(" ")) for text in batch]
            good = [(t / (abs(t) + 1) + 1) / 2 for t in totals]
            return [{"POS": g, "NEG": 1 - g} for g in good]

        return score

    found = score_texts(texts, batch_scorer(load, error="error"))
    return found.select("seq", "sentiment.label", "sentiment.confidence", c("sentiment.scores")["pos"].alias("positive"), "error")


# --- sources ----------------------------------------------------------------------------------


def _articles_out(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, "title", digest("content"), "url", "source", "published_date",
        "author", digest("summary"), joined("keywords"), "category",
    )


@query
def ingest_rss(spark, d):
    items = feeds.explode_feeds(A.rss_payloads(A.articles(spark, d)))
    found = feeds.items_to_articles(items, A.as_of())
    return _articles_out(found.withColumn("guid", c("metadata")["guid"].cast("long")), "guid")


@query
def ingest_atom(spark, d):
    items = feeds.explode_feeds(A.atom_payloads(A.articles(spark, d)))
    found = feeds.items_to_articles(items, A.as_of())
    return _articles_out(found.withColumn("guid", c("metadata")["entry_id"].cast("long")), "guid")


def _api_articles(spark, d):
    responses = api.parse_responses(A.api_payloads(A.articles(spark, d)))
    return api.responses_to_articles(responses, A.as_of())


@query
def ingest_api_json(spark, d):
    found = _api_articles(spark, d).withColumn("seq", c("metadata")["url_to_image"].cast("long"))
    return _articles_out(found, "seq").drop("category")


@query
def ingest_feed_items(spark, d):
    found = api.feed_items_to_articles(A.feed_item_payloads(A.articles(spark, d)), A.as_of(), "batch")
    rows = found.select(
        "batch", "title", digest("content"), "url", "source", "published_date", digest("summary"), joined("keywords")
    )
    return rows


@query
def source_catalog(spark, d):
    listed = A.catalog_payloads(A.articles(spark, d))
    every = api.source_catalog(listed, language=None).select(F.lit("all").alias("rule"), "*")
    some = api.source_catalog(listed, category="science", language="en").select(F.lit("some").alias("rule"), "*")
    return every.unionByName(some)


@query
def ingest_log(spark, d):
    responses = api.parse_responses(A.api_payloads(A.articles(spark, d)))
    return log_of(responses, A.as_of()).drop("scraping_time")


@query
def ingest_run_totals(spark, d):
    responses = api.parse_responses(A.api_payloads(A.articles(spark, d)))
    return stats.ingest_run_totals(log_of(responses, A.as_of()))


@query
def ingest_log_feeds(spark, d):
    """Feeds of which one in seven is broken."""
    broken = F.pmod(F.regexp_extract("source", r"(\d+)$", 1).cast("int") + c("batch"), F.lit(7)) == 3
    payloads = A.rss_payloads(A.articles(spark, d)).withColumn("payload", F.when(broken, "no feed at all").otherwise(c("payload")))
    log = log_of(feed_responses(payloads), A.as_of(), source_type=F.lit("rss"), articles=c("n_articles"))
    return log.drop("scraping_time")


@query
def ingest_log_items(spark, d):
    """Aggregator results, one in seven broken, and web pages, which are their own sources."""
    broken = F.pmod(F.regexp_extract("source", r"(\d+)$", 1).cast("int") + c("batch"), F.lit(7)) == 3
    items = A.feed_item_payloads(A.articles(spark, d)).withColumn("payload", F.when(broken, "{no list").otherwise(c("payload")))
    feeds_ = log_of(item_responses(items), A.as_of(), articles=c("n_articles"))
    web = page_responses(A.pages(spark, d)).withColumn("source", source_name(c("url")))
    return feeds_.unionByName(log_of(web, A.as_of(), source_type=F.lit("website"), articles=c("n_articles"))).drop("scraping_time")


@query
def ingest_capped(spark, d):
    """The first twenty items of each feed's source, then those with a keyword."""
    payloads = {"rss": A.rss_payloads(A.articles(spark, d))}
    return jobs.ingest(payloads, A.as_of(), ["est", "the"], 20).select("url", "source", "title")


@query
def union_sources(spark, d):
    df = A.articles(spark, d)
    rss = feeds.items_to_articles(feeds.explode_feeds(A.rss_payloads(df)), A.as_of())
    items = api.feed_items_to_articles(A.feed_item_payloads(df), A.as_of())
    both = R.union_sources(rss, _api_articles(spark, d), items)
    return both.groupBy("source_type", "source").agg(F.count(F.lit(1)).alias("n"))


@query
def extract_articles_html(spark, d):
    found = pages.extract_articles(A.pages_with_references(spark, d), A.as_of(), "page_id")
    return found.select("page_id", "title", digest("content"), "url", "source", "published_date", joined("keywords"))


@query
def extract_articles_dom(spark, d):
    """Title and content of the same pages, nested and unclosed elements matched as in the document."""
    found = pages.extract_articles(A.pages_with_references(spark, d), A.as_of(), "page_id")
    return found.select("page_id", "title", digest("content"))


@query
def site_selectors(spark, d):
    """Selectors of three steps for the sites of two domains, as a table by site."""
    df = A.pages_with_references(spark, d)
    found = pages.extract_articles(df, A.as_of(), "page_id", sites=A.site_table(df))
    return found.select("page_id", "title", digest("content"))


@query
def site_links(spark, d):
    """Links by the selectors of the sites that have some."""
    df = A.pages(spark, d)
    sites = A.site_table(df)
    known = df.where(F.regexp_extract("url", "//[^/]*", 0).rlike("[.](org|net)$"))
    return pages.extract_links(known, "page_id", sites=sites).select("page_id", "pos", "link")


@query
def extract_links(spark, d):
    return pages.extract_links(A.pages(spark, d), "page_id", selectors=["a[href]"]).select("page_id", "pos", "link")


@query
def follow_links(spark, d):
    df = A.articles(spark, d)
    found = pages.follow_links(A.listing_pages(df), A.landed_pages(df), A.as_of(), "seq")
    return found.select(
        "seq", "title", digest("content"), "url", "source", "published_date", "author", "summary", joined("keywords")
    )


@query
def source_name_from_url(spark, d):
    p = A.pages(spark, d).select(
        "page_id", c("url"), F.concat(F.lit("http://www.feeds."), F.regexp_extract("url", "//(.*)", 1)).alias("feed")
    )
    return p.select(
        "page_id",
        source_name(c("url")).alias("site"),
        source_name(c("feed")).alias("feed_as_site"),
        source_name(c("feed"), "rss").alias("feed"),
    )


@query
def parse_dates(spark, d):
    t = c("published_date")
    styles = [
        F.concat(iso_text(t), F.lit("Z")),
        F.concat(F.lit("Thu, "), F.date_format(t, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        F.concat(F.lit("Thu, "), F.date_format(t, "dd MMM yyyy HH:mm:ss"), F.lit(" +0200")),
        F.date_format(t, "MMM d, yyyy"),
        F.date_format(t, "yyyy-MM-dd"),
        F.date_format(t, "M/d/yyyy"),
        F.lit("a while ago"),
        F.lit(None).cast("string"),
        F.concat(F.date_format(t, "dd MMM yyyy HH:mm"), F.lit(" GMT")),
        F.concat(F.lit("Thu, "), F.date_format(t, "dd MMM yyyy HH:mm:ss"), F.lit(" EST")),
        F.date_format(t, "MMMM d, yyyy h:mm a"),
        F.date_format(t, "MMM d, yyyy hh:mm a"),
        F.date_format(t, "d MMMM yyyy"),
        F.date_format(t, "yyyy/MM/dd"),
        F.date_format(t, "yyyyMMdd'T'HHmmss'Z'"),
    ]
    text = F.element_at(F.array(*styles), (c("seq") % len(styles) + 1).cast("int"))
    return A.articles(spark, d).select("seq", parse_date(text, A.as_of()).alias("parsed"), is_date(text).alias("is_date"))


# --- store ------------------------------------------------------------------------------------

# Two overlapping editions that together hold every document.
BATCH_A, BATCH_B = "category <> 'fr'", "category <> 'en'"


def _stored_out(df: DataFrame) -> DataFrame:
    return df.select(
        "url", "seq", "source", "sentiment_label", "sentiment_confidence", "word_count", "reading_time",
        "created_at", "updated_at",
    )


def _incoming(spark, d):
    chosen = M.analyze(A.articles(spark, d).where(BATCH_B))
    return R.to_stored(chosen, F.timestamp_add("DAY", F.lit(7), c("published_date")))


@query
def stored_rows(spark, d):
    rows = R.to_stored(M.analyze(A.articles(spark, d)), A.as_of())
    return rows.select(
        "seq", "url", "sentiment_label", "sentiment_confidence", "sentiment_model", "word_count", "reading_time",
        F.size("sentiment_scores").alias("n_scores"), F.size("article_metadata").alias("n_metadata"), "created_at",
    )


@query
def stored_roundtrip(spark, d):
    back = R.from_stored(A.stored(spark, d))
    return back.select(
        "seq", "url", "sentiment.label", "sentiment.confidence", "sentiment.model_used",
        F.size("keywords").alias("n_keywords"), F.size("metadata").alias("n_metadata"), digest("content"),
    )


@query
def upsert_articles(spark, d):
    return _stored_out(U.upsert(A.stored(spark, d, BATCH_A), _incoming(spark, d)))


@query
def migrate_counts(spark, d):
    source, target = A.stored(spark, d, BATCH_B), A.stored(spark, d, BATCH_A)
    counts = U.migrate(source, target, work_path(spark, "migrated"))
    return spark.createDataFrame([counts], "saved long, urls long, inserted long, updated long, total long")


@query
def migrated_store(spark, d):
    """The target after a migration, as written."""
    source, target = A.stored(spark, d, BATCH_B), A.stored(spark, d, BATCH_A)
    path = work_path(spark, "migrated")
    U.migrate(source, target, path)
    return _stored_out(spark.read.parquet(path))


@query
def retention_purge(spark, d):
    rows = A.stored(spark, d)
    gone = U.expired(A.as_of(), 30)
    return rows.groupBy("source").agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


@query
def reanalyze_stored(spark, d):
    rows = A.stored(spark, d)
    later = F.lit("2025-01-01").cast("timestamp")
    return _stored_out(U.reanalyze(rows, later, "polarity", keywords=["est", "the"]))


@query
def reanalyze_newest(spark, d):
    rows = A.stored(spark, d)
    later = F.lit("2025-01-01").cast("timestamp")
    return _stored_out(U.reanalyze(rows, later, "polarity", limit=40))


# --- files ------------------------------------------------------------------------------------


@query
def export_csv_projection(spark, d):
    scored = M.analyze(A.articles(spark, d)).withColumn("keywords", J.frequent_keywords(c("content"), 5))
    return files.csv_projection(scored).withColumn("content", F.md5(c("content").cast("binary")))


@query
def export_head(spark, d):
    """The newest 200 articles, as an export shows them."""
    newest = M.analyze(A.articles(spark, d)).orderBy(F.desc("published_date"), "seq").limit(200)
    return files.csv_projection(newest).select("title", "url", "source", "published_date")


@query
def report_projection(spark, d):
    df = M.analyze(A.articles(spark, d))
    out = files.report_projection(df)
    return out.select(
        *[c(f"`{x}`").alias(x.lower().replace(" (min)", "").replace(" ", "_")) for x in out.columns if x != "Content"]
    )


@query
def report_tables(spark, d):
    """The two tables of a report as written."""
    path = work_path(spark, "report")
    scored = M.analyze(A.articles(spark, d)).withColumn("sentiment", F.when(c("seq") % 5 != 4, c("sentiment")))
    n = files.write_articles(scored, path, "report")
    articles = spark.read.parquet(f"{path}/articles").select(
        F.lit("articles").alias("sheet"), c("url").alias("name"), F.md5(c("content").cast("binary")).alias("text"), "sentiment_label",
        c("sentiment_confidence").alias("value"), F.lit(n).cast("long").alias("written"),
    )
    summary = spark.read.parquet(f"{path}/summary").select(
        F.lit("summary").alias("sheet"), c("metric").alias("name"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("sentiment_label"), "value", F.lit(n).cast("long").alias("written"),
    )
    return articles.unionByName(summary)


@query
def article_json_codec(spark, d):
    df = labelled(M.analyze(A.articles(spark, d)))
    coded = df.select("seq", files.article_json(df).alias("json"))
    back = files.articles_from_json(coded, A.as_of(), "seq")
    return back.select(
        "seq", "title", digest("content"), "url", "source", "published_date", "scraped_date", "author", "category",
        "source_type", "sentiment.label", "sentiment.confidence", F.size("keywords").alias("n_keywords"),
    )


def _roundtrip(spark, d, fmt):
    df = M.analyze(A.articles(spark, d)).withColumn("keywords", J.frequent_keywords(c("content"), 5))
    path = work_path(spark, f"export-{fmt}")
    files.write_articles(df, path, fmt)
    back = files.read_articles(spark, f"{path}/articles" if fmt == "json" else path, A.as_of(), "jsonl" if fmt == "json" else fmt)
    return back.select(
        "title", digest("content"), "url", "source", "published_date", "scraped_date", joined("keywords"),
        "category", "source_type", "sentiment.label", "sentiment.confidence",
    )


@query
def json_roundtrip(spark, d):
    return _roundtrip(spark, d, "json")


@query
def csv_roundtrip(spark, d):
    return _roundtrip(spark, d, "csv")


def _landed_json(spark, df: DataFrame, name: str) -> str:
    """Files of up to a thousand articles in the three layouts JSON exports have."""
    path = work_path(spark, name)
    A.json_payloads(df).repartition("file").write.partitionBy("file").text(path)
    return path


@query
def json_envelope_import(spark, d):
    """Indented envelopes, indented lists and lines, told apart by content."""
    path = _landed_json(spark, M.analyze(A.articles(spark, d)), "landed-json")
    back = files.read_articles(spark, path, A.as_of(), "json")
    return back.select(
        "title", digest("content"), "url", "source", "published_date", "scraped_date", "category", "source_type",
        "sentiment.label", "sentiment.confidence",
    )


@query
def import_quarantine(spark, d):
    """Records of the same files that are no articles, and why."""
    path = _landed_json(spark, A.spoiled(A.articles(spark, d)), "landed-spoiled")
    bad = files.rejected(files.import_records(spark, path, A.as_of(), "json"))
    field = lambda name: F.regexp_extract("record", f'"{name}" ?: ?"([^"]*)"', 1).alias(name)
    return bad.select(field("scraped_date"), field("category"), "problem")


# --- composed jobs and streams ----------------------------------------------------------------


@query
def ingest_to_summary(spark, d):
    return jobs.ingest_to_summary(A.articles(spark, d), A.as_of()).summary


def _source_log(df: DataFrame) -> DataFrame:
    ok = F.lit(True).alias("ok")
    return log_of(df.select("source", ok, F.lit(None).cast("string").alias("error_message")), A.as_of(), articles=F.lit(1))


def _two_runs(spark, d) -> str:
    """Two runs over halves of the documents; a third attempt repeats the second with more of them."""
    df, root = A.articles(spark, d), work_path(spark, "runs")
    for run_id, rows in (("one", c("seq") % 2 == 0), ("two", c("seq") % 4 == 1), ("two", c("seq") % 2 == 1)):
        half = df.where(rows)
        runs.run(half, _source_log(half), root, run_id, F.lit(f"2024-04-0{len(run_id) - 2} 00:00:00").cast("timestamp"))
    return root


@query
def full_pipeline(spark, d):
    """Store, export and log after two runs, of which the second was repeated."""
    root = _two_runs(spark, d)
    last = runs.history(spark, root)[-1]
    out = lambda df, part, key, label, n: df.select(F.lit(part).alias("part"), key.alias("key"), label.alias("label"), n.cast("long").alias("n"))
    stored = runs.current_store(spark, root)
    export = files.read_articles(spark, last.path("export/articles"), A.as_of(), "jsonl")
    log = runs.run_log(spark, root)
    counts = spark.createDataFrame([(k, getattr(last, k)) for k in ("saved", "urls", "inserted", "updated", "total", "exported")], "k string, n long")
    return (
        out(stored, "store", c("url"), F.concat_ws(" ", c("sentiment_label"), c("created_at").cast("date")), c("seq"))
        .unionByName(out(export, "export", c("url"), c("sentiment.label"), F.length("content")))
        .unionByName(out(log, "log", F.concat_ws(" ", "run_id", "source"), c("success").cast("string"), c("article_count")))
        .unionByName(out(counts, "counts", c("k"), F.lit(last.run_id), c("n")))
    )


@query
def run_dump(spark, d):
    """The dump of the second run: sources as logged, with the articles found for each."""
    last = runs.history(spark, _two_runs(spark, d))[-1]
    log, lines = runs.read_dump(spark, last.path("dump"))
    found = files.articles_from_json(lines.withColumnRenamed("source", "of"), A.as_of(), "of")
    rows = found.select(c("of").alias("source"), "url", "title", digest("content"), "sentiment.label")
    return log.select("source", "success", "article_count").join(rows, "source", "left")


def _landed(spark, df: DataFrame, name: str) -> str:
    path = work_path(spark, name)
    df.write.parquet(path)
    return path


@query
def stream_ingest(spark, d):
    payloads = A.rss_payloads(A.articles(spark, d))
    path = _landed(spark, payloads, "landed-rss")
    found = stream.ingest(stream.read_landed(spark, path, payloads.schema), "rss", A.as_of())
    out = work_path(spark, "ingested")
    stream.run(stream.append(found, out, work_path(spark, "checkpoint")))
    rows = spark.read.parquet(out)
    return _articles_out(rows.withColumn("guid", c("metadata")["guid"].cast("long")), "guid")


def _land_parts(spark, df: DataFrame, name: str, parts: int, each: Callable[[DataFrame], None]) -> None:
    """Rows arriving in turns by their number; ``each`` runs a stream over the folder after every one."""
    path = work_path(spark, name)
    for part in range(parts):
        df.where(c("seq") % parts == part).write.mode("append").parquet(path)
        each(stream.read_landed(spark, path, df.schema))


@query
def stream_dedup(spark, d):
    df = A.articles(spark, d).select("url", "source", "scraped_date", "seq")
    out, mark = work_path(spark, "unique"), work_path(spark, "checkpoint")
    _land_parts(spark, df, "landed-articles", 3, lambda rows: stream.run(stream.unique_batches(rows, out, mark, ("seq",))))
    return stream.unique_rows(spark, out).select("url", "source", "seq")


@query
def stream_upsert(spark, d):
    df = R.to_stored(A.articles(spark, d), c("published_date"))
    log, mark = work_path(spark, "upsert-log"), work_path(spark, "checkpoint")
    _land_parts(spark, df, "landed-stored", 3, lambda rows: stream.run(stream.log_batches(rows, log, mark, compact_every=2)))
    current = stream.current_articles(spark, log)
    return current.select("url", "seq", "source", "word_count", "created_at", "updated_at")


@query
def stream_sentiment_counts(spark, d):
    df = labelled(M.analyze(A.articles(spark, d))).select("published_date", "sentiment_label", "seq")
    out, mark = work_path(spark, "label-counts"), work_path(spark, "checkpoint")
    _land_parts(spark, df, "landed-labels", 3, lambda rows: stream.run(stream.count_batches(rows, out, mark, "1 day", compact_every=2)))
    return stream.running_counts(spark, out)
