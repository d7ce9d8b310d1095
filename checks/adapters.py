"""The driver's tables as article tables and as landed payloads.

Payloads are rendered from the tables by Spark, at most ``BATCH`` consecutive
documents per payload, so their number grows with the data and their size does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmood.functions.dates import iso_text
from newsmood.operators.articles import to_stored
from newsmood.operators.sentiment import analyze
from newsmood.operators.store import last_by_url
from newsmood.schema import ARTICLE
from newsmood.session import prepare, spread

AS_OF_TEXT = "2024-03-01 00:00:00"
BATCH = 1000
HOURS = 20000


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


#: Word weights of a linear scorer.
WEIGHTS = {"the": 3, "of": -2, "de": 2, "la": -3, "der": 1, "und": -1, "en": 1, "and": -1}

#: Symbols that the third voter counts.
MARKS = "[!%$&*#|]"

#: Character references as real pages hold them; a page ends with one of these.
TAILS = (
    " caf&eacute;&rarr;&lt x&#150;",
    " &#0;&#xD800;&#9999999;&notit; &#00233;",
    " &frac34x &#x1F600; &copy2024 &unknown; AT&T",
)


def pages_with_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col("page_id") % len(TAILS) + 1).cast("int"))
    return pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("</article>"), F.concat(tail, F.lit("</article>"))))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ARTICLE rows with ``seq``, the input order.

    The URL is a hash of the text, so exact copies share it.
    """
    c = F.col
    first_line = F.substring(F.split_part(c("text"), F.lit("\n"), F.lit(1)), 1, 80)
    published = F.timestamp_add("HOUR", c("doc_id") % HOURS, F.lit("2024-01-01").cast("timestamp"))
    return documents(spark, sf_dir).select(
        F.trim(first_line).alias("title"),
        c("text").alias("content"),
        F.concat(F.lit("https://news.example.org/"), F.md5(c("text").cast("binary"))).alias("url"),
        c("source"),
        published.alias("published_date"),
        F.timestamp_add("DAY", F.lit(1), published).alias("scraped_date"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("summary"),
        F.array().cast("array<string>").alias("keywords"),
        c("lang").alias("category"),
        F.when(c("doc_id") % 3 == 0, "rss").when(c("doc_id") % 3 == 1, "api").otherwise("website")
        .alias("source_type"),
        F.lit(None).cast(ARTICLE["sentiment"].dataType).alias("sentiment"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        c("doc_id").alias("seq"),
    )


def stored(spark: SparkSession, sf_dir: str, where: str = "true", analyzed: str = "seq % 5 <> 4") -> DataFrame:
    """A stored table of the chosen documents, one row per URL (the last), most of it scored."""
    chosen = articles(spark, sf_dir).where(where)
    scored = analyze(chosen).withColumn("sentiment", F.when(F.expr(analyzed), F.col("sentiment")))
    return last_by_url(to_stored(scored, F.col("published_date")))


def _xml(c: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def _element(name: str, value: Column, when: Column | None = None) -> Column:
    text = F.concat(F.lit(f"<{name}>"), _xml(value), F.lit(f"</{name}>"))
    return text if when is None else F.when(when, text).otherwise("")


def _batched(df: DataFrame, item: Column, by: str = "source") -> DataFrame:
    """Items of each source in payloads of consecutive documents: ``source, batch, items``."""
    batch = (F.col("seq") / BATCH).cast("long").alias("batch")
    grouped = df.select(by, batch, "seq", item.alias("item")).groupBy(by, "batch")
    ordered = F.sort_array(F.collect_list(F.struct("seq", "item")))
    return grouped.agg(F.transform(ordered, lambda x: x["item"]).alias("items"))


def rss_items(df: DataFrame) -> Column:
    c = F.col
    seq = c("seq")
    rfc = F.date_format("published_date", "dd MMM yyyy HH:mm:ss")
    return F.concat(
        F.lit("<item>"),
        _element("title", c("title")),
        _element("link", c("url"), seq % 17 != 0),
        # The shapes of feeds take turns: plain and namespaced names, elements with attributes.
        _element("content", c("content"), seq % 4 == 1),
        _element("content:encoded", c("content"), seq % 4 == 3),
        _element("description", F.when(seq % 4 == 3, F.concat(F.lit("Teaser: "), c("title"))).otherwise(c("content"))),
        _element("summary", c("content"), seq % 4 == 3),
        _element("pubDate", F.concat(F.lit("Mon, "), rfc, F.lit(" GMT")), (seq % 9 != 0) & (seq % 5 != 1)),
        _element("dc:date", F.concat(iso_text(c("published_date")), F.lit("Z")), (seq % 9 != 0) & (seq % 5 == 1)),
        _element("author", F.concat(F.lit(" Author  "), c("source")), seq % 8 == 0),
        _element("dc:creator", F.concat(F.lit(" Author  "), c("source")), seq % 8 == 4),
        _element("category", F.upper("category"), seq % 3 == 0),
        _element("category", c("source"), seq % 3 == 0),
        F.concat(F.lit('<guid isPermaLink="false">'), seq.cast("string"), F.lit("</guid></item>")),
    )


def atom_entries(df: DataFrame) -> Column:
    c = F.col
    seq = c("seq")
    iso = F.concat(iso_text(c("published_date")), F.lit("Z"))
    tag = lambda value: F.concat(F.lit('<category term="'), value, F.lit('"/>'))
    link = F.concat(F.lit('<link rel="self" href="https://feed.example.com/"/><link rel="alternate" href="'), c("url"), F.lit('"/>'))
    return F.concat(
        F.lit("<entry>"),
        F.concat(F.lit('<title type="text">'), _xml(c("title")), F.lit("</title>")),
        F.when(seq % 17 != 0, link).otherwise(""),
        F.when(seq % 2 == 1, F.concat(F.lit('<content type="html">'), _xml(c("content")), F.lit("</content>"))).otherwise(""),
        _element("summary", c("content")),
        _element("published", iso, (seq % 9 != 0) & (seq % 5 != 1)),
        _element("updated", iso, (seq % 9 != 0) & (seq % 5 == 1)),
        F.when(seq % 4 == 0, F.concat(F.lit("<author><name> Author  "), c("source"), F.lit("</name></author>"))).otherwise(""),
        F.when(seq % 3 == 0, F.concat(tag(F.upper("category")), tag(c("source")))).otherwise(""),
        _element("id", seq.cast("string")),
        F.lit("</entry>"),
    )


def atom_payloads(df: DataFrame) -> DataFrame:
    """``source, batch, feed_url, payload``: whole Atom documents."""
    url = F.concat(F.lit("https://feeds."), F.col("source"), F.lit(".example.com/atom"))
    body = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>'), F.array_join("items", ""), F.lit("</feed>"))
    return _batched(df, atom_entries(df)).select("source", "batch", url.alias("feed_url"), body.alias("payload"))


def rss_payloads(df: DataFrame) -> DataFrame:
    """``source, batch, feed_url, payload``: whole feed documents."""
    url = F.concat(F.lit("https://feeds."), F.col("source"), F.lit(".example.com/rss"))
    body = F.concat(
        F.lit('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>feed</title>'), F.array_join("items", ""), F.lit("</channel></rss>")
    )
    return _batched(df, rss_items(df)).select("source", "batch", url.alias("feed_url"), body.alias("payload"))


def api_payloads(df: DataFrame) -> DataFrame:
    """``source, batch, payload``: API responses, one in seven of them an error."""
    c = F.col
    seq = c("seq")
    teaser = F.concat(F.lit("About: "), c("content"))
    iso = F.concat(iso_text(c("published_date")), F.lit("Z"))
    item = F.struct(
        F.when(seq % 13 != 0, c("title")).alias("title"),
        c("url"),
        F.when(seq % 7 != 0, F.when(seq % 5 == 0, F.concat(c("content"), F.lit(" [+"))).otherwise(c("content"))).alias("content"),
        teaser.alias("description"),
        F.struct(
            F.lower("source").alias("id"), F.when(seq % 10 != 0, c("source")).alias("name")
        ).alias("source"),
        F.when(seq % 11 == 0, F.lit("soon")).when(seq % 11 != 1, iso).alias("publishedAt"),
        F.when(seq % 4 == 0, F.concat(F.lit("Author "), c("source"))).alias("author"),
        seq.cast("string").alias("urlToImage"),
    )
    grouped = _batched(df, item)
    failed = F.pmod(F.regexp_extract("source", r"(\d+)$", 1).cast("int") + F.col("batch"), F.lit(7)) == 3
    good = F.to_json(F.struct(F.lit("ok").alias("status"), c("items").alias("articles")))
    bad = F.to_json(
        F.struct(F.lit("error").alias("status"), F.concat(F.lit("limit of "), c("source")).alias("message"))
    )
    return grouped.select("source", "batch", F.when(failed, bad).otherwise(good).alias("payload"))


def feed_item_payloads(df: DataFrame) -> DataFrame:
    """``source, batch, payload``: aggregator results as JSON arrays."""
    c = F.col
    seq = c("seq")
    date = F.date_format("published_date", "dd MMM yyyy HH:mm:ss")
    rfc = F.concat(F.lit("Tue, "), date, F.lit(" GMT"))
    item = F.struct(
        c("title"),
        F.when(seq % 19 != 0, c("url")).alias("url"),
        F.when(seq % 3 == 0, rfc).alias("published date"),
        F.when(seq % 3 == 1, iso_text(c("published_date"))).alias("published"),
        F.when(seq % 6 == 2, F.lit("yesterday")).alias("published_at"),
        F.when(seq % 4 != 0, c("content")).alias("description"),
        F.when(seq % 8 == 0, F.concat(F.lit("More "), c("content"))).alias("snippet"),
        F.when(seq % 5 != 0, F.struct(F.concat(F.lit("Pub "), c("source")).alias("title"))).alias("publisher"),
        F.when(seq % 10 != 0, c("source")).alias("source"),
    )
    return _batched(df, item).select("source", "batch", F.to_json("items").alias("payload"))


def catalog_payloads(df: DataFrame) -> DataFrame:
    """One catalog response per source: its language is that of its first document."""
    c = F.col
    per_source = df.groupBy("source").agg(
        F.min(F.struct("seq", "category")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    entry = F.struct(
        c("source").alias("id"),
        F.upper("source").alias("name"),
        c("n").cast("string").alias("description"),
        F.concat(F.lit("https://"), c("source"), F.lit(".example.com")).alias("url"),
        F.element_at(
            F.array(F.lit("business"), F.lit("science"), F.lit("general")),
            (c("m.seq") % 3 + 1).cast("int"),
        ).alias("category"),
        c("m.category").alias("language"),
        F.when(c("m.seq") % 2 == 0, "us").otherwise("in").alias("country"),
    )
    status = F.when(c("m.seq") % 10 == 9, "error").otherwise("ok")
    body = F.struct(status.alias("status"), F.array(entry).alias("sources"))
    return per_source.select(F.to_json(body).alias("payload"))


def listing_pages(df: DataFrame) -> DataFrame:
    """Listing pages of 20 consecutive documents each: ``url, html``."""
    page = (F.col("seq") / 20).cast("long").alias("page")
    anchor = F.concat(
        F.lit('<li><a class="t" href="/article/'), F.col("seq").cast("string"), F.lit('">more</a></li>')
    )
    grouped = df.select(page, "seq", anchor.alias("item")).groupBy("page")
    items = F.transform(F.sort_array(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"])
    base = F.concat(F.lit("https://www.daily.example.org/list/"), F.col("page").cast("string"))
    html = F.concat(
        F.lit('<html><body><a href="/tag/all">tags</a><ul>'),
        F.array_join("items", ""),
        F.lit('</ul><a href="/article/0#top">top</a></body></html>'),
    )
    return grouped.agg(items.alias("items")).select(base.alias("url"), html.alias("html"))


def landed_pages(df: DataFrame) -> DataFrame:
    """The article page of every document: ``seq, url, html``."""
    c = F.col
    html = F.concat(
        F.lit("<html><head><title>"), _xml(c("title")),
        F.lit("</title><meta name=\"description\" content=\"about "), c("source"),
        F.lit("\"></head><body><div class=\"byline\">By "), c("source"),
        F.lit("</div><time datetime=\""), iso_text(c("published_date")),
        F.lit("Z\">then</time><article><h1>"), _xml(c("title")), F.lit("</h1><p>"),
        _xml(c("content")), F.lit("</p></article></body></html>"),
    )
    url = F.concat(F.lit("https://www.daily.example.org/article/"), c("seq").cast("string"))
    return df.select("seq", url.alias("url"), html.alias("html"))


def source_registry(df: DataFrame) -> DataFrame:
    """``(name, type, url)`` of every source and source type in the articles."""
    host = F.when(F.col("source_type") == "rss", "https://rss.").otherwise("https://www.")
    name = F.when((F.col("source_type") == "api") & (F.col("source") == "src1"), "NewsAPI").when(
        (F.col("source_type") == "api") & (F.col("source") == "src2"), "GNews"
    ).otherwise(F.initcap("source"))
    return df.select("source", "source_type").distinct().select(
        name.alias("name"),
        F.col("source_type").alias("type"),
        F.concat(host, F.col("source"), F.lit(".example.com/news")).alias("url"),
    )


def spoiled(df: DataFrame) -> DataFrame:
    """Articles with the faults imports meet: missing values, values outside the closed domains."""
    nth = F.col("seq") % 10
    mood = F.struct(F.lit("odd").alias("label"), F.lit(0.5).alias("confidence"), F.create_map().cast("map<string,double>").alias("scores"), F.lit("").alias("model_used"))
    return df.withColumns(
        {
            "title": F.when(nth != 1, F.col("title")),
            "url": F.when(nth != 2, F.col("url")),
            "source_type": F.when(nth == 3, "fax").otherwise(F.col("source_type")),
            "sentiment": F.when(nth == 4, mood),
        }
    )


def json_payloads(df: DataFrame) -> DataFrame:
    """``file, value``: exports of consecutive articles of a source, the layouts taking turns.

    Envelopes and lists are indented.
    """
    pretty = F.to_json(F.struct(*_json_fields()), {"ignoreNullFields": "false", "pretty": "true"})
    compact = F.to_json(F.struct(*_json_fields()), {"ignoreNullFields": "false"})
    both = _batched(df, F.struct(pretty.alias("pretty"), compact.alias("compact")))
    items = F.array_join(F.transform("items", lambda x: x["pretty"]), ",\n")
    lines = F.array_join(F.transform("items", lambda x: x["compact"]), "\n")
    nth = F.pmod(F.xxhash64("source", "batch"), F.lit(3))
    head = F.concat(F.lit('{\n  "export_info" : {\n    "total_articles" : '), F.size("items"), F.lit('\n  },\n  "articles" : [\n'))
    value = F.when(nth == 0, F.concat(head, items, F.lit("\n]\n}"))).when(nth == 1, F.concat(F.lit("[ "), items, F.lit(" ]"))).otherwise(lines)
    return both.select(F.concat_ws("-", F.coalesce("source", F.lit("none")), "batch").alias("file"), value.alias("value"))


def _json_fields() -> list[Column]:
    return [iso_text(F.col(f.name)).alias(f.name) if f.name.endswith("_date") else F.col(f.name) for f in ARTICLE.fields]


def site_table(pages_: DataFrame) -> DataFrame:
    """Selectors of the sites below two domains: by (site, field, priority, selector)."""
    sites = pages_.select(F.regexp_replace(F.regexp_extract("url", "//([^/]*)", 1), r"^www\.", "").alias("site")).distinct()
    rows = [("title", 1, "html head title"), ("content", 2, "html body footer"), ("content", 1, "nav ul .none"), ("links", 1, "nav ul li a[href]")]
    table = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("priority"), F.lit(s).alias("selector")) for f, p, s in rows])
    return sites.where("site LIKE '%.net' OR site LIKE '%.org'").select("site", F.explode(table).alias("r")).select("site", "r.*")
