from __future__ import annotations

import csv
import json
import random
import time

import pytest
from helpers import articles, as_of, column
from htmlwalk import walk
from pyspark.sql import functions as F

from checks import adapters
from newsmood.operators import stats
from newsmood.operators.sentiment import analyze
from newsmood.session import work_path
from newsmood.sources import api, feeds, files, pages, registry

FEED = """<rss version="2.0"><channel><title>t</title>
<item><title> A  Read more title </title><link>http://x.org/1</link><description>Body one</description>
  <pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><author>Ann</author><category>World</category><category>world</category>
  <category>EU</category><guid>g1</guid></item>
<item><title>No tags</title><link>http://x.org/2</link><content>Alpha beta alpha &amp; gamma</content><summary>Sum</summary></item>
<item><title></title><link>http://x.org/3</link></item>
<item><title>No link</title></item>
</channel></rss>"""


def test_rss(spark, tmp_path):
    df = spark.createDataFrame([("https://feeds.bbci.co.uk/rss.xml", FEED)], "feed_url string, payload string")
    a, b = feeds.items_to_articles(feeds.explode_feeds(df), as_of()).orderBy("url").collect()
    assert (a.title, a.content, a.source, a.author, a.category) == ("A  title", "Body one", "Bbci", "Ann", "World")
    assert a.keywords == ["world", "eu"] and str(a.published_date) == "2024-01-02 03:04:05"
    assert a.metadata["guid"] == "g1" and a.source_type == "rss"
    assert b.content == "Alpha beta alpha & gamma" and b.keywords == ["alpha", "beta", "gamma"]
    assert b.summary == "Sum" and b.author is None and b.category is None and str(b.published_date) == "2024-03-01 00:00:00"
    (tmp_path / "feed.xml").write_text(FEED)
    landed = feeds.read_items(spark, str(tmp_path / "feed.xml"))
    assert feeds.items_to_articles(landed, as_of()).count() == 2


def test_api(spark):
    items = [
        {"title": "T1", "url": "u1", "content": "cut [+", "description": "desc one", "source": {"id": "s", "name": "N"},
         "publishedAt": "2024-01-01T00:00:00Z", "author": "A", "urlToImage": "i"},
        {"title": "T2", "url": "u2", "content": "whole", "description": None, "source": None, "publishedAt": "bad"},
        {"title": None, "url": "u3"}, {"title": "T4", "url": ""},
    ]
    rows = [("a", json.dumps({"status": "ok", "articles": items})), ("b", json.dumps({"status": "error", "message": "no key"})),
            ("c", "not json"), ("d", None)]
    responses = api.parse_responses(spark.createDataFrame(rows, "source string, payload string"))
    one, two = api.responses_to_articles(responses, as_of()).orderBy("url").collect()
    assert (one.content, one.source, one.summary, one.metadata["source_id"]) == ("desc one", "N", "desc one", "s")
    assert (two.content, two.source, two.author, str(two.published_date)) == ("whole", "Unknown", None, "2024-03-01 00:00:00")
    log = {r.source: r for r in registry.ingest_log(responses, as_of()).collect()}
    assert log["a"].success and log["a"].article_count == 2
    assert not log["b"].success and log["b"].error_message == "News API error: no key"
    assert log["c"].error_message == log["d"].error_message == "News API error: Unknown error"
    assert tuple(stats.ingest_run_totals(registry.ingest_log(responses, as_of())).first()) == (4, 1, 2)


def test_feed_items(spark):
    items = [
        {"title": "T", "url": "u1", "published date": "Mon, 01 Jan 2024 08:00:00 GMT", "description": "", "snippet": "snip"},
        {"title": "T two", "url": "u2", "published_at": "2024-01-05", "publisher": {"title": "P"}, "source": "S"},
        {"title": "T", "url": None},
    ]
    df = spark.createDataFrame([(json.dumps(items),)], "payload string")
    a, b = api.feed_items_to_articles(df, as_of()).orderBy("url").collect()
    assert (a.content, a.source, str(a.published_date)) == ("snip", "Google News", "2024-01-01 08:00:00")
    assert (b.content, b.source, b.summary, b.published_date.day) == ("T two", "P", "", 5)


def test_catalog(spark):
    sources = [{"id": "a", "category": "x", "language": "en", "country": "us"}, {"id": "b", "category": "y", "language": "en", "country": "in"},
               {"id": "c", "category": "x", "language": "de", "country": "de"}]
    df = spark.createDataFrame(
        [(json.dumps({"status": "ok", "sources": sources}),), (json.dumps({"status": "error", "sources": sources}),)], "payload string"
    )
    ids = lambda q: sorted(r.id for r in q.collect())
    assert ids(api.source_catalog(df)) == ["a", "b"]
    assert ids(api.source_catalog(df, category="x", language=None)) == ["a", "c"]
    assert ids(api.source_catalog(df, country="in")) == ["b"]


BODY = "This is the long body of the article, it goes on for more than one hundred characters so that it is taken. " * 2
PAGE = f"""<html><head><title>Site title that is long</title><meta name="description" content="About &amp; more"></head><body>
<!-- <h1>Commented out headline text</h1> -->
<h1 class="x entry-title">The entry headline</h1><h1>Other headline here</h1>
<div class="entry-content main"><p>{BODY}</p><script>var a=1;</script><div class="ad">Buy now</div><p>Tail &eacute;&#233;.</p></div>
<article>{BODY}</article><span class="byline">By  Jo</span><time class="t" datetime="2024-02-03T04:05:06Z">x</time>
</body></html>"""


def test_page_fields(spark):
    df = spark.createDataFrame([("https://www.site.org/a", PAGE), ("u2", "<h1>Short</h1>"), ("u3", None)], "url string, html string")
    (a,) = pages.extract_articles(df, as_of()).collect()
    assert a.title == "The entry headline" and a.content.startswith("This is the long body")
    assert "Buy now" not in a.content and "var a" not in a.content
    assert (a.author, a.summary, a.source, str(a.published_date)) == ("By Jo", "About & more", "Site", "2024-02-03 04:05:06")
    assert len(a.keywords) == 8
    own = pages.extract_articles(df, as_of(), title=["h1"], content=["article"]).first()
    assert own.title == "The entry headline" and "Tail" not in own.content


NESTED = f'<h1>Nested page title</h1><div class="story-body"><div>{BODY}</div><div class="ad"><div>x</div>Buy</div><div>End here</div></div>'


def test_nested_elements_come_out_whole(spark):
    df = spark.createDataFrame([("u", NESTED)], "url string, html string")
    found = pages.extract_articles(df, as_of()).first()
    assert found.content.endswith("End here") and "Buy" not in found.content


def test_expressions_equal_a_document_walk(spark, sf_dir):
    df = adapters.pages(spark, sf_dir)
    found = pages.extract_articles(df, as_of(), "page_id").select("page_id", "title", "content", "author").collect()
    walked = [(r.page_id, *walk(r.html)) for r in df.collect()]
    assert found and sorted(map(tuple, found)) == sorted(w for w in walked if w[1] is not None and w[2] is not None)


def test_ends_of_elements(spark):
    """Each opening tag ends where a count of its tag's openings and closings says."""
    rng = random.Random(3)
    tags = ["<a>", "</a>", "<b>", "</b>", "<p class=x>", "</p>", "<br>", "</br>", "text", "<DIV>", "</div>"]
    htmls = ["".join(rng.choice(tags) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(htmls)), "seq long, html string").withColumn("d", pages.page(F.col("html")))
    for r in df.select("d").collect():
        names = r.d["names"]
        for i, name in enumerate(names):
            end = i
            if name and not name.startswith("/") and name not in pages._VOID:
                depth, end = 1, len(names)
                for j in range(i + 1, len(names)):
                    depth += (names[j] == name) - (names[j] == "/" + name)
                    if depth == 0:
                        end = j
                        break
            assert r.d["ends"][i] == end, (names, i)


def test_time_of_a_page_is_linear_in_its_length(spark):
    """The work table of ends grows with the pieces; eight times the elements take far less than 64 times as long."""
    part = f'<div class="a"><div class="ad">x</div><p>{"word " * 20}</p></div>'

    def seconds(n):
        html = f'<h1>A title that is long</h1><article>{part * n}</article>'
        df = spark.createDataFrame([("u", html)], "url string, html string").coalesce(1)
        start = time.perf_counter()
        (r,) = pages.extract_articles(df, as_of()).select(F.length("content").alias("n")).collect()
        assert r.n == n * 100 - 1
        return time.perf_counter() - start

    seconds(250)
    small, large = seconds(500), seconds(4000)
    assert large < 24 * small + 2, (small, large)


def test_selectors_as_constants_and_as_rows_are_the_same(spark):
    own = ["h1.a-b", ".x Y.z [rel=\"au.thor\"]", "a[href*=\"/p?/\"]", "time[datetime] b"]
    every = [*pages.TITLE, *pages.CONTENT, *pages.AUTHOR, *pages.DATE, *pages.LINKS, *own]
    (constants,) = spark.range(1).select(pages.rules(every).alias("r")).first()
    rows = spark.createDataFrame(list(enumerate(every)), "i int, s string").select("i", pages.rule(F.col("s")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == constants


def test_selectors_of_any_number_of_steps_by_site(spark):
    html = f"""<div class="top"><h1>The usual headline</h1></div><main><section id="s"><div class="lead"><h2 data-k="a.b">Headline of the site</h2>
      </div></section></main><h2>Another headline here</h2><article>{BODY}</article><div class="own"><p class="own">{"Own body. " * 20}</p></div>
      <ul class="nav"><li><a href="/p/1">1</a></li></ul><a href="/news/2">2</a>"""
    df = spark.createDataFrame([("https://www.A.org/x", html), ("http://b.org/x", html), ("c", html)], "url string, html string")
    table = spark.createDataFrame(
        [
            ("a.org", "title", 2, "h2"),
            ("a.org", "title", 1, "main section .lead h2[data-k=\"a.b\"]"),
            ("A.org", "title", 0, "main main h2"),
            ("a.org", "content", 1, ".own p.own"),
            ("a.org", "title", 0, "a > b"),
            ("b.org", "links", 1, "ul.nav li a[href]"),
            ("b.org", "colour", 1, "h1"),
            ("b.org", "title", 1, None),
        ],
        "site string, field string, priority int, selector string",
    )
    got = {r.url: (r.title, r.content[:4]) for r in pages.extract_articles(df, as_of(), sites=table).collect()}
    usual = ("The usual headline", BODY[:4])
    assert got == {"https://www.A.org/x": ("Headline of the site", "Own "), "http://b.org/x": usual, "c": usual}
    links = {r.base_url: r.link for r in pages.extract_links(df.limit(2), sites=table).collect()}
    assert links == {"https://www.A.org/x": "https://www.A.org/news/2", "http://b.org/x": "http://b.org/p/1"}
    assert sorted((r.field, str(r.selector)) for r in pages.bad_site_rules(table).collect()) == [("colour", "h1"), ("title", "None"), ("title", "a > b")]
    steps = spark.createDataFrame([(x,) for x in ("h1", "a.b c[d]", "", "  ", "a > b", "#x", '[k="v"]', "x:y")], "s string")
    assert [r.v for r in steps.select(pages.is_selector(F.col("s")).alias("v")).collect()] == [True, True, False, False, False, False, True, False]
    # A walk that knows the order of steps picks the same.
    assert walk(html, ("main section .lead h2",))[0] == "Headline of the site" and walk(html, ("main main h2",))[0] is None


def test_links(spark):
    html = """<div class="article-link"><a href="/z">z</a></div><a class="b" href='/news/1'>1</a><a href="/news/2#x">2</a>
      <a href="news/3">3</a><a href="/news/1">again</a><a href="/tag/news/">t</a>"""
    df = spark.createDataFrame([("https://s.org/home/x", html), ("https://s.org/", html.replace("news", "old"))], "url string, html string")
    got = {}
    for r in pages.extract_links(df).orderBy("base_url", "pos").collect():
        got.setdefault(r.base_url, []).append(r.link)
    assert got == {"https://s.org/home/x": ["https://s.org/news/1"], "https://s.org/": ["https://s.org/z"]}
    first = pages.extract_links(df.limit(1), selectors=["a[href]"]).orderBy("pos").collect()
    assert [r.link for r in first] == ["https://s.org/z", "https://s.org/news/1", "https://s.org/home/news/3"]
    with pytest.raises(ValueError):
        pages.extract_links(df, selectors=["a > b"])


def sample(spark):
    rows = [
        {"title": 'Quote " and, comma', "content": 'line one\nline "two"\r\nend', "url": "u1", "keywords": ["a b", "c"], "author": None},
        {"title": "plain", "content": "good text \\ slash", "url": "u2", "keywords": [], "summary": "", "category": "x"},
    ]
    return analyze(articles(spark, rows)).drop("seq")


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_file_roundtrip(spark, fmt):
    df, path = sample(spark), work_path(spark, fmt)
    assert files.write_articles(df, path, fmt) == 2
    back = files.read_articles(spark, f"{path}/articles" if fmt == "json" else path, as_of(), fmt)
    cols = ["title", "content", "url", "source", "published_date", "scraped_date", "author", "keywords", "category", "source_type"]
    got, want = back.orderBy("url").collect(), df.orderBy("url").collect()
    for g, w in zip(got, want):
        assert [g[c] for c in cols] == [w[c] for c in cols]
        assert (g.sentiment.label, g.sentiment.confidence) == (w.sentiment.label, w.sentiment.confidence)
    if fmt == "json":
        manifest = files.read_manifest(spark, path)
        assert manifest["total_articles"] == 2 and manifest["format_version"] == "1.0"
    assert len(got) == 2


GOOD = {"title": "t", "content": "c", "url": "u", "source": "s", "published_date": "2024-01-01T00:00:00Z"}


def test_envelope_and_bad_records(spark, tmp_path):
    bad = [{"title": "no url"}, GOOD | {"source_type": "fax"}, GOOD | {"sentiment": {"label": "odd", "confidence": 1.0}}]
    (tmp_path / "a.json").write_text(json.dumps({"export_info": {"total_articles": 4}, "articles": [GOOD, *bad]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps([GOOD | {"url": "v", "published_date": "someday"}]))
    rows = files.read_articles(spark, str(tmp_path), as_of(), "json").orderBy("url").collect()
    assert [(r.url, r.source_type, r.keywords) for r in rows] == [("u", "website", []), ("v", "website", [])]
    assert str(rows[1].published_date) == "2024-03-01 00:00:00"
    kept = files.rejected(files.import_records(spark, str(tmp_path), as_of(), "json")).orderBy("nth").collect()
    assert [(json.loads(r.record), r.problem) for r in kept] == list(zip(bad, ["no content", "unknown source type", "unknown sentiment label"], strict=True))
    assert all(r.file.endswith("a.json") for r in kept)


LAYOUTS = {
    "envelope": lambda r: json.dumps({"export_info": {"a": {"articles": 5}}, "other": [{"z": 1}], "articles": r, "end": [{"q": {}}]}, indent=2),
    "list": lambda r: json.dumps(r, indent=1, ensure_ascii=False),
    "one line": lambda r: json.dumps({"articles": r}),
    "rows": lambda r: "[\n" + ",\n".join(map(json.dumps, r)) + "\n]",
    "lines": lambda r: "\n".join(map(json.dumps, r)) + "\n\n",
    "key apart": lambda r: json.dumps({"articles": r}).replace('{"articles": [', '{"articles":\n[', 1),
}


@pytest.fixture
def small_ranges(spark):
    """Files split into byte ranges far shorter than some records."""
    settings = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "50"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def noisy(n=50):
    rng = random.Random(7)
    texts = ['a "quoted" {x} [y]', "line\nbreak\r\n, é", "\\ back\\", '"articles": [', "}}]]", ""]
    return [
        GOOD | {"url": f"u{i:03}", "content": rng.choice(texts) + "x" * rng.choice([0, 9, 4000]), "metadata": {"articles": '[{"k": 1}]'}, "keywords": ["k", "]"]}
        for i in range(n)
    ]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_json_layouts_split_at_records(spark, tmp_path, small_ranges, layout):
    records = noisy()
    path = tmp_path / "x.json"
    path.write_text(LAYOUTS[layout](records))
    found = files.import_records(spark, str(path), as_of(), "json")
    rows = found.orderBy("start", "nth").collect()
    assert [json.loads(r.record) for r in rows] == records
    assert [(r.article.url, r.article.content, r.article.keywords) for r in rows] == [(x["url"], x["content"], x["keywords"]) for x in records]
    assert len({r.start for r in rows}) > 5 or layout in ("one line", "key apart")
    assert files.read_articles(spark, str(path), as_of()).count() == len(records)


def test_broken_lines_spoil_no_others(spark, tmp_path):
    lines = [json.dumps(r) for r in noisy(20)]
    lines[3], lines[9], lines[12] = lines[3][:40], lines[9] + "}}", "null"
    (tmp_path / "x.json").write_text("\n".join(lines))
    found = files.import_records(spark, str(tmp_path / "x.json"), as_of(), "json")
    assert files.accepted(found).count() >= 17
    assert {r.record for r in files.rejected(found).collect()} >= {lines[3], "null"}
    (tmp_path / "empty.json").write_text("")
    assert files.read_articles(spark, str(tmp_path / "empty.json"), as_of()).count() == 0


def test_csv_splits_at_records(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        content = rng.choice(['say "hi",\nthen\n\nbye', "plain", ",", '""', "\r\n", "é" * 3000])
        rows.append({"title": f"t{i}", "url": f"u{i:03}", "content": content, "source": "s", "published_date": "2024-01-01T00:00:00", "keywords": "a, b"})
    with open(tmp_path / "x.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, files.CSV_COLUMNS)
        out.writeheader()
        out.writerows(rows)
        f.write("short,record\r\n")
    found = files.import_records(spark, str(tmp_path / "x.csv"), as_of(), "csv")
    good = files.accepted(found).orderBy("url").collect()
    assert [(r.url, r.title, r.content, r.keywords) for r in good] == [(x["url"], x["title"], x["content"], ["a", "b"]) for x in rows]
    assert [(r.record, r.problem) for r in files.rejected(found).collect()] == [("short,record", "wrong number of fields")]
    assert found.select("start").distinct().count() > 5


def test_exports_count_while_writing(spark, tmp_path):
    df = articles(spark, [{"url": f"u{i}"} for i in range(7)]).repartition(3)
    for fmt in ("json", "csv", "parquet", "report"):
        assert files.write_articles(df, str(tmp_path / fmt), fmt) == 7
    assert files.read_manifest(spark, str(tmp_path / "json"))["total_articles"] == 7
    assert files.write_articles(df.where("false"), str(tmp_path / "none"), "json") == 0


def test_dispatch(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_articles(spark, "x.docx", as_of())
    with pytest.raises(ValueError):
        files.write_articles(sample(spark), str(tmp_path / "x"), "docx")
    with pytest.raises(KeyError):
        registry.parse("fax", sample(spark), as_of())
    registry.register_parser("same", lambda df, when: df)
    assert "same" in registry.parser_kinds() and registry.remove_parser("same") and not registry.remove_parser("same")


def test_report_and_csv_columns(spark):
    df = sample(spark)
    assert len(files.report_projection(df).columns) == 15
    row = files.csv_projection(df).orderBy("url").first()
    assert tuple(row.asDict()) == files.CSV_COLUMNS
    assert (row.keywords, row.author, row.published_date) == ("a b, c", "", "2024-01-01T00:00:00")
    path = work_path(spark, "report")
    assert files.write_articles(df, path, "report") == 2
    assert spark.read.parquet(f"{path}/articles").count() == 2
    summary = {r.metric: r.value for r in spark.read.parquet(f"{path}/summary").collect()}
    assert summary["Total Articles"] == 2 and summary["Analysis Coverage"] == 100.0
    bare = files.csv_projection(df.withColumn("sentiment", F.lit(None).cast(df.schema["sentiment"].dataType))).first()
    assert (bare.sentiment_label, bare.sentiment_confidence) == ("", "")


def test_names_are_looked_for_in_tags_only(spark):
    html = "x <b>lead</b><DIV Class='Entry-Content' data-x='a>b'>" + "long words &lt;b&gt; &amp;amp; entry-title " * 9 + "</div><!-- .author --><p rel=author>me</p>"
    df = spark.createDataFrame([(0, html), (1, html.replace("<!--", "<i>")), (2, None)], "seq int, html string")
    low = column(df.select("seq", pages.page(F.col("html"))["low"].alias("v")))
    assert all("entry-content" in x and "entry-title" not in x for x in low[:2]) and low[2] == ""
    texts = column(df.select("seq", pages.first_text(pages.page(F.col("html")), pages.rules([".entry-content"]), lambda v: v != "").alias("v")))
    assert texts[0] == ("long words <b> &amp; entry-title " * 9).strip() and texts[1].startswith(texts[0]) and texts[2] is None
