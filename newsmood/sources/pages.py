"""Web pages to articles and article links, by expressions over the raw HTML.

A page is cut before every tag. Which piece ends an element is worked out for all of them at once
by sorting, so time grows with the length of a page and not with its elements times its length.
Selectors are data: lists given to a job, and rows of a table by site.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmood.functions.dates import parse_date
from newsmood.functions.html import unescape
from newsmood.functions.text import clean_text, first_filled, let
from newsmood.functions.urls import host, is_article_url, resolve, source_name
from newsmood.operators.textjobs import frequent_keywords
from newsmood.schema import ARTICLE
from newsmood.session import built_once

# Selectors by field, in order of preference.
TITLE = ("h1.article-title", "h1.entry-title", "h1.post-title", ".article-headline h1",
         ".story-title h1", "h1", "title")
CONTENT = (".article-content", ".entry-content", ".post-content", ".story-body", ".article-body",
           "article", ".content")
AUTHOR = (".author", ".byline", ".article-author", ".post-author", '[rel="author"]', ".writer")
DATE = ("time[datetime]", ".publish-date", ".article-date", ".post-date", "[pubdate]")
SUMMARY = (("name", "description"), ("property", "og:description"), ("name", "twitter:description"),
           ("name", "summary"))
LINKS = ('a[href*="/article/"]', 'a[href*="/story/"]', 'a[href*="/news/"]', 'a[href*="/post/"]',
         ".article-link a", ".story-link a", ".news-item a", "article a", ".post-title a")
MIN_TITLE, MIN_CONTENT, MAX_AUTHOR, N_KEYWORDS = 10, 100, 100, 8

_STEP = r'^([a-zA-Z][\w-]*)?(?:\.([\w-]+))?(?:\[([\w-]+)(?:(\*?=)"([^"]*)")?\])?$'


def _pattern(step: Column) -> Column:
    """Pattern of a piece that starts with an opening tag of this kind."""
    tag, css, attr, op, value = (F.regexp_extract(step, _STEP, i) for i in range(1, 6))
    quoted = F.concat(F.lit(r"\Q"), value, F.lit(r"\E"))
    inside = F.concat(F.lit(r"(?<![\w-])"), css, F.lit(r"(?![\w-])"))
    of_class = F.concat(
        F.lit(r"""(?=[^>]*?\sclass\s*=\s*(?:"[^">]*?"""), inside, F.lit("|'[^'>]*?"), inside, F.lit("|"), css, F.lit(r"[\s>]))")
    )
    has = F.concat(F.lit(r"(?=[^>]*?\s"), attr, F.lit(r"\b)"))
    holds = F.concat(F.lit(r"(?=[^>]*?\s"), attr, F.lit(r"""\s*=\s*["']?[^"'>]*?"""), quoted, F.lit(")"))
    equals = F.concat(F.lit(r"(?=[^>]*?\s"), attr, F.lit(r"""\s*=\s*["']?"""), quoted, F.lit(r"""(?=["'\s>]))"""))
    return F.concat(
        F.lit("(?is)^<"),
        F.when(tag == "", r"[a-zA-Z][a-zA-Z0-9]*").otherwise(tag),
        F.lit(r"\b"),
        F.when(css == "", "").otherwise(of_class),
        F.when(attr == "", "").when(op == "", has).when(op == "*=", holds).otherwise(equals),
    )


def _steps(selector: Column) -> Column:
    return F.filter(F.split(F.trim(selector), r"\s+"), lambda x: x != "")


def is_selector(selector: Column) -> Column:
    """Whether a text is a selector: steps of a tag, class and attribute test, apart by blanks."""
    steps = _steps(selector)
    return (F.size(steps) > 0) & F.forall(steps, lambda x: x.rlike(_STEP))


def rule(selector: Column) -> Column:
    """A selector of any number of steps as data: names that must occur, and each step's tag and
    pattern. An element fits the last step inside one that fits the step before, and so on."""
    names = lambda x: F.array(F.regexp_extract(x, _STEP, 2), F.regexp_extract(x, _STEP, 3))
    return let(
        _steps(selector),
        lambda steps: F.struct(
            F.filter(F.transform(F.flatten(F.transform(steps, names)), F.lower), lambda n: n != "").alias("needs"),
            F.transform(
                steps, lambda x: F.struct(F.lower(F.regexp_extract(x, _STEP, 1)).alias("tag"), _pattern(x).alias("pattern"))
            ).alias("steps"),
        ),
    )


def _opening(step: str) -> tuple[list[str], str, str]:
    """Names, tag and pattern of one step, as ``rule`` has them."""
    tag, css, attr, op, value = (x or "" for x in re.match(_STEP, step).groups())
    inside = rf"(?<![\w-]){css}(?![\w-])"
    quoted = rf"\Q{value}\E"
    tests = {"": rf"(?=[^>]*?\s{attr}\b)", "*=": rf"""(?=[^>]*?\s{attr}\s*=\s*["']?[^"'>]*?{quoted})"""}
    equals = rf"""(?=[^>]*?\s{attr}\s*=\s*["']?{quoted}(?=["'\s>]))"""
    pattern = rf"(?is)^<{tag or '[a-zA-Z][a-zA-Z0-9]*'}\b"
    if css:
        pattern += rf"""(?=[^>]*?\sclass\s*=\s*(?:"[^">]*?{inside}|'[^'>]*?{inside}|{css}[\s>]))"""
    if attr:
        pattern += tests.get(op, equals)
    return [n.lower() for n in (css, attr) if n], tag.lower(), pattern


def rules(selectors: Sequence[str]) -> Column:
    """Selectors as data, in order: constants of the plan. An unsupported one raises."""
    out = []
    for s in selectors:
        if not s.split() or not all(re.match(_STEP, step) for step in s.split()):
            raise ValueError(f"unsupported selector: {s}")
        steps = [_opening(step) for step in s.split()]
        out.append(
            F.struct(
                F.array(*[F.lit(n) for names, _, _ in steps for n in names]).cast("array<string>").alias("needs"),
                F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(pattern).alias("pattern")) for _, tag, pattern in steps]).alias("steps"),
            )
        )
    return F.array(*out)


_SKIPPED = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
_TAG = r"""(?s)^</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def page(html: Column) -> Column:
    """A page cut before every tag: ``struct(low, pieces, names, ends)``.

    ``names`` holds each piece's tag name, with a slash for closing tags; ``low`` is
    all pieces up to their first ``>`` in lower case, for cheap tests of names in tags. Comments, scripts and styles are gone.
    The element that begins with a piece reaches up to the piece in ``ends``; an unclosed
    one to the page's end, and pieces that open none end with themselves.
    """
    # Most pages have nothing to leave out.
    some = lambda h: h.rlike(r"(?i)<(?:!--|script|style)")
    bare = let(F.coalesce(html, F.lit("")), lambda h: F.when(some(h), F.regexp_replace(h, _SKIPPED, "")).otherwise(h))
    heads = lambda x: F.array_join(F.transform(x, lambda p: F.substring_index(p, ">", 1)), ">")
    pieces = let(
        F.split(bare, "(?=</?[a-zA-Z])"), lambda x: F.struct(F.lower(heads(x)).alias("low"), x.alias("pieces"))
    )
    name = lambda p: F.lower(F.regexp_extract(p, r"^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1))
    named = let(
        pieces,
        lambda x: F.struct(
            x["low"].alias("low"),
            x["pieces"].alias("pieces"),
            F.transform(x["pieces"], name).alias("names"),
        ),
    )
    return let(
        named,
        lambda x: F.struct(
            x["low"].alias("low"), x["pieces"].alias("pieces"), x["names"].alias("names"), _ends(x["names"]).alias("ends")
        ),
    )


def _ends(names: Column) -> Column:
    """For each piece the index of the piece that ends its element.

    An element ends where as many elements of its tag are open again as before it. Sorted by tag
    and place, the p-th tag that is the q-th to open has ``2q - p`` more opened than closed before
    it, but for a number that is the same for the whole tag; and likewise after a closing one. So
    sorted by tag, level and place, an element's end is its neighbour.
    """

    def closes(n: Column) -> Column:
        return n.startswith("/")

    def plain(n: Column) -> Column:
        return (n == "") | n.isin(*_VOID)

    tags = F.transform(names, lambda n, i: F.struct(F.ltrim(n, F.lit("/")).alias("tag"), i.alias("i"), closes(n).alias("close"), plain(n).alias("plain")))
    ordered = F.sort_array(F.filter(tags, lambda t: ~t["plain"]))
    placed = F.transform(ordered, lambda t, p: F.struct(t["tag"].alias("tag"), t["i"].alias("i"), t["close"].alias("close"), p.alias("p")))

    def event(t: Column, level: Column) -> Column:
        return F.struct(t["tag"].alias("tag"), level.alias("level"), t["i"].alias("i"), t["close"].alias("close"))

    def matched(all_: Column) -> Column:
        opened = F.transform(F.filter(all_, lambda t: ~t["close"]), lambda t, q: event(t, 2 * q - t["p"]))
        closed = F.transform(F.filter(all_, lambda t: t["close"]), lambda t, r: event(t, t["p"] - 2 * r - 1))
        return let(F.sort_array(F.concat(opened, closed)), pairs)

    def pairs(events: Column) -> Column:
        def end(t: Column, k: Column) -> Column:
            following = F.get(events, k + 1)
            same = (following["tag"] == t["tag"]) & (following["level"] == t["level"]) & following["close"]
            stop = F.when(t["close"], t["i"]).when(F.coalesce(same, F.lit(False)), following["i"]).otherwise(F.size(names))
            return F.struct(t["i"].alias("i"), stop.alias("end"))

        alone = F.transform(F.filter(tags, lambda t: t["plain"]), lambda t: F.struct(t["i"].alias("i"), t["i"].alias("end")))
        return F.transform(F.sort_array(F.concat(F.transform(events, end), alone)), lambda x: x["end"])

    return let(placed, matched)


def _end(doc: Column, start: Column) -> Column:
    """Index of the piece behind the element that starts at ``start``."""
    return F.get(doc["ends"], start)


def _inside(doc: Column, starts: Column, skip: int = 0) -> Column:
    """Indexes of the pieces of these elements, from ``skip`` pieces behind their start on."""

    def places(i: Column) -> Column:
        last = _end(doc, i) - 1
        return F.when(last >= i + skip, F.sequence(i + skip, last)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(starts, places)))


def _starts(doc: Column, tag: Column, pattern: Column) -> Column:
    """Indexes of all pieces that open an element of this kind."""

    def opens(p: Column, i: Column) -> Column:
        name = F.get(doc["names"], i)
        named = F.when(tag == "", ~name.isin("") & ~name.startswith("/")).otherwise(name == tag)
        return F.when(named & F.regexp_substr(p, pattern).isNotNull(), i)

    return F.array_compact(F.transform(doc["pieces"], opens))


def _possible(doc: Column, rule: Column) -> Column:
    """The attribute and class names occur at all; this settles most selectors at once."""
    return F.forall(rule["needs"], lambda n: F.contains(doc["low"], n))


def _selected(doc: Column, rule: Column) -> Column:
    """Indexes of the elements a rule picks, in page order."""
    anywhere = F.lit(None).cast("array<int>")

    def narrower(within: Column, step: Column) -> Column:
        found = _starts(doc, step["tag"], step["pattern"])
        return F.when(within.isNull(), found).otherwise(F.array_intersect(found, _inside(doc, within, 1)))

    picked = F.aggregate(rule["steps"], anywhere, narrower)
    return F.when(_possible(doc, rule), picked).otherwise(F.array().cast("array<int>"))


def _firsts(doc: Column, rules: Column) -> Column:
    """Index of the first element of each rule that picks any."""
    return F.array_compact(F.transform(rules, lambda r: F.get(_selected(doc, r), F.lit(0))))


def _element_text(doc: Column, start: Column, drop: Column | None = None) -> Column:
    """Cleaned text of the element, without the pieces whose indexes are in ``drop``."""

    def inside(end: Column) -> Column:
        if drop is None:
            pieces = F.slice(doc["pieces"], start + 1, end - start)
        else:
            places = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
            pieces = F.transform(F.array_except(places, drop), lambda i: F.get(doc["pieces"], i))
        return F.array_join(F.transform(pieces, lambda p: F.regexp_replace(p, _TAG, "")), "")

    return clean_text(unescape(let(_end(doc, start), inside)))


# Elements removed from the content.
UNWANTED = (".advertisement", ".ad", ".social-share")


def first_text(doc: Column, rules: Column, usable, drop: Column | None = None) -> Column:
    """Text of the first selected element whose text is usable; NULL if none."""
    texts = F.transform(_firsts(doc, rules), lambda i: _element_text(doc, i, drop))
    return F.get(F.filter(texts, usable), F.lit(0))


def _attribute(piece: Column, name: str) -> Column:
    value = F.regexp_extract(piece, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return unescape(F.regexp_replace(value, r"""^["']|["']$""", ""))


def _content(doc: Column, wanted: Column) -> Column:
    unwanted = F.flatten(F.transform(rules(UNWANTED), lambda r: _selected(doc, r)))
    long_enough = lambda v: F.length(v) > MIN_CONTENT
    return let(_inside(doc, unwanted), lambda drop: first_text(doc, wanted, long_enough, drop))


def _published(doc: Column) -> Column:
    def stamp(i: Column) -> Column:
        piece = F.get(doc["pieces"], i)
        return first_filled(_attribute(piece, "datetime"), _attribute(piece, "pubdate"), _element_text(doc, i))

    dates = F.transform(_firsts(doc, rules(DATE)), lambda i: let(stamp(i), parse_date))
    return F.get(F.filter(dates, lambda v: v.isNotNull()), F.lit(0))


def _about(doc: Column) -> Column:
    metas = F.filter(doc["pieces"], lambda p: p.rlike("(?i)^<meta\\b"))

    def pick(m: Column) -> Column:
        named = [F.get(F.filter(m, _is_meta(key, value)), F.lit(0)) for key, value in SUMMARY]
        texts = F.transform(F.array_compact(F.array(*named)), lambda p: clean_text(_attribute(p, "content")))
        return F.get(F.filter(texts, lambda v: v != ""), F.lit(0))

    return let(metas, pick)


def _is_meta(key: str, value: str):
    pattern = rf"""(?is)\s{key}\s*=\s*["']?{re.escape(value)}["'\s>/]"""
    return lambda piece: piece.rlike(pattern)


def _page_fields(doc: Column, titles: Column, contents: Column) -> Column:
    return F.struct(
        first_text(doc, titles, lambda v: F.length(v) > MIN_TITLE).alias("title"),
        _content(doc, contents).alias("content"),
        first_text(doc, rules(AUTHOR), lambda v: (v != "") & (F.length(v) < MAX_AUTHOR)).alias("author"),
        _published(doc).alias("published"),
        _about(doc).alias("summary"),
    )


# Fields that a site may have selectors of its own for.
SITE_FIELDS = ("title", "content", "links")


def site_rules(table: DataFrame) -> DataFrame:
    """``site, fields``: a table of rows (site, field, priority, selector) as rules by field, lower
    priorities first.

    A site is a host without ``www.``. Rows whose selector or field is unknown are left out;
    ``bad_site_rules`` has them.
    """
    good = table.where(is_selector(F.col("selector")) & F.col("field").isin(*SITE_FIELDS))
    by_field = good.groupBy(F.lower("site").alias("site"), "field").agg(F.sort_array(F.collect_set(F.struct("priority", "selector"))).alias("s"))
    fields = by_field.select("site", "field", F.transform("s", lambda x: rule(x["selector"])).alias("rules"))
    return fields.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("field", "rules"))).alias("fields"))


def bad_site_rules(table: DataFrame) -> DataFrame:
    """Rows of a table of selectors that ``site_rules`` leaves out."""
    good = is_selector(F.col("selector")) & F.col("field").isin(*SITE_FIELDS)
    return table.where(~F.coalesce(good, F.lit(False)))


def _with_rules(pages: DataFrame, table: DataFrame | None, url: str) -> DataFrame:
    """Pages with the rules of their site (``_fields``); a site's rules are one row."""
    if table is None:
        return pages
    site = F.regexp_replace(F.lower(host(F.col(url))), r"^www\.", "")
    known = site_rules(table).select(F.col("site").alias("_site"), F.col("fields").alias("_fields"))
    return pages.withColumn("_site", site).join(known, "_site", "left").drop("_site")


def _own_first(table: DataFrame | None, field: str, selectors: Sequence[str]) -> Column:
    """The site's rules for a field, then the given ones."""
    given = rules(selectors)
    return given if table is None else F.concat(F.coalesce(F.try_element_at(F.col("_fields"), F.lit(field)), F.slice(given, 1, 0)), given)


def _usable(pages: DataFrame, html: str, titles: Sequence[str], contents: Sequence[str], sites: DataFrame | None) -> Column:
    """The fields of a page's article, in an array that is empty if title or content is missing."""

    def make() -> Column:
        own = F.struct(_own_first(sites, "title", titles).alias("t"), _own_first(sites, "content", contents).alias("c"))
        fields = let(own, lambda r: let(page(F.col(html)), lambda d: _page_fields(d, r["t"], r["c"])))
        return F.filter(F.array(fields), lambda x: x["title"].isNotNull() & x["content"].isNotNull())

    return built_once(pages, ("page", html, titles, contents, sites is None), make)


def usable_articles(pages: DataFrame, html: str = "html") -> Column:
    """The number of articles (0 or 1) that ``extract_articles`` makes of a page."""
    return F.size(_usable(pages, html, TITLE, CONTENT, None))


def extract_articles(
    pages: DataFrame,
    as_of: Column,
    *keep: str,
    title: Sequence[str] = (),
    content: Sequence[str] = (),
    sites: DataFrame | None = None,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """ARTICLE rows of landed pages; pages without a usable title or content are dropped.

    ``title`` and ``content`` are selectors tried before the usual ones; a table ``sites`` (see
    ``site_rules``) has those that a page's own site comes first with.
    All fields come out of one struct that is unpacked as a zero- or one-row table,
    so the drop test does not compute title and content a second time.
    """
    usable = _usable(pages, html, (*title, *TITLE), (*content, *CONTENT), sites)
    return _with_rules(pages, sites, url).select(*keep, F.col(url).alias("url"), F.inline(usable)).select(
        "title",
        "content",
        "url",
        source_name(F.col("url")).alias("source"),
        F.coalesce("published", as_of).alias("published_date"),
        as_of.alias("scraped_date"),
        "author",
        "summary",
        frequent_keywords(F.col("content"), N_KEYWORDS).alias("keywords"),
        F.lit(None).cast("string").alias("category"),
        F.lit("website").alias("source_type"),
        F.lit(None).cast(ARTICLE["sentiment"].dataType).alias("sentiment"),
        F.create_map(F.lit("scraped_with"), F.lit("landed")).alias("metadata"),
        *keep,
    )


def article_links(html: Column, base: Column, wanted: Column) -> Column:
    """Absolute article links of the first rule that yields any, first occurrence order."""

    def valid(doc: Column, rule: Column) -> Column:
        refs = F.transform(_selected(doc, rule), lambda i: _attribute(F.get(doc["pieces"], i), "href"))
        urls = F.transform(F.filter(refs, lambda u: u != ""), lambda u: resolve(base, u))
        return F.filter(urls, is_article_url)

    def first(doc: Column) -> Column:
        # A fold, so that selectors behind the first that yields links are not evaluated.
        none = F.array().cast("array<string>")
        return F.aggregate(
            wanted, none, lambda acc, r: F.when(F.size(acc) > 0, acc).otherwise(valid(doc, r))
        )

    return F.array_distinct(let(page(html), first))


def extract_links(
    pages: DataFrame, *keep: str, selectors: Sequence[str] = (), sites: DataFrame | None = None, url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per link: ``keep, base_url, pos, link``. Nothing leaves the page's row."""
    order = (*selectors, *LINKS)
    links = built_once(
        pages, ("links", html, url, order, sites is None), lambda: article_links(F.col(html), F.col(url), _own_first(sites, "links", order))
    )
    return _with_rules(pages, sites, url).select(*keep, F.col(url).alias("base_url"), F.posexplode(links).alias("pos", "link"))


def follow_links(listings: DataFrame, landed: DataFrame, as_of: Column, *keep: str) -> DataFrame:
    """Articles behind the links of listing pages, from the pages landed for them.

    A link is followed once however many listings show it, so a popular target
    does not pile up on one task. ``landed`` holds one row per URL.
    """
    links = extract_links(listings).select(F.col("link").alias("url")).distinct()
    return extract_articles(landed.join(links, "url", "left_semi"), as_of, *keep)
