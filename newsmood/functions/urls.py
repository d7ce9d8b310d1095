"""URL column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmood.functions.text import capitalize, or_empty

# URLs that are not articles (matched without regard to case).
NOT_ARTICLE = (
    r"(?i)/tag/|/category/|/author/|/page/|/search/|/archive/|/contact/|/about/"
    r"|\.pdf$|\.jpg$|\.png$|\.gif$|#|mailto:|javascript:"
)


def host(url: Column) -> Column:
    """Lower-cased authority of an absolute URL, '' when there is none."""
    return F.lower(F.regexp_extract(or_empty(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def source_name(url: Column, kind: str = "website") -> Column:
    """First label of the host without ``www.`` (feeds: also ``feeds.``, ``rss.``)."""
    h = F.replace(host(url), F.lit("www."), F.lit(""))
    if kind == "rss":
        for prefix in ("feeds.", "rss."):
            h = F.replace(h, F.lit(prefix), F.lit(""))
    return capitalize(F.split_part(h, F.lit("."), F.lit(1)))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on the page ``base``, dot segments removed."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(page, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), "[^/]*$", "")
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_replace(href, r"^[^?#]*", "")
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), path)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .when(href.startswith("/"), F.concat(root, _without_dots(path), rest))
        .otherwise(F.concat(root, _without_dots(F.regexp_replace(joined, "/{2,}", "/")), rest))
    )


def _without_dots(path: Column) -> Column:
    """An absolute path with ``.`` and ``..`` segments worked off from the left."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.lit(1), F.size(done) - 1))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.array_append(done, part))

    walked = F.array_join(F.aggregate(parts, none, step), "/")
    closed = F.when(path.rlike(r"/\.{1,2}$"), F.concat(walked, F.lit("/"))).otherwise(walked)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), closed).otherwise(path)


def is_article_url(url: Column) -> Column:
    return ~url.rlike(NOT_ARTICLE)
