"""Text column expressions with Unicode-aware whitespace and word rules.

The regex shorthands differ between engines (``\\s`` is ASCII in Java), so
whitespace is spelled out as a class that holds exactly the characters a
Unicode-aware ``split`` treats as blank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
NOT_WS = "[^" + WS[1:]
WS_CHARS = (
    "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]))
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "".join(map(chr, [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
)

# Phrases removed from scraped text, in this order.
BOILERPLATE = (
    "Advertisement",
    "Click here",
    "Read more",
    "Subscribe",
    "Sign up",
    "Continue reading",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    An expression named twice, or once inside a lambda, is otherwise computed
    again for every use, which makes nested array functions quadratic.
    """
    # A lambda of one parameter: a second one, even optional, would receive the index.
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither NULL nor ''; NULL when there is none."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of whitespace to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    """Whitespace tokens; an empty array for blank text."""
    return F.filter(F.split(or_empty(c), f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(or_empty(c), F.lit(f"{NOT_WS}+"))


def reading_minutes(n_words: Column) -> Column:
    """Whole minutes at 200 words per minute, at least one."""
    return F.greatest(F.lit(1), F.floor(n_words / 200).cast("int"))


def clean_text(c: Column) -> Column:
    """Collapse whitespace, then delete the boilerplate phrases (case-sensitive)."""
    out = collapse(or_empty(c))
    for phrase in BOILERPLATE:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return F.trim(out)


# What counts as a URL, an e-mail address and a phone number.
URL_PATTERN = r"https?://[!$-_a-z]+"
EMAIL_PATTERN = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERN = r"(?:\+?1[-.%s]?)?\(?[0-9]{3}\)?[-.%s]?[0-9]{3}[-.%s]?[0-9]{4}" % (
    (WS[1:-1],) * 3
)


def scrub(
    c: Column,
    urls: bool = True,
    emails: bool = True,
    phones: bool = True,
    whitespace: bool = True,
) -> Column:
    """Remove URLs, then e-mail addresses, then phone numbers, then extra blanks."""
    out = or_empty(c)
    if urls:
        out = F.regexp_replace(out, URL_PATTERN, "")
    if emails:
        # The pattern can only match around an '@', which few texts hold.
        out = F.when(F.contains(out, F.lit("@")), F.regexp_replace(out, EMAIL_PATTERN, "")).otherwise(out)
    if phones:
        out = F.regexp_replace(out, PHONE_PATTERN, "")
    return collapse(out) if whitespace else out


def analysis_words(title: Column, content: Column, limit: int | None = None) -> Column:
    """Words a scorer sees: ``title. content``, all tokens or the first ``limit``."""
    text = F.concat(or_empty(title), F.lit(". "), or_empty(content))
    if limit is None:
        return words(text)
    # Splitting stops behind the last word needed: one part more for a blank at the
    # start, and one that holds the rest of the text.
    parts = F.split(text, f"{WS}+", limit + 2)
    return F.slice(F.filter(parts, lambda w: w != ""), 1, limit)


def analysis_text(title: Column, content: Column, limit: int | None = None) -> Column:
    if limit is None:  # the words joined by blanks, without an array of them
        return collapse(F.concat(or_empty(title), F.lit(". "), or_empty(content)))
    return F.array_join(analysis_words(title, content, limit), " ")


def sentences(c: Column) -> Column:
    """Text between runs of ``.``, ``!`` and ``?``, stripped, blanks dropped."""
    return F.filter(
        F.transform(F.split(or_empty(c), "[.!?]+"), strip), lambda s: s != ""
    )


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))
