"""Date strings to timestamps, without a silent "now" for bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmood.functions.text import let

# The zone names of RFC 822 and their offsets.
ZONES = {
    "UTC": "+0000", "GMT": "+0000", "UT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}

# Tried in order after weekday and zone name are normalised.
FORMATS = tuple(
    f"{day}{time}"
    for day in ("d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy", "yyyy/M/d")
    for time in (" HH:mm:ss Z", " HH:mm Z", " HH:mm:ss", " HH:mm", " h:mm:ss a", " h:mm a", "")
)
_COMPACT = r"^(\d{4})(\d{2})(\d{2})T?(\d{2})?(\d{2})?(\d{2})?Z?$"


def parse_iso(c: Column) -> Column:
    """ISO-8601 with or without offset or ``Z``; NULL when it is anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(c))


def _compact(c: Column) -> Column:
    """Digits alone, ``yyyyMMdd`` with or without a time of day."""
    part = lambda n: F.regexp_extract(c, _COMPACT, n)
    clock = lambda n: F.when(part(n) == "", "00").otherwise(part(n))
    day = F.concat_ws("-", part(1), part(2), part(3))
    return F.when(c.rlike(_COMPACT), F.try_to_timestamp(F.concat(day, F.lit(" "), F.concat_ws(":", clock(4), clock(5), clock(6)))))


def _normal(c: Column) -> Column:
    """Without weekday and doubled blanks, zone names as offsets, AM and PM set apart."""
    s = F.regexp_replace(c, r"^[A-Za-z]{3,9},\s*", "")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"(?i)(\d) ?([ap])\.?m\.?$", "$1 $2M")
    zone = F.regexp_extract(s, r"[\d ]([A-Z]{1,3})$", 1)
    offset = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    bare = F.regexp_replace(s, " ?[A-Z]{1,3}$", " ")
    s = F.when(F.map_contains_key(offset, zone), F.concat(bare, F.try_element_at(offset, zone))).otherwise(s)
    return F.regexp_replace(s, r"([+-]\d{2}):(\d{2})$", "$1$2")


def parsed_date(c: Column) -> Column:
    """The date a text means, NULL if it means none."""
    s = F.trim(c)
    none = F.lit(None).cast("timestamp")
    formats = F.array(*[F.lit(f) for f in FORMATS])
    # A fold keeps the generated code small; coalesce stops at the first format that fits.
    named = let(_normal(s), lambda n: F.aggregate(formats, none, lambda t, f: F.coalesce(t, F.try_to_timestamp(n, f))))
    return F.coalesce(parse_iso(s), _compact(s), named)


def parse_date(c: Column, as_of: Column | None = None) -> Column:
    """Free-form date; ``as_of`` (a job parameter) replaces what cannot be parsed."""
    return F.coalesce(parsed_date(c), *([as_of] if as_of is not None else []))


def is_date(c: Column) -> Column:
    """Whether a text means a date, so that a substituted one can be told from a true one."""
    return parsed_date(c).isNotNull()


def iso_text(c: Column) -> Column:
    """ISO text as written by the exports; fractions only when there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("second", c) == c, whole).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
