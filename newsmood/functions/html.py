"""HTML column expressions: character references and tags."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsmood.functions.text import collapse, let, or_empty

#: A reference as HTML 5 reads it, the text up to the next one, or a lone ampersand.
_PIECES = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"

#: Names that count without a semicolon, too, and so as the start of a longer word.
_BARE = {name: text for name, text in html5.items() if not name.endswith(";")}
_LONGEST = max(map(len, _BARE))


def _control_characters() -> dict[str, str]:
    """Codes 128 to 159 stand for the characters of Windows-1252; 0 is the replacement character."""
    out = {"0": "�"}
    for code in range(0x80, 0xA0):
        try:
            out[str(code)] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            out[str(code)] = chr(code)
    return out


def _constant(table: dict[str, str]) -> Column:
    """A map that the optimizer folds into one literal."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _numeric(piece: Column) -> Column:
    hexadecimal = piece.rlike("^&#[xX]")
    digits = F.regexp_extract(piece, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
    first = F.when(digits == "", "0").otherwise(F.substring(digits, 1, 7))
    code = F.when(hexadecimal, F.conv(first, 16, 10)).otherwise(F.conv(first, 10, 10)).cast("int")
    # Seven digits hold every code point in either base; longer numbers are none.
    code = F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(code)
    # chr() stops at 255, so characters come from their UTF-32 bytes.
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    gone = (
        code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
        | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    wrong = code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return (
        F.when(wrong, F.lit("�"))
        .when((code == 0) | code.between(0x80, 0x9F), F.try_element_at(_constant(_control_characters()), code.cast("string")))
        .when(gone, F.lit(""))
        .otherwise(char)
    )


def _named(piece: Column) -> Column:
    name = F.substring(piece, 2, 40)
    start = lambda n: F.substring(name, 1, n)
    known = [F.try_element_at(_constant(html5), name)]
    for n in range(_LONGEST, 1, -1):
        text = F.try_element_at(_constant(_BARE), start(n))
        known.append(F.when(F.length(name) > n, F.concat(text, F.substring(name, n + 1, 40))))
    return F.coalesce(*known, piece)


def unescape(c: Column) -> Column:
    """Decode every character reference as HTML 5 does: all names, with or without a semicolon,
    and numbers. Numbers that are no character become the replacement character or nothing, so
    no reference fails."""

    def decoded(text: Column) -> Column:
        pieces = F.transform(
            F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)),
            lambda p: F.when(~F.startswith(p, F.lit("&")) | (p == "&"), p)
            .when(p == "&amp;", "&")
            .when(p == "&lt;", "<")
            .when(p == "&gt;", ">")
            .when(F.startswith(p, F.lit("&#")), _numeric(p))
            .otherwise(_named(p)),
        )
        return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)

    return let(or_empty(c), decoded)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def clean_html(c: Column) -> Column:
    """Tags to nothing (words join up, script bodies stay), references decoded, blanks collapsed."""
    return collapse(unescape(strip_tags(or_empty(c))))
