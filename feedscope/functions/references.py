"""Character references of HTML, resolved in one pass on the JVM side.

A text is split at its ampersands; each piece is looked at once, so a resolved ``&amp;`` never makes another reference.
Names come from the HTML 5 table of the standard library.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column, functions as F

from .base import let, text_or_empty

#: Names that feeds use most, looked up before the whole table.
COMMON = ("amp;", "quot;", "apos;", "lt;", "gt;", "nbsp;", "ldquo;", "rdquo;", "lsquo;", "rsquo;", "ndash;", "mdash;", "hellip;", "middot;")
#: Names that count without a semicolon, so also with letters behind them; the longest has so many letters.
BARE = {n: c for n, c in html5.items() if not n.endswith(";")}
LONGEST_BARE = max(map(len, BARE))
NAME = r"^[^\t\n\f <&#;]{1,32};?"
NUMBER = r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?"


def _table(names: dict[str, str]) -> Column:
    """A literal map; Spark folds it once."""
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


@lru_cache
def legacy_codes() -> dict[int, str]:
    """Numbers that stand for another character: the Windows letters at 0x80 to 0x9f, zero, and return for itself."""
    found = {0: "�", 13: "\r"}
    for code in range(0x80, 0xA0):
        try:
            found[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            found[code] = chr(code)
    return found


def character(code: Column) -> Column:
    """Character of a code point, by its UTF-16 bytes; numbers that are none give U+FFFD, or nothing for control codes."""
    low = F.lpad(F.hex(code), 4, "0")
    rest = code - 0x10000
    pair = F.concat(F.hex(F.lit(0xD800) + F.shiftright(rest, 10)), F.hex(F.lit(0xDC00) + rest.bitwiseAND(F.lit(0x3FF))))
    legacy = F.element_at(_table({str(k): v for k, v in legacy_codes().items()}), code.cast("string"))
    silent = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
              | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    return (F.when((code == 0) | (code == 13) | code.between(0x80, 0x9F), legacy)
            .when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "�").when(silent, "")
            .otherwise(F.decode(F.unhex(F.when(code < 0x10000, low).otherwise(pair)), "UTF-16BE")))


def _number(digits: Column) -> Column:
    """The number behind ``#``; more than nine digits are too many for any character."""
    hexadecimal = digits.rlike("^[xX]")
    bare = F.regexp_replace(digits, "^[xX]?0*(?=.)", "")
    long = F.char_length(bare) > 9
    value = F.when(hexadecimal, F.conv(bare, 16, 10)).otherwise(bare)
    return F.when(long, F.lit(0x110000)).otherwise(value.cast("long"))


def _piece(p: Column) -> Column:
    """What a piece behind an ampersand stands for."""
    def named(name):
        whole = F.coalesce(F.element_at(_table({n: html5[n] for n in COMMON}), name), F.element_at(_table(html5), name))
        lengths = F.sequence(F.least(F.char_length(name) - 1, F.lit(LONGEST_BARE)), F.lit(2), F.lit(-1))
        fits = F.when(F.char_length(name) > 2, F.get(F.filter(F.transform(lengths, lambda k: F.struct(
            k.alias("k"), F.element_at(_table(BARE), F.left(name, k)).alias("c"))), lambda x: x["c"].isNotNull()), F.lit(0)))
        after = F.substring(p, F.char_length(name) + 1, F.char_length(p))
        partly = let(fits, lambda x: F.when(x.isNotNull(), F.concat(x["c"], F.substring(p, x["k"] + 1, F.char_length(p)))))
        return let(whole, lambda w: F.when(w.isNotNull(), F.concat(w, after)).otherwise(F.coalesce(partly, F.concat(F.lit("&"), p))))
    number = F.regexp_extract(p, NUMBER, 0)
    digits = F.regexp_replace(number, "[#;]", "")
    return (F.when(number != "", F.concat(let(_number(digits), character), F.substring(p, F.char_length(number) + 1, F.char_length(p))))
            .when(p.rlike(NAME), let(F.regexp_extract(p, NAME, 0), named)).otherwise(F.concat(F.lit("&"), p)))


def unescape(x: Column | str) -> Column:
    """The text with all character references resolved, as HTML 5 says; null gives an empty text."""
    def resolve(t):
        pieces = F.split(t, "&", -1)
        rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _piece)
        return F.when(t.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))).otherwise(t)
    return let(text_or_empty(x), resolve)
