"""Title keys, source-suffix removal and title tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as D

from ..plans import fixed_values as V
from .base import any_of, built_once, chars, col, collapse_ws, let, text_or_empty, trim_ws
from .references import unescape

KEY_NOISE = r"[\s\x{a0}\x{3000}\-_—–()（）【】\[\]「」『』・,，.。:：;；/\\|]"
SIMILARITY_NOISE = r"[\s\x{a0}\x{3000}\-—–|｜_【】\[\]（）()《》〈〉<>「」『』\"'“”‘’.,，。:：;；!！?？、…]"
_ACRONYM = r"^[A-Z][A-Z0-9]{1,8}$"
_DOMAIN = r"(?i)\.(gov|com|org|net|in|eu|go\.jp)([^A-Za-z0-9_]|$)"


@built_once
def title_key(title: Column | str, most_chars: int | None = None) -> Column:
    """Lower case, no spaces or punctuation; the first ``most_chars`` characters of that where a number is given."""
    key = F.regexp_replace(F.lower(text_or_empty(title)), KEY_NOISE, "")
    return F.substring(key, 1, most_chars) if most_chars else key


def strip_feed_source(title: Column | str, source: Column | str) -> Column:
    """Drop ' - source': the named source, else a short tail that looks like an institution."""
    t = trim_ws(text_or_empty(title))
    head = F.regexp_extract(t, r"(?s)^(.*) - (.*)$", 1)
    tail = trim_ws(F.regexp_extract(t, r"(?s)^(.*) - (.*)$", 2))
    name = trim_ws(text_or_empty(source))
    named = (name != "") & (F.lower(tail) == F.lower(name))
    looks = (F.char_length(tail) <= 70) & tail.rlike(V.FEED_SOURCE_TAIL)
    return F.when(t.contains(" - ") & (named | looks), trim_ws(head)).otherwise(t)


def is_publisher(x: Column | str, names: str = V.PUBLISHER_NAMES) -> Column:
    """Short text that is an acronym, holds a domain, or a known name with a capital start."""
    s = trim_ws(text_or_empty(x))
    first = F.substring(s, 1, 1)
    return ((s != "") & (F.char_length(s) <= 30)
            & (s.rlike(_ACRONYM) | s.rlike(_DOMAIN)
               | ((first != F.lower(first)) & F.lower(s).rlike(names))))


def _is_site_tail(tail: Column) -> Column:
    return (F.char_length(tail) <= 25) & tail.rlike(V.CJK_SITE_TAIL)


@built_once
def strip_title_suffix(title: Column | str, decoded: Column | None = None) -> Column:
    """Remove source and section tails from a title, all of them, separator by separator."""
    raw = decoded if decoded is not None else unescape(trim_ws(text_or_empty(title)))

    def cut(t):  # the full-width mark is looked for first
        return (F.when(t.contains("摘要："), trim_ws(F.substring_index(t, "摘要：", 1)))
                .when(t.contains("摘要:"), trim_ws(F.substring_index(t, "摘要:", 1))).otherwise(t))

    def step(acc, sep):
        tail = F.call_function("substring_index", acc, sep, F.lit(-1))
        head = F.left(acc, F.char_length(acc) - F.char_length(tail) - F.char_length(sep))
        s = trim_ws(tail)
        drop = acc.contains(sep) & (s != "") & (_is_site_tail(s) | is_publisher(s)
                                                | F.lower(s).isin(V.TAIL_WORDS))
        return F.when(drop, trim_ws(head)).otherwise(acc)

    def strip(t):
        # every separator is tried as often as it could occur, so the result is a fixpoint
        tries = F.flatten(F.array(*[F.array_repeat(F.lit(s), _occurrences(t, s) * 2)
                                    for s in V.TITLE_SEPARATORS]))
        return F.when(t.rlike(any_of(V.TITLE_SEPARATORS)), F.aggregate(tries, t, step)).otherwise(t)

    return let(raw, lambda r: let(cut(r), strip))


def _occurrences(t: Column, s: str) -> Column:
    gone = F.char_length(F.replace(t, F.lit(s), F.lit("")))
    return ((F.char_length(t) - gone) / len(s)).cast("int")


def is_nav_title(title: Column | str) -> Column:
    return trim_ws(text_or_empty(title)).rlike("(?i)^(?:" + "|".join(V.NAV_TITLES) + r")\s*$")


@built_once
def clean_page_title(raw: Column | str, most_chars: int | None = None) -> Column:
    """Title of a page: one blank, no label, at most one site tail gone; its first ``most_chars`` characters, by default all."""
    base = F.regexp_replace(collapse_ws(text_or_empty(raw)), r"(?i)^(?:title|标题|题名|文章标题)\s*[:：]\s*", "")

    def tail(t, sep):
        return F.call_function("substring_index", t, sep, F.lit(-1))

    def is_cut(t, sep):
        s = trim_ws(tail(t, sep))
        return t.contains(sep) & (s != "") & (_is_site_tail(s) | is_publisher(s, V.PAGE_PUBLISHER_NAMES))

    def strip(t):
        # the first separator, in list order, behind which a site name stands
        sep = F.get(F.filter(F.array(*[F.lit(x) for x in V.PAGE_TITLE_SEPARATORS]), lambda x: is_cut(t, x)), F.lit(0))
        head = F.left(t, F.char_length(t) - F.char_length(tail(t, sep)) - F.char_length(sep))
        out = F.when(sep.isNotNull(), trim_ws(head)).otherwise(t)
        return F.nullif(F.substring(out, 1, most_chars) if most_chars else out, F.lit(""))

    return let(base, strip)


@built_once
def is_generic_title(raw: Column | str) -> Column:
    t = trim_ws(text_or_empty(raw))
    return (t == "") | t.rlike("(?i)" + V.GENERIC_TITLES)


@built_once
def clean_digest_title(title: Column | str) -> Column:
    t = F.substring_index(collapse_ws(text_or_empty(title)), "摘要：", 1)
    t = F.regexp_replace(trim_ws(t), r"[\x{4e00}-\x{9fff}]{0,6}(小编|编辑)\s*[^\x{4e00}-\x{9fff}]*\d*[天小时分]?前\s*$", "")
    return trim_ws(F.regexp_replace(t, r"\s*[-–—]\s*[^，。；！？、\s]{2,24}$", ""))


def display_title(title: Column | str, translated: Column | str) -> Column:
    return F.coalesce(F.nullif(col(translated), F.lit("")), col(title))


def strip_fixed_suffix(title: Column | str, suffixes=tuple(V.FIXED_SUFFIXES)) -> Column:
    t = col(title)
    cuts = [F.when(t.endswith(s), trim_ws(F.left(t, F.char_length(t) - len(s)))) for s in suffixes]
    return F.coalesce(*cuts, t)


def strip_agency_tails(title: Column | str) -> Column:
    """Remove agency tails until none is left: one anchored, repeated alternation."""
    tails = "|".join(rf"\s*{p}\s*" for p in V.AGENCY_TAILS)
    return trim_ws(F.regexp_replace(trim_ws(text_or_empty(title)), rf"(?:{tails})+$", ""))


@built_once
def is_corpus_nav(title: Column | str) -> Column:
    t = F.lower(trim_ws(text_or_empty(title)))
    return (F.char_length(t) < 4) | t.isin(V.CORPUS_NAV_EXACT) | t.rlike("|".join(V.CORPUS_NAV_PATTERNS))


def is_static_page(title: Column | str) -> Column:
    return F.lower(trim_ws(text_or_empty(title))).isin(V.STATIC_PAGES)


def is_short_title(title: Column | str, limit: int = 30) -> Column:
    """Candidate for a fuller title: short, or not long and ending like a site name."""
    t = trim_ws(text_or_empty(title))
    return (chars(t) < limit) | (t.rlike("(网|官网|委员会|政府|部|中心|门户)$") & (chars(t) < 60))


def is_suspicious_title(title: Column | str, site_name: Column | str) -> Column:
    t, s = text_or_empty(title), text_or_empty(site_name)
    return (t != "") & (((s != "") & t.startswith(s)) | t.rlike(V.SUSPICIOUS_TITLES))


def similarity_form(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(text_or_empty(x), SIMILARITY_NOISE, ""))


def is_contained(a: Column | str, b: Column | str) -> Column:
    """The cheap, exact part of the similarity: one normal form holds the other."""
    na, nb = similarity_form(a), similarity_form(b)
    return (na != "") & (nb != "") & (na.contains(nb) | nb.contains(na))


@F.pandas_udf(D.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher
    return pd.Series([0.0 if not x or not y else SequenceMatcher(None, x, y).ratio()
                      for x, y in zip(a, b)], dtype="float64")


def title_similarity(a: Column | str, b: Column | str, contained_is_one: bool = True) -> Column:
    """0..1 matching-blocks ratio of the normal forms; use it on joined pairs only.

    Pairs that containment settles hand the Python side empty texts.
    """
    na, nb = similarity_form(a), similarity_form(b)
    if not contained_is_one:
        return _ratio(na, nb)
    settled = is_contained(a, b)
    left, right = F.when(settled, F.lit("")).otherwise(na), F.when(settled, F.lit("")).otherwise(nb)
    return F.when(settled, F.lit(1.0)).otherwise(_ratio(left, right))
