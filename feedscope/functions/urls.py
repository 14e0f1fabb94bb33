"""URL normalisation, item ids and link tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..plans import fixed_values as V
from .base import any_of, col, let, text_or_empty, trim_ws

_HIER = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
_HIER_NO_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:;[^/]*)?(?:[?#].*)?$"
_OPAQUE = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?!//)([^?#]*).*$"


def _resolve_dots(path: Column) -> Column:
    """Remove '.' and '..' segments; only paths that hold one pay for it."""
    def clean(p):
        kept = F.aggregate(
            F.split(p, "/"), F.array().cast("array<string>"),
            lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
            .when(seg == ".", acc).otherwise(F.array_append(acc, seg)))
        tail = F.when(p.rlike(r"/\.\.?$"), "/").otherwise("")
        return F.when(p.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), tail)).otherwise(p)
    return let(path, clean)


def normalize_url(url: Column | str) -> Column:
    """Drop query, fragment and path parameters and end slashes.

    Text without a scheme is only trimmed.  A URL whose path is empty keeps its
    query, because there is no path to rebuild it from.
    """
    def clean(raw):
        path = F.regexp_replace(F.regexp_extract(raw, _HIER, 3), r";[^/]*$", "")
        rebuilt = F.concat(F.lower(F.regexp_extract(raw, _HIER, 1)), F.lit("://"),
                           F.regexp_extract(raw, _HIER, 2), _resolve_dots(path))
        return (F.when(raw.rlike(_HIER_NO_PATH), F.rtrim(raw, F.lit("/")))
                .when(raw.rlike(_HIER), F.rtrim(rebuilt, F.lit("/")))
                .when(raw.rlike(_OPAQUE), F.rtrim(F.regexp_extract(raw, _OPAQUE, 1), F.lit("/")))
                .otherwise(raw))
    return let(trim_ws(text_or_empty(url)), clean)


def item_id(site: Column | str, title: Column | str, url: Column | str) -> Column:
    return F.sha1(F.concat_ws("||", text_or_empty(site), text_or_empty(title),
                              normalize_url(url)).cast("binary"))


def is_junk_link(text: Column | str, href: Column | str) -> Column:
    """Navigation, footer or account link rather than content."""
    label, target = trim_ws(text_or_empty(text)), F.lower(text_or_empty(href))
    return ((target == "") | (F.char_length(label) < 6)
            | label.rlike(any_of(V.LINK_JUNK_TEXT)) | target.rlike(any_of(V.LINK_JUNK_URL)))


def has_allowed_path(href: Column | str, patterns) -> Column:
    return text_or_empty(href).rlike(any_of(patterns))


def resolve_href(href: Column | str, base: Column | str) -> Column:
    """Absolute form of a link found on the page at ``base``."""
    def join(h):
        b = col(base)
        scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
        host = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
        folder = F.regexp_replace(F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
        relative = let(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), h),
                       lambda j: F.concat(_resolve_dots(F.regexp_extract(j, r"^([^?#]*)", 1)),
                                          F.regexp_extract(j, r"^[^?#]*(.*)$", 1)))
        return (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
                .when(h.startswith("//"), F.concat(scheme, h))
                .when(h.startswith("/"), F.concat(host, h))
                .when(h == "", b)
                .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h))
                .otherwise(F.concat(host, relative)))
    return let(trim_ws(col(href)), join)
