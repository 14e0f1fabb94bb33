"""Small helpers used by every function module."""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

# Whitespace that feeds really contain: ASCII, no-break and ideographic space.
WS = r"[\s\x{a0}\x{3000}]"
_META = set("\\.^$|?*+()[]{}-/&")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def escape(word: str) -> str:
    """Quote regular-expression signs in a way Java and RE2 both read."""
    return "".join("\\" + ch if ch in _META and ch not in "-/&" else ch for ch in word)


def any_of(words) -> str:
    """One alternation for a word list: compiled once per task."""
    return "(?:" + "|".join(escape(w) for w in words) + ")"


def trim_ws(x: Column | str) -> Column:
    return F.regexp_replace(col(x), rf"^{WS}+|{WS}+$", "")


def collapse_ws(x: Column | str) -> Column:
    return trim_ws(F.regexp_replace(col(x), rf"{WS}+", " "))


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def null_if_empty(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(""))


def found(x: Column | str, pattern: str, group: int = 0) -> Column:
    """``regexp_extract`` that gives NULL, not '', when nothing matches."""
    return null_if_empty(F.regexp_extract(col(x), pattern, group))


def chars(x: Column | str) -> Column:
    return F.char_length(col(x))


def let(x: Column, body) -> Column:
    """Name a costly expression once: ``body`` gets it as a variable, so trees stay small."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def built_once(fn):
    """Build a large expression over named columns once per application.

    Calls with other arguments than names and fixed packs are built afresh.
    """
    known: dict = {}

    @wraps(fn)
    def build(*args, **kwargs):
        given = (*args, *kwargs.values())
        if any(isinstance(a, Column) for a in given):
            return fn(*args, **kwargs)
        app = SparkContext._active_spark_context
        key = (id(app), tuple(a if isinstance(a, (str, bool, int, type(None))) else id(a) for a in args),
               tuple((k, v if isinstance(v, (str, bool, int, type(None))) else id(v)) for k, v in kwargs.items()))
        if key not in known:
            known[key] = (fn(*args, **kwargs), app, args, kwargs)  # keeps the arguments alive, so ids stay unique
        return known[key][0]
    return build
