"""Times: parsing, publish-time extraction, display and repair.

Every value is a UTC timestamp; ``as_of`` is always an argument, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .base import col, found, text_or_empty, trim_ws

LOCAL_ZONE = "Asia/Shanghai"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LIST_DATE = r"(20\d{2})[/\-.](\d{1,2})[/\-.](\d{1,2})"
ENGLISH_DATE = r"(\d{1,2})\s+([A-Za-z]+),?\s+(20\d{2})"
ISO = r"(20\d{2})-(\d{2})-(\d{2})[T ](\d{1,2}):(\d{2})(?::\d{2})?(Z|[+-]\d{2}:?\d{2})?"
DATE = r"(20\d{2})[年\-/.]\s*(\d{1,2})[月\-/.]\s*(\d{1,2})日?"
DATE_TIME = DATE + r"\s*(?:[\x{3000}\s]|$|,|，)(\d{1,2})[:：](\d{2})"
LABELLED_DATE = r"(?:发布\s*时间|时间|日期|成文日期)[:：]?\s*" + DATE


def parse_time(x: Column | str) -> Column:
    """Any common form with or without offset -> UTC; no offset means UTC; junk -> NULL."""
    s = trim_ws(col(x))
    mail = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{3,9},\s*", ""), r"\s+(GMT|UTC|UT|Z)$", " +0000")
    slashed = F.regexp_replace(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    return F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(s)),
        F.when(s.rlike(r"^\d{4}/"), F.try_to_timestamp(slashed)),
        F.when(s.rlike(r"^\d{4}\d{4}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd"))),
        F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"),
               F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))),
        F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}$"),
               F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss"))),
        F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy"))),
    )


def iso_text(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_day(x: Column | str) -> Column:
    """Midnight UTC of the written calendar day (the offset is dropped, not applied)."""
    s = trim_ws(col(x))
    written = F.regexp_replace(found(s, r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}"), "/", "-")
    return F.coalesce(F.try_to_timestamp(written), F.date_trunc("day", parse_time(s)))


def _day_text(y: Column, m: Column, d: Column) -> Column:
    month, day = m.cast("int"), d.cast("int")
    ok = (y != "") & month.between(1, 12) & day.between(1, 31)
    return F.when(ok, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def list_day(x: Column | str) -> Column:
    """First ``20yy-m-d`` like date of a text as 'yyyy-MM-dd'; NULL when out of range."""
    t = col(x)
    return _day_text(*(F.nullif(F.regexp_extract(t, LIST_DATE, i), F.lit("")) for i in (1, 2, 3)))


def list_item_day(html: Column | str) -> Column:
    """Date of a list entry: inline tags first, in order, then the whole text."""
    h = text_or_empty(html)
    tags = F.regexp_extract_all(
        h, F.lit(r"(?is)<(?:span|em|i|time)(?:\s[^>]*)?>(.*?)</(?:span|em|i|time)>"), F.lit(1))
    days = F.filter(F.transform(tags, lambda t: list_day(F.regexp_replace(t, "<[^>]+>", ""))),
                    lambda d: d.isNotNull())
    return F.coalesce(F.get(days, F.lit(0)), list_day(F.regexp_replace(h, "<[^>]+>", " ")))


def english_day(x: Column | str) -> Column:
    """'07 August 2026' -> midnight UTC; the month is known by its first three letters."""
    t = text_or_empty(x)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]),
                             F.substring(F.lower(F.regexp_extract(t, ENGLISH_DATE, 2)), 1, 3))
    written = F.when(month > 0, F.concat_ws("-", F.regexp_extract(t, ENGLISH_DATE, 3),
                                            F.lpad(month.cast("string"), 2, "0"),
                                            F.lpad(F.regexp_extract(t, ENGLISH_DATE, 1), 2, "0")))
    return F.try_to_timestamp(written, F.lit("yyyy-MM-dd"))


def publish_text(x: Column | str) -> Column:
    """Publish time written in a text, as local 'yyyy-MM-dd HH:mm' or 'yyyy-MM-dd'.

    Order: ISO (an offset moves it to local time, none keeps it), labelled date,
    date with clock, date alone.
    """
    t = text_or_empty(x)

    def part(p, i):
        return F.regexp_extract(t, p, i)

    clock_iso = F.concat(F.lpad(part(ISO, 4), 2, "0"), F.lit(":"), part(ISO, 5))
    day_iso = F.concat_ws("-", part(ISO, 1), part(ISO, 2), part(ISO, 3))
    offset = F.regexp_replace(part(ISO, 6), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    moved = F.from_utc_timestamp(
        F.try_to_timestamp(F.concat(day_iso, F.lit("T"), clock_iso, F.lit(":00"), offset)), LOCAL_ZONE)
    iso = F.when(~t.rlike(ISO), None).when(part(ISO, 6) == "", F.concat(day_iso, F.lit(" "), clock_iso)) \
           .otherwise(F.date_format(moved, "yyyy-MM-dd HH:mm"))

    def day(p):
        return _day_text(*(F.nullif(part(p, i), F.lit("")) for i in (1, 2, 3)))

    clock = F.concat(F.lpad(part(DATE_TIME, 4), 2, "0"), F.lit(":"), part(DATE_TIME, 5))
    has_clock = t.rlike(DATE_TIME)
    label_at, clock_at = F.regexp_instr(t, F.lit(LABELLED_DATE)), F.regexp_instr(t, F.lit(DATE_TIME))
    labelled = F.when(has_clock & (clock_at >= label_at), F.concat(day(LABELLED_DATE), F.lit(" "), clock)) \
                .otherwise(day(LABELLED_DATE))
    plain = (F.when(t.rlike(LABELLED_DATE), labelled)
             .when(has_clock, F.concat(day(DATE_TIME), F.lit(" "), clock))
             .otherwise(day(DATE)))
    return F.coalesce(iso, plain)


def local_to_utc(x: Column | str) -> Column:
    """Archived local text ('yyyy-MM-dd[ HH:mm]') -> UTC timestamp."""
    return F.to_utc_timestamp(F.try_to_timestamp(col(x)), LOCAL_ZONE)


def drop_future(local_text: Column | str, as_of: Column) -> Column:
    """NULL for a written publish time later than now (1 h slack; 1 day for a bare date)."""
    s = col(local_text)
    utc = local_to_utc(s)
    slack = F.when(F.char_length(s) > 10, as_of + F.expr("INTERVAL 1 HOUR")) \
             .otherwise(as_of + F.expr("INTERVAL 1 DAY"))
    return F.when(utc.isNotNull() & (utc <= slack), s)


def local_minute_text(ts: Column | str) -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), LOCAL_ZONE), "yyyy-MM-dd HH:mm")


def local_day(ts: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), LOCAL_ZONE))


def month_day(ts: Column | str) -> Column:
    return F.date_format(col(ts), "MM-dd")


def absolute_text(ts: Column | str) -> Column:
    """'2024年1月5日 上午9:07' in local time."""
    t = F.from_utc_timestamp(col(ts), LOCAL_ZONE)
    h = F.hour(t)
    half = F.when(h < 12, F.lit("上午")).otherwise(F.lit("下午"))
    h12 = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
    return F.concat(F.year(t).cast("string"), F.lit("年"), F.month(t).cast("string"), F.lit("月"),
                    F.dayofmonth(t).cast("string"), F.lit("日 "), half, h12.cast("string"), F.lit(":"),
                    F.date_format(t, "mm"))


def relative_text(ts: Column | str, as_of: Column) -> Column:
    t = col(ts)
    full = absolute_text(t)
    minutes = (F.unix_timestamp(as_of) - F.unix_timestamp(t)) / 60
    return (F.when(t.isNull(), F.lit("时间未知"))
            .when(minutes < 0, full)
            .when(minutes < 60, F.concat(F.floor(minutes).cast("string"), F.lit("分钟前 · "), full))
            .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("小时前 · "), full))
            .otherwise(full))


def shift_back_if_future(local_ts: Column | str, first_seen: Column | str) -> Column:
    """Repair a local time stored some multiples of 8 h too late (at most four)."""
    p, seen = col(local_ts), col(first_seen)
    late = F.unix_timestamp(F.to_utc_timestamp(p, LOCAL_ZONE)) - F.unix_timestamp(seen)
    steps = F.least(F.lit(4), F.ceil(late / (8 * 3600))).cast("int")
    return F.when(late > 0, p - F.make_interval(hours=steps * 8)).otherwise(p)
