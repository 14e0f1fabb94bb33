"""Queries over the text, title, URL and time functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import base as B, pages as P, references as R, text as X, times as TM, titles as T, urls as U
from ..plans import fixed_values as V
from ..sources.listing import ListRule, listing_links
from .base import AS_OF_SQL, query, quoted

WS = r"[\s\x{a0}\x{3000}]"


def trim_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze_sql(e: str) -> str:
    return trim_sql(f"regexp_replace({e}, '{WS}+', ' ', 'g')")


URL_FORMS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat(url, ';v=1')
  WHEN 2 THEN concat('  ', url, '/') WHEN 3 THEN concat(split_part(url, '/', 1), '//', split_part(url, '/', 3), '?x=1')
  WHEN 4 THEN substring(url, instr(url, '//') + 2, 500) ELSE concat('mailto:', url) END AS raw FROM {pages}"""


# only the forms both sides spell alike go through the twin: dots in paths have unit tests
@query("url_normalize", rf"""
WITH f AS ({URL_FORMS.replace("{pages}", "pages")}),
s AS (SELECT page_id, raw, trim(raw) AS r FROM f),
p AS (SELECT *, regexp_extract(r, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(r, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS host FROM s)
SELECT page_id, raw, CASE WHEN host <> '' AND path = '' THEN rtrim(r, '/')
  WHEN host <> '' THEN rtrim(concat(host, regexp_replace(path, ';[^/]*$', '')), '/')
  WHEN r LIKE 'mailto:%' THEN rtrim(regexp_replace(substring(r, 8), '[?#].*$', ''), '/')
  ELSE r END AS url FROM p""")
def url_normalize(d):
    return d.sql(URL_FORMS).withColumn("url", U.normalize_url("raw"))


@query("item_ids", r"""SELECT id, sha1(concat_ws('||', site_id, title, rtrim(regexp_replace(url, '[?#].*$', ''), '/'))) AS item_id
FROM articles""")
def item_ids(d):
    return d.articles().select("id", U.item_id("site_id", "title", "url").alias("item_id"))


KEY_SQL = r"""regexp_replace(lower(title), '[\s\x{a0}\x{3000}\-_—–()（）【】\[\]「」『』・,，.。:：;；/\\|]', '', 'g')"""


@query("title_keys", f"SELECT id, {KEY_SQL} AS title_key FROM items")
def title_keys(d):
    return d.items().select("id", T.title_key("title").alias("title_key"))


TIME_FORMS = """SELECT id, CASE id % 8
  WHEN 0 THEN {iso} WHEN 1 THEN {iso} || 'Z' WHEN 2 THEN {iso} || '+08:00' WHEN 3 THEN {day}
  WHEN 4 THEN {rfc} || ' +0000' WHEN 5 THEN 'junk' WHEN 6 THEN {rfc} || ' GMT' ELSE {slash} END AS raw,
  published_at AS truth FROM """
SPARK_TIME = TIME_FORMS.format(iso="date_format(published_at, \"yyyy-MM-dd'T'HH:mm:ss\")", day="date_format(published_at, 'yyyy-MM-dd')",
                               rfc="date_format(published_at, 'EEE, dd MMM yyyy HH:mm:ss')",
                               slash="date_format(published_at, 'yyyy/MM/dd HH:mm')") + "{articles}"
DUCK_TIME = TIME_FORMS.format(iso="strftime(published_at, '%Y-%m-%dT%H:%M:%S')", day="strftime(published_at, '%Y-%m-%d')",
                              rfc="strftime(published_at, '%a, %d %b %Y %H:%M:%S')",
                              slash="strftime(published_at, '%Y/%m/%d %H:%M')") + "articles"


@query("time_parse", f"""SELECT id, raw, CASE id % 8 WHEN 5 THEN NULL WHEN 3 THEN date_trunc('day', truth)
  WHEN 2 THEN truth - INTERVAL 8 HOUR ELSE truth END AS parsed,
  CASE WHEN id % 8 <> 5 THEN CAST(date_trunc('day', truth) AS TIMESTAMP) END AS day FROM ({DUCK_TIME}) q""")
def time_parse(d):
    return d.sql(SPARK_TIME).select("id", "raw", TM.parse_time("raw").alias("parsed"), TM.parse_day("raw").alias("day"))


DATE_HTML = """SELECT id, concat('<li><a href="/x">', title, '</a>', CASE id % 5
  WHEN 0 THEN concat('<span>', day, '</span>') WHEN 1 THEN concat('<em>[', slash, ']</em>')
  WHEN 2 THEN concat(' ', day, ' ') WHEN 3 THEN concat('<span>2024-13-45</span><i class="d">', slash, '</i>')
  ELSE '' END, '</li>') AS html, CASE WHEN id % 5 <> 4 THEN day END AS want FROM (SELECT id, title, {day} AS day, {slash} AS slash FROM """
SPARK_DATE = DATE_HTML.format(day="date_format(published_at, 'yyyy-MM-dd')", slash="date_format(published_at, 'yyyy/M/d')") + "{articles}) q"
DUCK_DATE = DATE_HTML.format(day="strftime(published_at, '%Y-%m-%d')", slash="strftime(published_at, '%Y/%-m/%-d')") + "articles) q"


@query("list_dates", f"SELECT id, want AS day FROM ({DUCK_DATE}) z")
def list_dates(d):
    return d.sql(SPARK_DATE).select("id", TM.list_item_day("html").alias("day"))


@query("english_dates", """SELECT id, CASE WHEN id % 4 = 3 THEN NULL
  ELSE CAST(date_trunc('day', published_at) AS TIMESTAMP) END AS day FROM articles""")
def english_dates(d):
    day = F.when(F.col("id") % 4 == 0, F.date_format("published_at", "dd MMMM yyyy")) \
           .when(F.col("id") % 4 == 1, F.date_format("published_at", "d MMM, yyyy")) \
           .when(F.col("id") % 4 == 2, F.concat(F.lit("Posted: "), F.date_format("published_at", "d MMMM yyyy"), F.lit(" by x"))) \
           .otherwise(F.concat(F.lit("31 Foo 2024 "), "title"))
    return d.articles().select("id", TM.english_day(day).alias("day"))


PUB_FORMS = """SELECT id, CASE id % 7 WHEN 0 THEN {iso} || 'Z' WHEN 1 THEN {iso} || '+02:00'
  WHEN 2 THEN {iso} WHEN 3 THEN '发布时间：' || {cn} || ' ' || {hm} || ' 来源' WHEN 4 THEN '日期: ' || {day}
  WHEN 5 THEN '编辑 ' || {slash} || ' ' || {hm} ELSE title END AS raw, published_at AS t FROM """
SPARK_PUB = PUB_FORMS.format(iso="date_format(published_at, \"yyyy-MM-dd'T'HH:mm:ss\")", cn="date_format(published_at, 'yyyy年M月d日')",
                             hm="date_format(published_at, 'H:mm')", day="date_format(published_at, 'yyyy.MM.dd')",
                             slash="date_format(published_at, 'yyyy/MM/dd')") + "{articles}"
DUCK_PUB = PUB_FORMS.format(iso="strftime(published_at, '%Y-%m-%dT%H:%M:%S')", cn="strftime(published_at, '%Y年%-m月%-d日')",
                            hm="strftime(published_at, '%-H:%M')", day="strftime(published_at, '%Y.%m.%d')",
                            slash="strftime(published_at, '%Y/%m/%d')") + "articles"


@query("publish_texts", f"""SELECT id, raw, CASE id % 7 WHEN 0 THEN strftime(t + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M')
  WHEN 1 THEN strftime(t + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M') WHEN 4 THEN strftime(t, '%Y-%m-%d')
  WHEN 6 THEN NULL ELSE strftime(t, '%Y-%m-%d %H:%M') END AS published FROM ({DUCK_PUB}) q""")
def publish_texts(d):
    return d.sql(SPARK_PUB).select("id", "raw", TM.publish_text("raw").alias("published"))


@query("future_guard", f"""SELECT id, CASE WHEN published_at IS NULL THEN NULL
  WHEN id % 2 = 0 AND published_at <= TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 1 HOUR THEN strftime(published_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M')
  WHEN id % 2 = 1 AND date_trunc('day', published_at) - INTERVAL 8 HOUR <= TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 1 DAY
    THEN strftime(published_at, '%Y-%m-%d') END AS published FROM articles""")
def future_guard(d):
    raw = F.when(F.col("id") % 2 == 0, TM.local_minute_text("published_at")) \
           .otherwise(F.date_format("published_at", "yyyy-MM-dd"))
    return d.articles().select("id", TM.drop_future(raw, F.lit("2024-01-20").cast("timestamp")).alias("published"))


TAILED = """SELECT id, {t}, concat(title, CASE id % 12 WHEN 0 THEN ' - EPA' WHEN 1 THEN ' - news - Mongabay' WHEN 2 THEN ' | 碳交易信息网'
  WHEN 3 THEN ' - Department of Energy (.gov)' WHEN 4 THEN ' _ reuters.com' WHEN 5 THEN ' - in six charts' WHEN 6 THEN ' — Carbon Brief — Press'
  WHEN 7 THEN '摘要：更多内容 - EPA' WHEN 8 THEN ' - the economist' WHEN 9 THEN ' &amp; more - EPA - NOAA - IEA' WHEN 10 THEN ' - ' ELSE '' END) AS raw,
  CASE id % 3 WHEN 0 THEN 'EPA' WHEN 1 THEN 'mongabay' ELSE '' END AS src FROM {f}"""
TAIL_TEST = f"""(t <> '' AND ((length(t) <= 25 AND regexp_matches(t, {quoted(V.CJK_SITE_TAIL)}))
  OR (length(t) <= 30 AND (regexp_matches(t, '^[A-Z][A-Z0-9]{{1,8}}$')
      OR regexp_matches(t, '(?i)\\.(gov|com|org|net|in|eu|go\\.jp)([^A-Za-z0-9_]|$)')
      OR (substring(t,1,1) <> lower(substring(t,1,1)) AND regexp_matches(lower(t), {quoted(V.PUBLISHER_NAMES)}))))
  OR list_contains({V.TAIL_WORDS!r}, lower(t))))"""


@query("feed_suffix", rf"""WITH q AS ({TAILED.format(t="title", f="items")}),
s AS (SELECT id, trim(raw) AS r, src FROM q), p AS (SELECT *, regexp_extract(r, '(?s)^(.*) - (.*)$', 1) AS head,
  trim(regexp_extract(r, '(?s)^(.*) - (.*)$', 2)) AS tail FROM s)
SELECT id, CASE WHEN contains(r, ' - ') AND ((src <> '' AND lower(tail) = lower(src))
  OR (length(tail) <= 70 AND regexp_matches(tail, {quoted(V.FEED_SOURCE_TAIL)}))) THEN trim(head) ELSE r END AS title FROM p""")
def feed_suffix(d):
    return d.sql(TAILED.format(t="title", f="{items}")).select("id", T.strip_feed_source("raw", "src").alias("title"))


@query("publisher_names", f"""WITH q AS (SELECT id, trim(split_part(raw, ' - ', 2)) AS t FROM ({TAILED.format(t="title", f="items")}) z)
SELECT id, t AS name, t <> '' AND length(t) <= 30 AND (regexp_matches(t, '^[A-Z][A-Z0-9]{{1,8}}$')
      OR regexp_matches(t, '(?i)\\.(gov|com|org|net|in|eu|go\\.jp)([^A-Za-z0-9_]|$)')
      OR (substring(t,1,1) <> lower(substring(t,1,1)) AND regexp_matches(lower(t), {quoted(V.PUBLISHER_NAMES)}))) AS publisher FROM q""")
def publisher_names(d):
    name = F.trim(F.split_part("raw", F.lit(" - "), F.lit(2)))
    return d.sql(TAILED.format(t="title", f="{items}")).select("id", name.alias("name"), T.is_publisher(name).alias("publisher"))


def unescape_sql(e: str) -> str:
    """Character references of HTML 5 resolved piece by piece."""
    names = ", ".join(quoted(n) for n in R.html5)
    table = f"map([{names}], [{', '.join(quoted(c) for c in R.html5.values())}])"
    bare = f"map([{', '.join(quoted(n) for n in R.BARE)}], [{', '.join(quoted(c) for c in R.BARE.values())}])"
    legacy = f"map([{', '.join(map(str, R.legacy_codes()))}], [{', '.join('chr(' + str(ord(c)) + ')' if ord(c) else quoted(c) for c in R.legacy_codes().values())}])"
    name, number = r"regexp_extract(p, '^[^\t\n\f <&#;]{1,32};?')", "regexp_extract(p, '^#([xX][0-9a-fA-F]+|[0-9]+);?')"
    digits = f"regexp_replace(replace(replace({number}, '#', ''), ';', ''), '^([xX]?)0*([0-9a-fA-F])', '\\1\\2')"
    code = f"CASE WHEN regexp_matches({digits}, '^[xX]') THEN CASE WHEN length({digits}) > 10 THEN 1114112 ELSE CAST(concat('0x', substring({digits}, 2)) AS BIGINT) END WHEN length({digits}) > 9 THEN 1114112 ELSE CAST({digits} AS BIGINT) END"
    silent = "c BETWEEN 1 AND 8 OR c = 11 OR c BETWEEN 14 AND 31 OR c = 127 OR c BETWEEN 64976 AND 65007 OR (c & 65534) = 65534"
    char = f"""list_transform([{code}], lambda c: CASE WHEN c IN (0, 13) OR c BETWEEN 128 AND 159 THEN {legacy}[c] WHEN c BETWEEN 55296 AND 57343 OR c > 1114111 THEN chr(65533) WHEN {silent} THEN '' ELSE chr(CAST(c AS INT)) END)[1]"""
    partly = f"""list_filter(list_transform([6, 5, 4, 3, 2], lambda k: CASE WHEN k < length({name}) AND {bare}[left(p, k)] IS NOT NULL THEN concat({bare}[left(p, k)], substring(p, k + 1)) END), lambda v: v IS NOT NULL)[1]"""
    piece = f"""CASE WHEN i = 1 THEN p WHEN {number} <> '' THEN concat({char}, substring(p, length({number}) + 1))
      WHEN {name} <> '' THEN CASE WHEN {table}[{name}] IS NOT NULL THEN concat({table}[{name}], substring(p, length({name}) + 1)) ELSE coalesce({partly}, concat('&', p)) END ELSE concat('&', p) END"""
    return f"(CASE WHEN contains({e}, '&') THEN array_to_string(list_transform(string_split({e}, '&'), lambda p, i: {piece}), '') ELSE {e} END)"


def strip_rounds(source: str) -> str:
    """Six separators in order, each three rounds, as plain nested selects over (id, raw)."""
    sql = f"""SELECT id, CASE WHEN contains(u,'摘要：') THEN trim(split_part(u,'摘要：',1))
        WHEN contains(u,'摘要:') THEN trim(split_part(u,'摘要:',1)) ELSE u END AS r
      FROM (SELECT id, {unescape_sql('trim(raw)')} AS u FROM ({source}) z) y"""
    for sep in V.TITLE_SEPARATORS:
        for _ in range(3):
            q, last = quoted(sep), quoted(f"(?s)^(.*){B.escape(sep)}(.*)$")
            sql = f"""SELECT id, CASE WHEN contains(r,{q}) AND {TAIL_TEST} THEN trim(h) ELSE r END AS r FROM (
              SELECT id, r, trim(regexp_extract(r, {last}, 2)) AS t, regexp_extract(r, {last}, 1) AS h FROM ({sql}) a) b"""
    return sql


@query("title_suffix", f"SELECT id, r AS title FROM ({strip_rounds(TAILED.format(t='title', f='items'))}) z")
def title_suffix(d):
    return d.sql(TAILED.format(t="title", f="{items}")).select("id", T.strip_title_suffix("raw").alias("title"))


NAV_MIX = """SELECT id, CASE id % 10 WHEN 0 THEN 'About us' WHEN 1 THEN concat('Station ', CAST(id AS VARCHAR(20)), ' data')
  WHEN 2 THEN 'News Archives ' WHEN 3 THEN 'glossary of terms' WHEN 4 THEN 'U.S. Energy Information Administration - EIA'
  WHEN 5 THEN 'EIA' WHEN 6 THEN 'ENSO outlook' WHEN 7 THEN 'Clean Trucks Plan - EPA' ELSE title END AS t FROM """


# every name of the table comes by with and without its semicolon, numbers of all kinds, and signs that are no references
REFERENCES = f"""SELECT id, concat('&', n, ' a &', replace(n, ';', ''), 'b &#', CAST(id * 7 % 70000 AS VARCHAR(20)), '; &#x', CASE id % 5 WHEN 0 THEN '110000' WHEN 1 THEN '1F600' WHEN 2 THEN '80' WHEN 3 THEN 'fdd0' ELSE '0000d800' END,
  CASE id % 2 WHEN 0 THEN ';' ELSE 'z' END, '&amp;lt; & && &; &# &#x; &#99999999999; ', title, ' &', n, title) AS raw FROM (
  SELECT id, title, split_part('{" ".join(sorted(R.html5))}', ' ', CAST(id * 13 % {len(R.html5)} + 1 AS INT)) AS n FROM {{f}}) q"""


@query("char_references", f"SELECT id, {unescape_sql('raw')} AS text FROM ({REFERENCES.format(f='items')}) z")
def char_references(d):
    return d.sql(REFERENCES.format(f="{items}")).select("id", R.unescape("raw").alias("text"))


@query("nav_titles", f"""SELECT id, t, regexp_matches(trim(t), {quoted("(?i)^(" + "|".join(V.NAV_TITLES) + r")\s*$")}) AS nav
FROM ({NAV_MIX} items) q""")
def nav_titles(d):
    return d.sql(NAV_MIX + "{items}").withColumn("nav", T.is_nav_title("t"))


PAGE_MIX = """SELECT id, CASE id % 8 WHEN 0 THEN concat('Title:  ', title) WHEN 1 THEN concat(title, '_碳排放交易网')
  WHEN 2 THEN concat(title, ' - EPA') WHEN 3 THEN concat(title, '|Reuters News') WHEN 4 THEN concat('标题：', title, '——上海交易所')
  WHEN 5 THEN 'Main navigation' WHEN 6 THEN '国家节能中心公共服务网 - 节能研究' ELSE title END AS raw FROM """


def _page_title_sql(source: str = f"{PAGE_MIX} items", key: str = "id") -> str:
    arms = []
    for sep in V.PAGE_TITLE_SEPARATORS:
        q = quoted(sep)
        last = quoted(f"(?s)^(.*){B.escape(sep)}(.*)$")
        tail = f"regexp_extract(s, {last}, 2)"
        test = TAIL_TEST.split("OR list_contains")[0] + "))"
        test = test.replace(V.PUBLISHER_NAMES.replace("'", "''"), V.PAGE_PUBLISHER_NAMES.replace("'", "''"))
        arms.append(f"WHEN contains(s,{q}) AND (SELECT {test} FROM (SELECT {trim_sql(tail)} AS t) w) "
                    f"THEN {trim_sql(f'regexp_extract(s, {last}, 1)')}")
    base = rf"""regexp_replace({squeeze_sql('raw')}, '(?i)^(title|标题|题名|文章标题)\s*[:：]\s*', '')"""
    return f"SELECT {key}, nullif(substring(CASE {' '.join(arms)} ELSE s END, 1, 120), '') AS title FROM (SELECT {key}, {base} AS s FROM ({source}) p) z"


@query("page_title_clean", _page_title_sql())
def page_title_clean(d):
    return d.sql(PAGE_MIX + "{items}").select("id", T.clean_page_title("raw", V.PAGE_TITLE_CHARS).alias("title"))


@query("generic_titles", f"""SELECT id, raw, regexp_matches(trim(raw), {quoted("(?i)" + V.GENERIC_TITLES)}) AS generic
FROM ({PAGE_MIX} items) q""")
def generic_titles(d):
    return d.sql(PAGE_MIX + "{items}").withColumn("generic", T.is_generic_title("raw"))


SIM_NOISE = r"""[\s\x{a0}\x{3000}\-—–|｜_【】\[\]（）()《》〈〉<>「」『』"''“”‘’.,，。:：;；!！?？、…]"""


@query("title_containment", f"""WITH q AS (SELECT id, lower(regexp_replace(title, '{SIM_NOISE}', '', 'g')) AS a,
  lower(regexp_replace(CASE id % 3 WHEN 0 THEN summary WHEN 1 THEN reverse(title) ELSE concat('- ', title, ' zq') END, '{SIM_NOISE}', '', 'g')) AS b FROM articles)
SELECT id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS contained FROM q""")
def title_containment(d):
    other = F.expr("CASE id % 3 WHEN 0 THEN summary WHEN 1 THEN reverse(title) ELSE concat('- ', title, ' zq') END")
    return d.articles().select("id", T.is_contained("title", other).alias("contained"))


@query("title_similarity")
def title_similarity(d):
    """Ratio of a title and the same title cut short or with another phrase."""
    other = F.expr("CASE WHEN id % 2 = 0 THEN substring(title, 5) ELSE concat('X', substring(title, 9)) END")
    return d.items().select("id", F.round(T.title_similarity("title", other), 9).alias("similarity"))


@query("strip_html", f"""SELECT page_id, {squeeze_sql("regexp_replace(html, '<[^>]+>', '', 'g')")} AS text FROM pages""")
def strip_html(d):
    return d.table("pages").select("page_id", X.strip_html("html").alias("text"))


@query("sentence_cut", r"""WITH q AS (SELECT doc_id, text, substring(text,1,260) AS h FROM documents),
p AS (SELECT *, regexp_extract(h, '(?s)^(.*[.!?。！？．])', 1) AS s, regexp_extract(h, '(?s)^(.*) ', 1) AS w FROM q)
SELECT doc_id, CASE WHEN length(text) <= 260 THEN text WHEN length(s) >= 60 THEN s WHEN length(w) > 60 THEN w ELSE h END AS summary FROM p""")
def sentence_cut(d):
    return d.table("documents").select("doc_id", X.cut_at_sentence("text", 260).alias("summary"))


@query("error_pages", f"""SELECT doc_id, length(t) < 15 OR ({" OR ".join(f"contains(lower(substring(t,1,120)), {quoted(m)})" for m in V.ERROR_MARKERS)}) AS error
FROM (SELECT doc_id, CASE doc_id % 20 WHEN 0 THEN concat('Error 404: ', text) WHEN 1 THEN substring(text,1,10)
  WHEN 2 THEN concat('抱歉，您访问的地址有错', text) ELSE text END AS t FROM documents) q""")
def error_pages(d):
    t = F.expr("CASE doc_id % 20 WHEN 0 THEN concat('Error 404: ', text) WHEN 1 THEN substring(text,1,10) "
               "WHEN 2 THEN concat('抱歉，您访问的地址有错', text) ELSE text END")
    return d.table("documents").select("doc_id", X.is_error_page(F.lit("x"), t).alias("error"))


@query("source_orgs", f"""SELECT id, nullif(trim(regexp_extract(t, {quoted(V.SOURCE_ORG)}, 1), '：:，,。 '), '') AS org FROM (
  SELECT id, CASE id % 4 WHEN 0 THEN concat(title, ' 来源：', summary) WHEN 1 THEN concat('文章来源: ', title)
  WHEN 2 THEN '来源：' ELSE title END AS t FROM items) q""")
def source_orgs(d):
    t = F.expr("CASE id % 4 WHEN 0 THEN concat(title, ' 来源：', summary) WHEN 1 THEN concat('文章来源: ', title) "
               "WHEN 2 THEN '来源：' ELSE title END")
    return d.items().select("id", X.source_org(t).alias("org"))


DIRTY_SUMMARY = """SELECT id, title, CASE id % 9 WHEN 0 THEN concat('我的位置 首页 字号 大 打印本页', s)
  WHEN 1 THEN concat('文章来源:未知 碳网 2024-01-05 14:05 ', s) WHEN 2 THEN concat('合作电话:010-1234 5678 栏目 文章来源:某报 2024-01-05 14:05', s)
  WHEN 3 THEN concat('碳道小编 · 2024-01-05 20:08 · 阅读量 · 16 摘要：', s) WHEN 4 THEN concat('摘要： ', s)
  WHEN 5 THEN '合作电话:010-1234 5678 文章来源:某报 2024-01-05 14:05 short' WHEN 6 THEN concat('发布时间：2024-01-05 ', title, ' ', title, s)
  WHEN 7 THEN concat(s, ' 小编 3天前 阅读量：12') ELSE s END AS raw FROM (SELECT id, title, replace(summary, chr(10), ' ') AS s FROM {f}) q"""
STAMP = r"\d{4}-\d{2}-\d{2}\s*\d{2}:\d{2}\s*"
EDITOR = r"[\x{4e00}-\x{9fff}]{0,6}(小编|编辑)\s*[^\x{4e00}-\x{9fff}]*\d*[天小时分]?前"


@query("summary_clean", rf"""WITH q AS ({DIRTY_SUMMARY.format(f="articles")}),
a AS (SELECT id, raw, regexp_replace({trim_sql('raw')}, '^文章来源[:：].{{0,60}}?{STAMP}', '') AS s FROM q),
b AS (SELECT *, regexp_matches(s, '合作电话[:：]?\d[\d\- ]{{6,20}}.*?文章来源[:：].{{0,60}}?{STAMP}') AS foot,
  regexp_replace(s, '^.*?合作电话[:：]?\d[\d\- ]{{6,20}}.*?文章来源[:：].{{0,60}}?{STAMP}', '') AS c FROM a)
SELECT id, CASE WHEN contains(raw,'我的位置') AND contains(raw,'字号') AND contains(raw,'打印本页') THEN ''
  WHEN foot AND length({trim_sql('c')}) < 15 THEN ''
  ELSE {trim_sql(rf"regexp_replace(regexp_replace(c, '^.{{0,50}}?(小编|編輯|编辑)\s*[·.]\s*\d{{4}}-\d{{2}}-\d{{2}}.*?阅读量\s*[·:：]?\s*\d+\s*', ''), '^摘要[：:]{WS}*', '')")} END AS summary FROM b""")
def summary_clean(d):
    return d.sql(DIRTY_SUMMARY.format(f="{articles}")).select("id", X.clean_summary("raw").alias("summary"))


DIRTY_TITLE = """SELECT id, CASE id % 6 WHEN 0 THEN concat(title, '摘要：正文') WHEN 1 THEN concat(title, ' 碳道小编 3天前')
  WHEN 2 THEN concat(title, ' - 碳交易网') WHEN 3 THEN concat('Road to net-zero') WHEN 4 THEN concat('  ', title, '   x ') ELSE title END AS raw FROM """


@query("digest_titles", rf"""WITH a AS (SELECT id, trim(split_part({squeeze_sql('raw')}, '摘要：', 1)) AS t FROM ({DIRTY_TITLE} items) q)
SELECT id, {trim_sql(rf"regexp_replace(regexp_replace(t, '{EDITOR}\s*$', ''), '\s*[-–—]\s*[^，。；！？、\s]{{2,24}}$', '')")} AS title FROM a""")
def digest_titles(d):
    return d.sql(DIRTY_TITLE + "{items}").select("id", T.clean_digest_title("raw").alias("title"))


def summary_base_sql(source: str) -> str:
    """id, title, s: the cleaned summary of (id, title, raw)."""
    marked = trim_sql("substring(s, strpos(s,'摘要：') + 3)")
    return rf"""SELECT id, title, regexp_replace(regexp_replace(regexp_replace(s, '发布时间：\d{{4}}-\d{{2}}-\d{{2}}\s*', '', 'g'), '{EDITOR}', '', 'g'),
  '^文章来源[:：]\s*[^\s，。；]{{1,24}}\s*\d{{4}}[-/]\d{{2}}[-/]\d{{2}}\s*\d{{2}}:\d{{2}}\s*', '') AS s FROM (
  SELECT id, title, CASE WHEN contains(s,'摘要：') THEN {marked} ELSE s END AS s FROM (SELECT id, title, {squeeze_sql('raw')} AS s FROM ({source}) a1) a2) a3"""


def digest_summary_sql(source: str) -> str:
    """id, summary of (id, title, raw): the common run is found letter by letter, places by listing the letters."""
    rounds, before, least = V.REPEATED_TITLE
    sql = f"SELECT id, regexp_replace(coalesce(title,''), '{WS}+', '', 'g') AS t, s FROM ({summary_base_sql(source)}) b0"
    at = " ".join(f"WHEN starts_with(substring(f,{k + 1}), left(t,{least})) THEN {k}" for k in range(before + 1))
    for _ in range(rounds):
        sql = f"""SELECT id, t, CASE WHEN n >= {least} THEN regexp_replace(concat(left(s, place[k + 1] - 1), CASE WHEN k + n < len(place) THEN substring(s, place[k + n + 1]) ELSE '' END), {quoted(V.REPEATED_TITLE_EDGES)}, '', 'g') ELSE s END AS s FROM (
  SELECT *, CASE WHEN k IS NOT NULL THEN list_filter(range(1, length(s) + 1), lambda i: letters[i] <> ' ') END AS place,
    CASE WHEN k IS NOT NULL THEN coalesce(list_position(list_transform(range(1, least(length(f) - k, length(t)) + 1), lambda i: fl[k + i] = tl[i]), FALSE) - 1, least(length(f) - k, length(t))) END AS n FROM (
  SELECT *, CASE WHEN k IS NOT NULL THEN string_split(s, '') END AS letters, CASE WHEN k IS NOT NULL THEN string_split(f, '') END AS fl, CASE WHEN k IS NOT NULL THEN string_split(t, '') END AS tl FROM (
  SELECT *, CASE WHEN length(t) <= 4 THEN NULL {at} END AS k FROM (SELECT *, replace(s, ' ', '') AS f FROM ({sql}) c1) c2) c3) c4) c5"""
    return f"SELECT id, concat(regexp_replace(substring(s,1,90), '[，。、；：,.;: ]+$', ''), CASE WHEN length(s) > 90 THEN '…' ELSE '' END) AS summary FROM ({sql}) c6"


@query("digest_summaries", digest_summary_sql(DIRTY_SUMMARY.format(f="articles")))
def digest_summaries(d):
    return d.sql(DIRTY_SUMMARY.format(f="{articles}")).select("id", X.digest_summary("title", "raw").alias("summary"))


@query("digest_summary_base", f"SELECT id, s AS summary FROM ({summary_base_sql(DIRTY_SUMMARY.format(f='articles'))}) z")
def digest_summary_base(d):
    return d.sql(DIRTY_SUMMARY.format(f="{articles}")).select("id", X.digest_summary_base("raw").alias("summary"))


def screen_summary_sql(source: str) -> str:
    """id, summary of (id, raw)."""
    return rf"""SELECT id, regexp_replace(substring(s,1,90), '[，。、；：,.;:·\s]+$', '') AS summary FROM (
  SELECT id, regexp_replace(regexp_replace(regexp_replace(s, '发布时间：\d{{4}}-\d{{2}}-\d{{2}}\s*', '', 'g'), '{EDITOR}', '', 'g'), '阅读量\s*[：:·]?\s*\d+', '', 'g') AS s FROM (
  SELECT id, CASE WHEN contains(s,'摘要：') THEN {trim_sql("split_part(s,'摘要：',2)")} ELSE s END AS s FROM (SELECT id, {squeeze_sql('raw')} AS s FROM ({source}) a1) a2) a3) a4"""


def digest_title_sql(title: str) -> str:
    t = f"trim(split_part({squeeze_sql(title)}, '摘要：', 1))"
    return trim_sql(rf"regexp_replace(regexp_replace({t}, '{EDITOR}\s*$', ''), '\s*[-–—]\s*[^，。；！？、\s]{{2,24}}$', '')")


@query("screen_summaries", screen_summary_sql(DIRTY_SUMMARY.format(f="articles")))
def screen_summaries(d):
    return d.sql(DIRTY_SUMMARY.format(f="{articles}")).select("id", X.screen_summary("raw").alias("summary"))


LANGUAGE_MIX = """SELECT id, CASE id % 5 WHEN 0 THEN concat('カーボン ', title) WHEN 1 THEN '碳市场新闻' WHEN 2 THEN '12345 ...'
  ELSE title END AS t FROM """


@query("translation_need", rf"""SELECT id, CASE WHEN regexp_matches(t, '[\x{{3040}}-\x{{30ff}}]') THEN TRUE
  WHEN regexp_matches(t, '[\x{{4e00}}-\x{{9fff}}]') THEN FALSE ELSE regexp_matches(t, '[A-Za-z]') END AS needed FROM ({LANGUAGE_MIX} items) q""")
def translation_need(d):
    return d.sql(LANGUAGE_MIX + "{items}").select("id", X.needs_translation("t").alias("needed"))


ABSOLUTE = """concat(CAST(year(l) AS VARCHAR), '年', CAST(month(l) AS VARCHAR), '月', CAST(day(l) AS VARCHAR), '日 ',
  CASE WHEN hour(l) < 12 THEN '上午' ELSE '下午' END, CAST(CASE WHEN hour(l) % 12 = 0 THEN 12 ELSE hour(l) % 12 END AS VARCHAR), ':', strftime(l, '%M'))"""


@query("time_display", f"""SELECT id, strftime(l, '%Y-%m-%d %H:%M') AS local_minute, strftime(published_at, '%m-%d') AS month_day,
  strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS iso,
  CASE WHEN published_at IS NULL THEN '时间未知' WHEN m < 0 THEN {ABSOLUTE} WHEN m < 60 THEN concat(CAST(CAST(floor(m) AS BIGINT) AS VARCHAR), '分钟前 · ', {ABSOLUTE})
   WHEN m < 1440 THEN concat(CAST(CAST(floor(m / 60) AS BIGINT) AS VARCHAR), '小时前 · ', {ABSOLUTE}) ELSE {ABSOLUTE} END AS relative
FROM (SELECT id, published_at, published_at + INTERVAL 8 HOUR AS l, date_diff('second', published_at, {AS_OF_SQL}) / 60.0 AS m FROM articles) q""")
def time_display(d):
    return d.articles().select("id", TM.local_minute_text("published_at").alias("local_minute"),
                               TM.month_day("published_at").alias("month_day"), TM.iso_text("published_at").alias("iso"),
                               TM.relative_text("published_at", d.as_of).alias("relative"))


@query("archived_times", """SELECT id, published_at AS utc FROM articles""")
def archived_times(d):
    return d.articles().select("id", TM.local_to_utc(TM.local_minute_text("published_at")).alias("utc"))


@query("display_titles", """SELECT id, CASE WHEN id % 3 = 0 THEN concat('译：', title) ELSE title END AS shown FROM items""")
def display_titles(d):
    zh = F.when(F.col("id") % 3 == 0, F.concat(F.lit("译："), F.col("title"))).when(F.col("id") % 3 == 1, F.lit(""))
    return d.items().select("id", T.display_title("title", zh).alias("shown"))


MARKED = """SELECT id, CASE id % 5 WHEN 0 THEN concat(left(s,60), ' 本`文@内-容-来-自；中^国_碳0排0放^交-易=网 ta n pa i fa ng . co m ', substring(s,61))
  WHEN 1 THEN concat(s, '禸嫆@唻洎：狆國 τāńｐāīｆāńɡ.ｃōｍ') WHEN 2 THEN concat(s, '  本/文-内.容.来.自')
  WHEN 3 THEN concat(s, '  ') ELSE s END AS line FROM (SELECT id, replace(summary, chr(10), ' ') AS s FROM {f}) q"""
_WM = [p.replace("'", "''") for p in V.WATERMARKS]


@query("watermarks", rf"""WITH q AS ({MARKED.format(f="articles")}),
a AS (SELECT id, line, regexp_replace(regexp_replace(line, '{_WM[0]}', '', 'g'), '{_WM[1]}', '', 'g') AS x FROM q),
b AS (SELECT id, line, regexp_replace(x, '{_WM[2].replace("(?=$|", "($|")}', '\1', 'g') AS x FROM a)
SELECT id, CASE WHEN x = line THEN line ELSE regexp_replace(regexp_replace(x, ' {{2,}}', ' ', 'g'), '{WS}+$', '') END AS line FROM b""")
def watermarks(d):
    return d.sql(MARKED.format(f="{articles}")).select("id", X.strip_watermark("line").alias("line"))


SUFFIXED = """SELECT id, concat(title, CASE id % 6 WHEN 0 THEN '-国家发展和改革委员会' WHEN 1 THEN ' -国家发改委' WHEN 2 THEN '_碳排放交易网'
  WHEN 3 THEN '-生态环境部x' ELSE '' END) AS raw FROM """


@query("fixed_suffix", f"""SELECT id, CASE {" ".join(f"WHEN suffix(raw, {quoted(s)}) THEN trim(left(raw, length(raw) - {len(s)}))" for s in V.FIXED_SUFFIXES)}
  ELSE raw END AS title FROM ({SUFFIXED} items) q""")
def fixed_suffix(d):
    return d.sql(SUFFIXED + "{items}").select("id", T.strip_fixed_suffix("raw").alias("title"))


AGENCY = """SELECT id, concat(title, CASE id % 8 WHEN 0 THEN ' - NOAA (.gov)' WHEN 1 THEN ' | U.S. Energy Information Administration (EIA) (.gov) - News'
  WHEN 2 THEN ' - EPA - Press - Daily ' WHEN 3 THEN ' - taiyangnews.info' WHEN 4 THEN '-上海环境能源交易所' WHEN 5 THEN ' - NOAA National Centers (NCEI) (.gov)...'
  ELSE '' END) AS raw FROM """


def _agency_sql() -> str:
    sql = f"SELECT id, trim(raw) AS t FROM ({AGENCY} items) q"
    for _ in range(4):
        arms = " ".join(f"WHEN regexp_matches(t, {quoted(chr(92) + 's*' + p + chr(92) + 's*$')}) THEN trim(regexp_replace(t, {quoted(chr(92) + 's*' + p + chr(92) + 's*$')}, ''))"
                        for p in V.AGENCY_TAILS)
        sql = f"SELECT id, CASE {arms} ELSE t END AS t FROM ({sql}) z"
    return f"SELECT id, t AS title FROM ({sql}) y"


@query("agency_tails", _agency_sql())
def agency_tails(d):
    return d.sql(AGENCY + "{items}").select("id", T.strip_agency_tails("raw").alias("title"))


@query("paragraph_reflow", rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l),
b AS (SELECT *, nxt IS NOT NULL AND {trim_sql('line')} <> '' AND {trim_sql('nxt')} <> ''
  AND NOT regexp_matches(line, '{X.NOT_PARAGRAPH}') AND NOT regexp_matches(nxt, '{X.NOT_PARAGRAPH}')
  AND (regexp_matches(line, '{X.PARA_END}') OR regexp_matches(nxt, '{X.PARA_START}')
    OR (length({trim_sql('line')}) >= 15 AND length({trim_sql('nxt')}) >= 15 AND NOT right({trim_sql('line')}, 1) IN ('，', ',', '、', '；', ';'))) AS brk FROM n)
SELECT doc_id, string_agg(CASE WHEN brk THEN concat(line, chr(10)) ELSE line END, chr(10) ORDER BY i) AS text FROM b GROUP BY doc_id""")
def paragraph_reflow(d):
    return d.table("documents").select("doc_id", X.reflow("text").alias("text"))


FRONT_LINES = """SELECT id, CASE id % 6 WHEN 0 THEN concat('tags: [', chr(39), site_id, chr(39), ', "b", c', chr(39), 'd, ]') WHEN 1 THEN concat('summary: "', replace(title, '"', ''), ' "x" y""')
  WHEN 2 THEN concat('stray: ', title) WHEN 3 THEN concat('keywords: [', site_id, ', "', chr(39), 'q', chr(39), '"]') WHEN 4 THEN concat('url: ', url) ELSE concat('plain ', title) END AS line FROM """


@query("frontmatter_tidy", f"""SELECT id, CASE id % 6 WHEN 0 THEN concat('tags: [''', site_id, ''', ''b'', ''c''''d'']')
  WHEN 1 THEN concat('summary: "', replace(title, '"', ''), ' ''x'' y''"') WHEN 2 THEN NULL
  WHEN 3 THEN concat('keywords: [''', site_id, ''', ''q'']') WHEN 4 THEN concat('url: ', url) ELSE concat('plain ', title) END AS line FROM items""")
def frontmatter_tidy(d):
    return d.sql(FRONT_LINES + "{items}").select("id", X.tidy_frontmatter_line("line").alias("line"))


@query("keyword_lists", r"""WITH t AS (SELECT id, topics, list_filter(list_transform(regexp_split_to_array(regexp_replace(title, '[：，、]', ' ', 'g'), '[\s\x{a0}\x{3000}]+'),
    lambda w: regexp_replace(w, '[,，.。、:：;；!！?？''"‘’“”()（）\[\]【】]', '', 'g')), lambda w: length(w) BETWEEN 2 AND 12 AND NOT starts_with(w,'http') AND NOT starts_with(w,'www')) AS toks FROM classified)
SELECT id, array_to_string(list_slice(list_sort(list_distinct(list_concat(topics, toks))), 1, 15), ',') AS keywords FROM t""")
def keyword_lists(d):
    return d.classified().select("id", F.array_join(X.keyword_list("topics", "title"), ",").alias("keywords"))


QUERY_FORMS = """SELECT id, concat('site:', site_id, '.org ', CASE id % 4 WHEN 0 THEN concat('(climate OR "', regexp_replace(title, '["()]', ''{g}), '" OR solar) when:7d')
  WHEN 1 THEN 'wind OR green energy when:14d' WHEN 2 THEN 'methane when:7d' ELSE '(a OR b)' END) AS query FROM """


@query("query_expand", f"""WITH q AS ({QUERY_FORMS.replace('{g}', ", 'g'")} articles), w AS (SELECT id, query, regexp_extract(query, '(when:[0-9]+d)$', 1) AS w,
  split_part(query, ' ', 1) AS site, trim(regexp_replace(regexp_replace(query, 'when:[0-9]+d$', ''), '^site:[^ ]+ ', '')) AS body FROM q),
p AS (SELECT id, query, w, site, unnest(string_split(trim(body, '()'), ' OR ')) AS part FROM w WHERE contains(query, ' OR '))
SELECT id, trim(concat(site, ' ', trim(part), ' ', w)) AS query FROM p UNION ALL SELECT id, query FROM q WHERE NOT contains(query, ' OR ')""")
def query_expand(d):
    from ..sources.payloads import expand_queries
    return expand_queries(d.sql(QUERY_FORMS.replace("{g}", "") + "{articles}")).select("id", "query")


@query("adjacent_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM l)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM p WHERE prev IS NULL OR prev <> line GROUP BY doc_id""")
def adjacent_lines(d):
    return d.table("documents").select("doc_id", F.array_join(X.adjacent_distinct(F.split("text", "\n", -1)), "\n").alias("text"))


# ---------------------------------------------------------------- pages
LINKS_SQL = r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')) AS a FROM pages),
l AS (SELECT page_id, url, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS label FROM a)"""


@query("link_junk", LINKS_SQL + f""" SELECT page_id, href, label, href = '' OR length(label) < 6
  OR {" OR ".join(f"contains(label, {quoted(w)})" for w in V.LINK_JUNK_TEXT)}
  OR {" OR ".join(f"contains(lower(href), {quoted(w)})" for w in V.LINK_JUNK_URL)} AS junk,
  contains(href, '/th') OR contains(href, 'e') AS allowed FROM l""")
def link_junk(d):
    return P.anchors(d.table("pages")).select("page_id", "href", "label", U.is_junk_link("label", "href").alias("junk"),
                                              U.has_allowed_path("href", ["/th", "e"]).alias("allowed"))


LIST_RULES = [ListRule("0", 3, "/", "", False, 40), ListRule("1", 2, "/[a-z]", "/(the|and)", False, 25),
              ListRule("2", 6, "e", "", True, 30)]


@query("page_links", r"""WITH x AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>') AS l FROM pages),
a AS (SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM x),
f AS (SELECT CAST(page_id % 3 AS VARCHAR) AS list_id, page_id, i, concat(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1), regexp_extract(a, 'href="([^"]*)"', 1)) AS href,
  trim(regexp_replace(regexp_replace(a, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS label FROM a),
r AS (SELECT * FROM (VALUES ('0',3,'/','',40),('1',2,'/[a-z]','/(the|and)',25),('2',6,'e','',30)) AS r(list_id, m, p, dn, h)),
k AS (SELECT f.*, h, row_number() OVER (PARTITION BY list_id, label, href ORDER BY page_id, i) AS d FROM f JOIN r USING (list_id)
  WHERE length(label) >= m AND regexp_matches(href, p) AND NOT (dn <> '' AND regexp_matches(href, dn)) AND NOT (list_id = '2' AND contains(href, '#')))
SELECT list_id, page_id, CAST(no AS INT) AS no, title, url FROM (SELECT list_id, page_id, label AS title, href AS url, h, row_number() OVER (PARTITION BY list_id ORDER BY page_id, i) AS no FROM k WHERE d = 1) z WHERE no <= h""")
def page_links(d):
    pages = d.table("pages").withColumn("list_id", (F.col("page_id") % 3).cast("string"))
    return listing_links(pages, LIST_RULES).select("list_id", "page_id", "no", "title", "url")


H1_SQL = f"""SELECT page_id, {unescape_sql(squeeze_sql("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')"))} AS raw FROM pages"""


@query("page_titles", _page_title_sql(H1_SQL, "page_id"))
def page_titles(d):
    return d.table("pages").select("page_id", P.article_title("html").alias("title"))


BODY_SQL = f"""WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS art FROM pages),
b AS (SELECT page_id, art, list_filter(list_transform(regexp_extract_all(art, '(?is)<(?:p|h[1-4]|li)(?:[ ][^>]*)?>(.*?)(?:</(?:p|h[1-4]|li)>|$)', 1),
  lambda x: {unescape_sql(squeeze_sql("regexp_replace(x, '<[^>]+>', ' ', 'g')"))}), lambda x: length(x) >= 15) AS l FROM a)
SELECT page_id, CASE WHEN art <> '' THEN array_to_string(l, chr(10) || chr(10)) END AS body FROM b"""


@query("page_body_fast", BODY_SQL)
def page_body_fast(d):
    return d.table("pages").select("page_id", P.article_text_fast("html").alias("body"))


@query("page_body")
def page_body(d):
    titled = d.table("pages").withColumn("title", P.article_title("html"))
    body = titled.select("page_id", "title", P.readable_text("html", "title").alias("body"))
    return body.withColumn("content", X.cut_at_sentence("body", 3000)).withColumn("summary", X.clean_summary(X.cut_at_sentence("body", 260)))


STAMPED = """SELECT page_id, day, replace(html, '<article>', concat(CASE page_id % 4 WHEN 0 THEN concat('<div class="meta"><span>', day, ' 09:30 来源：报社', CAST(page_id AS VARCHAR(20)), '</span></div>')
  WHEN 1 THEN concat('<time datetime="', day, 'T01:30:00Z">x</time>') WHEN 2 THEN concat('<p>日期：', day, '</p>') ELSE '' END, '<article>')) AS html
  FROM (SELECT page_id, html, concat('2024-01-', lpad(CAST(page_id % 28 + 1 AS VARCHAR(2)), 2, '0')) AS day FROM {pages}) q"""


@query("page_times", f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat(day, ' 09:30') WHEN 1 THEN concat(day, ' 09:30') WHEN 2 THEN day END AS published
  FROM ({STAMPED.replace("{pages}", "pages")}) q""")
def page_times(d):
    return d.sql(STAMPED).select("page_id", P.page_publish_text("html").alias("published"))


@query("page_source_orgs", f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('报社', CAST(page_id AS VARCHAR)) END AS org
  FROM ({STAMPED.replace("{pages}", "pages")}) q""")
def page_source_orgs(d):
    return d.sql(STAMPED.replace("09:30 来源", "09:30</span><span class=\"source\">来源")).select(
        "page_id", P.page_source_org("html").alias("org"))
