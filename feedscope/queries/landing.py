"""Queries over landed payloads and streams built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import payloads as P
from ..streaming import ingest
from .base import AS_OF_SQL, query, run_folder
from .cleaning import KEY_SQL, squeeze_sql


@query("payload_items", "SELECT id, title, url, CASE WHEN id % 2 = 0 THEN published_at END AS published_at FROM articles")
def payload_items(d):
    """Item JSON, wrapped and bare, written by Spark and read back."""
    one = F.struct(F.col("id").cast("string").alias("id"), "title", "url",
                   F.when(F.col("id") % 2 == 0, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published_at"))
    doc = F.when(F.col("id") % 3 == 0, F.to_json(F.array(one))).otherwise(F.to_json(F.struct(F.array(one).alias("items"))))
    rows = P.items_from_json(d.articles().select(doc.alias("payload")), "payload", "id string, title string, url string, published_at string")
    return rows.select(F.col("id").cast("long").alias("id"), "title", "url", P.parse_time("published_at").alias("published_at"))


def _xml(x):
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("feed_entries", f"""WITH e AS (SELECT id, site_id, trim(replace(replace(CASE WHEN id % 17 = 0 THEN ' ' ELSE title END, chr(10), ' '), chr(13), ' ')) AS title, url, CASE WHEN id % 4 = 0 THEN lang END AS author,
  CASE WHEN id % 3 = 0 THEN published_at WHEN id % 3 = 1 THEN published_at END AS t FROM articles),
o AS (SELECT *, row_number() OVER (PARTITION BY site_id, title, url ORDER BY id) AS k FROM e WHERE title <> ''), h AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY id) AS n FROM o WHERE k = 1)
SELECT id, site_id, coalesce(author, concat('Site ', site_id)) AS source, title, url, t AS published_at FROM h WHERE n <= 60""")
def feed_entries(d):
    """RSS entries as XML text: blanks, repeats, two time fields, 60 per feed."""
    a = d.articles()
    title = _xml(F.when(F.col("id") % 17 == 0, " ").otherwise(F.col("title")))
    rfc = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def tag(name, value):
        return F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))
    xml = F.concat(F.lit("<item>"), tag("title", title), tag("link", _xml(F.col("url"))),
                   tag("author", F.when(F.col("id") % 4 == 0, F.col("lang"))),
                   tag("pubDate", F.when(F.col("id") % 3 == 0, rfc)), tag("updated", F.when(F.col("id") % 3 == 1, iso)), F.lit("</item>"))
    entries = P.parse_feed_entries(a.select("site_id", F.concat(F.lit("Site "), "site_id").alias("site_name"), F.col("site_id").alias("feed_url"),
                                            F.col("id").alias("entry_no"), xml.alias("xml")), "xml")
    return P.feed_items(entries).select(F.col("entry_no").alias("id"), "site_id", "source", "title", "url", "published_at")


@query("subscriptions", """SELECT CASE WHEN source = 'src3' THEN 'feed.xml' ELSE concat('Feed ', source) END AS title, CASE WHEN source = 'src3' THEN 'https://src3.example.org/feed.xml' ELSE concat('https://', source, '.example.org/rss') END AS feed_url, count(*) AS n
FROM documents WHERE source <> 'src4' GROUP BY source""")
def subscriptions(d):
    """Subscription lists: nested outlines, both attribute spellings, a missing title, a non-http address."""
    line = F.expr("""CASE source WHEN 'src3' THEN '<outline xmlUrl="https://src3.example.org/feed.xml"/>' WHEN 'src4' THEN '<outline text="x" xmlUrl="ftp://x"/>'
      WHEN 'src5' THEN concat('<outline text="Feed ', source, '" xml_url="https://', source, '.example.org/rss"></outline>')
      ELSE concat('<outline title="Feed ', source, '" text="other" type="rss" xmlUrl="https://', source, '.example.org/rss"/>') END""")
    doc = F.concat(F.lit('<opml><body><outline text="group">'), line, F.lit("</outline></body></opml>"))
    return P.outlines(d.table("documents").select(doc.alias("value"))).groupBy("feed_url", "title").agg(F.count("*").alias("n"))


@query("api_records", """SELECT event_id, CAST(i AS INT) AS pos, CASE WHEN i = 0 THEN concat('T', user_id) ELSE concat('S', user_id) END AS title, CASE WHEN i = 0 THEN concat('https://api.example/', event_id) ELSE 'https://x.example' END AS url,
  CASE WHEN i = 0 THEN date_trunc('second', ts) - INTERVAL 8 HOUR END AS published_at FROM events, (VALUES (0), (1)) AS v(i)""")
def api_records(d):
    """Nested API answers with two title keys, relative addresses and local times."""
    time_text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    payload = F.concat(F.lit('{"data":{"list":[{"title":" T'), F.col("user_id").cast("string"), F.lit(' ","url":"/'), F.col("event_id").cast("string"),
                       F.lit('","time":"'), time_text, F.lit('"},{"title":"","short":"S'), F.col("user_id").cast("string"),
                       F.lit('","url":"https://x.example","time":"soon"},{"title":"","url":"y"}]}}'))
    schema = "data struct<list: array<struct<title:string, short:string, url:string, time:string>>>"
    return P.api_records(d.table("events").select("event_id", payload.alias("p")), "p", schema, "data.list", ["title", "short"], "url", "time", "https://api.example")


@query("event_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def event_props(d):
    return d.table("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("search_results", f"""WITH e AS (SELECT id, site_id, id % 3 AS query_no, trim(CASE id % 5 WHEN 0 THEN concat(title, ' - EPA') WHEN 1 THEN concat('- ', title) WHEN 2 THEN 'Photo Album - EPA' ELSE title END) AS raw FROM articles),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, query_no ORDER BY id) AS n FROM e) q WHERE n <= 15),
g AS (SELECT *, CASE WHEN suffix(raw, ' - EPA') THEN trim(left(raw, length(raw) - 6)) ELSE raw END AS title FROM h WHERE length(raw) >= 8 AND NOT starts_with(raw, '-') AND length(raw) - length(replace(raw, ' ', '')) >= 2),
k AS (SELECT *, {KEY_SQL} AS key FROM g WHERE length(title) >= 8 AND lower(title) <> 'photo album'),
o AS (SELECT *, row_number() OVER (PARTITION BY site_id, key ORDER BY query_no, id) AS kn FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY query_no, id) AS rn FROM o WHERE kn = 1)
SELECT id, site_id, title FROM r WHERE rn <= 20""")
def search_results(d):
    raw = F.when(F.col("id") % 5 == 0, F.concat("title", F.lit(" - EPA"))).when(F.col("id") % 5 == 1, F.concat(F.lit("- "), "title")) \
           .when(F.col("id") % 5 == 2, "Photo Album - EPA").otherwise(F.col("title"))
    entries = d.articles().select("id", "site_id", (F.col("id") % 3).alias("query_no"), F.col("id").alias("entry_no"), raw.alias("title"),
                                  F.lit("EPA").alias("source"), "url")
    return P.search_items(entries).select("id", "site_id", "title")


@query("publisher_filter", "SELECT id FROM articles WHERE id % 4 = 0")
def publisher_filter(d):
    t = F.concat("title", F.when(F.col("id") % 4 == 0, " - Reuters").otherwise(" - Other"))
    return P.ends_with_publisher(d.articles().withColumn("title", t), "reuters").select("id")


@query("microdata_posts", f"""WITH p AS (SELECT id, site_id, published_at, {squeeze_sql("concat('P ', regexp_replace(title, '[\"<>&]', '', 'g'))")} AS t FROM articles WHERE id % 9 <> 0)
SELECT concat('', id) AS post_id, concat('@', site_id) AS source, CASE WHEN id % 2 = 0 THEN concat('h', id) ELSE site_id END AS handle, t AS title, t AS summary,
  concat('https://x.com/', CASE WHEN id % 2 = 0 THEN concat('h', id) ELSE site_id END, '/status/', id) AS url, published_at,
  CAST(row_number() OVER (PARTITION BY site_id, id % 4 ORDER BY published_at DESC NULLS LAST, id) AS INT) AS position FROM p""")
def microdata_posts(d):
    """Account pages with many posts in page markup, some without text, handle or time; newest first."""
    def meta(name, value):
        return F.concat(F.lit(f'<meta itemprop="{name}" content="'), F.coalesce(value, F.lit("")), F.lit('">'))
    author = F.when(F.col("id") % 2 == 0, F.concat(F.lit('<div itemprop="author">'), meta("alternateName", F.concat(F.lit("h"), F.col("id").cast("string"))), F.lit("</div>"))).otherwise("")
    post = F.concat(F.lit('<article itemscope itemtype="https://schema.org/SocialMediaPosting">'), meta("identifier", F.col("id").cast("string")), author,
                    meta("datePublished", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
                    F.when(F.col("id") % 9 != 0, meta("text", F.concat(F.lit("P "), F.regexp_replace("title", "[\"<>&]", "")))).otherwise(""), F.lit("</article>"))
    # four pages an account
    pages = d.articles().groupBy(F.col("site_id").alias("handle"), (F.col("id") % 4).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("id", post.alias("post")))).alias("posts"))
    html = F.concat(F.lit("<html><body>"), F.array_join(F.transform("posts", lambda p: p["post"]), ""), F.lit("</body></html>"))
    return P.post_items(pages.select("handle", html.alias("html"))).drop("site_id")


# ---------------------------------------------------------------- streams over the same tables
def _stream(d, name):
    """The table's files as they land, whether it is one file or a folder of part files."""
    schema = d.table(name).schema
    # a pattern, as a stream takes a plain path for a folder
    return d.spark.readStream.schema(schema).parquet(f"{d.folder}/{name}.parque[t]")


@query("stream_history", f"""WITH k AS (SELECT id, {KEY_SQL} AS key, published_at AS t FROM (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE {AS_OF_SQL} - INTERVAL 1 MINUTE * (doc_id % 20000 * 113) END AS published_at FROM documents) q),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM k WHERE key <> '') z WHERE n = 1)
SELECT id FROM f WHERE t IS NULL OR t >= {AS_OF_SQL} - INTERVAL 62 DAY""")
def stream_history(d):
    """Documents as a stream, accumulated batch by batch; the table is then read."""
    docs = _stream(d, "documents")
    items = docs.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                        F.lit(None).cast("string").alias("url"),
                        F.when(F.col("doc_id") % 11 != 0, d.as_of - F.make_interval(mins=(F.col("doc_id") % 20000 * 113).cast("int"))).alias("published_at"))
    root = run_folder(d, "history")
    table = ingest.HistoryTable(d.spark, f"{root}/table")
    ingest.accumulate(items, table, f"{root}/progress", [F.col("id")]).awaitTermination()
    return table.read(d.as_of, 62).select("id")


@query("stream_repeats", "SELECT count(DISTINCT concat(user_id, '|', event_type)) AS kept FROM events")
def stream_repeats(d):
    """Repeat suppression on the event stream; the watermark spans the whole table."""
    events = _stream(d, "events").select(F.col("ts").cast("timestamp").alias("published_at"),
                                         F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("title"))
    root = run_folder(d, "repeats")
    q = ingest.suppress_repeats(events, keep_for="1000 hours", key=F.col("title")).writeStream.format("parquet") \
        .option("path", f"{root}/table").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return d.spark.read.parquet(f"{root}/table").agg(F.count("*").alias("kept"))
