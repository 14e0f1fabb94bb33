"""The whole run over the documents, as a batch and as a stream of three landings with restarts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.titles import strip_title_suffix
from ..plans import run as R
from ..streaming.ingest import FeedStream
from .base import AS_OF_SQL, chain, query, run_folder
from .cleaning import KEY_SQL, SIM_NOISE, strip_rounds

# landings come by id % 3; every second item has a URL of its own
RAW = """SELECT id, CAST(id % 3 AS BIGINT) * 1000000000000 + id AS arrival, site_id, CASE WHEN id % 5 = 0 THEN concat(title, ' - EPA') ELSE title END AS title, summary,
  CASE WHEN id % 2 = 0 THEN concat(url, 'i', CAST(id AS VARCHAR(20))) ELSE url END AS url, published_at, lang FROM {items}"""
SIDE = {
    "titles": "SELECT url, concat(title, ' full text') AS title, id FROM ({raw}) q WHERE id % 4 = 0",
    "summaries": "SELECT url, concat('Sum ', CAST(id AS VARCHAR(20))) AS summary FROM ({raw}) q WHERE id % 18 = 0",
    "published": "SELECT url, '2024-01-20 08:00' AS published FROM ({raw}) q WHERE id % 22 = 0",
}
SHOWN = ["id", "title", "title_zh", "summary", "published_at", "time_source", "dimension", "region", "score", "score_level"]


def _side(d) -> R.SideTables:
    side = {name: d.sql(text.format(raw=RAW)) for name, text in SIDE.items()}
    full = side["titles"].where("id % 8 = 0").select(strip_title_suffix("title").alias("title"), F.concat(F.lit("全"), F.col("id").cast("string")).alias("title_zh"))
    own = d.sql(RAW).where("id % 6 = 0").groupBy(strip_title_suffix("title").alias("title")).agg(F.concat(F.lit("译"), F.min("id").cast("string")).alias("title_zh"))
    return R.SideTables(**{k: v.drop("id") for k, v in side.items()}, translations=own.unionByName(full))


def _result(kept, late):
    shown = [*SHOWN, F.array_join("topics", ",").alias("topics"), F.array_join("people", ",").alias("people")]
    rows = kept.select(*shown).withColumn("late", F.lit(False))
    gone = late.select("id", F.lit(True).alias("late"))
    return rows.unionByName(gone, allowMissingColumns=True)


_RAW = RAW.replace("{items}", "items")
_TITLES = SIDE["titles"].format(raw=_RAW)
FULL_RUN_SQL = f"""WITH r AS ({_RAW}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY arrival) AS n FROM r) q WHERE n = 1),
st AS MATERIALIZED ({strip_rounds(f"SELECT id, title AS raw FROM r UNION ALL SELECT -id - 1, title FROM ({_TITLES}) t")}),
tr AS (SELECT title, max(zh) AS zh FROM (SELECT r AS title, concat('译', min(id)) AS zh FROM st WHERE id >= 0 AND id % 6 = 0 GROUP BY 1 UNION ALL
  SELECT r, concat('全', -id - 1) FROM st WHERE id < 0 AND (-id - 1) % 8 = 0) q GROUP BY 1),
cl AS (SELECT o.* EXCLUDE (title, n), st.r AS title, {AS_OF_SQL} AS first_seen_at FROM o JOIN st USING (id)),
{chain("cl", "_c")},
rel AS (SELECT c.id, arrival, site_id, c.title, summary, url, published_at, first_seen_at, lang, window_hours FROM classified_c c WHERE relevant),
late AS (SELECT * FROM rel WHERE published_at < {AS_OF_SQL} - INTERVAL 1 HOUR * window_hours),
ins AS (SELECT * FROM rel WHERE id NOT IN (SELECT id FROM late)),
ft AS (SELECT q.url, max(st.r) AS ft FROM (SELECT url, -id - 1 AS k FROM ({_TITLES}) t) q JOIN st ON st.id = q.k GROUP BY 1),
f1 AS (SELECT i.*, ft, lower(regexp_replace(i.title, '{SIM_NOISE}', '', 'g')) AS a, lower(regexp_replace(ft, '{SIM_NOISE}', '', 'g')) AS b FROM ins i LEFT JOIN ft USING (url)),
f2 AS (SELECT *, CASE WHEN length(ft) > length(title) AND a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) THEN ft ELSE title END AS t2 FROM f1),
f3 AS (SELECT f2.* EXCLUDE (title, summary, published_at), t2 AS title, CASE WHEN f2.summary <> '' THEN f2.summary WHEN f2.id % 18 = 0 THEN concat('Sum ', f2.id) ELSE '' END AS summary,
  coalesce(f2.published_at, CASE WHEN f2.id % 22 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' END, {AS_OF_SQL}) AS published_at,
  CASE WHEN f2.published_at IS NOT NULL OR f2.id % 22 = 0 THEN 'published' ELSE 'scraped' END AS time_source,
  CASE WHEN t2 <> f2.title AND regexp_matches(t2, '[A-Za-z]') AND NOT regexp_matches(t2, '[\\x{{4e00}}-\\x{{9fff}}]') AND y.zh IS NOT NULL THEN y.zh
       WHEN regexp_matches(f2.title, '[A-Za-z]') AND NOT regexp_matches(f2.title, '[\\x{{4e00}}-\\x{{9fff}}]') THEN coalesce(x.zh, '') ELSE '' END AS title_zh
  FROM f2 LEFT JOIN tr x ON x.title = f2.title LEFT JOIN tr y ON y.title = t2),
f4 AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN {KEY_SQL} <> '' THEN concat('t', {KEY_SQL}) ELSE concat('u', url) END ORDER BY arrival) AS k FROM f3) q WHERE k = 1),
{chain("f5", "_f")}
SELECT {", ".join(c for c in SHOWN)}, array_to_string(topics, ',') AS topics, array_to_string(people, ',') AS people, FALSE AS late FROM scored_f
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM late""".replace(
    chain("f5", "_f"), "f5 AS (SELECT * EXCLUDE (window_hours, lang, ft, a, b, t2) FROM f4),\n" + chain("f5", "_f"))


@query("full_run", FULL_RUN_SQL)
def full_run(d):
    """Raw items to scored history, with the late ones beside it."""
    kept, late = R.full_run(d.sql(RAW), d.sites, _side(d), d.as_of, [F.col("arrival")], "arrival", containment_only=True)
    return _result(kept, late)


@query("stream_full_run", FULL_RUN_SQL)
def stream_full_run(d):
    """The same in three micro-batches: each landing is one, and the stream ends and starts again between them."""
    root = run_folder(d, "feed")
    raw = d.sql(RAW)
    run = FeedStream(d.spark, f"{root}/run", d.sites, _side(d), d.as_of, [F.col("arrival")], containment_only=True)
    stream = d.spark.readStream.schema(raw.schema).parquet(f"{root}/landed/*")
    for part in range(3):  # a landing has as many files as its rows need; all that are new make one micro-batch
        raw.where(F.col("id") % 3 == part).write.parquet(f"{root}/landed/{part}")
        run.start(stream, f"{root}/progress").awaitTermination()
    return _result(run.read(), run.late())
