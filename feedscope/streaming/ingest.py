"""Continuous ingest: the batch plans inside Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.titles import title_key
from ..operators.dedup import first_per_key
from ..plans import fixed_values as V, history as H, run as R
from ..session import cut_lineage
from .store import Manifest


def suppress_repeats(stream: DataFrame, ts: str = "published_at", keep_for: str = "504 hours",
                     key: Column | None = None) -> DataFrame:
    """Drop items whose title key was seen while the watermark still remembers it.

    The state is bounded by the widest source window.
    """
    keyed = stream.withColumn("_key", key if key is not None else title_key("title"))
    return keyed.withWatermark(ts, keep_for).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def snapshot_counts(events: DataFrame, ts: str = "ts", site: str = "site_id", late: str = "1 hour",
                    width: str = "30 minutes") -> DataFrame:
    """Tumbling buckets per source with a watermark; works on a stream and on a table."""
    t = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return t.groupBy(F.window("_ts", width)["start"].alias("snap"), site).agg(F.count("*").alias("n"),
                                                                           F.sum("value").alias("total"))


class HistoryTable:
    """Append-only history.  Each micro-batch adds the rows with new keys as a folder, and a manifest lists the folders.

    Keys lie apart from the rows in ``buckets`` by their hash, and the manifest says which buckets a folder has: a batch reads
    the keys of its own buckets only.  ``compact`` puts older folders together.

    A batch that runs again replaces its own folder in the manifest and never looks at later ones of its stream, so a restart
    changes nothing.  A stream with another checkpoint counts its batches from 0 again and adds to what others stored.
    Retention is a filter of the reader; derived fields are recomputed on reading, so stored rows are never rewritten.
    """

    def __init__(self, spark: SparkSession, root: str, key: Column | None = None, buckets: int = 64, compact_after: int = 32):
        self.spark, self.root = spark, root.rstrip("/")
        self.key = key if key is not None else H.merge_key()
        self.buckets, self.compact_after = buckets, compact_after
        self.manifest = Manifest(spark, f"{self.root}/manifest")

    def entries(self) -> list[dict]:
        """One entry per folder: stream, batch, folder and its buckets; folders that only wait for removal are left out."""
        return [e for e in self.manifest.read()[1] if not e.get("gone")]

    def known_keys(self, buckets: list[int], entries: list[dict]) -> DataFrame | None:
        """Key and time of the stored rows in these buckets; no other file is read."""
        paths = [f"{self.root}/keys/{e['folder']}/bucket={b}" for e in entries for b in sorted(set(buckets) & set(e["buckets"]))]
        return self.spark.read.schema("_key string, _time timestamp").parquet(*paths) if paths else None

    def append(self, batch: DataFrame, batch_id: int, order: list[Column], as_of: Column | None = None,
               days: int = V.RETENTION_DAYS, stream: str = "") -> DataFrame:
        """Add a micro-batch of a stream and return the rows it added.

        With ``as_of``, stored rows that have aged out no longer count as known.  Only the numbers of the batch's buckets
        reach the driver.
        """
        keyed = batch.withColumn("_key", self.key).where(F.col("_key").isNotNull())
        times = [c for c in ("published_at", "first_seen_at") if c in batch.columns]
        keyed = keyed.withColumn("_time", F.coalesce(*times) if times else F.lit(None).cast("timestamp")) \
                     .withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int"))
        fresh = cut_lineage(first_per_key(keyed, ["_key"], order))
        buckets = [r[0] for r in fresh.select("_bucket").distinct().collect()]
        earlier = [e for e in self.entries() if e["stream"] != stream or e["batch"] < batch_id]
        known = self.known_keys(buckets, earlier)
        if known is not None:
            if as_of is not None:
                known = known.where(F.col("_time").isNull() | (F.col("_time") >= as_of - F.make_interval(days=F.lit(days))))
            # keys are unique in the batch, so this shuffles evenly
            fresh = fresh.join(known.select("_key").distinct(), "_key", "left_anti")
        entry = self._store(fresh, stream, batch_id)
        self.manifest.change(lambda old: [self._left(e, stream, batch_id) for e in old] + [entry])
        if len(self.entries()) > self.compact_after:
            self.compact(as_of, days)
        return self._rows([entry])

    @staticmethod
    def _left(entry: dict, stream: str, batch_id: int) -> dict:
        return entry | {"gone": True} if (entry["stream"], entry["batch"]) == (stream, batch_id) else entry

    def _store(self, rows: DataFrame, stream: str, batch_id: int) -> dict:
        folder = f"{stream or 'all'}-{max(batch_id, 0)}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/rows/{folder}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.root}/rows/{folder}")
        keys = stored.select("_key", "_time", F.col("_bucket").alias("bucket"))
        keys.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/keys/{folder}")
        buckets = sorted(r[0] for r in stored.select("_bucket").distinct().collect())
        return {"stream": stream, "batch": batch_id, "folder": folder, "buckets": buckets}

    def compact(self, as_of: Column | None = None, days: int = V.RETENTION_DAYS) -> None:
        """Put all folders but each stream's newest, which may run again, into one; with ``as_of`` without aged-out rows.

        Replaced folders stay until the next time, for readers that have begun.
        """
        entries = self.manifest.read()[1]
        live = [e for e in entries if not e.get("gone")]
        newest = {}
        for e in live:
            newest[e["stream"]] = max(newest.get(e["stream"], -1), e["batch"])
        old = [e for e in live if e["batch"] < 0 or e["batch"] < newest[e["stream"]]]
        if len(old) < 2:
            return
        rows = self._rows(old, whole=True)
        if as_of is not None:
            rows = rows.where(F.col("_time").isNull() | (F.col("_time") >= as_of - F.make_interval(days=F.lit(days))))
        base = self._store(rows.repartition("_bucket"), "", -1)
        merged, waiting = {e["folder"] for e in old}, {e["folder"] for e in entries if e.get("gone")}
        self.manifest.change(lambda now: [e | {"gone": True} if e["folder"] in merged else e for e in now
                                          if e["folder"] not in waiting] + [base])
        for folder in waiting:
            for part in ("rows", "keys"):
                self.manifest.delete_folder(f"{self.root}/{part}/{folder}")

    def _rows(self, entries: list[dict], whole: bool = False) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/rows/{e['folder']}" for e in entries])
        return rows if whole else rows.drop("_key", "_time", "_bucket")

    def read(self, as_of: Column, days: int) -> DataFrame:
        return H.retained(self._rows(self.entries()), as_of, days)


def accumulate(stream: DataFrame, table: HistoryTable, checkpoint: str, order: list[Column],
               prepare=lambda batch: batch, as_of: Column | None = None) -> StreamingQuery:
    """Clean, score and append every micro-batch, then stop when the landed files are used up."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # Spark keeps this id in the checkpoint: equal after a restart, new with a new checkpoint
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        table.append(prepare(batch), batch_id, order, as_of, stream=stream_id)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
                 .trigger(availableNow=True).start()


class FeedStream:
    """The whole run inside a stream: ``archive`` holds every item once, ``history`` the relevant ones in their window,
    scored, and ``late`` those that came after the window of their source's class."""

    def __init__(self, spark: SparkSession, root: str, sites: DataFrame, side: R.SideTables, as_of: Column, order: list[Column],
                 containment_only: bool = False):
        self.archive = HistoryTable(spark, f"{root}/archive", key=title_key("title"))
        self.history = HistoryTable(spark, f"{root}/history")
        self.spark, self.late_root = spark, f"{root}/late"
        self.sites, self.side, self.as_of, self.order, self.containment_only = sites, side, as_of, order, containment_only

    def process(self, batch: DataFrame, batch_id: int, stream: str = "") -> None:
        """One micro-batch; running it again changes nothing."""
        fresh = self.archive.append(batch, batch_id, self.order, stream=stream)
        kept, late = R.feed(fresh, self.sites, self.side, self.as_of, containment_only=self.containment_only)
        late.write.mode("overwrite").parquet(f"{self.late_root}/stream={stream or 'all'}/batch={batch_id}")
        self.history.append(kept, batch_id, self.order, self.as_of, stream=stream)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Process all files that have landed, then stop."""
        def write(batch: DataFrame, batch_id: int) -> None:
            self.process(batch, batch_id, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def late(self) -> DataFrame:
        return self.spark.read.option("basePath", self.late_root).parquet(self.late_root).drop("stream", "batch")

    def read(self, days: int = V.RETENTION_DAYS) -> DataFrame:
        return self.history.read(self.as_of, days)
