"""Substring dedup: winnowed anchors seed matches, which are extended to whole windows on both sides.

Each window of ``window`` words is owned by the leftmost smallest hash among its runs of ``seed`` words (its anchor), so
equal windows have equal anchors at equal offsets.  An occurrence of an anchor stands for the row of windows it owns.
Occurrences whose whole extent (all owned windows, both sides) is equal form a class.  Classes whose anchor lies in one
document only are dropped.  Inside a class every document but the first repeats all owned windows; only the first one of
classes that meet others at the same anchor, where a repeat begins or ends inside the extent, is compared window by window.
Rows thus grow with the number of anchors, never with pairs of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common as C

WINDOW = 50
SEED = 16


def _extents(w: C.Words, window: int, seed: int):
    """Anchors of a batch: text, anchor hash, class hash, place of the anchor, first and last window owned."""
    n = len(w.hashes)
    if n < window:
        return None
    sums = C.prefix(w.hashes)
    at = np.arange(n - seed + 1)
    gram = C.span(sums, at, at + seed)
    width, best, step = window - seed + 1, at, 1
    while step * 2 <= width:
        a, b = best[:len(best) - step], best[step:]
        best = np.where(gram[a] <= gram[b], a, b)
        step *= 2
    rest = width - step
    if rest:
        a, b = best[:len(best) - rest], best[rest:]
        best = np.where(gram[a] <= gram[b], a, b)
    doc = w.doc
    s = np.arange(n - window + 1)
    s = s[s + window <= w.first[doc[s] + 1]]
    if not len(s):
        return None
    owner = best[s]
    cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(doc[s]) != 0))
    lo, hi = s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]]
    anchor, doc = owner[np.r_[0, cut + 1]], doc[lo]
    kind = C.mix(C.span(sums, lo, hi + window) + (anchor - lo).astype(C.U64))
    first = w.first[doc]
    return doc, gram[anchor].view(np.int64), kind.view(np.int64), anchor - first, lo - first, hi - first


def anchors(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, _row, anchor, kind, place, lo, hi of every anchor of every text."""
    schema = "doc_id long, _row long, anchor long, kind long, place int, lo int, hi int"

    def find(batch: pa.RecordBatch):
        for part in C.slices(batch):
            found = _extents(C.Words(part.column("text")), window, seed)
            if found:
                doc, anchor, kind, *places = found
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), part.column("_row").take(pa.array(doc)),
                     pa.array(anchor), pa.array(kind), *(pa.array(p.astype(np.int32)) for p in places)],
                    names=["doc_id", "_row", "anchor", "kind", "place", "lo", "hi"])
    return C.by_arrow(docs.select(*C.doc_key(), "text"), find, schema)


def _windows(docs: DataFrame, extents: DataFrame, window: int) -> DataFrame:
    """One row per window of the given extents: anchor, offset of the anchor, hash of the words, doc_id, _row, start."""
    lists = extents.groupBy("doc_id", "_row").agg(F.collect_list(F.struct("anchor", "place", "lo", "hi")).alias("at"))
    joined = docs.select(*C.doc_key(), "text").join(lists, ["doc_id", "_row"])

    def cut(batch: pa.RecordBatch):
        for part in C.slices(batch):
            w = C.Words(part.column("text"))
            sums, at = C.prefix(w.hashes), part.column("at")
            per = np.diff(at.offsets.to_numpy())
            rows = at.flatten()
            doc = np.repeat(np.arange(len(per)), per)
            anchor, place, lo, hi = (rows.field(i).to_numpy() for i in range(4))
            many = (hi - lo + 1).astype(np.int64)
            each = np.repeat(np.arange(len(many)), many)
            start = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            begin = w.first[doc[each]] + start
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[each]), pa.array((place[each] - start).astype(np.int32)),
                 pa.array(C.span(sums, begin, begin + window).view(np.int64)),
                 part.column("doc_id").take(pa.array(doc[each])), part.column("_row").take(pa.array(doc[each])),
                 pa.array(start.astype(np.int32))],
                names=["anchor", "offset", "words", "doc_id", "_row", "start"])
    return C.by_arrow(joined, cut, "anchor long, offset int, words long, doc_id long, _row long, start int")


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, _row, lo, hi: rows of windows [lo, hi] that also start in a document with a smaller doc_id."""
    found = C.table(anchors(docs, window, seed))
    # aggregates are written before they are joined: a join of two plain inputs can split an anchor with very many places
    known = found.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"),
                                        (F.min("kind") < F.max("kind")).alias("mixed"))
    shared = C.table(found.join(C.table(known.where("_a < _b").select("anchor", "mixed")), "anchor"))
    firsts = C.table(shared.groupBy("anchor", "kind").agg(F.min("doc_id").alias("first")))
    judged = shared.join(firsts, ["anchor", "kind"])
    whole = judged.where("first < doc_id").select("doc_id", "_row", "lo", "hi")
    open_ = judged.where("first = doc_id and mixed").select("doc_id", "_row", "anchor", "place", "lo", "hi")
    windows = C.table(_windows(docs, open_, window))
    same = ["anchor", "offset", "words"]
    early = C.table(windows.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                    .where("first < last").drop("last"))
    part = windows.join(early, same).where("first < doc_id") \
                  .select("doc_id", "_row", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return whole.unionByName(part)


def _cut(text: str | None, spans: list | None, window: int) -> tuple[str, int, int]:
    """The words outside the spans joined by one space, the number of words and of those removed."""
    words = C.WORD.findall(text or "")
    n = len(words)
    if spans:
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, np.array([s["lo"] for s in spans]), 1)
        np.add.at(covered, np.array([s["hi"] for s in spans]) + window, -1)
        gone = np.cumsum(covered)[:-1] > 0
        words = [x for x, g in zip(words, gone.tolist()) if not g]
    return " ".join(words), n, n - len(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, text, kept, n_words, n_removed for every row of ``docs``.

    ``kept`` holds the words that no repeated window covers, joined by one space (null text: none, '').  Windows are
    judged on the input.  Rows with a null doc_id keep all words and are nobody's earlier document.  Rows with one
    doc_id never repeat each other.  Other columns are ignored.
    """
    spans = repeats(docs, window, seed).groupBy("doc_id", "_row") \
        .agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = docs.select(*C.doc_key(), "text").join(spans, ["doc_id", "_row"], "left")

    def cut(batch: pa.RecordBatch):
        found = [_cut(t, s, window) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        kept, n_words, n_removed = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()),
             pa.array(n_removed, pa.int64())], names=["doc_id", "text", "kept", "n_words", "n_removed"])
    return C.by_arrow(joined, cut, "doc_id long, text string, kept string, n_words long, n_removed long")


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with all their columns; a text that holds repeats becomes its kept words joined by one space."""
    spans = repeats(docs, window, seed).groupBy("doc_id", "_row") \
        .agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    joined = C.whole_rows(docs).join(spans, ["doc_id", "_row"], "left").select("text", "_all", "_spans")

    def cut(batch: pa.RecordBatch):
        kept = [_cut(t, s, window)[0] if s else t
                for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("_all"), pa.array(kept, pa.string())], names=["_all", "kept"])
    schema = StructType([joined.schema["_all"], StructField("kept", StringType())])
    return C.unfolded(C.by_arrow(joined, cut, schema), docs, F.col("kept"))


#: DuckDB twin of the query: every window as text, its first document, and the words that later copies cover.
ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT k, doc_id, i, array_to_string(words[i:i + 49], ' ') AS run FROM (SELECT k, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50) q),
f AS (SELECT run, min(doc_id) AS first FROM s GROUP BY run HAVING count(*) > 1),
c AS (SELECT DISTINCT k, unnest(range(i, i + 50)) AS j FROM s JOIN f USING (run) WHERE first < doc_id),
g AS (SELECT k, list(j) AS gone FROM c GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN g USING (k)
"""
