"""MinHash near-dedup of documents by BagMinHash signatures of their word shingles.

A document is the multiset of its runs of five words, each weighted by its count.  Every shingle owns Poisson processes on
dyadic weight intervals [0, 1), [1, 2), [2, 4) ...; a point carries a signature place and a weight, and counts only if that
weight is below the shingle's count.  The first point at each place is the signature, whose equality has exactly the
probability of the weighted Jaccard similarity.  Points are drawn in order and stop at the latest signature value, so most
shingles draw one or two.  Bands of the signature block candidates; links are verified on the exact multisets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .links import block_groups

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
#: Bits of 64 in which sketches of linked documents may differ: 6.4 are expected at 0.8, 17 is over four deviations more.
SKETCH_BITS = 17
#: Buckets by hash in which the shingles are counted that a row lacks or has beside its centre's.
BUCKETS = 128
_STEP = C.U64(0x9E3779B97F4A7C15)


def bags(w: C.Words, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash (48 bits) and count of each distinct shingle, ordered by text and hash."""
    hashes, doc = w.shingles(shingle)
    key = np.sort(doc.astype(C.U64) << C.U64(48) | hashes >> C.U64(16))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    key, count = key[first], np.diff(np.r_[first, len(key)])
    return (key >> C.U64(48)).astype(np.int64), key & C.U64((1 << 48) - 1), count


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, places: int) -> np.ndarray:
    """BagMinHash signatures (n x places) of n bags given as ordered (doc, shingle, count)."""
    sig = np.full((n, places), np.inf)
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    each = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    length = np.maximum(low, 1.0)
    seed = C.mix(shingle[each] * _STEP + level.astype(C.U64))
    owner, weight = doc[each], count[each].astype(np.float64)
    time, step, flat = np.zeros(len(each)), 0, sig.reshape(-1)
    while len(owner):
        k = 1 if len(owner) > 4096 else 32
        draw = C.mix(seed[:, None] + (np.arange(step + 1, step + k + 1, dtype=C.U64) * _STEP)[None, :])
        gap = -np.log(((draw >> C.U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / length[:, None]
        gap[:, 0] += time
        at = np.cumsum(gap, axis=1)
        second = C.mix(draw ^ C.U64(0xD6E8FEB86659FD93))
        place = (second >> C.U64(40)).astype(np.int64) % places
        level_at = low[:, None] + (second & C.U64(0xFFFFFFFF)).astype(np.float64) * 2.0 ** -32 * length[:, None]
        ok = level_at < weight[:, None]
        np.minimum.at(flat, (owner[:, None] * places + place)[ok], at[ok])
        time, step = at[:, -1], step + k
        left = time < sig.max(axis=1)[owner]
        owner, seed, low, length, weight, time = (x[left] for x in (owner, seed, low, length, weight, time))
    return sig


def _marks(sig: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (n x bands) and 64-bit sketches of signatures."""
    bits = C.mix(sig.view(C.U64))
    keys = np.zeros((len(sig), bands), C.U64)
    for r in range(rows):
        keys = C.mix(keys * _STEP + bits[:, r:bands * rows:rows])
    keys = C.mix(keys + np.arange(1, bands + 1, dtype=C.U64)[None, :])
    low = (bits[:, :64] & C.U64(1)) << np.arange(64, dtype=C.U64)[None, :]
    return keys.view(np.int64), np.bitwise_or.reduce(low, axis=1).view(np.int64)


def signed(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, _row, two halves of a digest of the whole text, its band hashes and its sketch."""
    def run(batch: pa.RecordBatch):
        for part in C.slices(batch):
            w = C.Words(part.column("text"))
            keys, sketch = _marks(signatures(*bags(w, shingle), part.num_rows, bands * rows), bands, rows)
            digest = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest()
                                            for t in C.texts(part.column("text"))), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("_row"), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                 pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.reshape(-1)),
                 pa.array(sketch)], names=["doc_id", "_row", "d1", "d2", "keys", "sketch"])
    return C.by_arrow(docs.select(*C.doc_key(), "text"), run,
                      "doc_id long, _row long, d1 long, d2 long, keys array<long>, sketch long")


def _with_bags(docs: DataFrame, reps: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """Pairs (a, b) of representatives with their bags x and y: 64-bit numbers, a shingle's hash and its count in turn."""
    def bag_of(batch: pa.RecordBatch):
        for part in C.slices(batch):
            doc, key, count = bags(C.Words(part.column("text")), shingle)
            cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
            both = np.stack([key.view(np.int64), count], 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([both[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                names=["id", "bag"])
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct() \
                  .join(reps.select("id", "doc_id", "_row"), "id")
    held = C.table(C.by_arrow(docs.select(*C.doc_key(), "text").join(needed, ["doc_id", "_row"]).select("id", "text"),
                              bag_of, "id long, bag binary").dropDuplicates(["id"]))
    return pairs.join(held.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a") \
                .join(held.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b").select("a", "b", "x", "y")


def _bags_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Both bags of each pair and the places of their common shingles."""
    for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
        x, y = (np.frombuffer(v, np.int64).reshape(-1, 2) for v in (x, y))
        _, i, j = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
        yield x, y, i, j


def verifier(docs: DataFrame, reps: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD):
    """Keeps pairs of representatives whose multisets of shingles overlap enough: sum of minima over sum of maxima."""
    def overlap(batch: pa.RecordBatch):
        ok = []
        for x, y, i, j in _bags_of(batch):
            least = np.minimum(x[i, 1], y[j, 1]).sum()
            ok.append(bool(least >= threshold * (x[:, 1].sum() + y[:, 1].sum() - least)))
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        return C.by_arrow(_with_bags(docs, reps, pairs, shingle), overlap, "a long, b long")
    return verify


def measurer(docs: DataFrame, reps: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD):
    """How representatives differ from centres, and which two of one centre can be linked.

    A row x lacks shingles of its centre c (weight m) and has others (weight d); ``s`` of d are shingles that another row
    of the centre has more often than c, too.  With n for the weight of c, two rows overlap by n - m - m' + w and make up
    n + d + d' - w, where w is what their differences share: at most min(m, m') + min(s, s'), and at most the sum of lesser
    counts over the buckets ``lacks`` and ``has``.  So no pair that reaches the threshold is left out, and copies with edits
    of their own make few pairs.
    """
    def differ(batch: pa.RecordBatch):
        n, m, d, more, counts, lacks, has = [], [], [], [], [], [], []
        for x, y, i, j in _bags_of(batch):
            over, under, least = x[:, 1].copy(), y[:, 1].copy(), np.minimum(x[i, 1], y[j, 1])
            over[i] -= least
            under[j] -= least
            n.append(int(y[:, 1].sum()))
            m.append(int(under.sum()))
            d.append(int(over.sum()))
            more.append(x[over > 0, 0])
            counts.append(over[over > 0])
            for out, bag, weight in ((lacks, y, under), (has, x, over)):
                out.append(np.bincount(bag[:, 0] % BUCKETS, weight, BUCKETS).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), *[pa.array(v, pa.int64()) for v in (n, m, d)],
             *[pa.array(v, pa.list_(pa.int64())) for v in (more, counts)],
             *[pa.array(v, pa.list_(pa.int32())) for v in (lacks, has)]],
            names=["id", "c", "n", "m", "d", "more", "counts", "lacks", "has"])

    def measure(pairs: DataFrame) -> DataFrame:
        found = C.table(C.by_arrow(
            _with_bags(docs, reps, pairs.select(F.col("id").alias("a"), F.col("c").alias("b")), shingle), differ,
            "id long, c long, n long, m long, d long, more array<long>, counts array<long>, lacks array<int>, has array<int>"))
        single = found.select("id", "c", F.explode(F.arrays_zip("more", "counts")).alias("e")) \
                      .groupBy("c", "e.more").agg(F.min("id").alias("id"), F.max("id").alias("_last"), F.sum("e.counts").alias("w")) \
                      .where(F.col("id") == F.col("_last")).groupBy("id", "c").agg(F.sum("w").alias("w"))
        rows = found.drop("more", "counts").join(single, ["id", "c"], "left") \
                    .withColumn("s", F.col("d") - F.coalesce("w", F.lit(0))).drop("w")
        return rows.where(F.col("s") >= threshold * (F.col("n") + F.col("d")) - F.col("n") + (1 - threshold) * F.col("m") - 1e-6)

    def may_link(x, y):
        needed = threshold * (x("n") + x("d") + y("d")) - x("n") + x("m") + y("m") - 1e-6

        def common(name):
            return F.aggregate(F.zip_with(x(name), y(name), lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda total, k: total + k)
        coarse = (1 + threshold) * (F.least(x("m"), y("m")) + F.least(x("s"), y("s"))) >= needed
        fine = (1 + threshold) * (common("lacks") + F.least(x("s"), y("s"), common("has"))) >= needed
        return F.when(coarse, fine).otherwise(F.lit(False))
    return measure, may_link


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """doc_id, _row, class_id, kept for every row: groups connected by a weighted Jaccard similarity of ``threshold``.

    ``class_id`` is the smallest doc_id of the group and ``kept`` marks it.  Copies are grouped by a digest first; one
    represents them.  Texts without words (null, empty) are equal to each other; a text shorter than a shingle is one
    shingle.  Equal rows stay or go together; among different texts with one doc_id in a group, one is kept.  Rows without a
    doc_id count as the greatest ids.
    """
    marks = C.table(signed(docs, shingle, bands, rows))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    reps = C.table(marks.groupBy("d1", "d2").agg(F.min_by(F.struct("doc_id", "_row", "keys", "sketch"), order).alias("r"))
                   .select("d1", "d2", "r.*").withColumn("id", F.monotonically_increasing_id()))
    members = reps.select(F.explode("keys").alias("key"), "id", "sketch")
    named_docs = docs.where("doc_id is not null")
    groups = block_groups(members, lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= SKETCH_BITS,
                          verifier(named_docs, reps, shingle, threshold), *measurer(named_docs, reps, shingle, threshold))
    named = C.table(reps.select("d1", "d2", "id", "doc_id", "_row").join(groups, "id", "left")
                    .withColumn("component", F.coalesce("component", "id")))
    heads = named.groupBy("component").agg(F.min_by(F.struct(F.col("doc_id").alias("class_id"), F.col("_row").alias("_head")),
                                                    order).alias("h")).select("component", "h.*")
    known = named.select("d1", "d2", "component").join(heads, "component").drop("component")
    return marks.select("doc_id", "_row", "d1", "d2").join(known, ["d1", "d2"]).select(
        "doc_id", "_row", "class_id",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("_row") == F.col("_head"))).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    kept = near_duplicates(docs, **settings).where("kept").select("doc_id", "_row").distinct()
    rows = C.whole_rows(docs).alias("x")
    same = F.col("x.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("x._row") == F.col("k._row"))
    return C.unfolded(rows.join(kept.alias("k"), same, "left_semi"), docs)
