"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

BINS = 512
BITS = 4
SHINGLE = 5
EMPTY = np.iinfo(np.uint64).max
ROUNDS = 4096
#: Full bins up to which the lender of each empty bin is looked up instead of drawn for.
FEW = 96


def _draws(bins: int) -> np.ndarray:
    """For each attempt and each empty bin the bin that is drawn: a fixed hash of the two."""
    attempt, col = np.arange(ROUNDS)[:, None], np.arange(bins)[None, :]
    return (C.mix((col * ROUNDS + attempt + 1).astype(C.U64)) % C.U64(bins)).astype(np.int32)


@lru_cache(maxsize=4)
def _draw_tables(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The draws, and by lending and empty bin the attempt that first draws the lender (``ROUNDS``: none does)."""
    draws = _draws(bins)
    first = np.full((bins, bins), ROUNDS, np.int32)
    for attempt in range(ROUNDS - 1, -1, -1):
        first[draws[attempt], np.arange(bins)] = attempt
    return draws, first


def _densify(sketch: np.ndarray) -> None:
    """Fill each empty bin from a bin drawn by a fixed hash of (bin, attempt), until a full one is met.

    After ``ROUNDS`` attempts, which only nearly empty sketches need, the next full bin to the right lends its value.
    Sketches with few full bins would need many attempts a bin: of theirs the full bin that is drawn first is looked up.
    """
    bins = sketch.shape[1]
    draws, first = _draw_tables(bins)
    full = sketch != EMPTY
    held = full.sum(1)
    for r in np.flatnonzero((held > 0) & (held <= FEW)).tolist():
        near, empty = np.flatnonzero(full[r]), np.flatnonzero(~full[r])
        at = first[near][:, empty]
        lender = near[at.argmin(0)]
        never = at.min(0) == ROUNDS
        lender[never] = near[np.searchsorted(near, empty[never]) % len(near)]
        sketch[r, empty] = sketch[r, lender]
    row, col = np.nonzero(~full & (held > FEW)[:, None])
    for attempt in range(ROUNDS):
        if not len(row):
            return
        source = draws[attempt, col]
        hit = full[row, source]
        sketch[row[hit], col[hit]] = sketch[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row.tolist(), col.tolist()):
        near = np.flatnonzero(full[r])
        sketch[r, c] = sketch[r, near[np.searchsorted(near, c) % len(near)]]


def sketches(column: pa.Array, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> np.ndarray:
    """Low-order bits of one minimum per bin, a row of small integers per text.

    A text with fewer words than a shingle is one shingle; a text without words has that of no words.
    """
    hashes, doc = C.Words(column).shingles(shingle)
    hashes = C.mix(hashes ^ C.U64(0x5851F42D4C957F2D))
    at = doc * bins + (hashes >> C.U64(32)).astype(np.int64) % bins
    flat = np.full(len(column) * bins, EMPTY, C.U64)
    np.minimum.at(flat, at, C.mix(hashes) >> C.U64(1))
    sketch = flat.reshape(len(column), bins)
    _densify(sketch)
    # each bin reads other bits, so that one value lent to many bins cannot agree with another in all of them by chance
    sketch = C.mix(sketch + np.arange(1, bins + 1, dtype=C.U64) * C.U64(0x9E3779B97F4A7C15))
    return (sketch & C.U64((1 << bits) - 1)).astype(np.uint8)


def packed(sketch: np.ndarray, bits: int = BITS) -> list[str]:
    """The rows' bits, packed and written as base64."""
    planes = (sketch[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    rows = np.packbits(planes.reshape(len(sketch), -1).astype(np.uint8), axis=1, bitorder="little")
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def unpacked(fingerprint: str, bits: int = BITS) -> np.ndarray:
    raw = np.unpackbits(np.frombuffer(base64.b64decode(fingerprint), np.uint8), bitorder="little")
    return (raw.reshape(-1, bits) << np.arange(bits, dtype=np.uint8)).sum(1).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Share of equal bins, less the share that equal low-order bits give by chance, within 0 and 1."""
    chance = 0.5 ** bits
    return np.clip(((a == b).mean(axis=-1) - chance) / (1 - chance), 0.0, 1.0)


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint of every text (null: empty).  Equal texts have equal fingerprints."""
    def run(batch: pa.RecordBatch):
        for part in C.slices(batch):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(packed(sketches(part.column("text"), bins, bits, shingle), bits))],
                names=["doc_id", "fingerprint"])
    return C.by_arrow(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


# ------------------------------------------------------------------ each document and the next one
def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows of ``docs`` dealt to ranges of doc_id, each range with the first row of the range below it.

    Columns: _range, _extra (true for the lent row), doc_id, text.  Only one number of rows, the least and the greatest
    id of each range reach the driver.  Rows are ordered by descending doc_id, nulls last, equal ids by text; after the
    last row comes the first.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).first()[0]
    marks = sorted(set(marks or []))
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(F.array(*[F.lit(m).cast("long") for m in marks]), lambda m: m < F.col("doc_id")))
        if marks else F.lit(0))
    ranged = docs.withColumn("_range", at)
    # the range above lends from the first row of each range: its greatest id, of equal ids the least text
    rows = ranged.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()
    if not rows:
        return ranged.withColumn("_extra", F.lit(False))
    places = sorted(r["_range"] for r in rows)
    top = {r["_range"]: r["top"] for r in rows}
    above = {p: places[(i + 1) % len(places)] for i, p in enumerate(places)}
    first = F.create_map(*[F.lit(x) for p in places for x in (p, top[p] if top[p] is not None else -1)])
    to = F.create_map(*[F.lit(x) for p in places for x in (p, above[p])])
    lend = F.coalesce(F.col("doc_id"), F.lit(-1)) == F.element_at(first, F.col("_range"))
    own = F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_extra"))
    lent = F.struct(F.element_at(to, F.col("_range")).alias("_range"), F.lit(True).alias("_extra"))
    return ranged.withColumn("_to", F.explode(F.when(lend, F.array(own, lent)).otherwise(F.array(own)))) \
                 .select("_to.*", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE,
                        ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text, of the same text with its second half taken from the next one, and their likeness.

    The next document has the next smaller doc_id; after the last one comes the first.  Null texts are empty, rows with
    equal ids follow each other by text, and a null id is the smallest.
    """
    spread = with_next(docs, ranges)
    dealt = spread.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_range") \
        .sortWithinPartitions("_range", "_extra", F.col("doc_id").desc_nulls_last(), "text")

    def rows(batches):
        for b in batches:
            yield from zip(b.column("_range").to_pylist(), b.column("_extra").to_pylist(),
                           b.column("doc_id").to_pylist(), b.column("text").to_pylist())

    def emit(todo: list[tuple]) -> pa.RecordBatch:
        """todo: (doc_id, text, next text)."""
        ids, own, after = zip(*todo)
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(own, after)]
        # the next text is mostly the next row's own, and drawn once
        place = {t: k for k, t in enumerate(dict.fromkeys([*own, *after]))}
        drawn = sketches(pa.array(list(place), pa.large_string()), bins, bits, shingle)
        a, c = (drawn[[place[t] for t in x]] for x in (own, after))
        b = sketches(pa.array(edited, pa.large_string()), bins, bits, shingle)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(packed(a, bits)),
             pa.array(packed(b, bits)), pa.array(likeness(a, b, bits)), pa.array(likeness(a, c, bits))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        todo, size, last, done = [], 0, None, set()
        for place, extra, doc_id, text in rows(batches):
            if last is not None and last[0] == place:
                if extra and place in done:
                    continue
                todo.append((last[1], last[2], text))
                size += len(last[2])
            if extra:
                done.add(place)
                last = None
            else:
                last = (place, doc_id, text)
            if size > C.SLICE_BYTES or len(todo) >= C.BATCH_ROWS:
                yield emit(todo)
                todo, size = [], 0
        if todo:
            yield emit(todo)
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
