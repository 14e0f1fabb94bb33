"""Token ids in wavelet-matrix shards: bit planes with rank and select support.

A shard is a run of consecutive documents in ascending doc_id order with about ``SHARD_TOKENS`` ids.  It is one row of
a Parquet file, so that any store Spark writes to can hold it: the documents' ids and lengths, and one compressed plane
per bit of the ids, most significant first.  Each plane has the bits in the order the plane above has left, and the number
of ones before every 512th bit.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_root
from . import common as C

SHARD_TOKENS = 1 << 20
BLOCK = 512
END_ID = 1
SCHEMA = "part int, number int, start long, n_tokens long, width int, doc_ids binary, lengths binary, planes array<binary>"


def _build(ids: np.ndarray, width: int) -> list[bytes]:
    out = []
    for bit in range(width - 1, -1, -1):
        ones = ((ids >> np.uint32(bit)) & np.uint32(1)).astype(bool)
        bits = np.packbits(ones, bitorder="little")
        padded = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        counts = np.bitwise_count(padded.reshape(-1, 64)).sum(1, dtype=np.uint32)
        before = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        out.append(zlib.compress(before.tobytes() + bits.tobytes(), 1))
        ids = np.concatenate([ids[~ones], ids[ones]])
    return out


class Wavelet:
    """A shard's ids, read from its planes."""

    def __init__(self, n: int, planes: list[bytes]):
        self.n, self.planes, self.before = n, [], []
        blocks = -(-n // BLOCK) + 1
        for p in planes:
            raw = zlib.decompress(p)
            self.before.append(np.frombuffer(raw, "<u4", blocks))
            self.planes.append(np.frombuffer(raw, np.uint8, -(-n // 8), blocks * 4))
        self.zeros = [n - int(b[-1]) for b in self.before]

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, bits = i // BLOCK, self.planes[level]
        count = int(self.before[level][block]) + int(np.bitwise_count(bits[block * 64:i >> 3]).sum())
        return count + ((int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(len(self.planes)):
            one, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | one
            i = self.zeros[level] + ones if one else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi, top = 0, i, len(self.planes) - 1
        for level in range(top + 1):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (top - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often a token stands among the first i places."""
        if token < 0 or token >> len(self.planes):
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, level: int, one: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane: block by its counts, then bits inside it."""
        before = self.before[level].astype(np.int64)
        if not one:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * 64:(block + 1) * 64], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of a token's k-th occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if token >> len(self.planes) or not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            i = self._find(level, one, i - self.zeros[level] if one else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids: the planes' stable partitions undone from the last to the first."""
        value = np.zeros(self.n, np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            out = np.empty(self.n, np.uint32)
            out[~ones] = value[:self.zeros[level]]
            out[ones] = value[self.zeros[level]:] | np.uint32(1 << (len(self.planes) - 1 - level))
            value = out
        return value


def write_shards(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID,
                 shard_tokens: int = SHARD_TOKENS, width: int = 16) -> str:
    """Write every document's ids and the end id in ascending doc_id order; returns the folder.

    Rows are dealt to ranges of doc_id; a task writes its range's shards one after the other, holding one shard only.
    Null texts are empty (the end id alone).  Null ids come first, equal ids by text.  ``width`` bits must hold the ids.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_root(spark).rstrip('/')}/feedscope/{uuid.uuid4().hex}"
    model = spark.sparkContext.broadcast(C.tokenizer_text(path))
    end = np.array([end_id], "<u4").tobytes()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(tasks, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")) \
                  .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        from pyspark import TaskContext
        part, number, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, held, size = [], [], 0

        def shard():
            ids = np.frombuffer(b"".join(held), "<u4")
            if len(ids) and int(ids.max()) >> width:
                raise ValueError(f"an id needs more than {width} bits")
            known = pa.array(doc_ids, pa.int64())
            lengths = np.array([len(h) // 4 for h in held], "<u4")
            return pa.RecordBatch.from_pylist([{
                "part": part, "number": number, "start": start, "n_tokens": len(ids), "width": width,
                "doc_ids": zlib.compress(known.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                                         + known.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), 1),
                "lengths": zlib.compress(lengths.tobytes(), 1), "planes": _build(ids, width)}],
                schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("start", pa.int64()),
                                  ("n_tokens", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.binary()),
                                  ("lengths", pa.binary()), ("planes", pa.list_(pa.binary()))]))
        for b in batches:
            for some in C.slices(b):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(),
                                       C.library_encoder(model.value)(C.texts(some.column("text")))):
                    doc_ids.append(doc_id)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= shard_tokens:
                        yield shard()
                        number, start = number + 1, start + size
                        doc_ids, held, size = [], [], 0
        if held:
            yield shard()
    ordered.mapInArrow(run, SCHEMA).write.parquet(folder)
    return folder


def read_shards(spark, folder: str) -> DataFrame:
    """The shards, with ``start`` counted over all files.

    One sum per range of ids reaches the driver, as many as the writing job had tasks.
    """
    shards = spark.read.schema(SCHEMA).parquet(folder)
    sums = sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    at, starts = 0, []
    for r in sums:
        starts += [F.lit(r["part"]), F.lit(at).cast("long")]
        at += r["n"]
    if not starts:
        return shards
    return shards.withColumn("start", F.col("start") + F.element_at(F.create_map(*starts), F.col("part")))


def _documents(row: dict) -> tuple[list, np.ndarray]:
    lengths = np.frombuffer(zlib.decompress(row["lengths"]), "<u4").astype(np.int64)
    raw = zlib.decompress(row["doc_ids"])
    ids, none = np.frombuffer(raw, "<i8", len(lengths)), np.frombuffer(raw, np.uint8, len(lengths), 8 * len(lengths))
    return [None if x else int(i) for i, x in zip(ids, none)], lengths


def read_documents(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document, from the planes."""
    def run(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            doc_ids, lengths = _documents(row)
            ids = Wavelet(row["n_tokens"], row["planes"]).ids().astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            for a in range(0, len(lengths), C.BATCH_ROWS):
                some = slice(a, a + C.BATCH_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[some], pa.int64()), pa.array(row["start"] + ends[some] - lengths[some]),
                     pa.array(lengths[some]),
                     pa.array([ids[4 * (e - n):4 * e] for e, n in zip(ends[some].tolist(), lengths[some].tolist())],
                              pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
    return C.by_arrow(read_shards(spark, folder), run, "doc_id long, start long, n_tokens long, ids binary")


def occurrences(spark, folder: str, tokens: list[int]) -> DataFrame:
    """token, place: every place of the given tokens in the whole stream, by select on each shard."""
    def run(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            w = Wavelet(row["n_tokens"], row["planes"])
            found = [(t, row["start"] + w.select(t, k)) for t in tokens for k in range(w.count(t))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()),
                                              pa.array([f[1] for f in found], pa.int64())], names=["token", "place"])
    return C.by_arrow(read_shards(spark, folder), run, "token long, place long")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the written shards."""
    spark = docs.sparkSession

    def run(batch: pa.RecordBatch):
        crc = [zlib.crc32(x) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")]
                                          + [pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return C.by_arrow(read_documents(spark, write_shards(docs, path=path)), run,
                      "doc_id long, start long, n_tokens long, ids_crc32 long")
