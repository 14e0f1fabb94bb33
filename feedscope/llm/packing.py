"""Best-fit packing of token pieces into sequences of fixed size, with a fixed number of open bins."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

CAPACITY = 2048
OPEN_BINS = 256
GROUP_PIECES = 100_000
END_ID = 0


class OpenBins:
    """Open bins in a bitset keyed by free space: bit f is set while some open bin has f places left."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_free: dict[int, list[int]] = {}
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def put(self, size: int) -> tuple[int, int]:
        """Bin and offset for a piece: the open bin with the least sufficient space, else a new one."""
        fitting = self.bits >> size
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + size
            number = self._take(free)
        else:
            if self.open >= self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.capacity
            self.made += 1
        rest = free - size
        if rest:
            self.by_free.setdefault(rest, []).append(number)
            self.bits |= 1 << rest
            self.open += 1
        return number, self.capacity - free


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and its end id, cut at ``capacity`` only."""
    model = docs.sparkSession.sparkContext.broadcast(C.tokenizer_text(path))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch):
        doc, piece, start, length, crc = [], [], [], [], []
        ids = C.library_encoder(model.value)(C.texts(batch.column("text")))
        for i, own in enumerate(ids):
            own += end
            for number, at in enumerate(range(0, len(own), capacity * 4)):
                part = own[at:at + capacity * 4]
                doc.append(i)
                piece.append(number)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
             pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return C.by_arrow(docs.select("doc_id", "text"), cut,
                      "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, order: list[Column | str], capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         group: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    Rows are dealt by a hash of ``order``, about ``group`` to a task, so the bins left open at the ends of tasks stay a
    small share of all.  Inside a task rows go to the bins one after the other in hash order, which makes a rerun give the
    same bins.  Sequence numbers are unique, not consecutive.
    """
    items = C.table(items)
    tasks = max(1, -(-items.count() // group))
    mixed = F.xxhash64(*order)
    dealt = items.withColumn("_mix", mixed).repartition(tasks, "_mix").sortWithinPartitions("_mix", *order)
    schema = items.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long"

    def run(batches):
        from pyspark import TaskContext
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).drop_columns(["_mix"])
        sizes = t.column("length").to_numpy()
        bins, place = OpenBins(capacity, open_bins), np.empty((len(sizes), 2), np.int64)
        for i, size in enumerate(sizes.tolist()):
            place[i] = bins.put(size)
        base = np.int64(TaskContext.get().partitionId()) << np.int64(36)
        t = t.append_column("sequence_id", pa.array(place[:, 0] + base)).append_column("offset", pa.array(place[:, 1]))
        yield from t.to_batches(C.BATCH_ROWS * 10)
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                   open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of all documents with their places.  Null text counts as empty: one piece, the end id.

    Rows with one doc_id or none are documents of their own.  Other columns are ignored.
    """
    return pack(pieces(docs, path, capacity), ["doc_id", "piece", "ids_crc32"], capacity, open_bins)
