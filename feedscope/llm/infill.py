"""Fill-in-middle transformation with piece tables.

A document is never cut into new strings.  It is a list of descriptors (buffer, start, length) over two immutable buffers,
the text and the sentinels.  Cutting splits a descriptor, an arrangement permutes the parts and puts sentinel descriptors
between them, the inverse permutation restores the text, and hashes read the descriptors one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

TEXT, SIGNS = 0, 1
PREFIX, MIDDLE, SUFFIX = range(3)
#: The sentinel in front of each part, and the parts' order in each form.
SENTINELS = ("<P>", "<M>", "<S>")
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Of 100 documents so many are rearranged, and of 100 rearranged ones so many put the suffix first.
MIXED, SUFFIX_FIRST = 90, 20

Piece = tuple[int, int, int]


def cut(pieces: Sequence[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The table before and after ``at`` units; the descriptor that holds the place is split."""
    left, right = [], []
    for buffer, start, length in pieces:
        own = min(max(at, 0), length)
        if own:
            left.append((buffer, start, own))
        if own < length:
            right.append((buffer, start + own, length - own))
        at -= length
    return left, right


def permuted(parts: Sequence, order: Sequence[int]) -> list:
    return [parts[i] for i in order]


def inverse(order: Sequence[int]) -> list[int]:
    """Where each part stands in ``order``."""
    return sorted(range(len(order)), key=order.__getitem__)


def views(pieces: Sequence[Piece], buffers: Sequence[bytes]) -> Iterator[memoryview]:
    """The described bytes in order, none of them copied."""
    held = [memoryview(b) for b in buffers]
    return (held[b][start:start + length] for b, start, length in pieces)


def digest(pieces: Sequence[Piece], buffers: Sequence[bytes]) -> str:
    h = hashlib.sha256()
    for view in views(pieces, buffers):
        h.update(view)
    return h.hexdigest()


class Arranger:
    """Arranges texts (UTF-8) by the four numbers of their ids."""

    def __init__(self, seed: int, sentinels: Sequence[str], mixed: int, suffix_first: int):
        marks = [s.encode() for s in sentinels]
        if len(set(marks)) != 3 or any(len(m) < 2 or any(m[:k] == o[-k:] for k in range(1, len(m)) for o in marks) for m in marks):
            raise ValueError("sentinels must be three different strings of which none begins as one ends")
        self.marks, self.signs = marks, b"".join(marks)
        starts = np.cumsum([0, *map(len, marks)]).tolist()
        self.sign_pieces = [(SIGNS, s, len(m)) for s, m in zip(starts, marks)]
        self.seed, self.mixed, self.suffix_first = seed, mixed, suffix_first

    def numbers(self, doc_id: int | None) -> list[int]:
        word = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(word[i:i + 4], "big") for i in (0, 4, 8, 12)]

    def form(self, text: bytes, third: int, fourth: int) -> str:
        if not text or third % 100 >= self.mixed or any(m in text for m in self.marks):
            return "plain"
        return "spm" if fourth % 100 < self.suffix_first else "psm"

    def arranged(self, text: bytes, n: int, doc_id: int | None) -> tuple[str, int | None, int | None, list[Piece]]:
        """Form, code points of prefix and middle (None if plain), and the output's table in bytes of the buffers."""
        h1, h2, h3, h4 = self.numbers(doc_id)
        form, whole = self.form(text, h3, h4), [(TEXT, 0, len(text))] if text else []
        if form == "plain":
            return form, None, None, whole
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        at = byte_places(text, n, (low, high))
        head, suffix = cut(whole, at[1])
        prefix, middle = cut(head, at[0])
        parts = [[sign, *part] for sign, part in zip(self.sign_pieces, (prefix, middle, suffix))]
        return form, low, high - low, [p for part in permuted(parts, ORDERS[form]) for p in part]

    def restored(self, output: bytes, form: str) -> list[Piece]:
        """The text's table over the output buffer, found from output and form alone."""
        if form == "plain":
            return [(TEXT, 0, len(output))] if output else []
        order, parts, at = ORDERS[form], [], 0
        ends = [output.index(self.marks[p], len(self.marks[order[0]])) for p in order[1:]] + [len(output)]
        for part, end in zip(order, ends):
            start = at + len(self.marks[part])
            parts.append((TEXT, start, end - start))
            at = end
        return [p for p in permuted(parts, inverse(order)) if p[2]]


def byte_places(text: bytes, n: int, places: Sequence[int]) -> list[int]:
    """Byte offsets of code points of a UTF-8 text of ``n`` code points."""
    if len(text) == n:
        return list(places)
    raw = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    return [int(starts[p]) if p < n else len(text) for p in places]


def transformed(docs: DataFrame, seed: int = 1, sentinels: Sequence[str] = SENTINELS, mixed: int = MIXED,
                suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output, pieces, output_sha256, restored_sha256.

    ``pieces`` is the output's table in bytes: array of (buffer: 0 text, 1 sentinels; start; length).  ``restored_sha256``
    is the hash of the text rebuilt from output and form.  Null and empty texts, and texts that hold a sentinel, are plain.
    A null doc_id is the empty number, so all such rows draw alike; equal rows give equal rows; texts are whole whatever
    their length; other columns are not read.  No row depends on another, so there is no shuffle and no skew.
    """
    own = Arranger(seed, sentinels, mixed, suffix_first)

    def run(batch: pa.RecordBatch):
        for part in C.slices(batch):
            ids, rows, flat, count = part.column("doc_id").to_pylist(), [], [], [0]
            for doc_id, text in zip(ids, C.texts(part.column("text"))):
                raw, n = text.encode(), len(text)
                form, prefix, middle, pieces = own.arranged(raw, n, doc_id)
                buffers = (raw, own.signs)
                output = b"".join(views(pieces, buffers))
                rows.append((n, form, prefix, middle, output, digest(pieces, buffers),
                             digest(own.restored(output, form), (output,))))
                flat += pieces
                count.append(len(flat))
            n, form, prefix, middle, output, hashed, again = zip(*rows)
            table = np.array(flat, np.int32).reshape(-1, 3)
            pieces = pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(table[:, k])) for k in range(3)], ["buffer", "start", "length"]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()), pieces,
                 pa.array(hashed), pa.array(again)],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "pieces", "output_sha256",
                       "restored_sha256"])
    return C.by_arrow(docs.select("doc_id", "text"), run,
                      "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, "
                      "pieces array<struct<buffer int, start int, length int>>, output_sha256 string, restored_sha256 string")


#: DuckDB twin of the query.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256(concat('1:', doc_id)) AS h FROM documents),
e AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS c4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain'
                  WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m)
                        ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""
