"""Alignment of two tokenisations of the same texts.

Both tokenisations run over the whole text first.  Where tokens of both end at one byte and the next ones begin with a
space, the ends are anchors; they cut a document into windows of token ids.  A window is named by its two tuples of ids
and aligned once per worker: its groups, their text and its links come from a table afterwards.

How often a pair of ids is linked in the corpus is counted by Spark.  Linked tokens end at the same byte, so one token's
bytes end with the other's: the number of pairs is bounded by the vocabularies, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Windows a worker remembers before it starts anew; this only saves time.
MOST_WINDOWS = 400_000
#: Pair counts are handed to every task only if the vocabularies cannot make more pairs than this (24 bytes each).
MOST_PAIRS = 2_000_000
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The printable sign of each byte in byte-level vocabularies, turned round."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in shown}
    signs.update({chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))})
    return signs


class ByteSide:
    """Ids and bytes of a byte-level BPE vocabulary."""

    def __init__(self, content: str):
        model = json.loads(content)
        signs, vocab = byte_alphabet(), model["model"]["vocab"]
        special = {t["content"] for t in model.get("added_tokens", [])}
        known = {i: bytes(signs[c] for c in t) for t, i in vocab.items() if t not in special}
        size = max([*vocab.values(), *(t["id"] for t in model.get("added_tokens", []))]) + 1
        self.bytes = [known.get(i, b"") for i in range(size)]
        #: Without a normaliser and with a sign for every byte the tokens' bytes are always the text's.
        self.exact = model.get("normalizer") is None and {bytes([b]) for b in range(256)} <= set(known.values())
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        self._fast = self._by_rank(known, [vocab[m] for m in merged])
        from tokenizers import Tokenizer
        self._library = Tokenizer.from_str(content)
        self._library.encode_special_tokens = True
        self._library.no_truncation()
        self._library.no_padding()

    @staticmethod
    def _by_rank(known: dict[int, bytes], merged: list[int]):
        """An encoder by ranks, where ids follow the order of merges: the same ids in a fourth of the time."""
        if merged != list(range(256, 256 + len(merged))) or sorted(known) != list(range(256 + len(merged))):
            return None
        import public_tokenizers
        import tiktoken
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks={b: i for i, b in known.items()})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self._fast:
            return [self._fast.encode_to_numpy(t, disallowed_special=()) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]


class PieceSide:
    """Ids and bytes of a sentence-piece model, which puts a space before each text by itself."""

    def __init__(self, content: bytes):
        import sentencepiece
        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.bytes = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            m = _BYTE_PIECE.fullmatch(piece)
            self.bytes.append(bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def vocabularies(byte_path: str | None = None, piece_path: str | None = None) -> tuple[str, bytes]:
    """The contents of the two vocabulary files, read by the driver; their size is fixed by the vocabularies."""
    import public_tokenizers
    with open(byte_path or public_tokenizers.path(BYTE_FILE), encoding="utf-8") as f:
        text = f.read()
    with open(piece_path or public_tokenizers.path(PIECE_FILE), "rb") as f:
        return text, f.read()


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs can ever be linked: pairs of which one token's bytes are the end of the other's."""
    def ends(longer: list[bytes], other: set[bytes], least: int) -> int:
        return sum(t[k:] in other for t in longer for k in range(least, len(t)))
    return ends(a, {t for t in b if t}, 0) + ends(b, {t for t in a if t}, 1)


class Aligner:
    """A worker's tokenisers and its table of aligned windows."""

    def __init__(self, byte_text: str, piece_model: bytes, most: int = MOST_WINDOWS):
        self.a, self.b, self.most = ByteSide(byte_text), PieceSide(piece_model), most
        self.len_a, self.len_b = (np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b))
        self.marked = np.array([t[:1] == b" " for t in self.a.bytes])
        #: How an id is written: before another id of its side, or as the last of its side in a group.
        self.names = [f"{i}{sign}" for side, last in ((self.a, "|"), (self.b, ";")) for i in range(len(side.bytes))
                      for sign in (",", last)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text: list[str] = []
        self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups_sha256, pairs, times) of each text; zeros where the bytes differ."""
        if len(self.known) > self.most:
            self.clear()
        spaced = [" " + t for t in texts]
        ids_a, ids_b = self.a.encode(spaced), self.b.encode(texts)
        held = [d for d, t in enumerate(spaced) if texts[d] and self._whole(t.encode(), ids_a[d], ids_b[d])]
        out = [(0, 0, 0, "", _NONE, _NONE)] * len(texts)
        if not held:
            return out
        n_a, n_b = (np.array([len(ids[d]) for d in held], np.int64) for ids in (ids_a, ids_b))
        a = np.concatenate([ids_a[d] for d in held]).astype(np.int32)
        b = np.fromiter(chain.from_iterable([ids_b[d] for d in held]), np.int32, int(n_b.sum()))
        end_a, end_b, last_a = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]), np.cumsum(n_a)
        shared_a, shared_b = _ends_in(end_a, end_b), _ends_in(end_b, end_a)
        link_a, link_b = np.flatnonzero(shared_a), np.flatnonzero(shared_b)
        # an anchor is an end of both with a space behind it, or the end of a text
        opens = np.zeros(len(a), bool)
        opens[:-1] = self.marked[a[1:]]
        opens[last_a - 1] = True
        anchors = np.flatnonzero(opens[link_a])
        ends = np.stack([link_a[anchors], link_b[anchors], anchors]) + 1
        starts = np.concatenate([np.zeros((3, 1), np.int64), ends[:, :-1]], axis=1)
        places, new = self._windows(a, b, starts, ends)
        if len(new):
            start, size = starts[:, new], (ends - starts)[:, new]
            run_a, run_b, run_link = (_runs(start[k], size[k]) for k in range(3))
            self.text += self._lines(a[run_a], b[run_b], shared_a[run_a], shared_b[run_b], size)
            self.pool = np.concatenate([self.pool, a[link_a[run_link]].astype(np.int64) << 32 | b[link_b[run_link]]])
            self.size = np.concatenate([self.size, size[2]])
        many = self.size[places]
        flat, link_ends = self.pool[_runs((np.cumsum(self.size) - self.size)[places], many)], np.cumsum(many)
        lines, first, link = [self.text[w] for w in places.tolist()], 0, 0
        for d, upto, x, y in zip(held, np.searchsorted(ends[0], last_a, "right").tolist(), n_a.tolist(), n_b.tolist()):
            hashed, link_end = hashlib.sha256(";".join(lines[first:upto]).encode()).hexdigest(), int(link_ends[upto - 1])
            out[d] = (x, y, link_end - link, hashed, *np.unique(flat[link:link_end], return_counts=True))
            first, link = upto, link_end
        return out

    def _whole(self, raw: bytes, ids_a: np.ndarray, ids_b: list[int]) -> bool:
        """Whether both sides' token bytes are the text's."""
        return (self.a.exact or raw == b"".join([self.a.bytes[i] for i in ids_a.tolist()])) \
            and raw == b"".join([self.b.bytes[i] for i in ids_b])

    def _windows(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each window in the table, and the windows seen for the first time, in the order of their numbers.

        Windows of this call are gathered by hash; if ids of equal hashes differ, each window is looked up by itself.
        """
        hashes = C.mix(C.span(C.prefix(C.mix(a.astype(C.U64) + C.U64(1))), starts[0], ends[0]) * C.U64(3)
                       + C.span(C.prefix(C.mix(b.astype(C.U64) + C.U64(1))), starts[1], ends[1]))
        _, first, named = np.unique(hashes, return_index=True, return_inverse=True)
        like, size = first[named], ends - starts
        if not all(np.array_equal(size[k], size[k][like]) and np.array_equal(
                ids, ids[_runs(starts[k][like], size[k])]) for k, ids in ((0, a), (1, b))):
            first = named = np.arange(len(hashes))
        raw_a, raw_b, known, places, new = a.tobytes(), b.tobytes(), self.known, [], []
        bounds = np.stack([starts[0], ends[0], starts[1], ends[1]])[:, first] * 4
        for at, p, x, q, y in zip(first.tolist(), *bounds.tolist()):
            key = raw_a[p:x] + _BETWEEN + raw_b[q:y]
            w = known.get(key)
            if w is None:
                w = known[key] = len(known)
                new.append(at)
            places.append(w)
        return np.array(places, np.int64)[named], np.array(new, np.int64)

    def _lines(self, a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray, size: np.ndarray) -> list[str]:
        """The groups of windows that follow each other, as text: ids of A and of B, up to each end of both sides."""
        def runs(closes):
            """The group of each token, and how many tokens of a side are in the groups before each group."""
            return np.cumsum(closes) - closes, np.r_[0, np.flatnonzero(closes) + 1]
        (group_a, before_a), (group_b, before_b) = runs(closes_a), runs(closes_b)
        signs = np.empty(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + before_b[group_a]] = a * 2 + closes_a
        signs[np.arange(len(b)) + before_a[group_b + 1]] = 2 * len(self.a.bytes) + b * 2 + closes_b
        names = self.names
        signs = [names[i] for i in signs.tolist()]
        ends = np.cumsum(size[0] + size[1]).tolist()
        return ["".join(signs[p:x])[:-1] for p, x in zip([0, *ends], ends)]


#: Between the ids of both sides in a window's name; no id has these bytes.
_BETWEEN = b"\xff\xff\xff\xff"
_NONE = np.zeros(0, np.int64)


def _ends_in(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the rising numbers ``own`` are among ``other``."""
    marks = np.zeros(int(max(own[-1], other[-1])) + 1, bool)
    marks[other] = True
    return marks[own]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each run of ``size`` places."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_aligners: dict = {}


def worker(byte_text: str, piece_model: bytes) -> Aligner:
    key = hash((byte_text, piece_model))
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(byte_text, piece_model)
    return _aligners[key]


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links (array of a, b, times) of every row of ``docs``.

    A link is a pair of tokens that end at one byte.  Null and empty texts, and those whose token bytes are not the text
    behind one space, have no tokens.  Repeated rows and null ids are rows like others; texts are whole; other columns
    are not read.
    """
    contents = vocabularies(byte_path, piece_path)
    spread = docs.sparkSession.sparkContext.broadcast(contents)  # two vocabulary files

    def run(batch: pa.RecordBatch):
        own = worker(*spread.value)
        for part in C.slices(batch, most=C.SLICE_BYTES):
            rows = own.align(C.texts(part.column("text")))
            n_a, n_b, groups, hashed, pairs, times = zip(*rows)
            cuts = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
            code = np.concatenate(pairs)
            links = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(
                [pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)),
                 pa.array(np.concatenate(times).astype(np.int32))], ["a", "b", "times"]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups)), pa.array(hashed), links],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
    return C.by_arrow(docs.select("doc_id", "text"), run,
                      "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
                      "links array<struct<a int, b int, times int>>")


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n: in how many links of all documents a pair of ids stands, and whether no other id of side a is linked with b
    more often (best)."""
    counts = links.groupBy("a", "b").agg(F.sum("times").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def scored(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """``aligned`` with n_links, n_best (links whose pair is its B id's most frequent) and count_sum (pair counts summed).

    The documents' links are written once, counted by pair with partial sums, and looked up in the pair counts.  Those are
    handed to every task only after the vocabularies have shown that there cannot be more than ``MOST_PAIRS``; else Spark
    chooses the join by bytes.
    """
    rows = C.table(aligned(docs, byte_path, piece_path).withColumn("_at", F.monotonically_increasing_id()))
    each = rows.select("_at", F.explode("links").alias("l")).select("_at", "l.*")
    counts = C.table(pair_counts(each))
    byte_text, piece_model = vocabularies(byte_path, piece_path)
    if most_pairs(ByteSide(byte_text).bytes, PieceSide(piece_model).bytes) <= MOST_PAIRS:
        counts = F.broadcast(counts)
    times = F.col("times").cast("long")
    sums = each.join(counts, ["a", "b"]).groupBy("_at").agg(
        F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    return rows.drop("links").join(sums, "_at", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
