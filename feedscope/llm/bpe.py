"""BPE encoding and decoding by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import re as plain_re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C

NONE = 1 << 40
#: Places of the trees that are merged side by side; words of any length and number take no more than this, or one word.
MERGE_PLACES = 1 << 18


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeTree:
    """The least rank of a word's adjacent pairs at the root, with the leftmost place among equals.

    Leaf i holds rank(i) * width + i for the pair that starts at symbol i, so one number orders by rank, then place.
    """

    def __init__(self, ranks: list[int]):
        width = 1
        while width < len(ranks):
            width *= 2
        self.width, tree = width, [NONE] * (2 * width)
        for i, r in enumerate(ranks):
            if r < NONE:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def least(self) -> int:
        """Place of the next merge, or -1."""
        root = self.tree[1]
        return root % self.width if root < NONE else -1

    def set(self, place: int, rank: int) -> None:
        tree, i = self.tree, place + self.width
        tree[i] = rank * self.width + place if rank < NONE else NONE
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            now = a if a < b else b
            if tree[i] == now:
                break
            tree[i] = now
            i >>= 1


class Bpe:
    """Encoder and decoder of one vocabulary file (byte-level letters, word ends, lower-cased text)."""

    def __init__(self, content: str):
        model = json.loads(content)
        self.vocab = model["model"]["vocab"]
        self.end = model["model"]["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.pairs = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        splits = [p for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"])
        self.cut = plain_re.compile("(" + "|".join(plain_re.escape(s) for s in self.special) + ")")

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge the leftmost pair of least rank until none can be merged."""
        n = len(symbols)
        if n < 2:
            return symbols
        pairs = self.pairs
        tree = MergeTree([pairs.get((symbols[i], symbols[i + 1]), NONE) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.least()) >= 0:
            j = after[i]
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                tree.set(j, NONE)
                tree.set(i, pairs.get((symbols[i], symbols[k]), NONE))
            else:
                if j < n - 1:
                    tree.set(j, NONE)
                tree.set(i, NONE)
            if (h := before[i]) >= 0:
                tree.set(h, pairs.get((symbols[h], symbols[i]), NONE))
        return [s for s in symbols if s]

    def prepare_batches(self) -> None:
        """Sorted pairs of ids with their ranks, and the id each rank merges to."""
        rows = sorted((self.vocab[a] << 32 | self.vocab[b], rank, self.vocab[a + b]) for (a, b), rank in self.pairs.items())
        self.pair_keys, self.pair_ranks = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.merged = np.zeros(len(rows), np.int64)
        self.merged[self.pair_ranks] = [r[2] for r in rows]
        self.first_ids = np.array([[self.vocab[self.letters[b] + e] for b in range(256)] for e in ("", self.end)])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], NONE)

    def encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that each are one word of the vocabulary's rules: a tree a row, all rows a merge at a time."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw])
        width_of = np.array([1 << max(1, int(n - 1).bit_length()) for n in size])
        out: list[bytes] = [b""] * len(words)
        for width in np.unique(width_of).tolist():
            rows, step = np.flatnonzero(width_of == width), max(1, MERGE_PLACES // width)
            for some in (rows[a:a + step] for a in range(0, len(rows), step)):
                for i, ids in zip(some.tolist(), self._merge_rows([raw[i] for i in some.tolist()], size[some], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, raw: list[bytes], size: np.ndarray, width: int) -> list[bytes]:
        n, row_at = len(raw), np.arange(len(raw))
        filled = np.arange(width)[None, :] < size[:, None]
        symbols = np.full((n, width + 1), -1)
        symbols[:, :width][filled] = self.first_ids[0][np.frombuffer(b"".join(raw), np.uint8)]
        symbols[row_at, size - 1] = self.first_ids[1][[r[-1] for r in raw]]
        tree = np.full((n, 2 * width), NONE)
        ranks = self._ranks(symbols[:, :width], symbols[:, 1:])
        tree[:, width:] = np.where(ranks < NONE, ranks * width + np.arange(width), NONE)
        for i in range(width - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[row_at, size - 1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        tree_, symbols_, after_, before_ = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()
        rows = row_at
        while True:
            root = tree_[rows * 2 * width + 1]
            alive = root < NONE
            rows, root = rows[alive], root[alive]
            if not len(rows):
                break
            at, leaf = rows * (width + 1), rows * 2 * width
            i = root % width
            j = after_[at + i]
            k = after_[at + j]
            now = self.merged[root // width]
            symbols_[at + i] = now
            symbols_[at + j] = -1
            after_[at + i] = k
            before_[at + k] = i
            h = np.maximum(before_[at + i], 0)
            first = before_[at + i] < 0
            tree_[leaf + width + j] = NONE
            rank = self._ranks(now, symbols_[at + k])
            tree_[leaf + width + i] = np.where(rank < NONE, rank * width + i, NONE)
            rank = self._ranks(np.where(first, -1, symbols_[at + h]), now)
            keep = tree_[leaf + width + h]
            tree_[leaf + width + h] = np.where(first, keep, np.where(rank < NONE, rank * width + h, NONE))
            nodes = [h + width, i + width, j + width]
            for _ in range(width.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree_[leaf + x] = np.minimum(tree_[leaf + 2 * x], tree_[leaf + 2 * x + 1])
        left = symbols[:, :width] >= 0
        return C.cut_ids(symbols[:, :width][left], left.sum(1))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens count as those."""
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            part = "".join(c.lower() for c in part)
            for word in self.words.findall(part):
                symbols = [self.letters[b] for b in word.encode()]
                symbols[-1] += self.end
                out += [self.vocab[s] for s in self.merge(symbols) if s in self.vocab]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with a space between each, as a vocabulary without decoder rules is read."""
        get = self.tokens
        return " ".join([get[i] for i in ids.tolist() if i in get])


_known: dict[int, tuple[Bpe, C.ChunkEncoder]] = {}


def worker(content: str) -> tuple[Bpe, C.ChunkEncoder]:
    key = hash(content)
    if key not in _known:
        bpe = Bpe(content)
        _known.clear()
        bpe.prepare_batches()
        _known[key] = bpe, C.ChunkEncoder(lambda words: [np.array(bpe.encode(w), "<u4").tobytes() for w in words],
                                          bpe.encode_letters)
    return _known[key]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every text; null counts as empty."""
    content = docs.sparkSession.sparkContext.broadcast(C.tokenizer_text(path))

    def run(batch: pa.RecordBatch):
        _, encoder = worker(content.value)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoder(C.texts(batch.column("text"))),
                                                                           pa.binary())], names=["doc_id", "ids"])
    return C.by_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text."""
    content = encoded.sparkSession.sparkContext.broadcast(C.tokenizer_text(path))

    def run(batch: pa.RecordBatch):
        bpe, _ = worker(content.value)
        out = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.string())],
                                          names=["doc_id", "ids", "decoded"])
    return C.by_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again.

    Both ways in one step, so that a task has one Python worker with one vocabulary, and texts of about ``C.SLICE_BYTES``
    at a time; a decoded text is gone when its digest is made.
    """
    content = docs.sparkSession.sparkContext.broadcast(C.tokenizer_text(path))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe, encoder = worker(content.value)
        for part in C.slices(batch):
            ids = encoder(C.texts(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                 pa.array([hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return C.by_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
