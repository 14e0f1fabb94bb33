"""Helpers shared by the operators: written tables, text batches, word hashes and token encoders."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import BATCH_ROWS, cut_lineage, keep_batches_small, ship_package  # noqa: F401

SLICE_BYTES = 1 << 20
WORD_FILE = "word_bpe_49k.json"
#: Chunks that a worker's table holds before it starts anew; large, as chunks are learned again after that.
LIBRARY_CHUNKS = 1_000_000

#: ASCII white space, the only separators of words: \x20 and \x09 to \x0d.
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[9, 10, 11, 12, 13, 32]] = True
WORD = re.compile(r"[^\x20\x09-\x0d]+")

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the workers and keep Arrow batches small, because texts can be long."""
    ship_package(spark)
    return keep_batches_small(spark)


def table(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read back from there."""
    return cut_lineage(df)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/documents.parquet")


def by_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch],
             schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    def run(batches):
        for b in batches:
            out = fn(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


# ------------------------------------------------------------------ hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the rolling base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span`` reads hashes of any run from them."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:len(values)], dtype=U64, out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


class Words:
    """The words of some texts: byte spans, hashes and the first word of each text."""

    def __init__(self, column: pa.Array, lower: bool = False):
        size, column = len(column), column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64, size + 1, column.offset * 8)
        start = int(offsets[0])
        data = column.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8, int(offsets[-1]) - start, start) if data else np.zeros(0, np.uint8)
        offsets = offsets - start
        sep = _SEPARATES[self.bytes]
        n = len(sep)
        opens, closes = ~sep, ~sep
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        opens[1:] &= sep[:-1] | border[1:n]
        closes[:-1] &= sep[1:] | border[1:n]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.offsets = offsets
        raw = self.bytes
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
        self.hashes = span(prefix(raw.astype(U64) + U64(1)), self.starts, self.ends) if n else np.zeros(0, U64)

    @property
    def doc(self) -> np.ndarray:
        """For each word the place of its text in the batch."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``k`` consecutive words and their texts; a shorter text is one shingle of all its words."""
        count = np.diff(self.first)
        sums = prefix(self.hashes)
        per = np.maximum(count - k + 1, 1)
        doc = np.repeat(np.arange(len(count)), per)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = self.first[doc] + place
        end = np.minimum(begin + k, self.first[doc + 1])
        return span(sums, begin, end), doc


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``most`` bytes of text, so that work arrays stay small."""
    sizes = np.array([len(t) if t is not None else 0 for t in batch.column(column).cast(pa.large_binary()).to_pylist()],
                     np.int64) if batch.num_rows else np.zeros(0, np.int64)
    group = np.cumsum(sizes) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]]).astype(int)
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


# ------------------------------------------------------------------ tokens
def tokenizer_text(path: str | None = None) -> str:
    """The vocabulary file's content, read by the driver; its size is fixed by the vocabulary."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(WORD_FILE)
    with open(path, encoding="utf-8") as f:
        return f.read()


_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&*#$|]*)")
_ODD_SPACES = re.compile(r"[\x1c-\x1f]")


class ChunkEncoder:
    """Token ids of whole texts from ids of white-space separated chunks.

    The vocabulary's rules drop white space and never let a token cross it, so a text's ids are those of its
    chunks in order.  A chunk is encoded once while it stays in the table of at most ``most`` chunks; the table only
    saves time.  Chunks of letters with closing signs share the entry of their lower-case letters; ``encode_letters``
    gets such words, ``encode_many`` any chunks.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]],
                 encode_letters: Callable[[list[str]], list[bytes]] | None = None, most: int = 400_000):
        self.encode_many, self.encode_letters = encode_many, encode_letters or encode_many
        self.most, self.known = most, {"": b""}

    def __call__(self, batch: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known = {"": b""}
        known, split, new = self.known, [], set()
        for t in batch:
            words = t.split() if not _ODD_SPACES.search(t) else re.split(r"[ \n]+", t)
            split.append(words)
            new.update(set(words).difference(known))
        self._learn(new)
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _learn(self, new: set[str]) -> None:
        known, parts, letters, other = self.known, [], set(), set()
        for w in new:
            m = _PLAIN.fullmatch(w)
            if m:
                a, b = m.groups()
                a = a.lower()
                parts.append((w, a, b))
                letters.add(a)
                if b:
                    other.add(b)
            else:
                other.add(w)
        for words, encode in ((letters, self.encode_letters), (other, self.encode_many)):
            words = [w for w in words if w not in known]
            for i in range(0, len(words), 4096):
                some = words[i:i + 4096]
                known.update(zip(some, encode(some)))
        for w, a, b in parts:
            known[w] = known[a] + known[b] if b else known[a]


def cut_ids(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Consecutive runs of ids as little-endian unsigned 32-bit bytes."""
    data, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


_encoders: dict = {}


def library_encoder(model: str) -> ChunkEncoder:
    """A worker's encoder by the tokenizers library; texts get no special tokens, truncation or padding."""
    key = ("library", hash(model))
    if key not in _encoders:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_str(model)
        tok.no_truncation()
        tok.no_padding()

        def many(words: list[str]) -> list[bytes]:
            return [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]
        vocab, end = tok.get_vocab(), getattr(tok.model, "end_of_word_suffix", None)
        closes = np.zeros(max(vocab.values(), default=0) + 1, bool)
        closes[[i for t, i in vocab.items() if end and t.endswith(end)]] = True

        def letters(words: list[str]) -> list[bytes]:
            """Words of letters in one text: each ends with its only token that closes a word."""
            ids = np.array(tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(closes[ids]) + 1
            if len(ends) != len(words) or ends[-1] != len(ids):
                return many(words)
            return cut_ids(ids, np.diff(ends, prepend=0))
        _encoders.clear()
        _encoders[key] = ChunkEncoder(many, letters, LIBRARY_CHUNKS)
    return _encoders[key]


def doc_key() -> list:
    """Names a row by its id and its text, should an id occur twice."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_row")]


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, _row, text and the row itself as ``_all``, so that other columns may have any names."""
    return docs.select(*doc_key(), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))


def unfolded(rows: DataFrame, docs: DataFrame, text=None, **more) -> DataFrame:
    """The columns of ``docs`` out of ``_all``, with another text and more columns, which take the place of their namesakes."""
    own = [text.alias(c) if c == "text" and text is not None else F.col("_all").getField(c).alias(c)
           for c in docs.columns if c not in more]
    return rows.select(*own, *[v.alias(k) for k, v in more.items()])
