"""Packing: harmonic packing of tokenized documents into sequences.

Pieces of a length in (C / (k + 1), C / k] are of class k, and k of them fill a sequence of capacity C, whatever
else there is: each class fills its sequences with a fixed count of pieces, and each task packs for itself. Since
documents may be cut, a document gives whole sequences first, and its tail is cut into the fewest pieces whose
class wastes at most WASTE of a sequence. A task's last, unfilled sequences are joined end to end into full ones
and at last into lengths that are powers of two, which need no padding.

Defined results: a null or empty text is the closing id alone. Repeated rows are packed each for itself. An empty
table gives no piece. Rows with a null doc_id are packed like others. Only doc_id and text are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphmill.llm.common import table

CAPACITY, CLOSING = 1024, 0
#: Tokens of padding in a sequence that a class may leave.
WASTE = CAPACITY // 128
#: Bytes of ids in a batch that a task sends on.
BATCH = 4 << 20


def tail_cuts(capacity: int, waste: int) -> list[list[int]]:
    """For each length below capacity, the fewest lengths that sum to it and whose classes waste little."""
    good = [c for c in range(1, capacity) if capacity - capacity // c * c <= waste]
    best: list[list[int]] = [[]]
    for n in range(1, capacity):
        best.append(min(([c, *best[n - c]] for c in reversed(good) if c <= n), key=lambda x: (len(x), sum(capacity - capacity // c * c for c in x))))
    return best


class Packer:
    """Packs (doc_id, ids as bytes) and yields (doc_id, start, length, ids, doc_tokens, sequence, offset)."""

    def __init__(self, base: int, capacity: int = CAPACITY, waste: int = WASTE) -> None:
        self.next, self.capacity = base, capacity
        self.cuts = tail_cuts(capacity, waste)
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, ids, total, self.next, offset
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        for length in [self.capacity] * (total // self.capacity) + self.cuts[total % self.capacity]:
            bin_ = self.open.setdefault(self.capacity // length, [])
            bin_.append((doc_id, at, ids[4 * at : 4 * (at + length)], total))
            if len(bin_) == self.capacity // length:
                yield from self._sequence(self.open.pop(self.capacity // length))
            at += length

    def close(self) -> Iterator[tuple]:
        """What is left, end to end: full sequences, then one for each power of two in the rest."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[2]) // 4 for p in rest)
        room, bin_ = 0, []
        for doc_id, start, ids, total in rest:
            at = 0
            while at < len(ids) // 4:
                if not room:
                    room = size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= size
                take = min(room, len(ids) // 4 - at)
                bin_.append((doc_id, start + at, ids[4 * at : 4 * (at + take)], total))
                at, room = at + take, room - take
                if not room:
                    yield from self._sequence(bin_)
                    bin_ = []
        self.open = {}


_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


class Ids:
    """Ids of a text as unsigned 32-bit little-endian bytes, just as the tokenizer's file has them.

    Where the file is plain byte-level BPE whose merges are in the order of its ids, its vocabulary serves as ranks,
    for which there is a faster encoder with the same ids. A text that holds the string of an added token, or that
    the faster one refuses, such as millions of white-space characters together, goes through the tokenizer itself;
    so does every text where the file is anything else.
    """

    def __init__(self, vocabulary: str) -> None:
        parsed = json.loads(vocabulary)
        self.slow, self.vocabulary, self.fast = None, vocabulary, None
        self.added = [t["content"] for t in parsed.get("added_tokens") or []]
        ranks = _plain_ranks(parsed)
        if ranks is not None:
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added):
            return self.by_tokenizer(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:
            return self.by_tokenizer(text)

    def by_tokenizer(self, text: str) -> bytes:
        if self.slow is None:
            self.slow = Tokenizer.from_str(self.vocabulary)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _plain_ranks(parsed: dict) -> dict[bytes, int] | None:
    """Ranks of a tokenizer's file, or None where it does anything but split by the usual pattern and merge bytes by rank."""
    model, split = parsed["model"], parsed.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    odd = parsed.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not usual or odd or any(t.get("normalized") for t in parsed.get("added_tokens") or []):
        return None
    special = {t["id"] for t in parsed.get("added_tokens") or []}
    byte_of = _byte_alphabet()
    vocab = {token: i for token, i in model["vocab"].items() if i not in special}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [vocab.get(m) for m in merges] != list(range(len(vocab) - len(merges), len(vocab))) or not all(c in byte_of for t in vocab for c in t):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else the next from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_ids: dict[int, Ids] = {}


def _encoder(vocabulary: str) -> Ids:
    """One for each worker."""
    if (key := hash(vocabulary)) not in _ids:
        _ids[key] = Ids(vocabulary)
    return _ids[key]


def packed(docs: DataFrame, vocabulary_file: str | None = None) -> DataFrame:
    """A row for each piece, with its ids as unsigned 32-bit little-endian bytes.

    The tokenizer's file is read on the driver, from ``vocabulary_file`` or the public one, and broadcast.
    """
    with open(vocabulary_file or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = _encoder(vocabulary.value), Packer(TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + CLOSING.to_bytes(4, "little")
                size += len(ids)
                rows += packer.add(doc_id.as_py(), ids)
                if size > BATCH and rows:
                    yield full()
                    rows, size = [], 0
        rows += packer.close()
        if rows:
            yield full()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as the query returns them."""
    return _digests(packed(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(packed(table(spark, sf_dir, "documents")))
