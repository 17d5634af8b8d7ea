"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Adjacent tokens are compatible if merging their joined bytes gives just these two. A sequence of tokens is the
encoding of its bytes if and only if all its neighbours are compatible, so each prefix of a piece has one last
token, and the encodings of all prefixes form a tree. A state of the transducer is what can still matter of that
tree: the last token of all that was read, and the open ends, from which some token can still reach beyond it, each
as a node of the trie of tokens and the last token before it. Its transitions are made when first taken and kept,
states that are equal are one, and all are dropped when they reach a fixed number. A run goes back over its states,
token by token, to emit them: at a piece's end, or in a long piece after every BLOCK bytes what all open ends have
in common, which is certain. Tokens come after bounded lookahead: an end whose bytes no token starts with can't
stay open.

Each match of the pattern is a piece with its own run of the transducer. A piece that is itself in the vocabulary
is that token, as the library has it. What the transducer made of a piece is kept, within a fixed size. Long texts are
cut at spaces between characters that aren't white space, where a match of the usual pattern always begins. Ids are
held as 32-bit little-endian bytes.

Decoding takes ids in any cuts and gives text as soon as it is whole: a state machine holds the bytes of a code
point that isn't complete, three at most. Bytes that aren't UTF-8 become U+FFFD.

Defined results: a null or empty text has no ids and decodes to the empty text. Repeated rows are encoded each for
itself; a null doc_id is carried. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import table

#: States and compatible pairs that are kept before all are dropped; bytes of a piece after which ids are emitted.
STATES, PAIRS, BLOCK = 1 << 18, 1 << 19, 1 << 12
#: Characters of a text taken at once (longer where no boundary comes); pieces kept in each of two generations, and
#: the longest one kept.
SLICE, KEPT, LONGEST = 1 << 18, 1 << 19, 64
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: Ids decoded at once, and bytes in a batch that a task sends on.
FEED, BATCH = 1 << 16, 4 << 20


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


NONE = -1


class _State:
    """Open ends as (node, last token before it), that of all bytes read last; the token read last and its bytes."""

    __slots__ = ("next", "open", "size", "token")

    def __init__(self, open_: tuple[tuple[int, int], ...], token: int, size: int) -> None:
        self.open, self.token, self.size = open_, token, size
        self.next: dict[int, _State] = {}


class Transducer:
    """Encodes pieces of bytes by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        #: The trie: children by node and byte; by node the token (NONE if none), its depth, and whether it goes on.
        self.child: dict[int, int] = {}
        self.token, self.depth, self.goes_on = [NONE], [0], [False]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.goes_on[node] = True
                    self.token.append(NONE)
                    self.depth.append(self.depth[node] + 1)
                    self.goes_on.append(False)
                node = self.child[key]
            self.token[node] = i
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.next.clear()  # states refer to each other; so they go without the cycle collector
        self.start = _State(((0, NONE),), NONE, 0)
        self.states = {self.start.open: self.start}

    def merged(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """By the definition: the pair of lowest rank is merged, the leftmost of them, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The pair that the last merge to a token joins; (token, token) for a byte, None if no merges make it."""
        if token not in self.halves:
            parts = self.merged(self.bytes_of[token], 2)
            self.halves[token] = (token, token) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether right can follow left: no merge across their border comes before those inside them.

        The border's neighbours are taken back merge by merge, the latest first. A pair of them that could merge
        before the merge just taken back would have done so.
        """
        if self._halves(right) is None:
            return False
        if left == NONE:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b, limit, found = left, right, 1 << 60, None
            while found is None:
                if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60) < limit:
                    found = False
                    break
                a_in, b_in = self._halves(a)[1], self._halves(b)[0]
                if a_in == a and b_in == b:
                    found = True
                elif b_in == b or (a_in != a and a > b):
                    a, limit = a_in, a
                else:
                    b, limit = b_in, b + 1  # the left border merges first among equals
            self.pairs[left, right] = found
        return found

    def _step(self, state: _State, byte: int) -> _State:
        child, token, goes_on = self.child, self.token, self.goes_on
        open_, end, size = [], NONE, 0
        for node, last in state.open:
            node = child.get(node << 8 | byte)
            if node is not None:
                if end == NONE and token[node] != NONE and self._compatible(last, token[node]):
                    end, size = token[node], self.depth[node]
                if goes_on[node]:
                    open_.append((node, last))
        if end == NONE:
            raise ValueError("the vocabulary lacks a byte or can't be encoded piece by piece")
        open_.append((0, end))
        key = tuple(open_)
        new = self.states.get(key)
        if new is None:
            if len(self.states) >= STATES:
                self._reset()
            new = self.states[key] = _State(key, end, size)
        state.next[byte] = new
        return new

    def _certain(self, read: list[_State]) -> int:
        """How many of the bytes read lie before what the encodings of all open ends have in common."""
        ends = {len(read) - self.depth[node] for node, _ in read[-1].open}
        while len(ends) > 1:
            latest = max(ends)
            ends.remove(latest)
            ends.add(latest - read[latest - 1].size)
        return ends.pop()

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, ids, read = self.start, [], []
        for at in range(0, len(piece), BLOCK):
            if at:
                sure = self._certain(read)
                ids += self._tokens(read, sure)
                del read[:sure]
            for byte in piece[at : at + BLOCK] if len(piece) > BLOCK else piece:
                state = state.next.get(byte) or self._step(state, byte)
                read.append(state)
        return ids + self._tokens(read, len(read)) if ids else self._tokens(read, len(read))

    @staticmethod
    def _tokens(read: list[_State], end: int) -> list[int]:
        """The tokens of the first ``end`` bytes read."""
        tokens = []
        while end > 0:
            state = read[end - 1]
            tokens.append(state.token)
            end -= state.size
        tokens.reverse()
        return tokens


class Utf8Stream:
    """Text of bytes that come in any cuts."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):  # a lead byte among the last three that wants more than is there
            b = data[-back]
            if b >= 0xC0:
                keep = back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
            if b < 0x80 or b >= 0xC0:
                break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    def __init__(self, data: bytes, pattern: str) -> None:
        self.transducer = Transducer(parse_ranks(data))
        self.pieces = regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        top = max(self.transducer.bytes_of, default=-1)
        self.table = [self.transducer.bytes_of.get(i, b"") for i in range(top + 1)]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the young generation may not have; when that is full it becomes the old one."""
        value = self.young.get(piece)
        if value is not None:
            return value
        value = self.old.get(piece)
        if value is None:
            value = array("i", self.transducer.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= LONGEST:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[piece] = value
        return value

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text in slices, as 32-bit little-endian bytes."""
        at, size = 0, len(text)
        while at < size:
            cut = _BOUNDARY.search(text, at + SLICE) if size - at > 2 * SLICE else None
            end = cut.start() if cut else size
            pieces = self.pieces.findall(text[at:end])
            values = list(map(self.young.get, pieces))
            if None in values:
                values = [self._piece(p) if v is None else v for p, v in zip(pieces, values, strict=True)]
            yield b"".join(values)
            at = end

    def decode(self, ids: Iterable[bytes]) -> Iterator[str]:
        stream = Utf8Stream()
        for some in ids:
            for at in range(0, len(some), 4 * FEED):
                yield stream.feed(b"".join(map(self.table.__getitem__, memoryview(some[at : at + 4 * FEED]).cast("i"))))
        yield stream.close()


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    if (key := (hash(data), pattern)) not in _codecs:
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def coded(docs: DataFrame, ranks_file: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of int) and decoded, the text that streaming decoding makes of the ids.

    The ranks are read on the driver, from ``ranks_file`` or the public one, and broadcast.
    """
    with open(ranks_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern)
        usual = gc.get_threshold()
        gc.set_threshold(1 << 20)  # the kept states are many objects, none of which is garbage
        try:
            yield from coded_(codec, batches)
        finally:
            gc.set_threshold(*usual)

    def coded_(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = size = 0
            ids: list[bytes] = []
            texts: list[str] = []
            for i, text in enumerate(batch.column(1)):
                ids.append(b"".join(codec.encode(text.as_py() or "")))
                texts.append("".join(codec.decode([ids[-1]])))
                size += len(ids[-1]) + len(texts[-1])
                if size > BATCH or i == batch.num_rows - 1:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))]))
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at : i + 1], lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
                    at, size, ids, texts = i + 1, 0, [], []

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(both, "doc_id long, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coded(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
