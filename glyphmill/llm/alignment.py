"""Cross-tokenizer alignment: minimal groups of tokens, and how often two tokens end together.

Tokens of both tokenizers cover the same bytes, a space and the text. Of two tokens that overlap, the one that starts
later has the other one around its first byte, so each token is hung on the token of the other side around its first
byte, if that starts before it; where both start together, B's is hung on A's. These are all edges of the bipartite
graph of overlaps, and a forest, so unions need no rank and a find is a doubling of paths over whole arrays. The
components are the minimal groups, numbered by their roots. The last members of a group's two sides end together, and
no other tokens do: they are its link.

Of two tokens that end together one's bytes are a suffix of the other's. So the pairs that can ever be linked follow
from the two vocabularies alone, 324,297 for the public ones: that proves a bound on the counts, which are
numbered by a table of these pairs, summed in each task and then over tasks, and broadcast to the documents' links.
Links are kept in the shared folder between the two passes; the folder stays there, since results are read from it.

A is a byte-level BPE file; strings of special tokens are ordinary text. B is a SentencePiece model, which puts a
space in front itself (see ``piece_bpe``).

Defined results: a text that is null, empty or not given back by both tokenizers' bytes (as with U+2581, which B reads
as a space) has no tokens: zeros, and ''. Texts of any length go whole. Repeated rows count each for itself; a null
doc_id is carried. An empty table gives no row. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphmill.llm import packing, piece_bpe
from glyphmill.llm.common import table
from glyphmill.plans.cut import shared_folder

#: Slots of the hash of pairs.
SLOTS = 1 << 22
NONE = np.empty(0, np.int32)


class ByteIds:
    """Ids of a byte-level BPE file in which special tokens are ordinary text, and the bytes of each."""

    def __init__(self, vocabulary: str) -> None:
        parsed = json.loads(vocabulary)
        byte_of, special = packing._byte_alphabet(), {t["id"] for t in parsed.get("added_tokens") or []}
        vocab = {i: bytes(byte_of[c] for c in token) for token, i in parsed["model"]["vocab"].items() if i not in special}
        self.bytes_of = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        ranks = packing._plain_ranks(parsed)
        self.fast = ranks and tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary, self.slow = vocabulary, None

    def __call__(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
            except ValueError:  # millions of white-space characters together
                pass
        if self.slow is None:
            self.slow = Tokenizer.from_str(self.vocabulary)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int32)


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All (A id << 32 | B id) of which one's bytes are a suffix of the other's, in order."""
    of: tuple[dict[bytes, list[int]], ...] = ({}, {})
    for ids, tokens in zip(of, (a, b), strict=True):
        for i, token in enumerate(tokens):
            if token:
                ids.setdefault(token, []).append(i)
    found = {x << 32 | y for token, xs in of[0].items() for at in range(len(token)) for y in of[1].get(token[at:], ()) for x in xs}
    found |= {x << 32 | y for token, ys in of[1].items() for at in range(len(token)) for x in of[0].get(token[at:], ()) for y in ys}
    return np.array(sorted(found), np.int64)


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The component of each token, A's and then B's, by the ends of their byte ranges; both cover the same bytes."""
    n = len(a_ends)
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    around = np.searchsorted(b_ends, a_starts, "right")
    hung = np.where(b_starts[around] < a_starts, n + around, np.arange(n))
    parent = np.concatenate([hung, np.searchsorted(a_ends, b_starts, "right")])
    while True:
        further = parent[parent]
        if np.array_equal(further, parent):
            break
        parent = further
    number = np.cumsum(hung == np.arange(n)) - 1
    return number[parent]


@dataclass
class Aligned:
    a: np.ndarray
    b: np.ndarray
    #: The group of each token of A and of B; groups are numbered in order.
    a_group: np.ndarray
    b_group: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.a_group[-1]) + 1 if len(self.a) else 0


class Aligner:
    def __init__(self, vocabulary: str, model: bytes) -> None:
        self.a, self.b = ByteIds(vocabulary), piece_bpe.Pieces(model)
        self.a_length = np.array(list(map(len, self.a.bytes_of)))
        self.b_length = np.array(list(map(len, self.b.bytes_of)))
        self.pairs = possible_pairs(self.a.bytes_of, [b"" if i in self.b.is_control or i == self.b.unknown else x for i, x in enumerate(self.b.bytes_of)])
        #: By a hash of a pair, a place in ``pairs`` to look at before a search.
        self.slots = np.zeros(SLOTS, np.int32)
        self.slots[_slot(self.pairs)] = np.arange(len(self.pairs))
        #: What is written for a token: its id and what follows it, by whether it is its group's last on its side.
        self.written = [f"{i}{after}" for after in ",|" for i in range(len(self.a_length))] + [f"{i}{after}" for after in ",;" for i in range(len(self.b_length))]

    def align(self, texts: list[str]) -> Iterator[Aligned | None]:
        """For each text its tokens and groups; None if it has no tokens."""
        form = [self.b.normalizer(t)[0] for t in texts] if self.b.normalizer.changes else [self.b.normalizer.plain(t) for t in texts]
        for text, pieces in zip(texts, self.b.pieces(form), strict=True):
            data = f" {text}".encode()
            a, b = self.a(f" {text}"), pieces.astype(np.int32)
            a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
            if not text or not len(a) or not len(b) or not a_ends[-1] == b_ends[-1] == len(data) or not self._gives_back(text, data, a, b):
                yield None
                continue
            group = components(a_ends, b_ends)
            yield Aligned(a, b, group[: len(a)], group[len(a) :])

    def _gives_back(self, text: str, data: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both tokens' bytes are the data. They are by construction where A is plain byte-level BPE and B
        changes nothing but spaces; a U+2581 of the text itself is read as a space."""
        if not self.a.fast and b"".join(map(self.a.bytes_of.__getitem__, a.tolist())) != data:
            return False
        if not self.b.normalizer.changes:
            return piece_bpe.SPACE not in text
        return b"".join(map(self.b.bytes_of.__getitem__, b.tolist())) == data

    def links(self, x: Aligned) -> np.ndarray:
        """The place in ``pairs`` of each group's link."""
        a, b = x.a[_last(x.a_group)].astype(np.int64), x.b[_last(x.b_group)]
        pair = a << 32 | b
        place = self.slots[_slot(pair)]
        others = np.flatnonzero(self.pairs[place] != pair)
        place[others] = np.searchsorted(self.pairs, pair[others])
        return place

    def text(self, x: Aligned) -> str:
        """Groups as a1,a2|b1;a3|b2,b3."""
        na, nb = len(self.a_length), len(self.b_length)
        a_last, b_last = _last(x.a_group), _last(x.b_group)
        order = np.empty(len(x.a) + len(x.b), np.int64)
        order[np.arange(len(x.a)) + np.append(0, b_last[:-1] + 1)[x.a_group]] = x.a
        order[np.arange(len(x.b)) + (a_last + 1)[x.b_group]] = 2 * na + x.b
        order[a_last + np.append(0, b_last[:-1] + 1)] += na
        order[b_last + a_last + 1] += nb
        return "".join(map(self.written.__getitem__, order.tolist()))[:-1]


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair >> 32) * 40_503 + pair) & (SLOTS - 1)


def _last(group: np.ndarray) -> np.ndarray:
    """Where each group's last member stands."""
    return np.append(np.flatnonzero(group[1:] != group[:-1]), len(group) - 1)


_aligners: dict[int, Aligner] = {}


def _aligner(vocabulary: str, model: bytes) -> Aligner:
    """One for each worker."""
    if (key := hash((vocabulary, model))) not in _aligners:
        _aligners[key] = Aligner(vocabulary, model)
    return _aligners[key]


def _files(vocabulary_file: str | None, model_file: str | None) -> tuple[str, bytes]:
    with open(vocabulary_file or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(model_file or public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def aligned(docs: DataFrame, vocabulary_file: str | None = None, model_file: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, groups (a1,a2|b1;a3|b2,b3, '' without tokens) and links, numbers of ``linkable`` pairs.

    The tokenizers' files are read on the driver and broadcast.
    """
    files = docs.sparkSession.sparkContext.broadcast(_files(vocabulary_file, model_file))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*files.value)
        for batch in batches:
            for at, texts in piece_bpe.together(batch.column(1)):
                found = list(aligner.align(texts))
                counts = [pa.array([len(getattr(x, side)) if x else 0 for x in found], pa.int64()) for side in "ab"]
                groups = pa.array([aligner.text(x) if x else "" for x in found], pa.string())
                links = piece_bpe.lists([aligner.links(x) if x else NONE for x in found], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(found)], *counts, groups, links], names=["doc_id", "n_a", "n_b", "groups", "links"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda batches: piece_bpe.few_collections(lambda: each(batches)), "doc_id long, n_a long, n_b long, groups string, links array<int>")


def linkable(spark: SparkSession, vocabulary_file: str | None = None, model_file: str | None = None) -> DataFrame:
    """pair, a_id and b_id of all pairs that can end together: as many as the vocabularies' suffixes allow."""
    pairs = _aligner(*_files(vocabulary_file, model_file)).pairs
    return spark.createDataFrame(pa.table({"pair": np.arange(len(pairs), dtype=np.int32), "a_id": pairs >> 32, "b_id": pairs & 0xFFFFFFFF}))


def counted(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` that are linked, with n, how often, and best, whether no pair of its B id has more.

    links: a column links, numbers of pairs. Each task sends a row for each pair that it met, at most.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            some = np.bincount(batch.column(0).flatten())
            if len(some) > len(total):
                total = np.concatenate([total, np.zeros(len(some) - len(total), np.int64)])
            total[: len(some)] += some
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["pair", "n"])

    n = links.select("links").mapInArrow(counts, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.join(n, "pair").withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


def summed(links: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """links' rows with n_best and count_sum in place of links. counts has at most ``size`` rows, which are broadcast."""
    found = counts.select("pair", "n", "best").toArrow()
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n[found["pair"].to_numpy()] = found["n"].to_numpy()
    best[found["pair"].to_numpy()] = found["best"].to_numpy()
    sent = links.sparkSession.sparkContext.broadcast((n, best))
    at = links.columns.index("links")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            pairs, ends = column.flatten().to_numpy(), np.cumsum(np.append(0, column.value_lengths().to_numpy()))
            own = [np.append(0, np.cumsum(of[pairs]))[ends] for of in sent.value[::-1]]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), *(pa.array(np.diff(x)) for x in own)], names=[*rest, "n_best", "count_sum"])

    rest = [c for c in links.columns if c != "links"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema if f.name != "links"]
    return links.mapInArrow(sums, ", ".join([*kinds, "n_best long", "count_sum long"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    rows = aligned(table(spark, sf_dir, "documents"))
    n = F.size("links").cast("long")
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    rows.select("doc_id", "n_a", "n_b", n.alias("n_groups"), n.alias("n_links"), digest.alias("groups_sha256"), "links").write.option("compression", "zstd").parquet(at)
    kept, pairs = spark.read.parquet(at), linkable(spark)
    out = summed(kept, counted(kept, pairs), pairs.count())
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
