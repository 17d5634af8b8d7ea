"""SentencePiece encoding that keeps offsets, and decoding.

A model's compiled character map is a double-array trie over UTF-8 bytes; at each place the longest key that the text
goes on with is replaced, and where there is none a character stands for itself. Each character of the normal form
records the byte of the text that it came from. White space becomes U+2581, and one is put in front. Pieces of the
normal form then project to spans of the text's bytes: a piece ends where the source of the next character begins, so
spans follow each other without a gap, and start and ends say all. Of the bytes of a character that isn't in the
vocabulary, the last one holds its span, and the others are empty.

No merge joins anything to a U+2581 on its right unless the vocabulary has such a piece. So the normal form falls into
units, each a run of U+2581 and what follows, that are merged each for itself; what became of a unit is kept, within a
fixed size. A unit merges the pair of the highest score first, of equal ones the leftmost; new units of many texts do
so side by side, each a pair a round, but for long ones, which have a heap.

Decoding joins the pieces' bytes. Bytes of byte pieces that aren't UTF-8 become U+FFFD each, the first U+2581 of the
text is dropped, other ones are spaces, and control pieces are empty.

Models of other kinds than BPE with byte pieces, and those with user-defined or unused pieces or white space as a
suffix, are refused with an error.

Defined results: a null or empty text has the end id alone, and decodes to the empty text. Texts of any length go
whole. Repeated rows are encoded each for itself; a null doc_id is carried. An empty table gives no row. Only doc_id
and text are read, so other columns can't clash.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import table

SPACE = "▁"
#: Units kept in each of two generations, and the longest one kept.
KEPT, LONGEST = 1 << 18, 64
#: Characters of a unit up to which many are merged at once, the longer ones by a heap; the score of what isn't a piece.
SHORT, NEVER = 48, float("-inf")
#: Characters of texts that are encoded together; a longer text goes alone.
TOGETHER = 1 << 20
#: Fixed values of the file format: field numbers, and types of pieces.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_MODEL_TYPE, _BYTE_FALLBACK, _AS_SUFFIX, _UNK_SURFACE, _BPE = 3, 35, 24, 44, 2
_CHARSMAP, _DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE = 2, 3, 4, 5
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map: the trie's size, its cells, then the replacements."""

    def __init__(self, data: bytes) -> None:
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.cells = np.frombuffer(data, "<u4", size // 4, 4).tolist() if data else []
        self.texts = data[4 + size :]
        self.begins: dict[str, bool] = {}

    def _next(self, at: int, byte: int) -> int | None:
        """The child of the cell ``at`` by a byte. A cell: label, leaf flag (bit 8), offset (bits 10 up, wider by bit 9)."""
        cell = self.cells[at]
        child = at ^ (cell >> 10) << ((cell & 1 << 9) >> 6) ^ byte
        return child if child < len(self.cells) and self.cells[child] & 0x800000FF == byte else None

    def _can_begin(self, char: str) -> bool:
        found = self.begins.get(char)
        if found is None:
            at: int | None = 0
            for byte in char.encode():
                at = self._next(at, byte) if at is not None else None
            found = self.begins[char] = at is not None
        return found

    def _longest(self, text: str, start: int) -> tuple[int, str] | None:
        """Characters of the longest key at ``start``, and its replacement."""
        at: int | None = 0
        best = None
        for end in range(start, len(text)):
            for byte in text[end].encode():
                at = self._next(at, byte) if at is not None else None
            if at is None:
                break
            cell = self.cells[at]
            if cell >> 8 & 1:
                leaf = self.cells[at ^ (cell >> 10) << ((cell & 1 << 9) >> 6)] & 0x7FFFFFFF
                best = end + 1 - start, self.texts[leaf : self.texts.index(b"\0", leaf)].decode()
        return best

    def replaced(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Stretches of the text: start, end and what they become. One that becomes itself has as many characters."""
        first = "".join(c for c in set(text) if self._can_begin(c)) if self.cells else ""
        at = 0
        if first:
            may = re.compile(f"[{re.escape(first)}]")
            found = may.search(text)
            while found:
                key = self._longest(text, found.start())
                if key:
                    if found.start() > at:
                        yield at, found.start(), text[at : found.start()]
                    at = found.start() + key[0]
                    yield found.start(), at, key[1]
                found = may.search(text, at if key else found.end())
        if at < len(text):
            yield at, len(text), text[at:]


class Normalizer:
    """The normal form of a text, and for each of its characters and its end the byte of the text it came from."""

    def __init__(self, spec: bytes) -> None:
        has = dict(_fields(spec))
        self.map = CharacterMap(has.get(_CHARSMAP, b""))
        self.prefix, self.trims = has.get(_DUMMY_PREFIX, 1), has.get(_REMOVE_EXTRA, 1)
        self.space = SPACE if has.get(_ESCAPE, 1) else " "
        #: Whether anything but spaces changes.
        self.changes = bool(self.map.cells or self.trims or not self.prefix or self.space != SPACE)

    def plain(self, text: str) -> str:
        """The normal form where nothing but spaces changes."""
        return f" {text}".replace(" ", SPACE) if text else ""

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        stretches = list(self.map.replaced(text))
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        byte_at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])
        if all(end - start == len(to) for start, end, to in stretches):
            origin = byte_at
        else:
            origin = np.concatenate([byte_at[start:end] if end - start == len(to) else np.full(len(to), byte_at[start]) for start, end, to in stretches] + [byte_at[-1:]])
        form = "".join(to for _, _, to in stretches)
        lead = 0
        if self.trims:
            lead = int(byte_at[_leading_spaces(stretches)])
            form, origin = self._trimmed(form, origin)
        if form and self.prefix:
            form, origin = " " + form, np.concatenate([[lead], origin])
        return (form.replace(" ", self.space), origin) if form else ("", np.zeros(1, np.int64))

    def _trimmed(self, form: str, origin: np.ndarray) -> tuple[str, np.ndarray]:
        """One space of each run, which keeps the first one's source, and none at the ends, where U+2581 goes too."""
        chars = np.frombuffer(form.encode("utf-32-le"), "<u4")
        space = chars == 32
        keep = ~(space & np.concatenate([[True], space[:-1]])) if len(form) else space
        last = np.flatnonzero(~space & (chars != ord(self.space)))
        if not len(last):
            return "", origin[-1:]
        keep[last[-1] + 1 :] = False
        end = origin[last[-1] + 1]
        return chars[keep].tobytes().decode("utf-32-le"), np.append(origin[:-1][keep], end)


def _leading_spaces(stretches: list[tuple[int, int, str]]) -> int:
    """Characters of the text that become a space each, before the first that doesn't."""
    at = 0
    for start, end, to in stretches:
        spaces = len(to) - len(to.lstrip(" "))
        if spaces < len(to) or not to:
            return start + (spaces if end - start == len(to) else 0)
        at = end
    return at


class Pieces:
    """A model's codec."""

    def __init__(self, model: bytes) -> None:
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        #: By id: bytes that a piece stands for in a text, and whether it is a byte or a control piece.
        self.bytes_of: list[bytes] = []
        self.is_byte, self.is_control = set(), set()
        self.byte_ids: list[int] = [0] * 256
        spec, trainer = b"", {}
        kinds = set()
        self.unknown = 0
        for number, value in _fields(model):
            if number == _PIECES:
                self._piece(dict(_fields(value)), kinds)
            elif number == _TRAINER:
                trainer = dict(_fields(value))
            elif number == _NORMALIZER:
                spec = value
        if trainer.get(_MODEL_TYPE, 1) != _BPE or not trainer.get(_BYTE_FALLBACK) or trainer.get(_AS_SUFFIX) or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or len(self.is_byte) != 256:
            raise ValueError("the model must be BPE with byte pieces, without user-defined or unused ones and white space as a suffix")
        self.bytes_of[self.unknown] = trainer.get(_UNK_SURFACE, " ⁇ ".encode())
        self.normalizer = Normalizer(spec)
        self.end = next((i for i in sorted(self.is_control) if self.names[i] == "</s>"), None)
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._merge_table()
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if apart else r"(?s:.+)")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    names: dict[int, str]

    def _piece(self, has: dict, kinds: set[int]) -> None:
        i, name, kind = len(self.bytes_of), has[1].decode(), has.get(3, _NORMAL)
        kinds.add(kind)
        self.names = getattr(self, "names", {})
        self.bytes_of.append(b"")
        if kind == _NORMAL:
            self.ids[name], self.scores[name] = i, struct.unpack("<f", has.get(2, bytes(4)))[0]
            self.bytes_of[i] = name.replace(SPACE, " ").encode()
        elif kind == _BYTE:
            self.is_byte.add(i)
            self.byte_ids[int(name[1:-1], 16)] = i
            self.bytes_of[i] = bytes([int(name[1:-1], 16)])
        elif kind == _CONTROL:
            self.is_control.add(i)
            self.names[i] = name
        elif kind == _UNKNOWN:
            self.unknown = i

    def _merge_table(self) -> None:
        """Symbols of a merge are pieces, by id, and other characters, by code point after the ids. Of each two symbols
        that make a piece: the pair as one number, in order, and the piece."""
        n = len(self.bytes_of)
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int64)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        of = lambda x: self.ids.get(x, n + ord(x) if len(x) == 1 else None)
        splits = [(of(name[:at]), of(name[at:]), i) for name, i in self.ids.items() for at in range(1, len(name))]
        pairs = sorted((left << 32 | right, i) for left, right, i in splits if left is not None and right is not None)
        self.pairs, self.made = (np.array(x, np.int64) for x in zip(*[*pairs, (1 << 62, -1)], strict=True))
        self.score = np.append(np.full(n, NEVER), NEVER)
        for name, i in self.ids.items():
            self.score[i] = self.scores[name]

    def _makes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        pair = left << 32 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.made[at], -1)

    def _short(self, units: list[str]) -> list[bytes]:
        """All units at once: in each round every unit merges its pair of the highest score, the leftmost of them."""
        size = np.array(list(map(len, units)))
        symbol = self.symbol[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")]
        unit, taken = np.repeat(np.arange(len(units)), size), np.ones(len(symbol), np.int64)
        makes = np.append(np.where(unit[1:] == unit[:-1], self._makes(symbol[:-1], symbol[1:]), -1), -1)
        done: list[tuple[np.ndarray, ...]] = []
        while len(symbol):
            score = self.score[makes]
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.repeat(np.maximum.reduceat(score, starts), np.diff(np.append(starts, len(unit))))
            ended = best == NEVER
            at = np.flatnonzero((score == best) & ~ended)
            at = at[np.append(True, unit[at[1:]] != unit[at[:-1]])] if len(at) else at
            symbol[at] = makes[at]
            taken[at] += taken[at + 1]
            done.append((unit[ended], symbol[ended], taken[ended]))
            stays = ~ended
            stays[at + 1] = False
            at = (np.cumsum(stays) - 1)[at]
            symbol, unit, taken, makes = symbol[stays], unit[stays], taken[stays], makes[stays]
            for i in (at, at[at > 0] - 1):  # the pairs that a merged symbol is in
                after = np.minimum(i + 1, max(len(symbol) - 1, 0))
                makes[i] = np.where((unit[i] == unit[after]) & (after > i), self._makes(symbol[i], symbol[after]), -1)
        unit, symbol, taken = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(unit, kind="stable")
        data = (symbol | taken << 32)[order].tobytes()
        ends = 8 * np.cumsum(np.bincount(unit, minlength=len(units)))
        values = [data[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        for i in set(unit[symbol >= len(self.bytes_of)].tolist()):
            values[i] = self._with_bytes(np.frombuffer(values[i], "<i8").tolist())
        return values

    def _with_bytes(self, pieces: list[int]) -> bytes:
        """The same with byte pieces for characters that aren't pieces."""
        out, n = array("q"), len(self.bytes_of)
        for piece in pieces:
            symbol = piece & 0xFFFFFFFF
            if symbol < n:
                out.append(piece)
            else:
                out.extend(self.byte_ids[x] for x in chr(symbol - n).encode("utf-8", "surrogatepass"))
                out[-1] |= 1 << 32
        return out.tobytes()

    def _long(self, unit: str) -> bytes:
        """One unit, by a heap."""
        parts, scores = list(unit), self.scores
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap = [(-scores[p], i, i + 1, len(p)) for i, p in enumerate(map(str.__add__, parts, parts[1:])) if p in scores]
        heapq.heapify(heap)

        def offer(left: int, right: int) -> None:
            pair = parts[left] + parts[right]
            if pair in scores:
                heapq.heappush(heap, (-scores[pair], left, right, len(pair)))

        while heap:
            _, left, right, size = heapq.heappop(heap)
            if after[left] != right or not parts[left] or len(parts[left]) + len(parts[right]) != size:
                continue  # one of the two has been merged meanwhile
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        n = len(self.bytes_of)
        return self._with_bytes([(self.ids[p] if p in self.ids else n + ord(p)) | len(p) << 32 for p in parts if p])

    def _values(self, units: list[str]) -> list[bytes]:
        """For each of different units its pieces as 64-bit numbers: the id, and from bit 32 on the characters it takes.

        They are kept from now on; when the young generation is full it becomes the old one.
        """
        values = list(map(self.young.get, units))
        new = [i for i, v in enumerate(values) if v is None]
        short = []
        for i in new:
            values[i] = self.old.get(units[i])
            if values[i] is None:
                if len(units[i]) <= SHORT:
                    short.append(i)
                else:
                    values[i] = self._long(units[i])
        if short:
            for i, value in zip(short, self._short([units[i] for i in short]), strict=True):
                values[i] = value
        if len(self.young) + len(new) > KEPT:
            self.old, self.young = self.young, {}
        self.young.update((units[i], values[i]) for i in new if len(units[i]) <= LONGEST)
        return values

    def pieces(self, forms: list[str]) -> list[np.ndarray]:
        """The pieces of each normal form, as 64-bit numbers."""
        units = list(chain.from_iterable(map(self.units.findall, forms)))
        different = list(dict.fromkeys(units))
        values = self._values(different)
        number = dict(zip(different, range(len(different)), strict=True))
        which = np.fromiter(map(number.__getitem__, units), np.int64, len(units))
        size = np.fromiter(map(len, values), np.int64, len(values)) // 8
        first, sizes = np.cumsum(size) - size, size[which]
        places = np.arange(sizes.sum()) + np.repeat(first[which] - (np.cumsum(sizes) - sizes), sizes)
        pieces = np.frombuffer(b"".join(values), "<i8")[places]
        return np.split(pieces, np.searchsorted(np.cumsum(pieces >> 32), np.cumsum(list(map(len, forms)))[:-1], "right"))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """For each text ids without an end id, the byte where the first piece's span starts, and those where spans end."""
        normal = list(map(self.normalizer, texts))
        for pieces, (_, origin) in zip(self.pieces([form for form, _ in normal]), normal, strict=True):
            yield pieces.astype("<i4"), int(origin[0]), origin[np.cumsum(pieces >> 32)]

    def decode(self, ids: list[int]) -> str:
        """Bytes join up within runs that no control piece cuts."""
        runs: list[list[int]] = [[]]
        for i in self.is_control.intersection(ids) and ids:
            if i in self.is_control:
                runs.append([])
            else:
                runs[-1].append(i)
        if len(runs) == 1:
            runs = [ids]
        some = next((r for r in runs if r), [])
        drops = bool(some) and (self.normalizer.prefix or self.normalizer.trims) and some[0] not in self.is_byte and some[0] != self.unknown and self.bytes_of[some[0]][:1] == b" "
        text = "".join(b"".join(map(self.bytes_of.__getitem__, r)).decode("utf-8", _EACH) for r in runs)
        return text[1:] if drops else text


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """U+FFFD for one byte, then on from the next."""
    assert isinstance(error, UnicodeDecodeError)
    return "�", error.start + 1


_EACH = "glyphmill-each-byte"

_codecs: dict[int, Pieces] = {}


def codec(model: bytes) -> Pieces:
    """One for each worker."""
    import codecs

    codecs.register_error(_EACH, _each_byte)
    if (key := hash(model)) not in _codecs:
        _codecs[key] = Pieces(model)
    return _codecs[key]


def few_collections(body: Callable[[], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``body`` with rare garbage collections: what a codec keeps are many objects, none of which is garbage."""
    usual = gc.get_threshold()
    gc.set_threshold(1 << 20)
    try:
        yield from body()
    finally:
        gc.set_threshold(*usual)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list array of arrays of one type."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(kind, int(ends[-1]), [None, pa.py_buffer(values.tobytes())]))


def together(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where each lot of texts begins, and the texts, empty for null."""
    at, size, texts = 0, 0, []
    for i, text in enumerate(column):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size > TOGETHER or i == len(column) - 1:
            yield at, texts
            at, size, texts = i + 1, 0, []


def encoded(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, ids (with the end id), start, ends (bytes of the text where each piece's span ends; the end id's is
    empty) and decoded, what decoding makes of the ids.

    The model is read on the driver, from ``model_file`` or the public one, and broadcast.
    """
    with open(model_file or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model.value)
        closing = np.array([] if pieces.end is None else [pieces.end], "<i4")
        for batch in batches:
            for at, texts in together(batch.column(1)):
                ids, starts, ends = [], [], []
                for own, start, own_ends in pieces.encode(texts):
                    ids.append(np.concatenate([own, closing]))
                    starts.append(start)
                    ends.append(np.concatenate([own_ends, [own_ends[-1] if len(own_ends) else start] * len(closing)]).astype(np.int64))
                decoded = [pieces.decode(x.tolist()) for x in ids]
                columns = [batch.column(0)[at : at + len(ids)], lists(ids, pa.int32()), pa.array(starts, pa.int64()), lists(ends, pa.int64()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "start", "ends", "decoded"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda batches: few_collections(lambda: coded(batches)), "doc_id long, ids array<int>, start long, ends array<long>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of ``encoded`` over documents; spans_crc32 is of start and ends, joined by commas."""
    return encoded(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.crc32(F.array_join(F.concat(F.array("start"), "ends").cast("array<string>"), ",")).alias("spans_crc32"),
    )
