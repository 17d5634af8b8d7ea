"""PII: pattern rules, and an information-theoretic measure of what other terms disclose.

The rules find e-mail addresses, IP addresses, card and phone numbers: the protected entities. A term near an
entity discloses it as far as the corpus has the two together: with p(e) the share of documents about the entity
and p(e|t) the share of those that hold the term that hold both near each other, all in different texts, the disclosure is their pointwise
mutual information over the entity's information, 1 - log p(e|t) / log p(e). Terms at or over the threshold are
spans too, wherever they stand in any text, generalised where they disclose less and removed where they disclose more.
p(e|t) is smoothed towards p(e) by PRIOR windows, so a pair met in few windows is measured, with less certainty.
Copies of a text count once, and copies of a window once in that weight. Terms are words without regard to case; words under 4 characters are terms, in their
own case, unless they begin with a small letter. A window is, on each side, the words up to the WINDOW-th of 4
characters or more, at most 3 * WINDOW of them, whatever stands between; words that touch an entity aren't counted.

Frequencies are counted over all different texts. Each task adds up its own; a text that has copies is sent on with
its terms, once from each task, and counted once. Only terms whose bucket in a bitmap of fixed size holds a
candidate are counted, which is exact as candidates are then joined by their hash.

Defined results: a null or empty text has no span, and stays as it is when sanitised. Repeated rows, rows that share
a doc_id and rows without one are scanned and sanitised each for itself, by their own text; windows of copies count
once. Terms with equal disclosure are told apart by nothing: all at or over the threshold are spans. An empty table
gives no rows. Texts may be of any length. Only doc_id and text are read; columns of other names don't matter.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed, table
from glyphmill.operators.skew import HEAVY_KEYS, LIGHT

KINDS = ["email", "ip", "card", "phone", "term"]
#: Words of 4 characters or more on each side of an entity that are its window, with the shorter ones among them;
#: windows that p(e) weighs in p(e|t); disclosure that makes a span; disclosure that removes.
WINDOW, PRIOR, THRESHOLD, REMOVE = 8, 1.0, 0.75, 0.9
#: Buckets of the bitmap of candidates; terms that a task adds up before it sends them on, and strings it remembers.
BUCKETS, FLUSH = 1 << 22, 1 << 17
#: Different marked strings in a text up to which each is searched for; with more the text is taken apart.
SEARCHED = 16
#: Tasks over which a text with very many copies is dealt.
SALTS = 64
#: Buckets of the bitmap of disclosing terms.
MARKS = 1 << 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits: it would have started with the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_](?:[\w'-]*[^\W_])?")
_DIGITS = re.compile(r"[^0-9]+")
_PART = re.compile(r"\S+")
_PUNCTUATION = string.punctuation + "\u2018\u2019\u201c\u201d\u00ab\u00bb\u2013\u2014\u2026\u00bf\u00a1"

T = TypeVar("T")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules' matches, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _DIGITS.sub("", m.group())) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


def _hash(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def _term(word: str) -> str | None:
    """A word as a term. Short ones are names or numbers if they don't begin with a small letter, in their own case."""
    return word.lower() if len(word) >= 4 else None if word[0].islower() else word


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches covered by the spans, in order and apart from each other."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _outside(places: Iterator[tuple[int, int, T]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, T]]:
    """Places, in order of their start, that touch none of the taken stretches."""
    at = 0
    for place in places:
        while at < len(taken) and taken[at][1] <= place[0]:
            at += 1
        if at == len(taken) or taken[at][0] >= place[1]:
            yield place


def contexts(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(entity, window, term) of the words near each entity, words that touch an entity left out."""
    words = list(_outside(((*m.span(), m.group()) for m in _WORD.finditer(text)), _apart(spans)))
    starts = [w[0] for w in words]
    for kind, start, end in spans:
        terms: list[str] = []
        at = bisect_left(starts, start)
        for side in (range(at - 1, max(-1, at - 1 - 3 * WINDOW), -1), range(at, min(len(words), at + 3 * WINDOW))):
            long, near = 0, []
            for i in side:
                near.append(words[i][2])
                long += len(words[i][2]) >= 4
                if long == WINDOW:
                    break
            terms += (t for w in (reversed(near) if side.step < 0 else near) if (t := _term(w)))
        value = text[start:end].lower() if kind == 0 else text[start:end] if kind == 1 else _DIGITS.sub("", text[start:end])
        entity, window = _hash(f"{kind}:{value}"), _hash(" ".join(terms))
        for t in terms:
            yield entity, window, _hash(t)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_NEAR = pa.struct([("entity", pa.int64()), ("window", pa.int64()), ("term", pa.int64())])
_HIT = pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, near = [], []
        for text in batch.column(2):
            text = text.as_py() or ""
            base = base_spans(text)
            near.append([dict(zip(("entity", "window", "term"), c, strict=True)) for c in contexts(text, base)] if base else [])
            spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in base])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(near, pa.list_(_NEAR))], names=["doc_id", "digest", "base", "near"])


class _Sieve(Generic[T]):
    """What ``make`` finds in strings between white space. Those in which it finds nothing are set aside at once.

    Strings are remembered in two generations of FLUSH each.
    """

    def __init__(self, make: Callable[[str], tuple[T, ...]]) -> None:
        self.make = make
        self.dull: set[str] = set()
        self.before: set[str] = set()
        self.found: dict[str, tuple[T, ...]] = {}

    def __call__(self, text: str) -> dict[str, tuple[T, ...]]:
        parts = set(text.split())
        parts -= self.dull
        dull = parts & self.before
        parts -= dull
        known = parts & self.found.keys()
        parts -= known
        for part in parts:
            if value := self.make(part):
                self.found[part] = value
                known.add(part)
            else:
                dull.add(part)
        out = dict(zip(known, map(self.found.__getitem__, known), strict=True))
        if len(self.found) >= FLUSH:
            self.found.clear()
        if len(self.dull) >= FLUSH:
            self.before, self.dull = self.dull, set()
        self.dull |= dull
        return out


def _marked(bits: bytes, size: int) -> Callable[[str], tuple[tuple[int, int, int], ...]]:
    """(start, end, hash) of the terms in a string between white space whose bucket in a bitmap is set."""

    def found(part: str) -> tuple[tuple[int, int, int], ...]:
        word = part.strip(_PUNCTUATION)
        if word.isalnum():  # one word, most often one that isn't wanted
            term = word.lower() if len(word) >= 4 else None if word[0].islower() else word
            if term is None or not _holds(bits, xxhash.xxh64_intdigest(term) & (size - 1)):
                return ()
        hashes = ((*m.span(), _hash(t)) for m in _WORD.finditer(part) if (t := _term(m.group())))
        return tuple(x for x in hashes if _holds(bits, x[2] & (size - 1)))

    return found


def _frequencies(bitmap, copied) -> callable:
    """Counts of terms over texts without copies, and the terms of each text whose digest's bucket is among ``copied``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, counts = _marked(bitmap.value.tobytes(), BUCKETS), Counter()
        several, seen = copied.value.tobytes() if copied else None, set()

        def given(digests: list, terms: list, counts: dict) -> pa.RecordBatch:
            few, many = [None] * len(digests), [None] * len(counts)
            columns = [([*digests, *many], pa.binary()), ([*terms, *many], pa.list_(pa.int64())), ([*few, *counts], pa.int64()), ([*few, *counts.values()], pa.int64())]
            return pa.record_batch([pa.array(x, t) for x, t in columns], ["digest", "terms", "term", "n"])

        sieve = _Sieve(lambda part: tuple(h for _, _, h in marked(part)))
        for batch in batches:
            digests, terms = [], []
            for digest, text in zip(batch.column(0), batch.column(1), strict=True):
                digest = digest.as_py()
                found = set().union(*sieve(text.as_py() or "").values())
                if several and found and _holds(several, int.from_bytes(digest[:4], "big") % BUCKETS):
                    if digest not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        terms.append(list(found))
                    continue
                counts.update(found)
            if digests:
                yield given(digests, terms, {})
            if len(counts) >= FLUSH:
                yield given([], [], counts)
                counts = Counter()
            if len(seen) >= FLUSH:
                seen.clear()
        yield given([], [], counts)

    return counted


def _holds(bits: bytes, at: int) -> int:
    return bits[at >> 3] >> (7 - (at & 7)) & 1


def _stand(text: str, parts: dict[str, tuple]) -> Iterator[tuple[int, int, int]]:
    """(start, end, term) of the marked words of ``parts``, strings between white space, in order."""
    if len(parts) > SEARCHED:
        places = ((m.start(), found) for m in _PART.finditer(text) if (found := parts.get(m.group())))
    else:
        places = []
        for part, found in parts.items():
            at = text.find(part)
            while at >= 0:
                end = at + len(part)
                if (not at or text[at - 1].isspace()) and (end == len(text) or text[end].isspace()):
                    places.append((at, found))
                at = text.find(part, end)
        places.sort()
    for at, found in places:
        for start, end, term in found:
            yield at + start, at + end, term


def _occurrences(bitmap) -> callable:
    """Where words of the bitmap's buckets stand in each text, once for copies in a batch; entities left out."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = _Sieve(_marked(bitmap.value.tobytes(), MARKS))
        for batch in batches:
            out = {}
            for digest, text in zip(batch.column(0), batch.column(1), strict=True):
                digest = digest.as_py()
                if digest not in out:
                    text = text.as_py() or ""
                    parts = sieve(text)
                    hits = _outside(_stand(text, parts), _apart(base_spans(text))) if parts else ()
                    out[digest] = [{"term": h, "start": a, "end": b} for a, b, h in hits]
            out = {d: hits for d, hits in out.items() if hits}
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.list_(_HIT))], names=["digest", "hits"])

    return placed


def _bitmap(spark: SparkSession, buckets: DataFrame, size: int):
    """A frame's one column of buckets as a broadcast bitmap, or None where it has none; at most ``size`` numbers come here."""
    taken = buckets.distinct().toPandas().iloc[:, 0].to_numpy()
    if not len(taken):
        return None
    bits = np.zeros(size, np.uint8)
    bits[taken] = 1
    return spark.sparkContext.broadcast(np.packbits(bits))


def _bucket(size: int) -> Column:
    return F.pmod("term", F.lit(size)).cast("int")


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _by_digest(rows: DataFrame, terms: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with the terms of their text. Texts with very many copies, HEAVY_KEYS at most, are dealt over SALTS tasks."""
    total = texts.agg(F.sum("copies")).first()[0]
    heavy = F.broadcast(texts.where(F.col("copies") > max(LIGHT, total // HEAVY_KEYS)).select("digest", F.lit(True).alias("heavy")))
    dealt = rows.join(heavy, "digest", "left").withColumn("salt", F.when(F.col("heavy"), F.pmod("row", F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    every = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = terms.join(heavy, "digest", "left").withColumn("salt", F.explode(every))
    return dealt.drop("heavy").join(spread.drop("heavy"), ["digest", "salt"], "left").drop("salt")


def scanned(docs: DataFrame, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """row, doc_id, digest of the text, base and spans: arrays of (kind, start, end) by kind, then start; terms also in ``disclosure``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), "text")
    shape = "array<struct<kind:int,start:int,end:int>>"
    found = docs.mapInArrow(_scan, f"doc_id long, digest binary, base {shape}, near array<struct<entity:long,window:long,term:long>>")
    found = checkpointed(found.withColumn("row", F.monotonically_increasing_id()))
    near = found.where(F.size("near") > 0).dropDuplicates(["digest"]).select("digest", F.explode("near").alias("x")).select("digest", "x.*")
    pairs = checkpointed(near.groupBy("entity", "term").agg(F.countDistinct("digest").alias("both"), F.countDistinct("window").alias("windows")))
    shared = _bitmap(docs.sparkSession, pairs.select(_bucket(BUCKETS)), BUCKETS)
    none = F.array().cast("array<struct<kind:int,start:int,end:int,disclosure:double>>")
    bare = found.select("row", "doc_id", "digest", "base", F.col("base").alias("spans"), none.alias("terms"))
    if shared is None:
        return bare
    texts = checkpointed(found.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).select("digest", "copies", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int").alias("b")))
    copied = _bitmap(docs.sparkSession, texts.where("copies > 1").select("b"), BUCKETS)
    counts = checkpointed(docs.select("digest", "text").mapInArrow(_frequencies(shared, copied), "digest binary, terms array<long>, term long, n long"))
    once = counts.where("digest is not null").groupBy("digest").agg(F.first("terms").alias("terms")).select(F.explode("terms").alias("term"), F.lit(1).cast("long").alias("n"))
    frequency = counts.where("digest is null").select("term", "n").union(once).groupBy("term").agg(F.sum("n").alias("df"))
    about = near.groupBy("entity").agg(F.countDistinct("digest").alias("of_entity"))
    total = F.lit(float(max(2, texts.count())))
    share = F.least(F.col("of_entity"), total - 1) / total
    given = (F.col("windows") * F.least(F.lit(1.0), F.col("both") / F.greatest("df", F.lit(1))) + prior * share) / (F.col("windows") + prior)
    told = pairs.join(frequency, "term").join(about, "entity").select("term", (1 - F.log(given) / F.log(share)).alias("disclosure")).where(F.col("disclosure") >= threshold)
    told = checkpointed(told.groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    marks = _bitmap(docs.sparkSession, told.select(_bucket(MARKS)), MARKS)
    if marks is None:
        return bare
    hits = docs.select("digest", "text").mapInArrow(_occurrences(marks), "digest binary, hits array<struct<term:long,start:int,end:int>>").groupBy("digest").agg(F.first("hits").alias("hits"))
    hit = hits.select("digest", F.explode("hits").alias("x")).select("digest", "x.*").join(told, "term")
    terms = hit.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct(F.lit(KINDS.index("term")).alias("kind"), "start", "end", "disclosure"))).alias("terms"))
    out = _by_digest(found.select("row", "doc_id", "digest", "base"), terms, texts).withColumn("terms", F.coalesce("terms", none))
    return out.select("row", "doc_id", "digest", "base", F.concat("base", F.transform("terms", lambda t: F.struct(t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end")))).alias("spans"), "terms")


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text is None:
                out.append(None)
                continue
            marks = [(start, end, f"[{KINDS[kind].upper()}]") for kind, start, end in base_spans(text)]
            for t in terms or ():
                word = text[t["start"] : t["end"]]
                general = "[NUMBER]" if word[:1].isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"
                marks.append((t["start"], t["end"], "" if t["disclosure"] >= REMOVE else general))
            parts, at = [], 0
            for a, b, mark in sorted(marks):
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def sanitised(docs: DataFrame, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """doc_id and text of every row, with entities masked and disclosing terms generalised or removed.

    What a text discloses depends on the text alone, so terms come by its digest, not by doc_id.
    """
    terms = scanned(docs, threshold, prior).where(F.size("terms") > 0).dropDuplicates(["digest"]).select("digest", "terms")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _digest().alias("digest")).join(terms, "digest", "left")
    return joined.select("doc_id", "text", "terms").mapInArrow(_masked, "doc_id long, text string")


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])), ",")


def _of(kind: int):
    return lambda s: s["kind"] == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
