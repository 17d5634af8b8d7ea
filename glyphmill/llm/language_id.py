"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language on the executors, each task adding up its documents before anything is
shuffled; the matrix of log-probabilities is broadcast, and texts are scored in numpy from the sparse n-grams
they hold: a batch of texts is a sparse matrix of n-gram counts, multiplied by the matrix of log-probabilities in
parts of bounded size. Every text is scored whole, in pieces of bounded size.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0; so is every text where
no language was learned. Ties go to the first language in order. Repeated rows are scored each for itself. A null
doc_id is in no fold: never learned from, held_out false. Rows with lang null are scored and never learned from.
An empty table gives no rows and no language. Columns of other names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import table

#: Hash buckets (a power of two), n-gram lengths, and additive smoothing.
BUCKETS, LENGTHS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
#: The classifier is fitted on about this many documents of each language at most, chosen by hash.
TRAIN_DOCS_PER_LANGUAGE = 20_000
#: Code points scored at once: bounds a worker's memory whatever the length of a text.
PIECE = 1 << 18
#: The broadcast matrix holds a column for each language; more labels than this are an error, not a cut.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: Numbers of the sparse product held at once, and texts.
CELLS, TEXTS = 1 << 19, 128


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    #: BUCKETS x languages
    log_prob: np.ndarray


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points in pieces that overlap by the longest n-gram less one, case folded; a space stands at both ends."""
    over = max(LENGTHS) - 1
    text = f" {text} "
    for at in range(0, len(text) - over, PIECE):
        yield np.frombuffer(text[at : at + PIECE + over].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def ngrams(codes: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of a piece; a shorter n-gram is counted at the start of each longest one."""
    n = len(codes) - max(LENGTHS) + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    out = []
    h = np.zeros(len(codes), np.uint32)
    for k in range(1, max(LENGTHS) + 1):
        h = (h[: len(codes) - k + 1] ^ codes[k - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k in LENGTHS:
            out.append((h[:n] + np.uint32(k)) & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            text, lang = text.as_py(), lang.as_py()
            if lang not in counts:
                counts[lang], docs[lang] = np.zeros(BUCKETS, np.int64), 0
            docs[lang] += 1
            for codes in _pieces(text):
                counts[lang] += np.bincount(ngrams(codes), minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.record_batch([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([docs[lang], *c[at].tolist()], pa.int64())], ["lang", "bucket", "n"])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def train(docs: DataFrame, limit: int = TRAIN_DOCS_PER_LANGUAGE) -> Model:
    """Learns from text and non-null lang of the documents outside the held-out fold."""
    known = docs.where((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model((), np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 20, (limit << 20) // n))])
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")))
    counted = some.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sizes))
    column = {x: i for i, x in enumerate(languages)}
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    grams = counted[counted.bucket >= 0]
    counts[grams.bucket.to_numpy(), grams.lang.map(column).to_numpy()] += grams.n.to_numpy()
    prior = np.array([float(sizes[x]) for x in languages])
    return Model(languages, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _sparse(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different buckets and their counts, piece by piece."""
    for codes in _pieces(text):
        grams = ngrams(codes).astype(np.uint16)
        grams.sort(kind="stable")  # by radix
        starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
        yield grams[starts], np.diff(np.append(starts, len(grams)))


def _product(rows: list[int], parts: list[tuple[np.ndarray, np.ndarray]], model: Model, totals: np.ndarray) -> None:
    """Adds a sparse matrix of counts, in parts of one row each, times the matrix of log-probabilities."""
    sizes = np.array([len(b) for b, _ in parts])
    buckets, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    full = np.flatnonzero(sizes)
    if len(full):
        sums = np.add.reduceat(model.log_prob[buckets] * counts[:, None].astype(np.float64), (np.cumsum(sizes) - sizes)[full], axis=0)
        np.add.at(totals, np.array(rows)[full], sums)


def scores(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """The language of each text and its posterior probability; at most about CELLS numbers are held at once."""
    totals = np.tile(model.log_prior.astype(np.float64), (len(texts), 1))
    known = [bool(model.languages) and _has_letter(t) for t in texts]
    rows: list[int] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held, room = 0, max(1, CELLS // max(1, len(model.languages)))
    for i in np.flatnonzero(known).tolist():
        for buckets, counts in _sparse(texts[i]):
            for at in range(0, len(buckets), room):
                rows.append(i)
                parts.append((buckets[at : at + room], counts[at : at + room]))
                held += len(parts[-1][0])
                if held >= room:
                    _product(rows, parts, model, totals)
                    rows, parts, held = [], [], 0
    if parts:
        _product(rows, parts, model, totals)
    out = []
    for ok, total in zip(known, totals, strict=True):
        best = int(total.argmax()) if ok else 0
        out.append((model.languages[best], float(1.0 / np.exp(total - total[best]).sum())) if ok else (UNKNOWN, 0.0))
    return out


def score(text: str | None, model: Model) -> tuple[str, float]:
    return scores([text], model)[0]


def predicted(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in ``keep`` (doc_id by default) with lang_pred and score, by text alone."""
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            got = [x for at in range(0, batch.num_rows, TEXTS) for x in scores([t.as_py() for t in column.slice(at, TEXTS)], shared.value)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    docs = docs.select(*keep, F.col("text").alias("text_"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes[: len(keep)])
    return docs.mapInArrow(scored, f"{schema}, lang_pred string, score double")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least one half; their columns as they were."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return predicted(docs, train(docs), columns).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.5)).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs, train(docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
