"""SimHash near-duplicates: fingerprints joined over a grid of segment bit counts.

A fingerprint's 64 bits are cut into 32 segments of two bits. The counts of set bits in the segments embed it in a
grid, and the Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. A count
of 0, 1 or 2 is held in unary (00, 01, 11), so the embedding is one long and the Manhattan distance of two of them
is the number of bits that differ.

The range join cuts the 32 coordinates into BLOCKS runs. Points at distance 3 or less agree on all but 3 runs at
most, so they meet in a cell of one of the grids that keep BLOCKS - 3 runs; candidates of a cell are filtered by
the lower bound and then verified by the exact distance. Only distinct fingerprints are joined, copies share one.
In cells with more than CELL fingerprints no pairs are formed: each of their fingerprints is sent to the points
within distance 1 and 2 of it. Those that meet within 1 of a point are within 2 of each other; one within 1 and
one within 2 are within 3; and every pair at distance 3 or less meets in one of these ways. So each point's
meeting is a star of links, exact and in proportion to the fingerprints.

Defined results: a text that is null or has no word has fingerprint zero, linked like any other; fewer than three
words make one shingle of them all. Repeated rows each get their row. A null doc_id never is a component's id
unless all its members' are null. An empty table gives no rows; texts of any length are hashed in parts. Of several
least doc_ids there is one value, so ties can't arise. Only doc_id and text are read; columns of other names, fp or
component_id among them, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import DOCUMENT_COLUMNS, checkpointed, table
from glyphmill.operators.components import connected_components
from glyphmill.operators.skew import skewed_join

SHINGLE, SEED, DISTANCE = 3, 42, 3
BLOCKS = 6
#: Distinct fingerprints in a cell up to which it is joined by pairs; larger cells go by meeting points.
CELL = 512
#: Shingles hashed at once.
CHUNK = 1 << 16

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_GAPS = bytes.maketrans(bytes(range(9, 14)), b" " * 5)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_GAPS).split(b" ") if w]
    if not words:
        return 0
    total = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns in ``keep`` (doc_id by default) and fp, a long with the fingerprint's bits."""
    keep = ["doc_id"] if keep is None else keep
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select(*keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes[:-1])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x.as_py()) for x in batch.columns[-1]), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got.view(np.int64))], names=[*keep, "fp"])

    return docs.mapInArrow(scanned, f"{schema}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _embedding(fp: Column) -> Column:
    """Counts of the two-bit segments in unary: the low bit is their OR, the high bit their AND."""
    low = F.lit(0x5555555555555555)
    other = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(other).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(other).bitwiseAND(low), 1))


def _grids() -> list[int]:
    """Masks of the bits that each grid keeps."""
    ends = [round(i * 32 / BLOCKS) * 2 for i in range(BLOCKS + 1)]
    runs = [sum(1 << b for b in range(ends[i], ends[i + 1])) for i in range(BLOCKS)]
    return [_signed(sum(c)) for c in combinations(runs, BLOCKS - DISTANCE)]


def _flips(n: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for c in combinations(range(64), n)]


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (u, v) that connect just the fingerprints of column ``fp`` within DISTANCE of each other."""
    grid = F.posexplode(F.transform(F.array(*[F.lit(m) for m in _grids()]), lambda m: F.col("e").bitwiseAND(m))).alias("grid", "cell")
    points = distinct.select("fp", _embedding(F.col("fp")).alias("e")).select("fp", "e", grid)
    sizes = points.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    points = checkpointed(points.join(sizes, ["grid", "cell"]))
    small = points.where(F.col("n") <= cell).select("grid", "cell", "fp", "e")
    a, b = small.select("grid", "cell", F.col("fp").alias("u"), F.col("e").alias("eu")), small.select("grid", "cell", F.col("fp").alias("v"), F.col("e").alias("ev"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("eu").bitwiseXOR(F.col("ev"))) <= DISTANCE) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
    same = reduce(lambda x, y: x & y, [a[c] == b[c] for c in ("grid", "cell")])
    pairs = a.join(b, same & near).select("u", "v")
    crowded = points.where(F.col("n") > cell).select("fp").distinct()
    flips = crowded.sparkSession.createDataFrame([(x, d) for d in (0, 1, 2) for x in _flips(d)], "x long, d int")  # 2081 rows, whatever the input
    met = crowded.join(F.broadcast(flips)).select(F.col("fp").bitwiseXOR(F.col("x")).alias("at"), "fp", "d")
    within = met.where("d <= 1").groupBy("at").agg(F.min("fp").alias("hub"))
    stars = met.join(within, "at").where("fp <> hub").select(F.col("hub").alias("u"), F.col("fp").alias("v"))
    return pairs.union(stars)


def grouped(prints: DataFrame, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(fp, component, least, n) of every different fingerprint, and (component, least, n), with the least doc_ids.

    n counts the rows of a fingerprint, and the fingerprints of a component.
    """
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    of = connected_components(links(least.select("fp"), cell)).withColumnsRenamed({"node": "fp"})
    group = checkpointed(least.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    return group, group.groupBy("component").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n"))


def components(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, fp and component_id of every row of docs."""
    prints = checkpointed(fingerprints(docs))
    group, ids = grouped(prints, cell)
    different = group.count()
    of = skewed_join(group.select("fp", "component", F.col("n").alias("rows")), ids.withColumnRenamed("least", "component_id"), ["component"], different)
    of = checkpointed(of.select("fp", "component_id", F.col("rows").alias("n")))
    return skewed_join(prints, of, ["fp"], prints.count()).select("doc_id", "fp", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id, rows without one last.

    Rows are told apart by 128 bits of hashes of all their columns; of equal rows one stays. Texts are shuffled once.
    """
    marks = {"h1": F.xxhash64(*DOCUMENT_COLUMNS), "h2": F.xxhash64(F.lit("second"), *DOCUMENT_COLUMNS)}
    docs = docs.select(*DOCUMENT_COLUMNS).withColumns(marks)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2")
    prints = checkpointed(fingerprints(docs.withColumn("key", key), ["doc_id", "key"]))
    group, _ = grouped(prints)
    first = prints.groupBy("fp").agg(F.min("key").alias("key")).join(group.select("fp", "component"), "fp")
    first = first.groupBy("component").agg(F.min("key").alias("key")).select("key.h1", "key.h2")
    return docs.join(first, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select(*DOCUMENT_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
