"""Embedding near-duplicates by spherical-cap filters of structured random product codes.

The filters are the sums of one codeword from each block of a random rotation of the space. A vector's home is the
filter nearest to it, which is the nearest codeword in each block. A vector at cosine t differs from it by a step
of squared length 2 - 2t, and to move the home in a block to another codeword, the step's part across the plane
between the two codewords must reach the vector's distance from that plane. Squared and summed over the blocks,
those distances are what list decoding bounds: a vector is sent to every filter whose sum is at most BOUND times
what a step of random direction has in one dimension. The blocks are decoded one after another, keeping only
prefixes within the bound, so filters that are out of reach are never enumerated.

A vector links with those it meets in their homes, so each pair is met once in each direction, and is verified by
its cosine in double precision. Homes and visitors of a filter are cut into groups of at most GROUP vectors, and
each pair of groups is a task's matrix product; it sends on the count of links of each visitor and a spanning
forest, not the pairs. Equal vectors under a label are one class, counted, and never expanded.

Recall: with random directions a pair at the very threshold is missed in one direction with a probability of about
MISS, and less beyond it; tests measure it against brute force.

Defined results: vectors that are null, zero, empty, or hold null or non-finite components, and those whose label
is null, link with nothing: n_links 0, component_id their own vec_id, kept true. Vectors of different dimension
never link. Rows that repeat a vector link with each other and are counted as other vectors. A null vec_id is
never a component's id unless all its members' are null. An empty table gives no rows. Only vec_id, embedding and
label are read; columns of other names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed, table
from glyphmill.operators.components import connected_components
from glyphmill.operators.skew import skewed_join

THRESHOLD = 0.98
BLOCKS = 2
#: Vectors of a label meant to have the same home, which sets the number of codewords.
PER_HOME = 128
MISS = 1e-5
BOUND = 2 * math.log(1 / MISS)
#: Vectors in a group: bounds a task's matrices.
GROUP = 512
SEED = 7

_Codes = tuple[np.ndarray, list[np.ndarray]]


def codebook(dim: int, words: int) -> _Codes:
    """A rotation, and for each block its codewords, which are unit vectors."""
    rng = np.random.default_rng([SEED, dim, words])
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    codes = []
    for part in np.array_split(np.arange(dim), min(BLOCKS, dim)):
        c = rng.standard_normal((words, len(part)))
        codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12))
    return rotation, codes


def decode(vectors: np.ndarray, book: _Codes, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, filter, whether it is the row's home) of all filters within reach of each unit vector."""
    rotation, codes = book
    words = len(codes[0])
    turned = vectors @ rotation
    rows, filters, cost, home = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors)), np.ones(len(vectors), bool)
    at = 0
    for c in codes:
        inner = turned[:, at : at + c.shape[1]] @ c.T
        at += c.shape[1]
        best = inner.argmax(axis=1)
        apart = 2 - 2 * (c[best] @ c.T)  # squared, of the best codeword from each; equal ones can't be told apart
        gap = (inner.max(axis=1, keepdims=True) - inner) ** 2 / np.where(apart > 1e-12, apart, np.inf)
        gap[np.arange(len(best)), best] = 0
        total = cost[:, None] + gap[rows]
        i, w = np.nonzero(total <= reach)
        home = home[i] & (w == best[rows[i]])
        filters, cost, rows = filters[i] * words + w, total[i, w], rows[i]
    return rows, filters, home


def _sent(words: int, threshold: float):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, _Codes] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                flat = [np.asarray(v, np.float64) for v in part.column(1).to_pylist()]
                dims = np.array([len(v) for v in flat])
                for dim in np.unique(dims).tolist():
                    pick = np.flatnonzero(dims == dim)
                    x = np.stack([flat[i] for i in pick])
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    if dim not in books:
                        books[dim] = codebook(dim, words)
                    rows, filters, home = decode(x, books[dim], (2 - 2 * threshold) / dim * BOUND)
                    took = part.take(pa.array(pick[rows]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), took.column(2), pa.array(filters), pa.array(home), took.column(0), took.column(1), took.column(3)], names=["dim", "label", "filter", "home", "id", "embedding", "n"])

    return sent


def _linked(threshold: float):
    """Visitors and homes of a filter, sorted, to counts of links and the edges of a forest."""

    def product(homes: list, visits: list) -> pa.RecordBatch:
        def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
            x = np.stack([np.asarray(v, np.float64) for _, v, _ in vectors])
            x /= np.abs(x).max(axis=1, keepdims=True)
            return x, np.linalg.norm(x, axis=1)

        (h, nh), (v, nv) = unit(homes), unit(visits)
        hit = (v @ h.T) / (nv[:, None] * nh[None]) >= threshold
        hid, vid = [x[0] for x in homes], [x[0] for x in visits]
        place = {x: i for i, x in enumerate(hid)}
        for i, x in enumerate(vid):
            if x in place:
                hit[i, place[x]] = False
        counts = hit @ np.array([x[2] for x in homes], np.int64)
        group = list(range(len(hid)))  # union of the homes that a visitor links

        def find(x: int) -> int:
            while group[x] != x:
                group[x] = group[group[x]]
                x = group[x]
            return x

        edges = []
        for i in np.flatnonzero(counts):
            js = np.flatnonzero(hit[i]).tolist()
            edges.append((vid[i], hid[js[0]]))
            for j in js[1:]:
                a, b = find(js[0]), find(j)
                if a != b:
                    group[b] = a
                    edges.append((vid[i], hid[j]))
        some = np.flatnonzero(counts)
        u = [vid[i] for i in some] + [a for a, _ in edges]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([None] * len(some) + [b for _, b in edges], pa.int64()), pa.array([*counts[some].tolist(), *[0] * len(edges)], pa.int64())], names=["u", "v", "n"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, visits = None, [], []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *k, home, i, vector, n in zip(*cols, strict=True):
                if k != key:
                    if homes and visits:
                        yield product(homes, visits)
                    key, homes, visits = k, [], []
                (homes if home else visits).append((i, vector, n))
        if homes and visits:
            yield product(homes, visits)

    return linked


def linked(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label)."""
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    valid = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    # A class is found again by 128 bits of its vector's and label's hashes, so vectors aren't shuffled a second time.
    hashes = {"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit("second"), "embedding", "label")}
    classes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("n"))
    classes = checkpointed(classes.withColumns(hashes).withColumn("id", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    words = max(1, round((largest / PER_HOME) ** (1 / BLOCKS)))
    sent = checkpointed(classes.select("id", "embedding", "label", "n").mapInArrow(_sent(words, threshold), f"dim int, label string, filter long, home boolean, id long, embedding {kind}, n long"))
    key = ["dim", "label", "filter"]
    groups = lambda c: F.ceil(F.count(F.when(c, 1)) / GROUP).cast("int")
    sizes = sent.groupBy(key).agg(groups(F.col("home")).alias("homes"), groups(F.lit(True)).alias("visits"), F.count(F.lit(1)).alias("n_")).where("homes > 0")
    met = skewed_join(sent.withColumnRenamed("n", "copies"), checkpointed(sizes.withColumnRenamed("n_", "n")), key, sent.count()).withColumnRenamed("copies", "n")
    slot = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = met.where("home").select(*key, slot(F.col("homes")).alias("h"), span("visits").alias("v"), F.lit(True).alias("home"), "id", "embedding", "n")
    visits = met.select(*key, span("homes").alias("h"), slot(F.col("visits")).alias("v"), F.lit(False).alias("home"), "id", "embedding", "n")
    dealt = homes.union(visits)
    cell = [*key, "h", "v"]
    found = checkpointed(dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_linked(threshold), "u long, v long, n long"))
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("links")).withColumnRenamed("u", "id")
    of = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "id")
    group = classes.select("id", "vec", "k1", "k2", "n").join(of, "id", "left").join(counts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    group = checkpointed(group.withColumnRenamed("n", "copies"))
    ids = group.groupBy("component").agg(F.min("vec").alias("component_id"), F.count(F.lit(1)).alias("n"))
    result = skewed_join(group, ids, ["component"], group.count())
    result = checkpointed(result.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.col("copies").alias("n")))
    known = skewed_join(valid.withColumns(hashes).select("vec_id", "k1", "k2"), result, ["k1", "k2"], result.agg(F.sum("n")).first()[0] or 0)
    other = rows.where(F.col("label").isNull() | ~F.coalesce(finite, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = known.select("vec_id", "n_links", "component_id").union(other)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id as u, vec_id as v from embeddings union select r.u, p.v from r join p on r.v = p.u),
c as (select u, min(v) as component_id from r group by u),
n as (select u, count(*) as n_links from p group by u)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on c.u = e.vec_id left join n on n.u = e.vec_id
"""
