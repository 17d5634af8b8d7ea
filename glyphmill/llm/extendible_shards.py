"""Sharding by extendible hashing: only buckets over the byte limit split, each on another bit of the hash.

A directory is indexed by the first bits of a row's hash. A bucket of some depth holds the rows that share that many
bits, and is a shard if it fits the limit, or if all its rows have one hash, and the bucket it was split from is
not. Buckets are sums of a histogram over ``step`` more bits than about the right depth; what is still too large
there is split in another round, over only its own rows. What comes to the driver is the total and the number of
buckets left. Rows with the same hash repeat each other in doc_id and text; if together they are over the limit,
they are dealt over pages of one shard, numbered by task and place in it. So every page fits its limit, but for
one that holds a single row which is larger itself (``over_limit``).

Defined results: null text has no bytes, a null doc_id is hashed as the empty string. An empty table has no shard.
A text over the limit is a page of its own. Repeated rows are dealt over pages in the order of tasks; as they are
equal, which goes where makes no difference. Columns that aren't asked for don't matter, whatever their names; those
named shard, depth, page, bytes or over_limit can't be asked for by ``sharded`` and are written by ``write`` as they
are only under other names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed, table
from glyphmill.operators.skew import skewed_join

#: The byte limit of a shard's texts; large outputs take a larger one.
SHARD_BYTES = 1 << 20
BITS = 60


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.expr(f"shiftright(h, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", h, F.lit(BITS) - depth)


def _hash() -> Column:
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(BITS // 4)), 16, 10).cast("long")


def sharded(docs: DataFrame, limit: int = SHARD_BYTES, keep: list[str] | None = None, step: int = 4) -> DataFrame:
    """Columns in ``keep`` (doc_id by default) with shard (its bits), depth, page, bytes and over_limit."""
    keep = ["doc_id"] if keep is None else keep
    named = {f"keep_{i}": F.col(c) for i, c in enumerate(keep)}
    rows = docs.select(*[c.alias(n) for n, c in named.items()], _hash().alias("h"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    rows = checkpointed(rows)  # the hashes of all texts are made once
    sizes = checkpointed(rows.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total, n_rows = sizes.agg(F.sum("bytes"), F.sum("n")).first()
    if total is None:
        return rows.select(*[F.col(n).alias(c) for n, c in zip(named, keep, strict=True)], F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("page"), "bytes", F.lit(False).alias("over_limit"))
    low, high, left, directory = -1, min(BITS, step + max(0, math.ceil(math.log2(max(1, total) / limit)))), sizes, None
    while True:
        cells = left.groupBy(_prefix(F.col("h"), high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("first"), F.max("h").alias("last"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low + 1), F.lit(high))))
        prefix = F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth"))
        buckets = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("size"), F.min("first").alias("first"), F.max("last").alias("last"))
        done = (F.col("size") <= limit) | (F.col("first") == F.col("last"))
        buckets = checkpointed(buckets.withColumn("done", done))
        split = buckets.where("not done").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        top = buckets.where((F.col("depth") == low + 1) & F.col("done"))
        below = buckets.where("done").withColumn("parent", F.shiftright("prefix", 1)).join(split, ["depth", "parent"])
        leaf = ["depth", "prefix", "size", "first", "last"]
        leaves = top.select(*leaf).union(below.select(*leaf))
        directory = leaves if directory is None else directory.union(leaves)
        deeper = buckets.where((F.col("depth") == high) & ~F.col("done")).select("prefix")
        if high == BITS or not deeper.count():
            break
        left = checkpointed(left.withColumn("prefix", _prefix(F.col("h"), high)).join(deeper, "prefix", "left_semi").drop("prefix"))
        low, high = high, min(BITS, high + 2 * step)
    # A hash finds its shard by the depths that shards have: at most BITS + 1 of them, and one shard matches.
    depths = sorted(r["depth"] for r in directory.select("depth").distinct().collect())
    found = sizes.select("h", "n", F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth")).withColumn("prefix", F.call_function("shiftright", F.col("h"), F.lit(BITS) - F.col("depth")))
    found = found.join(directory, ["depth", "prefix"]).select("h", "n", "depth", "prefix", ((F.col("size") > limit) & (F.col("first") == F.col("last"))).alias("paged"))
    out = skewed_join(rows, checkpointed(found), ["h"], n_rows)
    plain = out.where("not paged").withColumn("page", F.lit(0).cast("long"))
    # Rows of one hash are alike. Their place is counted within a task's rows, after the rows of the tasks before.
    many = checkpointed(out.where("paged").withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    tasks = many.groupBy("h", "task").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("from"))
    earlier = F.sum("n").over(Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # a row a task
    before = tasks.select("h", "task", "from", F.coalesce(earlier, F.lit(0)).alias("before"), "n")
    placed = skewed_join(many, checkpointed(before), ["h", "task"], n_rows)
    pages = placed.withColumn("page", F.floor((F.col("before") + F.col("place") - F.col("from")) / F.greatest(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(1))).cast("long"))
    columns = [*named, "depth", "prefix", "page", "bytes"]
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return plain.select(*columns).union(pages.select(*columns)).select(*[F.col(n).alias(c) for n, c in zip(named, keep, strict=True)], bits.alias("shard"), "depth", "page", "bytes", (F.col("bytes") > limit).alias("over_limit"))


def write(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Documents as Parquet in a folder for each shard and page."""
    out = sharded(docs, limit, docs.columns).withColumn("shard", F.concat(F.lit("b"), "shard"))
    out.drop("depth", "bytes", "over_limit").repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


SQL = f"""
with d as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint as bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, {BITS // 4}))::bigint as h from documents),
l as (select doc_id, bytes, h, unnest(range(0, {BITS + 1}))::integer as depth from d),
b as (select *, h >> ({BITS} - depth) as prefix from l),
s as (select depth, prefix, sum(bytes) as size, min(h) as first, max(h) as last from b group by all),
f as (select h, min(b.depth)::integer as depth from b join s using (depth, prefix) where size <= {SHARD_BYTES} or first = last group by h),
p as (select d.doc_id, d.bytes, d.h, f.depth, d.h >> ({BITS} - f.depth) as prefix, s.size, s.first = s.last as single
    from d join f using (h) join s on s.depth = f.depth and s.prefix = d.h >> ({BITS} - f.depth))
select doc_id, case when depth = 0 then '' else lpad(bin(prefix), depth, '0') end as shard, depth,
  case when single and size > {SHARD_BYTES} then ((row_number() over (partition by h) - 1) // greatest({SHARD_BYTES} // greatest(bytes, 1), 1))::bigint else 0 end as page,
  bytes, bytes > {SHARD_BYTES} as over_limit from p
"""
