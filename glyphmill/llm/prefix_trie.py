"""The prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start with it, and its owner is
the smallest of them. Members only get fewer further down, so each conversation owns a suffix of its path, perhaps an
empty one. Windows mark the owned nodes of each path and carry along it what the sums need: the words at or after a
turn less those at nodes that the conversation owns, the owner above its own suffix, and whether it owns a leaf. One
group-by of all (conversation, depth) by prefix then gives each node's row: what members save is words of all
occurrences in the subtree less one for each node, since each node has one owner.

A prefix is known by a digest of the sums, over its turns, of six 32-bit hashes of (depth, digest of role and text).
Sums, unlike chains, can be taken piecewise, so a conversation with a large share of all turns is spread over tasks;
so are prefixes that many conversations share (``operators/running.py``). Ids of conversations that end at a node
come together in chunks of at most 1,024 and stream through one hash in order, never as one string.

Turns are ordered by turn, nulls first, then by the SHA-256 of role and text. A null role or text is empty. Words are
runs of characters other than space and the ASCII controls tab to carriage return.

Defined results: rows with a null conv_id belong to no conversation. A conversation whose base is absent or short has
fewer turns; one without any is still a member of the root. Repeated rows are turns of their own. An empty table has
no node. Texts of any length are only hashed and counted. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed, table
from glyphmill.operators.running import group_values, running_sums
from glyphmill.operators.skew import skewed_join

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that share a base, and the most turns taken from it, less one.
FAMILY, HEAD = 20, 4
HASHES = [f"s{i}" for i in range(6)]
#: Bits of a conversation's id within a chunk of ids.
CHUNK = 10


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, r (the turn's place from 1), digest (of role and text) and words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return running_sums(rows, ["conv_id"], ["turn", "digest", "words"], {"r": F.lit(1).cast("long")}).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turns) and their turns (conv_id, d, turns, digest, words): a head of the base's, then their own."""
    n = F.count(F.lit(1)).alias("n")
    heads = turns.where(F.col("r") < HEAD).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("r", "digest", "words"))).alias("head"))
    whole = turns.groupBy("conv_id").agg(n)
    whole = whole.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD})
    whole = whole.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<r:bigint,digest:binary,words:bigint>>")), F.lit(1), F.col("h").cast("int")))
    whole = whole.withColumn("turns", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    whole = checkpointed(whole.select("conv_id", "n", "h", "head", "turns"))
    first = whole.select("conv_id", "turns", F.explode("head").alias("t")).select("conv_id", F.col("t.r").alias("d"), "turns", "t.digest", "t.words")
    own = skewed_join(turns, whole.select("conv_id", "n", "h", F.size("head").alias("taken"), "turns"), ["conv_id"], whole.agg(F.sum("n")).first()[0] or 0)
    own = own.where("r > h").select("conv_id", (F.col("r") - F.col("h") + F.col("taken")).alias("d"), "turns", "digest", "words")
    return whole.select("conv_id", "turns"), first.unionByName(own)


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary"))


def occurrences(whole: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth: key (of the prefix), words (of its last turn) and so_far (of all)."""
    low = {s: F.xxhash64("d", "digest", F.lit(i)).bitwiseAND(F.lit(0xFFFFFFFF)) for i, s in enumerate(HASHES)}
    sums = running_sums(turns, ["conv_id"], ["d", "turns", "digest", "words"], {**low, "so_far": F.col("words")})
    rows = sums.select("conv_id", "d", "turns", _key(F.col("d"), [F.col(s) for s in HASHES]).alias("key"), "words", "so_far")
    zero = F.lit(0).cast("long")
    roots = whole.select("conv_id", zero.alias("d"), "turns", _key(zero, [zero] * len(HASHES)).alias("key"), zero.alias("words"), zero.alias("so_far"))
    return rows.unionByName(roots)


def marked(rows: DataFrame) -> DataFrame:
    """Occurrences with the marks of ownership, and what each adds to its node's sums."""
    rows = checkpointed(group_values(rows, ["key"], {"owner": F.min("conv_id"), "goes_on": F.max(F.col("turns") > F.col("d"))}))
    owned = F.col("owner") == F.col("conv_id")
    rows = group_values(
        rows.withColumn("owned", owned),
        ["conv_id"],
        {
            "first_owned": F.min(F.when(F.col("owned"), F.col("d"))),
            "above": F.max(F.when(~F.col("owned"), F.col("owner"))),  # owners only grow on the way down
            "not_owned": F.max(F.when(~F.col("owned"), F.col("so_far"))),
            "leaf": F.max(F.col("owned") & ~F.col("goes_on")),
        },
    )
    at = F.col("d") == F.col("first_owned")
    return rows.select(
        "key", "d", "conv_id", "owned", "leaf",
        F.when(F.col("owned"), F.when(at, F.col("above")).otherwise(F.col("conv_id"))).alias("parent"),
        ((F.col("d") < F.col("turns")) & (F.col("d") + 1 >= F.col("first_owned"))).alias("owns_next"),
        # words at or after this turn (total - so_far + words) less owned ones (total - not_owned, or all of them)
        F.when(F.col("owned"), 0).otherwise(F.col("not_owned") - F.col("so_far") + F.col("words")).alias("saved"),
        (F.col("d") == F.col("turns")).alias("ends"),
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the SHA-256 of its chunks joined by commas; rows come sorted by key and chunk."""
    now, digest = None, hashlib.sha256()
    for batch in batches:
        keys, values = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key == now:
                digest.update(b",")
            else:
                if now is not None:
                    keys.append(now)
                    values.append(digest.hexdigest())
                now, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """key and the digest of the ids of conversations that end there."""
    chunks = rows.where("ends").groupBy("key", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(_hashed, "key string, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the rebuilt conversations' trie."""
    rows = checkpointed(marked(checkpointed(occurrences(*rebuilt(checkpointed(turns_of(conversations)))))))
    count = lambda c: F.count(F.when(F.col(c), 1))
    nodes = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.max("parent").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
        count("owns_next").alias("n_children"), count("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    return nodes.join(_ends(rows), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: Nodes as joined digests of turns, subtrees by the paths that go through a node. crc32 goes byte by byte.
SQL = r"""
with crc as materialized (
    select list(list_reduce(list_prepend(n::ubigint, [i::ubigint for i in range(8)]), lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end) order by n) as t from range(256) r(n)
), original as (
    select conv_id, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
        length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words, turn
    from conversations where conv_id is not null
), numbered as (
    select conv_id, digest, words, row_number() over (partition by conv_id order by turn nulls first, digest) as r from original
), convs as (
    select conv_id, conv_id - conv_id % 20 as base,
        xor(list_reduce(list_prepend(4294967295::ubigint, [ascii(x)::ubigint for x in string_split(conv_id::varchar, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint)::bigint % 4 as h
    from (select distinct conv_id from numbered), crc
), turns as (
    select conv_id, digest, words, row_number() over (partition by conv_id order by own, r) as d from (
        select c.conv_id, 0 as own, r, digest, words from convs c join numbered n on n.conv_id = c.base and n.r <= c.h
        union all select c.conv_id, 1, r, digest, words from convs c join numbered n on n.conv_id = c.conv_id and n.r > c.h)
), paths as (
    select conv_id, d, words, string_agg(digest, ',') over (partition by conv_id order by d) as key from turns
    union all select conv_id, 0, 0, '' from convs
), nodes as (
    select key, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from paths group by key, d
), parents as (
    select distinct p.key, q.key as parent from paths p join paths q on p.conv_id = q.conv_id and q.d = p.d - 1
), children as (select parent as key, count(*) as n from parents group by 1),
subtree as (
    select distinct p.key as top, q.key from paths p join paths q on p.conv_id = q.conv_id and q.d >= p.d
), sums as (
    select top as key, sum((n.n_convs - 1) * n.words)::bigint as saved_tokens, count(*) filter (children.n is null) as n_leaves
    from subtree join nodes n using (key) left join children using (key) group by 1
), ends as (
    select key, string_agg(conv_id::varchar, ',' order by conv_id) as ids from (select conv_id, max_by(key, d) as key from paths group by conv_id) group by key
)
select n.conv_id, n.d as depth, above.conv_id as parent_conv_id, n.n_convs, coalesce(children.n, 0) as n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from nodes n join sums using (key) left join children using (key) left join ends using (key)
left join parents on parents.key = n.key left join nodes above on above.key = parents.parent
"""
