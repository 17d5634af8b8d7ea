"""Duplicates, leakage between splits, near duplicates, groups and seeded choices."""

from __future__ import annotations

import difflib
import math
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators import neighbours
from glyphmill.plans.cut import checkpointed

#: Differing bits of visual hashes that are alike.
HASH_DISTANCE = 4
#: Characters of a block of texts compared with another; lengths of the runs of characters that rule pairs out.
BLOCK, GRAMS = 1 << 18, (1, 3)


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of rows with the same text: its digest, how many, the least key. Copies aren't collected."""
    return df.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("least")).where("copies > 1")


def cross_split_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split, with the splits."""
    return df.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits"), F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def sign_hash(vector: str) -> F.Column:
    """64 bits: the signs of a vector's components, the first highest; a stand-in for an image's difference hash."""
    return F.aggregate(F.col(vector), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def hamming_pairs(df: DataFrame, key: str, bits: str, distance: int = HASH_DISTANCE) -> DataFrame:
    """All pairs of keys whose 64-bit hashes differ in at most ``distance`` bits.

    The links of classes of equal hashes, written out: as many rows as there are pairs, quadratic in a class. Where
    groups or links of classes will do, take ``neighbours``.
    """
    known = checkpointed(neighbours.classes(df, key, bits))
    near = neighbours.near_hashes(known, distance).union(known.where("n > 1").select(F.col("h").alias("left"), F.col("h").alias("right"), F.lit(0).alias("distance")))
    rows = df.where(F.col(bits).isNotNull())
    a, b = (rows.select(F.col(bits).alias(side), F.col(key).alias(f"{side}_key")) for side in ("left", "right"))
    both = near.join(a, "left").join(b, "right").where((F.col("left") != F.col("right")) | (F.col("left_key") < F.col("right_key")))
    return both.select(F.least("left_key", "right_key").alias("left_id"), F.greatest("left_key", "right_key").alias("right_id"), "distance")


def _tagged(text: str, size: int) -> list[tuple[str, int]]:
    """Runs of ``size`` characters, each with how often it came before: a set's overlap is then the bag's."""
    seen: Counter = Counter()
    out = []
    for i in range(len(text) - size + 1):
        gram = text[i : i + size]
        out.append((gram, seen[gram]))
        seen[gram] += 1
    return out


def _alike(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Ordered pairs of a cell's left and right texts with a ratio at or over the threshold."""

    def compared(cell: pd.DataFrame) -> pd.DataFrame:
        left, right = (cell[cell["side"] == side] for side in (0, 1))
        hashes, texts = right["h"].tolist(), right["t"].tolist()
        lengths = np.array([len(t) for t in texts], np.int64)
        postings = []
        for size in GRAMS:
            found = defaultdict(list)
            for j, t in enumerate(texts):
                for gram in _tagged(t, size):
                    found[gram].append(j)
            postings.append({g: np.array(js, np.int64) for g, js in found.items()})
        same = len(cell) and (cell["c"].iat[0], cell["i"].iat[0]) == (cell["d"].iat[0], cell["j"].iat[0])
        out = []
        for h, t, lo, hi in zip(left["h"], left["t"], left["lo"], left["hi"], strict=True):
            total = lengths + len(t)
            keep = 2.0 * np.minimum(lengths, len(t)) >= threshold * total - 1e-9
            if lo == hi:  # texts of one split only, and that the same one
                keep &= ~((right["lo"].to_numpy() == lo) & (right["hi"].to_numpy() == lo))
            for size, posting in zip(GRAMS, postings, strict=True):
                need = (threshold / 2 - (size - 1) * (1 - threshold)) * total - (size - 1)
                hit = [posting[g] for g in _tagged(t, size) if g in posting]
                shared = np.bincount(np.concatenate(hit), minlength=len(texts)) if hit else np.zeros(len(texts), np.int64)
                keep &= shared >= need - 1e-9
            for j in np.flatnonzero(keep):
                if hashes[j] == h or (same and hashes[j] < h):
                    continue
                for x, y, u, v in ((h, hashes[j], t, texts[j]), (hashes[j], h, texts[j], t)):  # the ratio depends on the order
                    ratio = difflib.SequenceMatcher(None, u, v, autojunk=False).ratio()
                    if ratio >= threshold:
                        out.append((x, y, ratio))
        return pd.DataFrame(out, columns=["left_h", "right_h", "ratio"])

    return compared


def _near_texts(df: DataFrame, key: str, text: str, split: str, threshold: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Rows (k, s, h) and pairs of classes (left_h, right_h, ratio) of texts of ``min_words`` or more that are alike once numbers are masked.

    Equal masked texts are one class with ratio 1, so only distinct ones are compared, block against block, with
    those whose length allows the ratio: lengths of a pair are in the same or adjoining classes. In a block a pair is
    left out only where it cannot reach the threshold: with m matching of T characters in all, the matches are at
    most 1 + T - 2m blocks, so the texts share m - (q - 1)(1 + T - 2m) runs of q characters or more.
    """
    masked = F.regexp_replace(F.lower(F.col(text)), r"\p{Nd}+(?:\.\p{Nd}+)?", "<number>")
    long = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= min_words
    rows = df.where(long).select(F.col(key).alias("k"), masked.alias("t"), F.col(split).alias("s")).where("s is not null and t <> ''").withColumn("h", F.sha2("t", 256))
    width = math.log((2 - threshold) / threshold) + 1e-9 if threshold > 0 else math.inf
    texts = rows.groupBy("h").agg(F.first("t").alias("t"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    texts = texts.withColumn("c", F.floor(F.log(F.char_length("t").cast("double")) / F.lit(width)).cast("int"))
    # A handful of rows: classes grow by a factor.
    blocks = texts.groupBy("c").agg(F.ceil(F.sum(F.char_length("t")) / F.lit(BLOCK)).cast("int").alias("n"))
    of = lambda step, name: blocks.select((F.col("c") + step).alias("c"), F.col("n").alias(name))
    placed = texts.join(of(0, "n"), "c").join(of(-1, "above"), "c", "left").join(of(1, "below"), "c", "left").withColumn("b", F.pmod(F.xxhash64("h"), "n").cast("int"))
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda side, c, i, d, j: F.struct(F.lit(side).alias("side"), c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"))
    c, b = F.col("c"), F.col("b")
    cells = F.concat(
        F.transform(F.sequence(b, F.col("n") - 1), lambda j: cell(0, c, b, c, j)),
        F.transform(F.sequence(F.lit(0), b), lambda i: cell(1, c, i, c, b)),
        F.transform(each(F.coalesce("above", F.lit(0))), lambda j: cell(0, c, b, c + 1, j)),
        F.transform(each(F.coalesce("below", F.lit(0))), lambda i: cell(1, c - 1, i, c, b)),
    )
    dealt = placed.select("h", "t", "lo", "hi", F.explode(cells).alias("x")).select("h", "t", "lo", "hi", "x.*")
    found = dealt.groupBy("c", "i", "d", "j").applyInPandas(_alike(threshold), "left_h string, right_h string, ratio double")
    equal = texts.where("lo <> hi").select(F.col("h").alias("left_h"), F.col("h").alias("right_h"), F.lit(1.0).alias("ratio"))
    return rows.select("k", "s", "h"), found.union(equal)


def near_text_links(df: DataFrame, key: str, text: str, split: str, threshold: float = 0.9, min_words: int = 12) -> DataFrame:
    """left_id, right_id, ratio, left_n and right_n: classes of equal masked texts, by their least keys, that are alike
    and lie in different splits, and their rows. A class in several splits is linked to itself. Copies add no links."""
    rows, found = _near_texts(df, key, text, split, threshold, min_words)
    classes = checkpointed(rows.groupBy("h").agg(F.min("k").alias("id"), F.count(F.lit(1)).alias("n")))
    left, right = (classes.select(F.col("h").alias(f"{x}_h"), F.col("id").alias(f"{x}_id"), F.col("n").alias(f"{x}_n")) for x in ("left", "right"))
    return found.join(left, "left_h").join(right, "right_h").where("left_id <= right_id").select("left_id", "right_id", "ratio", "left_n", "right_n")


def near_text_pairs(df: DataFrame, key: str, text: str, split: str, threshold: float = 0.9, min_words: int = 12) -> DataFrame:
    """All pairs of rows with such texts in different splits: links written out, as many rows as there are pairs."""
    rows, found = _near_texts(df, key, text, split, threshold, min_words)
    left, right = (rows.select(F.col("h").alias(f"{x}_h"), F.col("k").alias(f"{x}_id"), F.col("s").alias(f"{x}_s")) for x in ("left", "right"))
    return found.join(left, "left_h").join(right, "right_h").where("left_id < right_id and left_s <> right_s").select("left_id", "right_id", "ratio")


def seeded_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same ones for a seed: the least by a hash of seed and key. More than there are is an error."""
    if n < 1 or (there := df.limit(n).count()) < n:
        raise ValueError(f"{n} rows of {df.count() if n < 1 else there}")
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.withColumn("order_", order).orderBy("order_", key).limit(n).drop("order_")


def stratified_round_robin(df: DataFrame, key: str, band: str, n: int, seed: int) -> DataFrame:
    """n rows taken from the bands in turn, in a seeded order within each: no band needs more than n of its rows."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    turn = F.row_number().over(Window.partitionBy(band).orderBy("order_", key))
    return df.withColumn("order_", order).withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", band).limit(n).drop("order_")
