"""Hamming neighbours, exact percentiles, grouped splits and running sums, against brute force and on hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import audit, neighbours, quantiles, running, splits


def hashes(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, h long")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def by_all_pairs(values, distance):
    return {(*sorted((a, b)), d) for i, a in enumerate(values) for b in values[:i] if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= distance}


@pytest.mark.parametrize(("crowd", "distance"), [(256, 4), (2, 4), (1, 2), (3, 0)])
def test_near_hashes_against_all_pairs(spark, monkeypatch, crowd, distance):
    """With a small crowd hashes go on to more runs, up to the most there are."""
    monkeypatch.setattr(neighbours, "CROWD", crowd)
    r = random.Random(crowd)
    base = [r.getrandbits(64) for _ in range(12)]
    values = {signed(b ^ sum(1 << i for i in r.sample(range(64), r.randrange(5)))) for b in base for _ in range(8)} | {0, -1, signed(1 << 63), 1}
    got = neighbours.near_hashes(spark.createDataFrame([(v,) for v in values], "h long"), distance).collect()
    assert len(got) == len({(x.left, x.right) for x in got})
    assert {(x.left, x.right, x.distance) for x in got} == by_all_pairs(list(values), distance)


def test_runs_grow_with_the_table():
    assert [neighbours.runs_for(n, 4) for n in (10, 10**4, 10**6, 10**9, 10**13)] == [5, 6, 6, 8, 10]
    for runs in range(5, 11):
        masks = neighbours._masks(runs, 4)
        assert len(masks) == len(set(masks)) and all(m != 0 for m in masks)


def test_copies_are_one_class(spark):
    copies = spark.range(100_000).select(F.col("id"), F.lit(77).cast("long").alias("h"))
    others = spark.createDataFrame([(200_000, 76), (200_001, -1), (200_002, None)], "id long, h long")
    both = copies.union(others)
    known = neighbours.classes(both, "id", "h")
    assert known.count() == 3
    assert [tuple(r) for r in neighbours.class_links(known, 4).collect()] == [(0, 200_000, bin(77 ^ 76).count("1"))]
    got = neighbours.groups(both, "id", "h", 4)
    assert got.count() == 100_003 - 1 and got.where("component = 0").count() == 100_001 and got.where("key = 200001").first().component == 200_001


def test_even_hashes_meet_few_others(spark, monkeypatch):
    """Candidates a row don't grow with the table."""
    met = []
    for n in (500, 50_000):
        rows = spark.range(n).select(F.xxhash64("id").alias("h"))
        masks = neighbours._masks(neighbours.runs_for(n, 4), 4)
        cells = rows.select(F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("c", "v")).groupBy("c", "v").count()
        met.append(cells.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] / n)
    assert met[1] < 4 * max(met[0], 1)


def test_pairs_written_out(spark):
    values = [5, 5, 5, 7, 1 << 40, None]
    got = {(x.left_id, x.right_id, x.distance) for x in audit.hamming_pairs(hashes(spark, values), "id", "h").collect()}
    assert got == {(0, 1, 0), (0, 2, 0), (1, 2, 0), (0, 3, 1), (1, 3, 1), (2, 3, 1), (0, 4, 3), (1, 4, 3), (2, 4, 3), (3, 4, 4)}


@pytest.mark.parametrize("small", [100, 2])
def test_percentiles_against_the_built_in(spark, monkeypatch, small):
    monkeypatch.setattr(running, "SMALL", small)
    r = random.Random(4)
    rows = [("hot", r.choice([0.1, 0.2, 7.0, -3.5]) if i % 3 else r.random()) for i in range(3000)] + [("one", 2.5), ("two", 1.0), ("two", 2.0), ("null", None), (None, 4.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    want = {x.g: x for x in df.where("v is not null").groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in at.items()], F.count("v").alias("n")).collect()}
    got = quantiles.percentiles(df, ["g"], "v", at).collect()
    known = {x.g: x for x in got if x.g is not None}
    assert set(known) == {"hot", "one", "two"}
    for g, x in known.items():
        assert x.n == want[g].n and all(getattr(x, n) == pytest.approx(getattr(want[g], n), abs=1e-12) for n in at)
    assert quantiles.percentiles(df.where("false"), ["g"], "v", at).count() == 0
    alone = quantiles.percentiles(df, [], "v", at).first()
    values = [v for _, v in rows if v is not None]
    assert alone.n == len(values) and all(getattr(alone, n) == pytest.approx(float(np.percentile(values, 100 * q)), abs=1e-12) for n, q in at.items())


def one_by_one(target, count, size, groups):
    """Each group for itself to the split that lacks most."""
    out = []
    for _ in range(groups):
        lack = {s: target[s] - count[s] for s in target}
        best = max(target, key=lack.__getitem__)
        count[best] += size
        out.append(best)
    return out


def test_turns_against_one_by_one():
    r = random.Random(6)
    for _ in range(400):
        names = ["a", "b", "c"][: r.randrange(1, 4)]
        target = {s: r.choice([r.randrange(200), r.random() * 200]) for s in names}
        count = {s: r.randrange(60) for s in names}
        size, groups = r.randrange(1, 9), r.randrange(1, 120)
        own, plain = dict(count), dict(count)
        phases = splits.turns(target, own, size, groups)
        want = one_by_one(target, plain, size, groups)
        got = []
        for (start, turn), (end, _) in zip(phases, [*phases[1:], (groups, None)], strict=True):
            got += [turn[(k - start) % len(turn)] for k in range(start, end)]
        assert got == want and own == plain


def test_turns_of_very_many_groups():
    count = {"train": 10, "validation": 5, "test": 5}
    phases = splits.turns({"train": 7e11, "validation": 1.5e11, "test": 1.5e11}, count, 1, 10**12 - 20)
    assert len(phases) < 20 and sum(count.values()) == 10**12 and abs(count["train"] - 7e11) <= 1


def samples(spark, sizes):
    rows = [(f"s{i}-{j}", f"d{i}", f"w{i}") for i, n in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame(rows, "sample_id string, source_document string, writer_id string")


@pytest.mark.parametrize("writers", [True, False])
@pytest.mark.parametrize("sizes", [[300] + [1] * 700, [1, 1, 1], [5, 4, 3, 3, 3, 2] * 20, [50, 1, 1, 1]])
def test_ratios_are_met(spark, sizes, writers):
    """A hot group, few groups, and many: no split is further from its share than the groups force."""
    ratios = {"train": 0.6, "validation": 0.2, "test": 0.2}
    out = splits.grouped_split(samples(spark, sizes), ratios, 3, writers).collect()
    assert len(out) == sum(sizes) and len({r.split_group for r in out}) == len(sizes)
    assert all(len({r.split for r in out if r.split_group == g}) == 1 for g in {r.split_group for r in out})
    got = {s: sum(r.split == s for r in out) for s in ratios}
    assert min(got.values()) > 0
    if len(sizes) > 50 and max(sizes) < 10:
        assert all(abs(got[s] - ratios[s] * sum(sizes)) <= max(sizes) for s in ratios)


def test_writers_tie_documents_together(spark):
    s = spark.createDataFrame([(i, i % 12, i % 5) for i in range(60)] + [(100 + i, 50 + i, 90 + i) for i in range(60)], "sample_id long, source_document long, writer_id long")
    out = splits.grouped_split(s, {"train": 0.6, "validation": 0.2, "test": 0.2}, 1).join(s, "sample_id")
    for c in ("source_document", "writer_id"):
        assert out.groupBy(c).agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert out.count() == 120 and out.select("split_group").distinct().count() == 61


def test_splits_refuse(spark):
    for wrong in ({"train": 0.5, "test": 0.4}, {"train": 1.5, "test": -0.5}):
        with pytest.raises(ValueError, match="ratios"):
            splits.grouped_split(samples(spark, [1, 1]), wrong, 1)
    with pytest.raises(ValueError, match="as many groups"):
        splits.grouped_split(samples(spark, [5, 5]), {"train": 0.6, "validation": 0.2, "test": 0.2}, 1)
    with pytest.raises(ValueError, match="without a document"):
        splits.grouped_split(spark.createDataFrame([("a", " ", "w")], "sample_id string, source_document string, writer_id string"), {"train": 1.0}, 1)
    assert splits.grouped_split(samples(spark, [2, 1]), {"train": 1.0, "test": 0.0}, 1).where("split <> 'train'").count() == 0


def test_a_subset_is_not_larger_than_its_table(spark):
    with pytest.raises(ValueError, match="4 rows of 3"):
        audit.seeded_subset(spark.range(3).withColumnRenamed("id", "k"), "k", 4, 1)


@pytest.mark.parametrize("small", [100, 1])
def test_values_of_hot_groups(spark, monkeypatch, small):
    monkeypatch.setattr(running, "SMALL", small)
    rows = [(1, i) for i in range(500)] + [(None, 7), (None, 3), (2, None)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(4)
    got = running.group_values(df, ["g"], {"least": F.min("v"), "n": F.count(F.lit(1))}).collect()
    assert {(r.g, r.least, r.n) for r in got} == {(1, 0, 500), (None, 3, 2), (2, None, 1)} and len(got) == 503
    sums = {(r.g, r.v): r.s for r in running.running_sums(df, ["g"], ["v"], {"s": F.coalesce("v", F.lit(0))}).collect()}
    assert all(sums[1, i] == i * (i + 1) // 2 for i in range(500)) and sums[None, 7] == 10 and sums[None, 3] == 3


def test_near_text_links_of_copies(spark):
    """Two hundred copies in two splits, and a near text, are two classes and two links."""
    base = "on page {} of the long report we read of rivers and of towns along their banks in spring"
    rows = [(i, base.format(i), "train" if i % 2 else "test") for i in range(200)] + [(500, base.format(3) + " x", "test"), (501, "nothing like it " * 5, "test"), (502, None, "test")]
    got = audit.near_text_links(spark.createDataFrame(rows, "id long, text string, split string"), "id", "text", "split").collect()
    assert sorted((r.left_id, r.right_id, r.left_n, r.right_n) for r in got) == [(0, 0, 200, 200), (0, 500, 200, 1)]
    assert all(r.ratio >= 0.9 for r in got)


def test_near_text_links_are_the_pairs_of_classes(spark):
    import difflib
    import re

    r = random.Random(8)
    base = [" ".join(r.choice("river town bridge hall spring report page road field".split()) for _ in range(16)) for _ in range(6)]
    texts = [(b + f" {r.randrange(99)}" if r.random() < 0.5 else b.replace("river", r.choice(["river", "rivers"]))) for b in base for _ in range(6)]
    rows = [(i, t, r.choice(["train", "test"])) for i, t in enumerate(texts)]
    mask = {i: re.sub(r"\d+(?:\.\d+)?", "<number>", t.lower()) for i, t, _ in rows}
    members = {}
    for i, _, s in rows:
        members.setdefault(mask[i], []).append((i, s))
    want = set()
    for a, x in members.items():
        for b, y in members.items():
            if x[0][0] <= y[0][0] and any(s != u for _, s in x for _, u in y) and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.9:
                want.add((x[0][0], y[0][0], len(x), len(y)))
    got = audit.near_text_links(spark.createDataFrame(rows, "id long, text string, split string"), "id", "text", "split").collect()
    assert {(g.left_id, g.right_id, g.left_n, g.right_n) for g in got} == want and len(got) == len(want) > 5
