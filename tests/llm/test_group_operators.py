"""Operators over many rows together, against plain versions and on odd rows."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import cap_filters, extendible_shards, quote_links, simhash


def components_of(n, linked):
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    rows = [(1, None), (2, ""), (3, "One"), (4, "one two"), (5, "A b\tC d a B c"), (6, "É é x y z " * 400), (7, "x" * 100_000)]
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in rows}
    assert got[1] == got[2] == 0


def test_fingerprint_is_sparks_hash(spark):
    h = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("cell", [512, 3])
def test_simhash_components(spark, monkeypatch, cell):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 8)]
    values = base + [b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)) for b in base for _ in range(12)] + base[:2]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", F.col("fp").cast("long").alias("fp")))
    got = {r.doc_id: r.component_id for r in simhash.components(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"), cell).collect()}
    assert got == dict(enumerate(components_of(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 3)))


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b c d", "x"), (3, "a b c d", "x"), (4, "A b C d", "x"), (None, "q r s t", "x")], "doc_id long, text string, fp string")
    got = simhash.components(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    assert simhash.components(docs.limit(0)).count() == 0


def plain_links(rows):
    units = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            units[k] = (label, np.array(v, float) / np.linalg.norm(v))
    link = lambda a, b: a in units and b in units and units[a][0] == units[b][0] and len(units[a][1]) == len(units[b][1]) and units[a][1] @ units[b][1] >= 0.98 - 1e-12
    group = components_of(len(rows), link)
    return [(rows[i][0], sum(link(i, j) for j in range(len(rows)) if j != i), rows[group[i]][0]) for i in range(len(rows))]


def test_cap_filters(spark):
    rng = np.random.default_rng(2)
    center = rng.standard_normal(16)
    near = [(center + 0.15 * rng.standard_normal(16)).tolist() for _ in range(60)]
    far = rng.standard_normal((40, 16)).tolist()
    rows = [(i, v, i % 2) for i, v in enumerate(near + far)]
    rows += [(200, near[0], 0), (201, near[0], None), (202, None, 0), (203, [0.0] * 16, 0), (204, [None] * 16, 0), (205, [float("nan")] * 16, 0), (206, [float("inf")] * 16, 0), (207, [1.0] * 8, 0), (208, [2.0] * 8, 0), (209, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cap_filters.linked(df).collect())
    assert got == sorted((i, n, c, i == c) for i, n, c in plain_links(rows))
    assert cap_filters.linked(df.limit(0)).count() == 0


def test_cap_filters_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "GROUP", 7)
    monkeypatch.setattr(cap_filters, "PER_HOME", 5)
    rng = np.random.default_rng(3)
    center = rng.standard_normal(32)
    rows = [(i, [float(np.float32(x)) for x in center + 0.1 * rng.standard_normal(32)], 1) for i in range(80)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in cap_filters.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == sorted(plain_links(rows))


def test_cap_filter_recall():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = rng.standard_normal((2000, 64))
    step -= (step * x).sum(1, keepdims=True) * x
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * step  # pairs at the very threshold
    book = cap_filters.codebook(64, 12)
    reach = (2 - 2 * 0.98) / 64 * cap_filters.BOUND
    r, f, h = cap_filters.decode(x, book, reach)
    home = dict(zip(r[h], f[h], strict=True))
    r, f, _ = cap_filters.decode(y, book, reach)
    met = set(zip(r.tolist(), f.tolist(), strict=True))
    assert sum((i, int(home[i])) in met for i in range(2000)) >= 1995


@pytest.mark.parametrize("limit", [10, 60, 200, 100_000])
def test_shards(spark, limit):
    rows = [(i % 7 if i < 60 else i, "x" * (i % 50 + 1)) for i in range(200)] + [(i, "same" * 5) for i in range(200, 300)] + [(250, "same" * 5)] * 80 + [(None, None), (1000, "z" * 500)]
    out = extendible_shards.sharded(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")), limit, step=1).toPandas()
    assert len(out) == len(rows)
    sizes = out.groupby(["shard", "page"]).bytes.agg(["sum", "size"])
    assert ((sizes["sum"] <= limit) | (sizes["size"] == 1)).all()
    names = sorted(set(out.shard))
    assert not any(b.startswith(a) and a != b for a in names for b in names)


def test_shards_empty_and_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 100, "k") for i in range(50)], "doc_id long, text string, kind string")
    assert extendible_shards.sharded(docs.limit(0)).count() == 0
    extendible_shards.write(docs, str(tmp_path / "s"), 1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.groupBy("shard", "page").agg(F.sum(F.length("text")).alias("b")).agg(F.max("b")).first()[0] <= 1000


def test_shards_and_quotes_match_sql(spark, sf, duck, same_rows):
    assert same_rows(extendible_shards.query(spark, sf).toPandas(), duck.execute(extendible_shards.SQL).df())
    assert same_rows(quote_links.query(spark, sf).toPandas(), duck.execute(quote_links.SQL).df())
    assert same_rows(cap_filters.query(spark, sf).toPandas(), duck.execute(cap_filters.SQL).df())


MESSAGES = "conv_id long, turn long, role string, text string"


def plain_replies(rows):
    """{(conv_id, turn): (reply_to, links)} by the definition, message against message."""

    def parsed(text):
        out = []
        for line in text.split("\n"):
            mark = re.match(r"(?: {0,3}>)+ ?", line)
            mark = mark.group() if mark else ""
            out.append((mark.count(">"), " ".join(re.split("[ \t\n\x0b\f\r]+", line[len(mark) :].lower())).strip()))
        return out

    def passages(text):
        for level, run in itertools.groupby(parsed(text), key=lambda x: x[0]):
            lines = [x for _, x in run]
            paragraphs = [list(g) for filled, g in itertools.groupby(lines, key=bool) if filled]
            yield level, [[sum(paragraphs, [])] if paragraphs else [], paragraphs, [[x] for x in lines if x]]

    wrote = collections.defaultdict(set)
    for conv, turn, _, text in rows:
        for level, kinds in passages(text or ""):
            if not level:
                wrote[conv, turn] |= {tuple(u) for k in kinds for u in k}
    out = {}
    found = collections.defaultdict(collections.Counter)
    for conv, turn, text in {(c, t, x) for c, t, _, x in rows if None not in (c, t, x)}:
        for level, kinds in passages(text):
            for units in kinds if level else ():
                hits = [(len(u), [t for (c, t), w in wrote.items() if c == conv and t is not None and t < turn and tuple(u) in w]) for u in units]
                for n, turns in hits:
                    if turns:
                        found[conv, turn][level, max(turns)] += n
                if any(turns for _, turns in hits):
                    break
    for key, links in found.items():
        reply = min(links, key=lambda x: (x[0], -links[x], -x[1]))[1]
        out[key] = reply, ",".join(f"{a}:{b}" for a, b in sorted(links))
    return out


def chats():
    """Conversations whose messages quote earlier ones whole, in part and nested, with common lines and repeated rows."""
    r = random.Random(3)
    rows = []
    for conv in range(40):
        texts = []
        for turn in range(r.randrange(1, 14)):
            lines = []
            for _ in range(r.randrange(0, 3)):
                if texts:
                    old = r.choice(texts).split("\n")
                    a = r.randrange(len(old))
                    lines += [("> " if r.random() < 0.7 else ">") + (x.upper() if r.random() < 0.2 else x) for x in old[a : a + r.randrange(1, 6)]]
                if r.random() < 0.7:
                    lines += [r.choice(["thanks", "yes", "", f"words {conv % 3} {turn} {r.randrange(9)}", "a  common line"]) for _ in range(r.randrange(1, 5))]
            texts.append("\n".join(lines))
            rows.append((conv, turn, r.choice(["user", "assistant"]), texts[-1]))
    return [*rows, rows[3], rows[50], (None, 1, "u", "> thanks"), (1, None, "u", "> thanks"), (2, 20, "u", None)]


@pytest.mark.parametrize("block", [4096, 3])
def test_quote_links_against_plain_version(spark, monkeypatch, block, same_rows):
    monkeypatch.setattr(quote_links, "BLOCK", block)
    rows = chats()
    messages = spark.createDataFrame(rows, MESSAGES)
    out = quote_links.linked(messages)
    want = plain_replies(rows)
    assert len(want) > 70 and len({x for _, l in want.values() for x in l.split(",") if x > "2"}) > 5
    assert out.count() == len(rows)
    for r in out.collect():
        assert (r.reply_to, r.links) == want.get((r.conv_id, r.turn), (None, ""))
    con = duckdb.connect()
    con.register("conversations", messages.toArrow())
    assert same_rows(out.toPandas(), con.execute(quote_links.SQL).df())


def test_quote_links(spark):
    rows = [(1, 0, "u", "Hello there\nHow are you?"), (1, 1, "a", "> Hello there\nI am fine"), (1, 2, "u", "> > how are  YOU?\n> I am fine\n\nGood"), (1, 3, "u", "none"), (1, 4, "u", None), (1, 5, "u", ">"), (2, 1, "u", "> I am fine\nx"), (None, 1, "u", "> I")]
    m = spark.createDataFrame(rows, MESSAGES).withColumn("thread", F.lit("clash")).withColumn("links", F.lit("clash"))
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.max_level, r.n_quoted, r.links, r.text) for r in quote_links.linked(m).collect()}
    assert got[1, 1] == (0, 0, 1, 1, "1:0", "I am fine") and got[1, 2] == (1, 0, 2, 2, "1:1,2:0", "\nGood")
    assert got[1, 4] == (None, 4, 0, 0, "", None) and got[1, 5] == (None, 5, 1, 1, "", "") and got[2, 1] == (None, 1, 1, 1, "", "x") and got[None, 1][0] is None
    assert quote_links.linked(m.limit(0)).count() == 0
    long = [(1, i, "u", f"line {i}" if not i else f"> line {i - 1}\nline {i}") for i in range(40)]
    assert {r.thread for r in quote_links.linked(spark.createDataFrame(long, MESSAGES)).collect()} == {0}
    # A common line doesn't outweigh the passage, the latest writer before is meant, and deeper quotes link alone.
    rows = [(1, 0, "u", "first\nthanks"), (1, 1, "a", "thanks"), (1, 2, "u", "> first\n> thanks\nok"), (1, 3, "u", "> thanks\nwell"), (1, 4, "u", "thanks"), (1, 5, "u", "> > first\nso")]
    got = {r.turn: (r.reply_to, r.thread) for r in quote_links.linked(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert [got[i] for i in (2, 3, 5)] == [(0, 0), (1, 1), (0, 0)]


def test_quote_links_of_a_very_long_message(spark):
    text = "\n".join(f"line {i}" for i in range(30_000))
    rows = [(1, 0, "u", text), (1, 1, "u", "> " + text.replace("\n", "\n> ") + "\nend"), (1, 2, "u", "x" * 500_000)]
    got = {r.turn: (r.reply_to, r.n_quoted, len(r.text)) for r in quote_links.linked(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == {0: (None, 0, len(text)), 1: (0, 30_000, 3), 2: (None, 0, 500_000)}
