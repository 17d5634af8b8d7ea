"""SentencePiece codec, alignment of tokenizers and the prefix trie, against libraries, brute force and SQL."""

import bisect
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphmill.llm import alignment, piece_bpe, prefix_trie
from glyphmill.operators import running

PARTS = ["a", "b", " ", "  ", "   ", "\n", "'s", "é", "ß", "日本", "🙂", "1", "23", "--", "\x1c", "\t", "the", "ing", " the", "́", "Ω", "я", "aaaa", "▁", "▁▁", "　", "\xa0", "<s>", "</s>", "<0x41>", "<unk>", "\0", "ﬁ", "Ａ", " " * 20, "​", "ｶﾞ", "\r\n", "<|endoftext|>"]
LONG = "x" * 200_000 + " " + "word again and " * 40_000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "é" * 50 + "\x1c🙂 \x00"), (6, LONG), (None, "no id here"), (7, "with ▁ in it"), (8, "<|endoftext|> and <s>")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").select("doc_id", "text", F.lit("x").alias("ids"), F.lit(1).alias("n_a"), F.lit("y").alias("links"), F.lit("z").alias("pair"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pieces():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return piece_bpe.codec(f.read())


def random_texts(n, seed=3, most=30):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(most))) for _ in range(n)]


def test_pieces_and_spans_against_library(pieces, library):
    texts = random_texts(4000)
    for text, (ids, start, ends) in zip(texts, pieces.encode(texts), strict=True):
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want] == library.encode(text)
        assert list(zip([start, *ends.tolist()], ends.tolist(), strict=False)) == [(p.begin, p.end) for p in want]
        assert pieces.decode([*ids.tolist(), 2]) == library.decode([*library.encode(text), 2])


def test_decoding_of_any_ids_against_library(pieces, library):
    r = random.Random(4)
    for _ in range(3000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3, 259), r.randrange(5)]) for _ in range(r.randrange(8))]
        assert pieces.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_normal_forms_and_sources_against_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    mine = piece_bpe.Normalizer(dict(piece_bpe._fields(library.serialized_model_proto()))[3])
    for text in random_texts(1500, 5, 20):
        form, source = mine(text)
        want, at = library.normalize(text, with_offsets=True)
        data = text.encode()
        assert form == want
        assert not form or [len(data[:i].decode()) for i in source.tolist()] == list(at)


def test_pieces_in_either_way_and_forgotten(pieces, library, monkeypatch):
    texts = ["internationalisation thereuponnevertheless", "xxxxxxxxyyyyzzzz", "     aaaaaaaaaa     ", *random_texts(300, 6)]
    monkeypatch.setattr(piece_bpe, "SHORT", 0)
    monkeypatch.setattr(piece_bpe, "KEPT", 5)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        small = piece_bpe.Pieces(f.read())
    for text in texts:
        assert next(small.encode([text]))[0].tolist() == library.encode(text)
    assert [x[0].tolist() for x in small.encode(texts)] == library.encode(texts)


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="BPE"):
        piece_bpe.Pieces(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())


def test_piece_rows(odd, empty, library):
    got = piece_bpe.encoded(odd).collect()
    assert sorted(repr((r.doc_id, r.ids, r.decoded)) for r in got) == sorted(repr((i, [*library.encode(t or ""), 2], library.decode([*library.encode(t or ""), 2]))) for i, t in ODD)
    for r in got:
        assert len(r.ends) == len(r.ids) and r.ends == sorted(r.ends)
    assert piece_bpe.encoded(empty).count() == 0


def test_piece_query(spark, sf, library):
    for r in piece_bpe.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        ids = library.encode(r.text, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def plain_alignment(rows, library, tokenizer):
    """By the definition: ends of every token, one document at a time."""
    alphabet = {chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None: b for b in range(256)}
    alphabet.pop(None)
    n = 0
    for b in range(256):
        if b not in alphabet.values():
            alphabet[chr(256 + n)] = b
            n += 1
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in tokenizer.get_vocab().items() if i != 50256}

    def b_bytes(i):
        name = library.id_to_piece(i)
        return bytes([int(name[1:-1], 16)]) if library.is_byte(i) else name.replace("▁", " ").encode()

    docs = []
    for i, text in rows:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = library.encode(text) if text else []
        whole = b"" if not text else b" " + text.encode()
        if b"".join(map(a_bytes.get, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        ends = [np.cumsum([len(x) for x in map(f, ids)]).tolist() for f, ids in ((a_bytes.get, a), (b_bytes, b))]
        common = sorted(set(ends[0]) & set(ends[1]))
        members = [["", ""] for _ in common]
        for side, ids in enumerate((a, b)):
            for t, end in zip(ids, ends[side], strict=True):
                group = members[bisect.bisect_left(common, end)]
                group[side] += f",{t}" if group[side] else str(t)
        groups = ["|".join(g) for g in members]
        ending = [dict(zip(ends[side], ids, strict=True)) for side, ids in enumerate((a, b))]
        links = [(ending[0][e], ending[1][e]) for e in common]
        docs.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for d in docs for p in d[4])
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(repr((i, a, b, g, len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), h)) for i, a, b, g, ls, h in docs)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def joined(spark, docs):
    kept = docs.withColumn("n_groups", F.size("links").cast("long"))
    pairs = alignment.linkable(spark)
    out = alignment.summed(kept, alignment.counted(kept, pairs), pairs.count())
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return sorted(repr(tuple(r)) for r in out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("l"), "n_best", "count_sum", digest).collect())


def test_alignment_against_definition(spark, library, tokenizer):
    rows = [*enumerate(random_texts(400, 7)), *enumerate(random_texts(5, 8, 3000), 400), (500, "a" * 3000), (501, "7" * 2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(spark, alignment.aligned(docs)) == plain_alignment(rows, library, tokenizer)


def test_alignment_rows(spark, odd, empty, library, tokenizer):
    assert joined(spark, alignment.aligned(odd)) == plain_alignment(ODD, library, tokenizer)
    assert joined(spark, alignment.aligned(empty)) == []


def test_alignment_query(spark, sf, library, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = alignment.query(spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_alignment(rows, library, tokenizer)


def test_components_are_those_of_all_overlaps():
    r = random.Random(9)
    for _ in range(300):
        n = r.randrange(1, 40)
        ends = [np.array(sorted({*r.sample(range(1, n + 1), r.randrange(n)), n})) for _ in "ab"]
        got = alignment.components(*ends)
        of = list(range(len(ends[0]) + len(ends[1])))

        def find(x, of=of):
            while of[x] != x:
                x = of[x]
            return x

        spans = [(s, e) for es in ends for s, e in zip([0, *es], es, strict=False)]
        for i in range(len(ends[0])):
            for j in range(len(ends[0]), len(spans)):
                if spans[i][0] < spans[j][1] and spans[j][0] < spans[i][1]:
                    of[find(i)] = find(j)
        assert all((got[i] == got[j]) == (find(i) == find(j)) for i in range(len(of)) for j in range(len(of)))


def test_vocabularies_bound_the_pairs():
    a, b = [b"ab", b"b", b"", b"xab"], [b"ab", b"b", b"b", b"zb"]
    want = {x << 32 | y for x in range(4) for y in range(4) if a[x] and b[y] and (a[x].endswith(b[y]) or b[y].endswith(a[x]))}
    assert alignment.possible_pairs(a, b).tolist() == sorted(want)


SCHEMA = "conv_id long, turn long, role string, text string, key string, words int, d int"


def conversations(seed=1, n=60):
    """Few roles and texts, so that paths meet; nulls, ties, repeats, holes, families without a base, negative ids."""
    r = random.Random(seed)
    rows = [(r.choice([*range(n), *range(107, 113), -3, -25, 2**40]), r.choice([None, *range(5)]), r.choice([None, "", "user"]), r.choice([None, "", "a b", "c\td \x0b e", "é f"])) for _ in range(6 * n)]
    rows += [(i, t, "user", "same start") for i in range(20, 60) for t in range(-3, 0)]
    rows += [(None, 1, "user", "nobody's")] * 3 + [(5, 1, "user", "twice")] * 2
    return [(*x, "k", 1, 2) for x in rows]


def by_definition(rows):
    """Every node by its whole sequence of turns."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    words = lambda s: sum(bool(w) for w in s.translate(dict.fromkeys(map(ord, "\t\n\x0b\f\r"), " ")).split(" "))
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in members if p}
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == path)))
        saved = sum((len(members[p]) - 1) * words(p[-1][1]) for p in below if p)
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), sum(p[:-1] == path for p in members if p), sum(p not in inner for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def trie_rows(df):
    return sorted(repr(tuple(r)) for r in prefix_trie.trie(df).collect())


@pytest.mark.parametrize("small", [100, 3])
def test_trie_against_definition_and_sql(spark, monkeypatch, small):
    """With 3, many conversations and prefixes count as heavy."""
    monkeypatch.setattr(running, "SMALL", small)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_definition(rows)
    assert trie_rows(df) == want
    c = duckdb.connect()
    c.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    found = c.execute(f"select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({prefix_trie.SQL})").fetchall()
    assert sorted(map(repr, found)) == want


def test_trie_of_hot_conversation_and_prefix(spark, monkeypatch):
    monkeypatch.setattr(running, "SMALL", 50)
    rows = [(40, t, "user", f"turn {t}") for t in range(3000)] + [(c, 0, "user", "all alike") for c in range(100, 3100)]
    rows = [(*x, "k", 1, 2) for x in rows]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    root = next(r for r in got if r.depth == 0)
    assert (root.conv_id, root.n_convs, root.parent_conv_id) == (40, 3001, None)
    ends = range(100, 3100)
    node = next(r for r in got if r.depth == 1 and r.conv_id == 100)
    assert node.n_convs == len(ends) and node.saved_tokens == 2 * (len(ends) - 1)
    assert node.ends_sha256 == hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
    assert sum(r.n_convs == 1 and r.conv_id == 40 for r in got) == 3000


def test_trie_of_nothing(spark):
    assert trie_rows(spark.createDataFrame([], SCHEMA)) == [] and trie_rows(spark.createDataFrame([(None, 1, "a", "b", "k", 1, 2)], SCHEMA)) == []


def test_trie_sql(spark, sf, duck, same_rows):
    assert same_rows(prefix_trie.query(spark, sf).toPandas(), duck.execute(prefix_trie.SQL).df())
