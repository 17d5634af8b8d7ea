import re

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import audit, checks, eligibility, ranking, scoring
from glyphmill.sources import readers


def board(spark, rows):
    return spark.createDataFrame(rows, "track string, model string, score double, median_latency_seconds double, terminal_complete boolean")


def test_bands_are_anchored(spark):
    rows = [("t", "a", 95.0, 0.2, True), ("t", "b", 94.6, 0.1, True), ("t", "c", 94.2, 0.05, True)]
    got = {r.model: (r.band, r["rank"]) for r in ranking.ranked(board(spark, rows), 0.5).collect()}
    assert got == {"b": (1, 1), "a": (1, 2), "c": (2, 3)}
    w = ranking.winners(ranking.ranked(board(spark, rows), 0.5)).first()
    assert (w.winner, w.status) == ("b", "available")


def test_unknown_latency_withholds_places(spark):
    rows = [("t", "a", 95.0, None, True), ("t", "b", 94.6, 0.1, True), ("t", "c", 90.0, 0.05, True), ("t", "d", None, 0.1, True)]
    got = {r.model: r["rank"] for r in ranking.ranked(board(spark, rows), 0.5).collect()}
    assert got == {"a": None, "b": None, "c": 3}
    assert ranking.winners(ranking.ranked(board(spark, rows), 0.5)).first().winner_reason == "missing_top_band_latency"


def test_incomplete_withholds_winner(spark):
    assert ranking.winners(ranking.ranked(board(spark, [("t", "a", 95.0, 0.1, False)]), 0.5)).first().winner_reason == "incomplete_evaluation"


def test_penalties_and_pass_means(spark):
    samples = spark.createDataFrame([("s", "abcd", "prose", "d")], "sample_id string, reference string, content_type string, source_document string")
    models = spark.createDataFrame([("a", 0), ("b", 1)], "model string, ord int")
    passes = spark.createDataFrame([(1,), (2,)], "pass int")
    results = spark.createDataFrame([("b", 1, "s", "success", "abcd", "abcd", False, 0.1), ("b", 2, "s", "success", "abce", "abcd", False, 0.3), ("a", 1, "s", "error", None, "abcd", False, None)], "model string, pass int, sample_id string, status string, prediction string, reference string, cache_hit boolean, latency_seconds double")
    policy = scoring.Policy(0.7, 0.3)
    got = {r.model: r for r in scoring.model_table(scoring.cells(samples, models, passes, results), policy).collect()}
    assert got["b"].score == pytest.approx(76.25) and got["b"].score_stddev == pytest.approx(33.58757210636101)
    assert got["b"].p95_latency_seconds == pytest.approx(0.29)
    assert got["a"].score == 0 and got["a"].failed_count == 1 and got["a"].missing_count == 1


def test_policy_is_checked():
    with pytest.raises(ValueError):
        scoring.Policy(0.5, 0.6)


def test_exclusions_take_the_first_reason(spark):
    rows = [(1, "prose", "test", "verified"), (2, "prose", "train", "verified"), (3, "prose", None, None), (4, "prose", "train", "unverified"), (5, "prose", "eval", "yes")]
    s = spark.createDataFrame(rows, "sample_id long, content_type string, split string, verification_status string")
    got = {r.sample_id: r.reason for r in eligibility.exclusions(s).collect()}
    assert got == {1: None, 2: "not_test_split", 3: "missing_split", 4: "reference_unverified", 5: None}


def test_hamming_pairs_against_all_pairs(spark):
    import random

    r = random.Random(2)
    base = [r.getrandbits(63) for _ in range(6)]
    values = base + [b ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for b in base for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    got = {(x.left_id, x.right_id, x.distance) for x in audit.hamming_pairs(df, "id", "h").collect()}
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 4}
    assert got == want


def test_near_text_pairs(spark):
    rows = [(1, "page 12 of the long report on rivers", "train"), (2, "page 34 of the long report on rivers", "test"), (3, "something else entirely", "test"), (4, None, "test")]
    got = audit.near_text_pairs(spark.createDataFrame(rows, "id long, text string, split string"), "id", "text", "split", min_words=0).collect()
    assert [(r.left_id, r.right_id) for r in got] == [(1, 2)]


@pytest.mark.parametrize("block", [1 << 18, 700])
def test_near_text_pairs_against_all_pairs(spark, monkeypatch, block):
    import difflib
    import random

    monkeypatch.setattr(audit, "BLOCK", block)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = [word(r.randrange(2, 9)) for _ in range(60)]
    texts = []
    for _ in range(15):  # near copies with changed words, each of them also in one other row
        own = [word(7) for _ in range(3)]
        at = r.sample(range(60), 3)
        texts += [" ".join(own[at.index(i)] if i in at else w for i, w in enumerate(base)), " ".join([*own, word(5), word(5)])]
    texts += ["".join(r.choice("ab1 ") for _ in range(r.randrange(1, 12))) for _ in range(40)] + ["Chapter 1", "chapter 22", "x" * 50, "x" * 60, "x" * 62]
    rows = [(i, t, r.choice(["train", "test", "validation"])) for i, t in enumerate(texts)]
    mask = [re.sub(r"\d+(?:\.\d+)?", "<number>", t.lower()) for t in texts]
    ratio = lambda i, j: difflib.SequenceMatcher(None, mask[i], mask[j], autojunk=False).ratio()
    want = {(i, j): x for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][2] != rows[j][2] and mask[i] and mask[j] and (x := ratio(i, j)) >= 0.9}
    got = audit.near_text_pairs(spark.createDataFrame(rows, "id long, text string, split string"), "id", "text", "split", min_words=0).collect()
    assert len(want) > 50 and len(got) == len(want) and {(x.left_id, x.right_id): x.ratio for x in got} == want


def test_violations(spark):
    samples = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "sample_id long, reference string")
    results = spark.createDataFrame([("m", 1, 1, "a"), ("m", 1, 1, "a"), ("m", 3, 9, "x"), ("m", 1, 2, "B")], "model string, pass int, sample_id long, reference string")
    got = {r.check: r.n for r in checks.violations(samples, results, 2).collect()}
    assert got == {"duplicate_result": 1, "unknown_sample": 1, "pass_out_of_plan": 1, "reference_mismatch": 2, "duplicate_sample": 1}


def test_readers(spark, tmp_path):
    (tmp_path / "words.txt").write_text("# c\na01 ok 154 1 1 2 2 AT A\na02 err 154 1 1 2 2 AT B\n")
    assert [tuple(r) for r in readers.word_table(spark, str(tmp_path / "words.txt")).collect()] == [("a01", "A")]
    (tmp_path / "form.xml").write_text('<forms><form id="f1" writer-id="7"><handwritten-part><line id="1" text="hello you"><word id="w"><cmp x="1" y="2" width="3" height="4"/><cmp x="9" y="1" width="1" height="2"/></word></line><line id="2" text="Name: Bob"><word id="v"><cmp x="1" y="9" width="1" height="1"/></word></line></handwritten-part></form></forms>')
    spark_forms = readers.forms(spark, str(tmp_path / "form.xml"))
    assert [r.asDict() for r in spark_forms.collect()] == [{"form": "f1", "writer_id": "7", "at": 0, "text": "hello you", "left": 1, "top": 1, "right": 10, "bottom": 6}]
