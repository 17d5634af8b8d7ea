"""Plans of queries over scores: what is measured is measured once and dealt out."""

import itertools
import random

import pandas as pd
import pytest

from glyphmill.functions import text as t
from glyphmill.operators import compare, scoring, summary
from glyphmill.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contingency_measures_once(spark, sf):
    assert "collect_list(" not in plan(catalog.QUERIES["paired_contingency"](spark, sf))  # kept before both sides read it


def test_contingency_of_known_results(spark):
    rows = [(1, "a", "x", True), (1, "b", "x", True), (1, "a", "y", True), (1, "b", "y", False), (1, "c", "z", True), (2, "b", "x", False)]
    scored = spark.createDataFrame(rows, "pass int, model string, sample_id string, exact_match boolean")
    planned = spark.createDataFrame([(p, s) for p in (1, 2) for s in "xyz"], "pass int, sample_id string")
    got = {r["pass"]: tuple(r)[1:] for r in compare.contingency(scored, planned, "a", "b", ["pass"]).collect()}
    assert got == {1: (1, 1, 0, 0, 1), 2: (0, 0, 0, 0, 3)}


def test_suite_is_dealt_out(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "REPARTITION_BY_NUM" in plan(catalog.QUERIES["suite_variability"](spark, sf))  # not the exchange of a join, which is gathered by bytes
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_condition_pairs_measures_once(spark, sf):
    assert "collect_list(" not in plan(catalog.QUERIES["condition_pairs"](spark, sf))


@pytest.mark.parametrize("name", ["winner", "accuracy_bands", "difficult_examples", "worst_n", "subgroup_report", "summary_by_model", "winner_gates", "threshold_sweep", "raw_accuracy_rank"])
def test_texts_are_normalised_inside_the_step(spark, sf, name, monkeypatch):
    monkeypatch.setattr(scoring, "checkpointed", lambda df: df)
    assert "regexp_replace(" not in plan(catalog.QUERIES[name](spark, sf))  # ten times a pair before, most of the step's time


def test_spine_measures_nothing(spark, sf):
    assert "edits(" not in plan(catalog.QUERIES["result_spine"](spark, sf))


def test_outcomes_are_those_of_cells(spark):
    samples = spark.createDataFrame([(1, "a b", "prose", 1), (2, " \t", "word", 1), (3, None, "equation", 2), (4, "x", "equation", 2)], "sample_id int, reference string, content_type string, source_document int")
    models, passes = spark.createDataFrame([("m", 0), ("n", 1)], "model string, ord int"), spark.createDataFrame([(1,), (2,)], "pass int")
    said = [(1, "success", "a"), (1, "error", None), (2, "success", "x"), (3, "success", "x"), (4, "success", None), (4, "unsupported", None), (1, "success", "a"), (4, None, "x"), (9, "success", "x")]
    results = spark.createDataFrame([("m", 1 + i % 2, k, r, s, p, False, 1.0) for i, (k, s, p) in enumerate(said) for r in [{1: "a b", 2: " \t", 4: "x", 9: "y"}.get(k)]], "model string, pass int, sample_id int, reference string, status string, prediction string, cache_hit boolean, latency_seconds double")
    want = scoring.cells(samples, models, passes, results).select("track", "model", "pass", "sample_id", "outcome").collect()
    got = scoring.outcomes(samples, models, passes, results).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.outcome for r in got} == {"success", "failed", "missing", "unsupported"}


@pytest.mark.parametrize("name", ["difficult_examples", "worst_n", "subgroup_report", "summary_by_model", "winner_gates", "threshold_sweep"])
def test_texts_are_dealt_out_once(spark, sf, name, monkeypatch):
    monkeypatch.setattr(scoring, "checkpointed", lambda df: df)
    found = plan(catalog.QUERIES[name](spark, sf))
    assert "collect_list(" not in found  # every prediction was dealt out with its reference and sorted into groups before
    below = found[found.index("ArrowEvalPython [edits(") :]
    assert below.index("BroadcastNestedLoopJoin") < below.index("REPARTITION_BY_NUM")  # samples are dealt out, results made of them there


def test_equal_pairs_of_a_batch_are_measured_once(monkeypatch):
    seen, counts = [], t._counts
    monkeypatch.setattr(t, "_counts", lambda r, p: seen.append((r, p)) or counts(r, p))
    r, p = pd.Series(["a b", "a b", None, "a b", None]), pd.Series(["a b", "a c", "x", "a c", "x"])
    assert t.edits.func(r, p)["char_edits"].tolist() == [0, 1, pd.NA, 1, pd.NA]
    assert len(seen) == 3


def test_measures_of_odd_results(spark):
    said = [("success", "a c"), ("success", None), (None, "a b"), ("error", "a b"), ("unsupported", None), ("success", " a  b "), ("success", "")]
    rows = [(i, r, s, p) for i, (r, (s, p)) in enumerate((r, x) for r in ("a b", " \t", None) for x in said)]
    results = spark.createDataFrame(rows, "sample_id int, reference string, status string, prediction string")
    got = {x["sample_id"]: x["m"] and (x["m"]["char_edits"], x["m"]["word_edits"], x["m"]["exact_match"]) for x in summary.with_measures(results).collect()}
    assert got == {i: {0: (1, 1, False), 5: (0, 0, True), 6: (3, 2, False)}.get(i) for i in range(len(rows))}
    assert {x["sample_id"]: x["char_edits"] for x in scoring.scored(results).collect()} == {0: 1, 5: 0, 6: 3}


def _table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_counts_are_those_of_the_whole_table():
    rng = random.Random(15)
    texts = [rng.choice(["", " ", "\t"]) + rng.choice([" ", "  ", " \n"]).join(rng.choices(["a", "ab", "b", "ba", "é", "aa"], k=rng.randrange(9))) for _ in range(60)]
    for r, p in itertools.product(texts, texts):
        a, b = r.split(), p.split()
        left, right = " ".join(a), " ".join(b)
        assert t._counts(r, p) == (_table(left, right), _table(a, b), len(left), len(a), a == b)


def test_words_left_out_need_no_comparison_of_characters(monkeypatch):
    monkeypatch.setattr(t, "edit_distance", None)  # was called on the texts and on their words before
    assert t._counts("the a  the b", " a b ") == (8, 2, 11, 4, False)
    assert t._counts("a b", "b a b c") == (4, 2, 3, 2, False)
    assert t._counts(" a b", "\n") == (3, 2, 3, 2, False)


def test_reference_is_split_once_for_results_side_by_side():
    class Text(str):
        splits = 0

        def split(self):
            Text.splits += 1
            return super().split()

    r = Text("one reference of three predictions")
    assert [t._counts(r, p)[1] for p in ("one reference", r, "two", "another reference of three predictions")] == [3, 0, 5, 1]
    assert Text.splits == 1


def test_subgroups_join_fields_before_measuring(spark, sf):
    found = plan(catalog.QUERIES["subgroup_report"](spark, sf))
    assert found.index("ArrowEvalPython [edits(") < found.index("ShuffledHashJoin")  # measured rows were sent and sorted for it before
    assert "SortMergeJoin" not in found


def test_summary_makes_no_cell_for_missing_samples(spark, sf):
    assert "LeftAnti" not in plan(catalog.QUERIES["summary_by_model"](spark, sf))  # every model with every sample before


def test_missing_samples_of_odd_results(spark):
    said = [("m", 1), ("m", 1), ("m", 9), ("x", 1), (None, 2), ("n", None), ("n", 2), ("n", 3)]
    columns = "model string, sample_id int, reference string, prediction string, status string, truncated boolean, cache_hit boolean, latency_seconds double, load_duration_seconds double"
    results = spark.createDataFrame([(m, k, "a b", "a b", "success", False, False, 1.0, None) for m, k in said], columns)
    expected = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "sample_id int")
    models = spark.createDataFrame([("m",), ("n",), ("o",), (None,)], "model string")
    got = sorted(((r.model or "", r.missing_sample_count) for r in summary.summarize(results, expected, models).collect()))
    assert got == [("", 0), ("", 0), ("m", 4), ("n", 2), ("o", 5), ("x", 0)]
