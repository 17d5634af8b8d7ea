"""Strict readers, exports, snapshots, adapters and the attempt machine: what they refuse, and odd rows."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import identity, rollup, running
from glyphmill.sources import adapters, export, log, runs, strict


def texts(spark, tmp_path, name, *files):
    (tmp_path / name).mkdir()
    for i, text in enumerate(files):
        (tmp_path / name / f"{i}.txt").write_text(text)
    return str(tmp_path / name)


def ks(df):
    return sorted(r.k for r in df.collect())


def test_logs(spark, tmp_path):
    at = texts(spark, tmp_path, "log", '{"k": 1}\n{"k": 2}\n{"k"', '{"k": 3}\n', "", '{"k": 4}\r\n{"k": 5}')
    records, torn = log.repaired(spark, at, "k int")
    assert ks(records) == [1, 2, 3, 4, 5] and [r.value for r in torn.collect()] == ['{"k"']
    assert ks(log.live(spark, at, "k int")) == [1, 2, 3, 4]
    ends = {r.file.rsplit("/", 1)[1]: (r.end, r.lines, r.corrupt) for r in log.ends(log.lines(spark, at, "k int")).collect()}
    assert ends == {"0.txt": ("torn", 3, 0), "1.txt": ("committed", 1, 0), "3.txt": ("unterminated", 2, 0)}
    log.repair(spark, at, "k int", str(tmp_path / "to"), str(tmp_path / "aside"))
    assert ks(spark.read.json(str(tmp_path / "to"))) == [1, 2, 3, 4, 5] and spark.read.json(str(tmp_path / "aside")).first().value == '{"k"'


@pytest.mark.parametrize("text", ['{"k": 1}\nnope\n{"k": 2}\n', '{"k": 1}\n{"k": 2\n', '{"k": "x"}\n', '{"k": 1}\n\n', '{"k": 1}\n5\n{"k"', "\n"])
def test_logs_with_a_corrupt_line(spark, tmp_path, text):
    """A line with a newline must be a record, also when it is the last."""
    at = texts(spark, tmp_path, "bad", text, '{"k": 3}\n')
    for read in (log.live, log.repaired):
        with pytest.raises(ValueError, match="corrupt line"):
            read(spark, at, "k int")


def test_a_log_of_several_blocks(spark, tmp_path, monkeypatch):
    """Read by several tasks, and with more open ends than are broadcast."""
    monkeypatch.setattr(log, "FEW", 0)
    n = 20_000
    at = texts(spark, tmp_path, "large", "".join(f'{{"k": {i}, "t": "é"}}\n' for i in range(n)) + '{"k": -1}', '{"k": -2}\n{"k')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        found = log.lines(spark, at, "k int")
        assert found.rdd.getNumPartitions() > 5
        assert ks(log.live(spark, at, "k int")) == [-2, *range(n)]
        records, torn = log.repaired(spark, at, "k int")
        assert ks(records) == [-2, -1, *range(n)] and torn.count() == 1
        assert {r.state: r["count"] for r in log.states(spark, at, "k int").groupBy("state").count().collect()} == {"whole": n + 2, "torn": 1}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_log_that_grows_while_it_is_read(spark, tmp_path):
    at = texts(spark, tmp_path, "grows", '{"k": 1}\n{"k":')
    found = log.lines(spark, at, "k int")
    with open(f"{at}/0.txt", "a") as f:
        f.write(' 2}\n{"k": 3}\n')
    assert [(r.end, r.corrupt) for r in log.ends(found).collect()] == [("unterminated", 0)]


def test_annotation_tables_refuse(spark, tmp_path):
    with pytest.raises(ValueError, match="two texts"):
        strict.word_table(spark, texts(spark, tmp_path, "words", "a ok 1 A x\na ok 1 A y\n"))
    line = "{} ok 154 19 408 746 1661 89 {}\n"
    with pytest.raises(ValueError, match="repeated line"):
        strict.protocol_lines(spark, texts(spark, tmp_path, "twice", line.format("a", "x") * 2))
    with pytest.raises(ValueError, match="without a reference"):
        strict.protocol_lines(spark, texts(spark, tmp_path, "empty", line.format("a", "|")))
    with pytest.raises(ValueError, match="not an id"):
        strict.ids(spark, texts(spark, tmp_path, "ids", "a-1\nb c\n"))
    with pytest.raises(ValueError, match="repeated id"):
        strict.ids(spark, texts(spark, tmp_path, "ids2", "a-1\na-1\n"))
    with pytest.raises(ValueError, match="given twice"):
        strict.metadata(spark, texts(spark, tmp_path, "meta", '{"id": "a"}\n{"sample_id": "a"}\n'))


def test_external_predictions(spark, tmp_path):
    roster = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    good = '{"sample_id": "a", "prediction": "x"}\n\n{"sample_id": "b", "prediction": "", "status": "error", "latency_seconds": 0.5, "usage": {"input_tokens": 1}}\n'
    got = {r.sample_id: r for r in strict.predictions(spark, texts(spark, tmp_path, "good", good), roster).collect()}
    assert got["a"].status == "success" and got["b"].status == "error" and got["b"].usage.input_tokens == 1 and got["b"].latency_seconds == 0.5
    for i, (bad, why) in enumerate([('{"sample_id": "a", "sample_id": "a", "prediction": "x"}', "not_json"), ('{"sample_id": "c", "prediction": "x"}', "unknown_sample"), ('{"sample_id": "a", "prediction": "x", "latency_seconds": 1e999}', "not_json|bad_latency")]):
        with pytest.raises(ValueError, match=why):
            strict.predictions(spark, texts(spark, tmp_path, f"bad{i}", bad + "\n"), roster)
    assert strict.prediction_findings(spark.createDataFrame([], "value string"), roster).count() == 0


def test_provenance_and_settings():
    assert strict.provenance(" by hand ") == {"description": "by hand"} and strict.provenance(document='{"a": 1}') == {"a": 1}
    for wrong in ({}, {"description": "x", "document": "{}"}, {"description": " "}, {"document": "{}"}, {"document": '{"a": 1, "a": 2}'}, {"document": '{"a": NaN}'}, {"document": "[1]"}):
        with pytest.raises(ValueError):
            strict.provenance(**wrong)
    assert strict.settings('models = ["a"]\nrepeats = 3\naccuracy_margin = 1') == {"models": ["a"], "passes": 3, "margin": 1}
    assert strict.settings('version = 3\nmodels = ["a"]\nmargin = 0.5')["margin"] == 0.5
    for wrong in ("", "version = 9", 'models = ["a"]\nwhat = 1', 'version = 3\nmodels = ["a"]\nrepeats = 3', 'models = ["a"]\nseed = true', "models = 3"):
        with pytest.raises(ValueError):
            strict.settings(wrong)


def test_publishing_is_whole_and_once(spark, tmp_path):
    df = spark.range(3)
    export.publish(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3 and not (tmp_path / "p.part").exists()
    with pytest.raises(FileExistsError):
        export.publish(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="no|cannot|zero|divide"):
        export.publish(df.select(F.raise_error(F.lit("no"))), str(tmp_path / "q"))
    assert not (tmp_path / "q").exists()
    export.write_package(spark.createDataFrame([(1, "test", "real"), (2, "train", "real")], "id int, split string, origin string"), str(tmp_path / "k"), ["split", "origin"])
    assert (tmp_path / "k" / "split=test" / "origin=real").exists()


def test_cells_of_a_sheet(spark):
    text = "ab😀" * 5
    got = export.overflow(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "k int, t string"), "k", "t", 7).collect()
    pieces = [r.text for r in sorted(got, key=lambda r: r.piece)]
    assert {r.k for r in got} == {1} and "".join(pieces) == text and all(len(p.encode("utf-16-le")) <= 14 for p in pieces)
    cells = [r.c for r in spark.createDataFrame([("a\x02b",), ("ok",), (None,)], "t string").select(export.cell(F.col("t")).alias("c")).collect()]
    assert json.loads(cells[0].removeprefix(export.JSON_MARK)) == "a\x02b" and cells[1:] == ["ok", None]


def test_documents_and_digests(spark):
    docs = spark.createDataFrame([(1, '{"b": {"c": [1, {"d": 2}], "e": {}}, "a": null}'), (2, "[]"), (3, None)], "k int, d string")
    assert sorted(tuple(r) for r in export.document_rows(docs, "k", "d").collect()) == [(1, "a", "null"), (1, "b.c", '[1,{"d":2}]'), (1, "b.e", "{}"), (2, "", "[]")]
    assert export.digest({"b": 1, "a": [2.5]}) == export.digest({"a": [2.5], "b": 1})
    with pytest.raises(ValueError):
        export.digest({"a": float("nan")})
    assert runs.metadata_rows(spark, '{"x": {"y": "z"}}').first().asDict() == {"path": "x.y", "value": "z"}


def test_snapshots(spark, tmp_path):
    s = spark.createDataFrame([(1, "a", "/x/1"), (2, "b", "/x/2")], "sample_id long, reference string, crop_path string")
    mark = runs.freeze(s, str(tmp_path / "s"))
    assert runs.snapshot(spark, str(tmp_path / "s"), mark).count() == 2
    with pytest.raises(ValueError, match="fingerprint"):
        runs.snapshot(spark, str(tmp_path / "s"), "other")
    spark.read.parquet(str(tmp_path / "s")).withColumn("reference", F.lit("c")).write.parquet(str(tmp_path / "changed"))
    with pytest.raises(ValueError, match="changed row"):
        runs.snapshot(spark, str(tmp_path / "changed"))
    assert runs.evidence_id(s.withColumn("metrics", F.lit(1))).collect() == runs.evidence_id(s.withColumn("metrics", F.lit(2)).orderBy(F.desc("sample_id"))).collect()


def test_runs_refuse_stray_results(spark, tmp_path):
    s = spark.createDataFrame([(1, "a", "easy")], "sample_id long, reference string, difficulty string")
    m = spark.createDataFrame([("m",)], "model string")
    schema = "model string, pass int, sample_id long, status string, prediction string, reference string"
    row = '{"model": "m", "pass": 1, "sample_id": 1, "status": "success", "prediction": "a", "reference": "a"}\n'
    assert runs.run(spark, texts(spark, tmp_path, "ok", row), s, m, 1, schema).first()["difficulty"] == "easy"
    for i, (bad, why) in enumerate([(row * 2, "duplicate"), (row.replace('"a"}', '"b"}'), "mismatch"), (row.replace('"pass": 1', '"pass": 2'), "out_of_plan"), (row + '{"mod', "torn")]):
        with pytest.raises(ValueError, match=why):
            runs.run(spark, texts(spark, tmp_path, f"bad{i}", bad), s, m, 1, schema)


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name in ("x/l-1.png", "x/l-2.png"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    members = runs.archive_members(spark, str(tmp_path))
    assert sorted(r.name for r in members.collect()) == ["x/l-1.png", "x/l-2.png"]
    assert [r.id for r in runs.members_missing(members, spark.createDataFrame([("l-1",), ("l-3",)], "id string")).collect()] == ["l-3"]
    assert runs.listing(spark, str(tmp_path), "*.tar").first()["bytes"] > 0


def test_caches_and_plans(spark):
    cache = spark.createDataFrame([("a", "1")], "key string, response string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "key string, response string")
    assert [tuple(r) for r in runs.cache_store(cache, new, "response").collect()] == [("b", "2")]
    with pytest.raises(ValueError, match="conflicting"):
        runs.cache_store(cache, spark.createDataFrame([("a", None)], "key string, response string"), "response")
    plan = spark.createDataFrame([("experiment", 0, None, 1, "p"), ("experiment", 0, None, 1, "q")], "kind string, position int, condition string, repetition int, path string")
    with pytest.raises(ValueError, match="repetition"):
        runs.source_plan(plan)


def test_adapters(spark):
    class Broken:
        def load(self):
            pass

        def transcribe(self, sample):
            raise KeyError("gone")

        def unload(self):
            pass

    s = spark.createDataFrame([(1, "see", "secret", "prose", "line"), (2, "x", "secret", "equation", "line")], "sample_id long, image string, reference string, track string, sample_type string")
    got = {r.sample_id: r for r in adapters.run(s, "m", *adapters.backend("TEST:any")[1:]).collect()}
    assert got[1].prediction == "s33" and got[2].status == "unsupported" and got[2].prediction is None
    assert {r.error for r in adapters.run(s, "m", Broken, adapters.Capabilities()).collect()} == {"KeyError: 'gone'"}
    for c in (adapters.Capabilities(fields=("reference",)), adapters.Capabilities(concurrency=0)):
        with pytest.raises(ValueError):
            adapters.run(s, "m", Broken, c)
    with pytest.raises(ValueError, match="unknown system"):
        adapters.backend("nowhere:m")
    assert adapters.source_fingerprint(Broken) != adapters.source_fingerprint(adapters.Plain) and adapters.model_listing(spark).count() == 1


def test_reviews_and_filters_refuse(spark):
    roster = spark.createDataFrame([("a", "c" * 64, "text")], "sample_id string, crop string, reference string")
    review = roster.select("sample_id", F.col("crop").alias("crop_sha256"), F.sha2("reference", 256).alias("reference_sha256"), F.lit("exclude").alias("decision"), F.lit("unreadable").alias("reason_code"), F.lit("blot").alias("reason"))
    assert identity.review_exclusions(review, roster).first()["reason"] == "human_review:unreadable: blot"
    with pytest.raises(ValueError, match="repeated_decision"):
        identity.review_exclusions(review.union(review), roster)
    with pytest.raises(ValueError, match="reason_missing"):
        identity.review_exclusions(review.withColumn("reason_code", F.lit("why")), roster)
    with pytest.raises(ValueError, match="no record"):
        identity.only(spark.createDataFrame([("train", "word")], "split string, content_type string"), "test")
    assert identity.safe_response(spark.createDataFrame([("k", "p", "h")], "key string, prediction string, headers string")).columns == ["key", "prediction"]


def test_running_sums_over_many_ranges(spark):
    rows = [(i % 2, i, i * 10) for i in range(500)] + [(2, 0, None)]
    got = {(r.g, r.i): r.s for r in running.running_sums(spark.createDataFrame(rows, "g int, i int, v int"), ["g"], ["i"], {"s": F.coalesce("v", F.lit(0))}).collect()}
    for g in (0, 1):
        total = 0
        for i in range(g, 500, 2):
            total += i * 10
            assert got[g, i] == total
    assert got[2, 0] == 0


def test_empty_evidence(spark):
    none = spark.createDataFrame([], "type string, subject string")
    assert rollup.bounded_details(none).count() == 0 and rollup.ordered_groups(spark.createDataFrame([], "v string"), "v").count() == 0
