"""Queries over files: each writes what it needs in the shared folder from the test tables and reads it back strictly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions import text as t
from glyphmill.operators import ledger
from glyphmill.plans.scores import P, _round
from glyphmill.sources import adapters, export, log, readers, runs, strict
from glyphmill.sources import evidence as e
from glyphmill.streaming import attempts, machine, ordered, tokens

EVENT = "event_id long, user_id long, event_type string, value double"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _written(spark, df, name):
    """df's one column as lines of text files."""
    at = export.scratch(spark, name)
    df.write.text(at)
    return at


def _unended(spark, at, content):
    """One more file of a folder, that ends as content does."""
    spark.createDataFrame([(content[:-1],)], "value string").coalesce(1).write.mode("append").option("lineSep", content[-1]).text(at)


def log_repair(spark, sf_dir):
    ev = _table(spark, sf_dir, "events").select(*[c.split()[0] for c in EVENT.split(", ")])
    at = _written(spark, ev.select(F.to_json(F.struct(*ev.columns)).alias("value")), "log")
    _unended(spark, at, '{"event_id": -1, "user_id": 1, "event_type": "click", "value": 1.0}\n{"event_id": -2, "user_')
    to, aside = export.scratch(spark, "repaired"), export.scratch(spark, "aside")
    log.repair(spark, at, EVENT, to, aside)
    records, torn = spark.read.schema(EVENT).json(to), spark.read.schema("file string, value string").json(aside)
    return records.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).withColumn("torn", F.lit(torn.count()))


def corrupt_lines(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    at = _written(spark, n.orderBy("n_nationkey").coalesce(1).select(F.when(F.col("n_nationkey") % 7 == 3, F.col("n_name")).when(F.col("n_nationkey") == 24, '{"k": 2').otherwise(F.to_json(F.struct(F.col("n_nationkey").alias("k")))).alias("value")), "lines")
    _unended(spark, at, '{"k": 98}\n\n{"k": "word"}\n{"k": 99')
    _unended(spark, at, '{"k": 97}')
    return log.states(spark, at, "k int").select("value", "state")


#: Events of a log file; a file's end is, by its number: committed, whole without a newline, torn, or corrupt with one.
FILE_EVENTS = 1000


def log_ends(spark, sf_dir):
    f, kind = F.expr(f"event_id div {FILE_EVENTS}"), F.expr(f"event_id div {FILE_EVENTS} % 4")
    w = Window.partitionBy("f").orderBy("event_id")
    ev = _table(spark, sf_dir, "events").select("event_id", "user_id", f.alias("f"), kind.alias("kind"))
    ev = ev.withColumn("first", F.lag("event_id").over(w).isNull()).withColumn("last", F.lead("event_id").over(w).isNull())
    line = F.when(F.col("last") & (F.col("kind") >= 2), '{"event_id": {"x": 1}').otherwise(F.to_json(F.struct("event_id", "user_id")))
    rows = ev.select("f", "kind", "event_id", F.when(F.col("first") | F.col("kind").isin(0, 3), line).otherwise(F.concat(F.lit("\n"), line)).alias("value"))
    sound, broken = export.scratch(spark, "ends"), export.scratch(spark, "broken")
    for where, at, end in (("kind = 0", sound, "\n"), ("kind in (1, 2)", sound, "}"), ("kind = 3", broken, "\n")):
        some = rows.where(where).withColumn("value", F.col("value") if end == "\n" else F.expr("left(value, length(value) - 1)"))
        some.repartition("f").sortWithinPartitions("f", "event_id").select("f", "value").write.mode("append").option("lineSep", end).partitionBy("f").text(at)
    schema = "event_id long, user_id long"
    known = log.ends(log.lines(spark, [sound, broken] if spark.read.option("recursiveFileLookup", True).text(broken).limit(1).count() else sound, schema))
    number = F.regexp_extract("file", r"/f=(\d+)/", 1).cast("long")
    count = lambda df, name: df.groupBy(F.expr(f"event_id div {FILE_EVENTS}").alias("f")).agg(F.count(F.lit(1)).alias(name), F.sum("user_id").alias(f"{name}_users"))
    repaired, live = count(log.repaired(spark, sound, schema)[0], "repaired"), count(log.live(spark, sound, schema), "live")
    return known.select(number.alias("f"), "end", "lines", "corrupt").join(repaired, "f", "left").join(live, "f", "left")


def metadata_scan(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    line = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.col("c_name").alias("id"), F.col("c_mktsegment").alias("content_type"), F.struct(F.array("c_mktsegment").alias("critical_expressions")).alias("annotations")))).otherwise(F.to_json(F.struct(F.col("c_name").alias("sample_id"), F.lit("test").alias("split"), F.lit(1).alias("other"))))
    out = strict.metadata(spark, _written(spark, c.select(line.alias("value")), "metadata"))
    return out.select("sample_id", "content_type", "split", F.get("annotations.critical_expressions", F.lit(0)).alias("critical"))


def word_table_scan(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    line = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("# "), "s_name")).otherwise(F.concat_ws(" ", F.concat(F.lit("w-"), F.col("s_suppkey") % 40), F.when(F.col("s_suppkey") % 3 == 0, "err").otherwise("ok"), F.lit("154 1 2 3 4 AT"), F.concat(F.lit("word"), F.col("s_suppkey") % 40)))
    return strict.word_table(spark, _written(spark, s.select(line.alias("value")), "words"))


def line_table_scan(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    sep = F.when(k % 2 == 0, " | ").otherwise("  ")
    text = F.when(k % 2 == 0, F.concat_ws(" ", F.lit("A"), "s_name")).otherwise(F.concat_ws("|", F.lit("A"), F.lit("MOVE"), "s_name"))
    line = F.concat_ws(" ", F.concat(F.lit("l-"), k, sep, F.when(k % 5 == 0, "err").otherwise("ok"), sep, F.when(k % 11 == 0, "x").otherwise("154"), sep, F.lit("19"), sep, F.lit("408"), sep, F.lit("746"), sep, F.lit("1661"), sep, F.lit("89"), sep, text))
    return strict.line_table(spark, _written(spark, s.select(line.alias("value")), "lines"))


def protocol_scan(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    line = F.concat_ws(" ", F.concat(F.lit("l-"), "s_suppkey"), F.when(F.col("s_suppkey") % 4 == 0, "err").otherwise("ok"), F.lit("154 19 408 746 1661 89"), F.concat_ws("|", F.lit("A"), F.lit("MOVE"), "s_nationkey"))
    return strict.protocol_lines(spark, _written(spark, s.select(line.alias("value")), "protocol"))


def id_list_scan(spark, sf_dir):
    return strict.ids(spark, _written(spark, _table(spark, sf_dir, "customer").select(F.concat(F.lit(" c-"), "c_custkey", F.lit("  ")).alias("value")), "ids"))


def paired_files(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    images = p.where("p_partkey % 5 <> 0").select(F.concat(F.lit("/data/images/"), k % 3, F.lit("/p"), k, F.lit(".png")).alias("path")).union(p.where("p_partkey % 17 = 1").select(F.concat(F.lit("/data/images/"), k % 3, F.lit("/p"), k, F.lit(".jpg")).alias("path")))
    texts = p.where("p_partkey % 7 <> 0").select(F.concat(F.lit("/data/text/"), k % 3, F.lit("/p"), k, F.lit(".txt")).alias("path"))
    out = strict.paired(images.withColumn("stem", strict.stem(F.col("path"), "images")), texts.withColumn("stem", strict.stem(F.col("path"), "text")))
    return out.select("stem", "finding")


def layout_overlap(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    tables = {"words": c.where("id % 3 = 0"), "lines": c.where("id % 2 = 0"), "forms": c.where("id % 2 = 1 or id % 100 = 0")}
    return strict.layout(c.where("id % 4 <> 3"), tables)


#: Lines of external predictions with each thing that can be wrong, as an expression.
LINE = """
case doc_id % 40 when 1 then '{"sample_id": "' || doc_id when 2 then '[1]' when 3 then '{"sample_id": "' || doc_id || '", "prediction": "x", "extra": 1}' when 4 then '{"prediction": "x"}' when 5 then '{"sample_id": "none-' || doc_id || '", "prediction": "x"}'
  when 6 then '{"sample_id": "' || (doc_id - 6) || '", "prediction": "again"}' when 7 then '{"sample_id": "' || doc_id || '", "prediction": 5}' when 8 then '{"sample_id": "' || doc_id || '", "prediction": "x", "status": "odd"}' when 9 then '{"sample_id": "' || doc_id || '", "prediction": "x", "latency_seconds": -1}'
  when 10 then '{"sample_id": "' || doc_id || '", "prediction": "x", "latency_seconds": NaN}' when 11 then '{"sample_id": "' || doc_id || '", "prediction": "x", "prediction": "y"}' when 12 then '{"sample_id": "' || doc_id || '", "prediction": "x", "usage": 3}'
  when 13 then '{"sample_id": "' || doc_id || '", "prediction": "x", "usage": {"input_tokens": -3}}' when 14 then '{"sample_id": "' || doc_id || '", "prediction": "x", "usage": {"output_tokens": 2.5}}' when 15 then '{"sample_id": "' || doc_id || '", "prediction": "x", "latency_seconds": true}'
  when 16 then '{"sample_id": "' || doc_id || '", "prediction": "x", "usage": {"input_tokens": 4, "input_tokens_details": {"cached_tokens": "1"}}}' when 17 then '  ' when 18 then '{"sample_id": "' || doc_id || '", "prediction": null}'
  else '{"sample_id": "' || doc_id || '", "prediction": "text ' || doc_id || '", "latency_seconds": ' || (doc_id % 7) || ', "usage": {"input_tokens": 4, "output_tokens": 2}}' end
"""


def import_findings(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    at = _written(spark, d.select(F.expr(LINE).alias("value")), "predictions")
    return strict.prediction_findings(spark.read.text(at), d.select(F.col("doc_id").alias("sample_id"))).groupBy(F.coalesce("finding", F.lit("none")).alias("finding")).agg(F.count(F.lit(1)).alias("n"))


def import_predictions(spark, sf_dir):
    s = e.samples(spark, sf_dir)
    line = F.to_json(F.struct(F.col("sample_id").cast("string").alias("sample_id"), F.replace("reference", F.lit("a"), F.lit("o")).alias("prediction"), F.when(F.col("sample_id") % 9 == 0, "error").alias("status"), F.struct(F.lit(3).alias("input_tokens")).alias("usage")))
    got = strict.predictions(spark, _written(spark, s.where("sample_id % 10 <> 0").select(line.alias("value")), "predictions"), s)
    both = s.select(F.col("sample_id").cast("string").alias("sample_id"), "reference", "content_type").join(got, "sample_id", "left")
    out = both.withColumn("exact", (F.col("status") == "success") & (t.normalize_text(F.col("prediction")) == t.normalize_text(F.col("reference"))))
    return out.groupBy("content_type", F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("exact"), 1)).alias("exact"), F.sum("usage.input_tokens").alias("input_tokens"))


def flat_records(spark, sf_dir):
    r = e.results(spark, sf_dir).where("status = 'error'")
    r = r.select("model", "pass", "sample_id", "status", F.struct(F.lit("inner").alias("status"), (F.col("sample_id") % 10).alias("cer"), F.lit(True).alias("exact")).alias("metrics"))
    return export.flat(r)


def error_rows(spark, sf_dir):
    r = e.results(spark, sf_dir).select("model", "pass", "sample_id", F.when(F.col("sample_id") % 14 != 0, F.col("status")).alias("status"), F.when(F.col("sample_id") % 21 == 0, "late").when(F.col("sample_id") % 22 == 0, "").alias("error"))
    return export.error_rows(r)


def csv_round_trip(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("="), "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('a "b"\n'), "text")).otherwise(F.col("text")).alias("text"), (F.col("doc_id") % 2 == 0).alias("even"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"), F.array("source").alias("sources"))
    at = export.scratch(spark, "csv")
    export.write_csv(d, at, ["doc_id", "lang"])
    back = spark.read.csv(at, header=True, multiLine=True, escape='"').na.fill("")
    unmarked = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(at).where("substring(content, 1, 3) <> X'EFBBBF'").count()
    return back.toDF(*[c.lstrip("\ufeff") for c in back.columns]).withColumn("mark", F.lit(not unmarked))


def export_tables(spark, sf_dir):
    r = e.results(spark, sf_dir)
    at = export.scratch(spark, "run")
    tables = {"samples": e.samples(spark, sf_dir).drop("reference"), "errors": export.error_rows(r.withColumn("error", F.lit(None).cast("string"))).drop("reference", "prediction"), "tracks": r.groupBy("content_type", "model").agg(F.count(F.lit(1)).alias("n"))}
    export.export_run(tables, at)
    out = None
    for name in tables:
        n = spark.read.csv(f"{at}/{name}", header=True).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.union(n)
    return out


def utf16_pieces(spark, sf_dir):
    return export.overflow(_table(spark, sf_dir, "documents"), "doc_id", "text", 2000)


def sheet_cells(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.substr("text", F.lit(1), F.lit(20)), F.lit('\x01"end'))).otherwise(F.col("source")).alias("text"))
    return d.select("doc_id", export.cell(F.col("text")).alias("cell"))


def document_rows(spark, sf_dir):
    ev = _table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.struct("user_id").alias("by"), (F.col("event_id") % 2 == 0).alias("even")).alias("run"), F.array("user_id", "event_id").alias("ids"))).alias("document"))
    return export.document_rows(ev, "event_id", "document")


def list_summary(spark, sf_dir):
    o = _table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("k")).agg(F.sort_array(F.collect_list("c_custkey")).alias("ids"))
    return o.select("k", export.summarised(F.when(F.col("k") < 4, F.slice("ids", 1, 5)).otherwise(F.flatten(F.array_repeat(F.slice("ids", 1, 10), 101)))).alias("shown"))


def merged_metadata(spark, sf_dir):
    d, k = _table(spark, sf_dir, "documents"), F.col("doc_id")
    outer = {"split": F.when(k % 3 == 0, "test").when(k % 3 == 1, " "), "writer": F.when(k % 2 == 0, F.col("source"))}
    return d.select("doc_id", *export.merged(outer, {"split": F.lit("train"), "writer": F.when(k % 5 == 0, F.lit("w")), "lang": F.col("lang")}))


def html_table(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" <b>&\"'")).alias("n_name"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("region"))
    at = export.scratch(spark, "html")
    export.write_html(n, at, "nations")
    return spark.read.text(at).where(F.col("value").startswith("<tr>")).select(F.col("value").alias("html"))


def six_digits(spark, sf_dir):
    v = F.element_at(F.array(F.col("s_acctbal"), F.col("s_acctbal") * 1e6, F.col("s_acctbal") / 1e9, F.col("s_suppkey").cast("double"), F.col("s_suppkey") / 7, F.lit(0.0)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", export.six_digits(v).alias("shown"))


def snapshot_check(spark, sf_dir):
    s = e.samples(spark, sf_dir).withColumn("crop_path", F.concat(F.lit("/a/"), "sample_id"))
    at = export.scratch(spark, "snapshot")
    mark = runs.freeze(s, at)
    moved = runs.fingerprint(s.withColumn("crop_path", F.lit("/b")).orderBy(F.desc("sample_id"))).first()["fingerprint"]
    other = runs.fingerprint(s.withColumn("reference", F.upper("reference"))).first()["fingerprint"]
    return runs.snapshot(spark, at, mark).agg(F.count(F.lit(1)).alias("n"), F.lit(mark == moved).alias("moved_is_same"), F.lit(mark == other).alias("changed_is_same"))


def run_load(spark, sf_dir):
    s, r = e.samples(spark, sf_dir), e.results(spark, sf_dir)
    keep = ["model", "pass", "sample_id", "status", "prediction", "reference", "latency_seconds"]
    at = _written(spark, r.select(F.to_json(F.struct(*keep)).alias("value")), "run")
    _unended(spark, at, '{"model": "m_sub", "pass": 3, "sam')
    schema = "model string, pass int, sample_id long, status string, prediction string, reference string, latency_seconds double"
    got = runs.run(spark, at, s, e.models(spark), 3, schema, live=True)
    return _round(got.groupBy("model", "difficulty").agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("predicted"), F.avg("latency_seconds").alias("mean_latency")))


def source_plan(spark, sf_dir):
    m = _table(spark, sf_dir, "nation").select(F.lit("suite").alias("kind"), F.col("n_regionkey").alias("position"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("c"), "n_regionkey")).alias("condition"), F.when(F.col("n_regionkey") > 0, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + 100).alias("repetition"), F.col("n_name").alias("path"))
    return runs.source_plan(m)


def report_scan(spark, sf_dir):
    at = export.scratch(spark, "report")
    _table(spark, sf_dir, "region").select(F.to_json(F.struct(F.col("r_name").alias("title"), F.array(F.struct("r_regionkey")).alias("models")), {"pretty": "true"}).alias("value")).repartitionByRange(5, "value").write.text(at)
    return runs.report(spark, at, "title string, models array<struct<r_regionkey: int>>").select("title", F.get("models.r_regionkey", F.lit(0)).alias("key"))


def cache_lookup(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    cache = p.where("p_partkey % 3 = 0").select(F.md5("p_name").alias("key"), "p_name").groupBy("key").agg(F.min("p_name").alias("response"))
    return runs.cache_lookup(p.select("p_partkey", F.md5("p_name").alias("key")), cache).select("p_partkey", "response", "hit")


def cache_conflicts(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.col("p_partkey") % 500).alias("key"), (F.col("p_partkey") % 500 % 7 + F.when(F.col("p_partkey") % 999 == 0, 1).otherwise(0)).cast("string").alias("response"), "p_partkey")
    return runs.cache_conflicts(p.where("p_partkey < 300"), p.where("p_partkey >= 300"), "response")


def adapter_run(spark, sf_dir):
    model, factory, c = adapters.backend("test:plain")
    s = e.samples(spark, sf_dir).select("sample_id", F.when(F.col("sample_id") % 12 != 0, F.col("reference")).otherwise(F.lit(" ")).alias("image"), "reference", F.col("content_type").alias("track"), F.lit("line").alias("sample_type"))
    return adapters.run(s, model, factory, c).select("model", "sample_id", "status", "prediction", "error", F.col("latency_seconds").isNotNull().alias("timed"))


def _outcomes(events):
    kind = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "permanent").when(F.col("event_type") == "signup", "retryable").otherwise("wait")
    return events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("number"), kind.alias("outcome"))


def attempt_states(spark, sf_dir):
    log = attempts.log(spark, sf_dir)
    return machine.drained(machine.results(_outcomes(log)), export.scratch(spark, "machine"))


#: What a request reserves, and a ledger's limit, in millionths of a dollar.
AMOUNT, LIMIT = 50_000, 4_000_000


def reservation_ledger(spark, sf_dir):
    """Every event but clicks starts a request and finishes it within the hour; clicks never finish, and one error in fifty has no cost."""
    ev = _table(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("ledger"), "ts", "event_id", "event_type", "value")
    amount = F.lit(AMOUNT).cast("long") + F.col("event_id") % 7
    starts = ev.select("ledger", "ts", (F.col("event_id") * 2).alias("number"), F.col("event_id").alias("request"), F.lit("reserve").alias("kind"), amount.alias("amount"), F.lit(None).cast("long").alias("cost"))
    cost = F.when((F.col("event_type") == "error") & (F.col("event_id") % 50 == 7), F.lit(None)).otherwise(F.col("event_id") % 90_000)
    ends = ev.where("event_type <> 'click'").select("ledger", F.expr("timestampadd(second, int(event_id * 37 % 3600), ts)").alias("ts"), (F.col("event_id") * 2 + 1).alias("number"), F.col("event_id").alias("request"), F.lit("finish").alias("kind"), F.lit(None).cast("long").alias("amount"), cost.alias("cost"))
    events = starts.union(ends)
    strict.sound(events, ledger.findings(events), "ledger")
    return ledger.running(events, LIMIT, AMOUNT)


def token_timing(spark, sf_dir):
    """Ten events of the log are a response: a start, tokens, and an end that some lack; in some the first token is an error."""
    at = F.col("event_id") % 10
    request = F.expr("event_id div 10")
    kind = F.when(at == 0, "start").when((at == 1) & (request % 11 == 3), "error").when((at == 9) & (request % 7 != 0), "end").otherwise("token")
    log_ = attempts.log(spark, sf_dir).select(request.alias("key"), "ts", F.col("event_id").alias("number"), kind.alias("kind"))
    return ordered.drained(tokens.timing(log_), export.scratch(spark, "tokens")).drop("began")


def appended_log(spark, sf_dir):
    """The log appended by a query that runs twice; the second run finds nothing new."""
    path, checkpoint = export.scratch(spark, "appended"), export.scratch(spark, "checkpoint")
    records = attempts.log(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    attempts.append(records, path, checkpoint)
    attempts.append(records, path, checkpoint)
    return spark.read.schema(EVENT).json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("different"), F.sum("user_id").alias("users"))


def stream_dedup_repeats(spark, sf_dir):
    log = attempts.log(spark, sf_dir)
    both = log.union(log.where("event_id % 10 = 0"))
    return attempts.drained(attempts.once(both), "append", export.scratch(spark, "repeats")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("different"))


_LONG = "'l-' || s_suppkey"

QUERIES = {
    "log_repair": (log_repair, "select event_type, n + (event_type = 'click')::int as n, ids - (event_type = 'click')::int as ids, 1 as torn from (select event_type, count(*) as n, sum(event_id)::bigint as ids from events group by 1)"),
    "corrupt_lines": (corrupt_lines, """select case when n_nationkey % 7 = 3 then n_name when n_nationkey = 24 then '{"k": 2' else '{"k":' || n_nationkey || '}' end as value, case when n_nationkey = 24 or n_nationkey % 7 = 3 then 'corrupt' else 'whole' end as state from nation
        union all values ('{"k": 98}', 'whole'), ('', 'corrupt'), ('{"k": "word"}', 'corrupt'), ('{"k": 99', 'torn'), ('{"k": 97}', 'whole')"""),
    "log_ends": (log_ends, f"""with g as (select event_id // {FILE_EVENTS} as f, count(*) as n, sum(user_id)::bigint as u, arg_max(user_id, event_id) as v from events group by 1)
        select f, case f % 4 when 1 then 'unterminated' when 2 then 'torn' else 'committed' end as "end", n as lines, (f % 4 = 3)::bigint as corrupt,
        case f % 4 when 0 then n when 1 then n when 2 then nullif(n - 1, 0) end as repaired, case f % 4 when 0 then u when 1 then u when 2 then u - v end as repaired_users,
        case f % 4 when 0 then n when 1 then nullif(n - 1, 0) when 2 then nullif(n - 1, 0) end as live, case f % 4 when 0 then u when 1 then u - v when 2 then u - v end as live_users from g"""),
    "metadata_scan": (metadata_scan, "select c_name as sample_id, case when c_custkey % 2 = 0 then c_mktsegment end as content_type, case when c_custkey % 2 = 1 then 'test' end as split, case when c_custkey % 2 = 0 then c_mktsegment end as critical from customer"),
    "word_table_scan": (word_table_scan, "select distinct 'w-' || s_suppkey % 40 as id, 'word' || s_suppkey % 40 as text from supplier where s_suppkey % 10 <> 0 and s_suppkey % 3 <> 0"),
    "line_table_scan": (line_table_scan, f"select {_LONG} as id, case when s_suppkey % 2 = 0 then 'A ' || s_name else 'A MOVE ' || s_name end as text from supplier where s_suppkey % 5 <> 0 and s_suppkey % 11 <> 0"),
    "protocol_scan": (protocol_scan, f"select {_LONG} as id, case when s_suppkey % 4 = 0 then 'err' else 'ok' end as status, 'A MOVE ' || s_nationkey as text from supplier"),
    "id_list_scan": (id_list_scan, "select 'c-' || c_custkey as id from customer"),
    "paired_files": (paired_files, "select p_partkey % 3 || '/p' || p_partkey as stem, case when p_partkey % 5 <> 0 and p_partkey % 17 = 1 then 'ambiguous' when p_partkey % 5 = 0 and p_partkey % 17 <> 1 then 'missing_image' when p_partkey % 7 = 0 then 'missing_reference' end as finding from part where p_partkey % 5 <> 0 or p_partkey % 17 = 1 or p_partkey % 7 <> 0"),
    "layout_overlap": (layout_overlap, "with c as (select c_custkey as id from customer where c_custkey % 4 <> 3) select 'words' as name, count(*) as n from c where id % 3 = 0 union all select 'lines', count(*) from c where id % 2 = 0 union all select 'forms', count(*) from c where id % 2 = 1 or id % 100 = 0"),
    "import_findings": (import_findings, """with d as (select doc_id, doc_id % 40 as m from documents), ids as (select doc_id from documents) select case when m in (1, 10, 11) then 'not_json' when m = 2 then 'not_an_object' when m = 3 then 'unknown_field' when m = 4 then 'missing_sample_id' when m = 5 then 'unknown_sample'
        when m = 6 or (m = 0 and doc_id + 6 in (select doc_id from ids)) then 'duplicate_sample' when m in (7, 18) then 'missing_prediction' when m = 8 then 'unknown_status' when m in (9, 15) then 'bad_latency' when m = 12 then 'bad_usage' when m in (13, 14, 16) then 'bad_token_count' else 'none' end as finding, count(*) as n from d where m <> 17 group by 1"""),
    "import_predictions": (import_predictions, f"{P} select content_type, case when sample_id % 10 = 0 then 'missing' when sample_id % 9 = 0 then 'error' else 'success' end as status, count(*) as n, count(*) filter (sample_id % 10 <> 0 and sample_id % 9 <> 0 and not contains(reference, 'a')) as exact, (sum(3) filter (sample_id % 10 <> 0))::bigint as input_tokens from samples group by all"),
    "flat_records": (flat_records, f"{P} select model, pass, sample_id, status, sample_id % 10 as cer, true as exact from results where status = 'error'"),
    "error_rows": (error_rows, f"{P} select model, pass, sample_id, case when sample_id % 14 <> 0 then status end as status, case when sample_id % 21 = 0 then 'late' when sample_id % 22 = 0 then '' end as error from results where sample_id % 14 = 0 or status <> 'success' or sample_id % 21 = 0"),
    "csv_round_trip": (csv_round_trip, r"""with d as (select doc_id, case doc_id % 4 when 0 then '=' || text when 1 then 'a "b"' || chr(10) || text else text end as x, lang, source from documents) select doc_id::varchar as doc_id, case when doc_id % 3 = 0 then lang else '' end as lang, (doc_id % 2 = 0)::varchar as even, '["' || source || '"]' as sources,
        case when regexp_matches(x, '^\x{FEFF}?\s*[=+@-]') then '''' || x else coalesce(x, '') end as text, true as mark from d"""),
    "export_tables": (export_tables, f"{P} select 'samples' as \"table\", count(*) as n from samples union all select 'errors', count(*) from results where status <> 'success' union all select 'tracks', count(*) from (select distinct content_type, model from results)"),
    "utf16_pieces": (utf16_pieces, "select doc_id, i::integer as piece, substr(text, i * 2000 + 1, 2000) as text from (select doc_id, text, unnest(range(0, (length(text) + 1999) // 2000)) as i from documents where length(text) > 2000)"),
    "sheet_cells": (sheet_cells, r"""select doc_id, case when doc_id % 5 = 0 then 'json:"' || replace(replace(replace(replace(substr(text, 1, 20), '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '\u0001\"end"' else source end as cell from documents"""),
    "document_rows": (document_rows, """select event_id, x.path as path, x.value as value from (select event_id, unnest([{'path': 'ids', 'value': '[' || user_id || ',' || event_id || ']'}, {'path': 'kind', 'value': event_type}, {'path': 'run.by.user_id', 'value': user_id::varchar}, {'path': 'run.even', 'value': (event_id % 2 = 0)::varchar}]) as x from events)"""),
    "list_summary": (list_summary, """with o as (select c_nationkey % 5 as k, list(c_custkey order by c_custkey) as ids from customer group by 1), j as (select k, '[' || array_to_string(case when k < 4 then ids[1:5] else flatten(list_transform(range(101), lambda i: ids[1:10])) end, ',') || ']' as t, len(ids) as n from o)
        select k, case when k = 4 and n >= 10 then '{"items":1010,"sha256":"' || sha256(t) || '"}' else t end as shown from j"""),
    "merged_metadata": (merged_metadata, "select doc_id, lang, case when doc_id % 3 = 0 then 'test' else 'train' end as split, case when doc_id % 2 = 0 then source when doc_id % 5 = 0 then 'w' end as writer from documents"),
    "html_table": (html_table, "select '<tr><td>' || n_nationkey || '</td><td>' || n_name || ' &lt;b&gt;&amp;&quot;&#x27;</td><td>' || case when n_regionkey > 1 then n_regionkey::varchar else '' end || '</td></tr>' as html from nation"),
    "six_digits": (six_digits, "select s_suppkey, format('{:.6g}', case s_suppkey % 6 when 0 then s_acctbal when 1 then s_acctbal * 1e6 when 2 then s_acctbal / 1e9 when 3 then s_suppkey::double when 4 then s_suppkey / 7 else 0.0::double end) as shown from supplier"),
    "snapshot_check": (snapshot_check, f"{P} select count(*) as n, true as moved_is_same, bool_and(reference = upper(reference)) as changed_is_same from samples"),
    "run_load": (run_load, f"{P} select r.model, s.difficulty, count(*) as n, count(r.prediction) as predicted, round(avg(r.latency_seconds), 6) as mean_latency from results r join samples s using (sample_id) group by all"),
    "source_plan": (source_plan, "select n_regionkey as position, case when n_regionkey > 0 then 'c' || n_regionkey else 'baseline' end as condition, case when n_regionkey > 0 then n_nationkey else n_nationkey + 100 end as repetition, n_name as path from nation"),
    "report_scan": (report_scan, "select r_name as title, r_regionkey as key from region"),
    "cache_lookup": (cache_lookup, "with c as (select distinct p_name from part where p_partkey % 3 = 0) select p_partkey, c.p_name as response, c.p_name is not null as hit from part left join c using (p_name)"),
    "cache_conflicts": (cache_conflicts, "select 'k' || p_partkey % 500 as key from part group by 1 having count(distinct p_partkey % 500 % 7 + (p_partkey % 999 = 0)::int) > 1"),
    "adapter_run": (adapter_run, f"{P} select 'plain' as model, sample_id, case when content_type = 'equation' then 'unsupported' when sample_id % 12 = 0 then 'error' else 'success' end as status, case when content_type <> 'equation' and sample_id % 12 <> 0 then replace(reference, 'e', '3') end as prediction, case when content_type <> 'equation' and sample_id % 12 = 0 then 'ValueError: nothing to read' end as error, content_type <> 'equation' as timed from samples"),
    "attempt_states": (attempt_states, """with o as (select user_id as key, event_id as number, case event_type when 'purchase' then 'success' when 'error' then 'permanent' when 'signup' then 'retryable' else 'wait' end as o from events),
        c as (select *, sum((o <> 'wait')::int) over w as tries, sum((o = 'retryable')::int) over w as again, o in ('success', 'permanent') or (o = 'retryable' and sum((o <> 'wait')::int) over w > 2) as ends from o window w as (partition by key order by number)),
        f as (select key, min(number) as at from c where ends group by 1), l as (select key, max(number) as at from c group by 1), z as (select l.key, coalesce(f.at, l.at) as at from l left join f using (key))
        select z.key, case when c.ends and c.o = 'success' then 'success' when c.ends then 'error' when c.o = 'wait' then 'paused' else 'retrying' end as state, c.tries::integer as attempts, z.at from z join c on c.key = z.key and c.number = z.at"""),
    "reservation_ledger": (reservation_ledger, f"""with x as (select event_id // 100 as ledger, ts, event_id * 2 as number, 'reserve' as kind, {AMOUNT} + event_id % 7 as held, 0 as spent, 0 as unknown, 1 as open from events
            union all select event_id // 100, ts + to_seconds(event_id * 37 % 3600), event_id * 2 + 1, 'finish', -({AMOUNT} + event_id % 7), case when event_type = 'error' and event_id % 50 = 7 then 0 else event_id % 90000 end, (event_type = 'error' and event_id % 50 = 7)::int, -1 from events where event_type <> 'click'),
        s as (select ledger, number, kind, sum(spent) over w as spent, sum(held) over w as reserved, sum(unknown) over w as unknown, sum(open) over w as open from x window w as (partition by ledger order by ts, number))
        select ledger, number, kind, spent::bigint as spent, reserved::bigint as reserved, unknown::bigint as unknown, open::bigint as open, unknown = 0 and spent + reserved < {LIMIT} and spent + reserved + {AMOUNT} <= {LIMIT} as may_start from s"""),
    "token_timing": (token_timing, """with x as (select event_id // 10 as key, event_id % 10 as pos, epoch_us(ts) // 1000 as ms from events), g as (select key, max(ms) as last, max(ms) filter (pos = 0) as began, max(ms) filter (pos = 1) as first, max(ms) filter (pos = 9) as ended, count(*) as n from x group by 1),
        s as (select *, key % 11 = 3 as broke, last + 3600000 < (select max(ms) - 600000 from x) as silent from g)
        select key, case when broke then 'rejected' when key % 7 <> 0 then 'complete' when silent then 'rejected' else 'open' end as status, case when not broke then first - began end as first_ms, case when not broke and key % 7 <> 0 then ended - began end as total_ms, case when broke then 0 when key % 7 <> 0 then 8 else 9 end::bigint as tokens from s"""),
    "appended_log": (appended_log, "select event_type, count(*) as n, count(*) as different, sum(user_id)::bigint as users from events group by 1"),
    "stream_dedup_repeats": (stream_dedup_repeats, "select event_type, count(distinct event_id) as n, count(distinct event_id) as different from events group by 1"),
}
