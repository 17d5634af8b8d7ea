"""Folds over events in order: any cut into batches, any order within the watermark, and what leaves the store."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import ledger, running
from glyphmill.streaming import attempts, machine, ordered, tokens

BASE = datetime.datetime(2024, 1, 1)
ATTEMPT = "key long, ts timestamp, number long, outcome string"


def at(seconds):
    return BASE + datetime.timedelta(seconds=seconds)


def stream(spark, folder, batches, schema):
    """A batch for each list of rows."""
    (folder / "in").mkdir(parents=True)
    for i, rows in enumerate(batches):
        for part in spark.createDataFrame(rows, schema).coalesce(1)._jdf.toJSON().collectAsList():
            with open(folder / "in" / f"{i:03}.json", "a") as f:
                f.write(part + "\n")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))


def states(rows):
    return sorted(tuple(r) for r in rows.select("key", "state", "attempts", "at").collect())


def test_steps():
    walk = lambda *outcomes: machine._advance(machine.START, enumerate(outcomes))
    assert walk("retryable", "success", "permanent") == ("success", 2, 1)
    assert walk("retryable", "retryable", "retryable", "success") == ("error", 3, 2)
    assert walk("wait") == ("paused", 0, 0) and walk("wait", "permanent") == ("error", 1, 1)


def test_states_do_not_depend_on_batches(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(8), at(i * 10), i, r.choice(["retryable", "wait", "retryable", "success", "permanent"])) for i in range(60)]
    rows += [(9, at(5), 5, "success"), (9, at(1), 1, "permanent")]
    want = states(machine.results(spark.createDataFrame(rows, ATTEMPT)))
    assert dict((w[0], w[1:]) for w in want)[9] == ("error", 1, 1)
    for cut in (1, 4):
        order = sorted(rows, key=lambda x: (x[1] - BASE).total_seconds() + r.randrange(250))  # out of order by less than 300 s
        batches = [order[i * len(order) // cut : (i + 1) * len(order) // cut] for i in range(cut)]
        batches[-1] = batches[-1] + batches[-1][:2]  # repeats
        got = ordered.drained(machine.results(stream(spark, tmp_path / str(cut), batches, ATTEMPT), late="300 seconds"), str(tmp_path / f"out{cut}"))
        assert states(got) == want


def test_keys_of_a_group(spark, tmp_path, monkeypatch):
    """Many keys share a value of the store and a timer; large ids stay whole beside a null one."""
    monkeypatch.setattr(ordered, "GROUPS", 1)
    r = random.Random(2)
    keys = [None, *(2**60 + i for i in range(5))]
    rows = [(r.choice(keys), at(i * 10), i, r.choice(["retryable", "wait", "wait", "success"])) for i in range(60)]
    got = ordered.drained(machine.results(stream(spark, tmp_path, [rows[:20], rows[20:40], rows[40:]], ATTEMPT), late="60 seconds"), str(tmp_path / "out"))
    want = []
    for k in keys:
        want.append((k, *machine._advance(machine.START, [(n, o) for x, _, n, o in rows if x == k])))
    assert sorted(map(repr, (tuple(x) for x in got.select("key", "state", "attempts", "at").collect()))) == sorted(map(repr, want))


def test_finished_keys_leave_the_store(spark, tmp_path):
    """What comes after a key was forgotten starts anew; what comes while it is known changes nothing."""
    batches = [[(1, at(0), 0, "success"), (2, at(0), 1, "success")], [(3, at(50), 2, "wait")], [(2, at(60), 3, "permanent")], [(3, at(1000), 4, "wait")], [(3, at(1001), 5, "wait")], [(1, at(1002), 6, "permanent")]]
    got = ordered.drained(machine.results(stream(spark, tmp_path, batches, ATTEMPT), late="10 seconds", keep=100), str(tmp_path / "out"))
    assert states(got) == [(1, "error", 1, 6), (2, "success", 1, 1), (3, "paused", 0, 5)]


EVENT = "ledger long, ts timestamp, number long, request long, kind string, amount long, cost long"
EVENTS = [
    (1, at(0), 0, 10, "reserve", 60, None), (1, at(1), 1, 11, "reserve", 30, None), (1, at(2), 2, 10, "finish", None, 20), (1, at(3), 3, 11, "finish", None, 35),
    (1, at(4), 4, 12, "reserve", 40, None), (1, at(5), 5, 12, "finish", None, None), (2, at(0), 6, 13, "reserve", 99, None), (2, at(0), 7, 14, "reserve", 1, None),
]


@pytest.mark.parametrize("small", [100, 1])
def test_ledger(spark, monkeypatch, small):
    monkeypatch.setattr(running, "SMALL", small)
    got = {r.number: (r.spent, r.reserved, r.unknown, r.open, r.may_start) for r in ledger.running(spark.createDataFrame(EVENTS, EVENT), 100, 10).collect()}
    assert got == {
        0: (0, 60, 0, 1, True), 1: (0, 90, 0, 2, True), 2: (20, 30, 0, 1, True), 3: (55, 0, 0, 0, True), 4: (55, 40, 0, 1, False), 5: (55, 0, 1, 0, False),
        6: (0, 99, 0, 1, False), 7: (0, 100, 0, 2, False),
    }
    assert ledger.running(spark.createDataFrame([], EVENT), 100, 10).count() == 0


def test_ledger_findings(spark):
    bad = [*EVENTS, (3, at(0), 8, 20, "finish", None, 1), (3, at(1), 9, 21, "reserve", 1, None), (3, at(0), 10, 21, "finish", None, 1), (3, at(0), 11, 22, "reserve", 1, None), (3, at(0), 12, 22, "reserve", 1, None), (3, at(0), 13, 23, "reserve", 1, None), (3, at(1), 14, 23, "finish", None, 1), (3, at(2), 15, 23, "finish", None, 1)]
    assert ledger.findings(spark.createDataFrame(EVENTS, EVENT)).count() == 0
    assert {(r.request, r.finding) for r in ledger.findings(spark.createDataFrame(bad, EVENT)).collect()} == {(20, "never_reserved"), (21, "finished_before"), (22, "reserved_twice"), (23, "finished_twice")}


def test_ledger_as_a_stream(spark, tmp_path):
    held = {e[3]: e[5] for e in EVENTS if e[4] == "reserve"}
    rows = [(e[0], e[1], e[2], e[4], held[e[3]], e[6]) for e in EVENTS]
    schema = "key long, ts timestamp, number long, kind string, amount long, cost long"
    fold = ordered.Fold(ledger.START, ledger.step, lambda s: False, ledger.STATE, [("kind", "string"), ("amount", "long"), ("cost", "long")], 10**9)
    events = stream(spark, tmp_path, [rows[3:], rows[:3]], schema)
    got = ordered.drained(ordered.folded(events, fold, ledger.STATE, "60 seconds"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.select("key", "spent", "reserved", "unknown", "open").collect()) == [(1, 55, 0, 1, 0), (2, 0, 100, 0, 2)]


TOKENS = "key long, ts timestamp, number long, kind string"


def test_token_streams(spark, tmp_path):
    """Late tokens and ends, missing ends, errors, ends without output, and a response that is still open."""
    first = [(1, at(0), 0, "start"), (1, at(4), 2, "token"), (1, at(9), 3, "end"), (2, at(0), 4, "start"), (2, at(1), 5, "token"), (3, at(2), 6, "start"), (3, at(3), 7, "error"), (4, at(0), 8, "start"), (4, at(5), 9, "end"), (6, at(1), 12, "token")]
    second = [(1, at(1), 1, "token"), (3, at(4), 10, "token"), (5, at(400), 11, "start"), (5, at(401), 13, "token")]
    got = ordered.drained(tokens.timing(stream(spark, tmp_path, [first, second], TOKENS), patience=60, late="30 seconds"), str(tmp_path / "out"))
    rows = {r.key: (r.status, r.first_ms, r.total_ms, r.tokens) for r in got.collect()}
    assert rows == {1: ("complete", 1000, 9000, 2), 2: ("rejected", 1000, None, 1), 3: ("rejected", None, None, 0), 4: ("rejected", None, 5000, 0), 5: ("open", 1000, None, 1), 6: ("rejected", None, None, 0)}


def test_an_append_that_is_cut_off_repeats_nothing(spark, tmp_path):
    """Killed after its files were written and before the batch was committed; killed before the sink named them."""
    source = stream(spark, tmp_path, [[(1, at(0), 0, "a")], [(2, at(1), 1, "b")]], TOKENS)
    log, checkpoint = tmp_path / "log", tmp_path / "checkpoint"
    attempts.append(source, str(log), str(checkpoint))
    for f in (checkpoint / "commits").glob("*1*"):  # 1 and .1.crc
        f.unlink()
    attempts.append(source, str(log), str(checkpoint))
    read = lambda: sorted(r.key for r in spark.read.json(str(log)).collect())
    assert read() == [1, 2]
    for f in [*(checkpoint / "commits").glob("*1*"), *(log / "_spark_metadata").glob("*1*")]:
        f.unlink()
    attempts.append(source, str(log), str(checkpoint))
    assert read() == [1, 2] and len(list(log.glob("*.json"))) > 2


def test_windows_leave_the_store(spark, tmp_path):
    """Windows behind the watermark take no more events, and what they had stays the result."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    row = lambda i, seconds, value: (i, at(seconds), 1, "error" if i == 2 else "view", value, None)
    events = stream(spark, tmp_path, [[row(1, 0, 1.0), row(2, 60, 3.0)], [row(3, 20_000, 5.0)], [row(5, 20_100, 7.0)], [row(4, 100, 7.0)]], schema)
    got = ordered.drained(attempts.windows(events), str(tmp_path / "out"), ("start",))
    assert sorted((r.n, r.errors, r.mean_latency) for r in got.collect()) == [(2, 0, 6.0), (2, 1, 2.0)]
