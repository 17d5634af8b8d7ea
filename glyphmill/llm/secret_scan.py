"""Secret scans: pattern rules, and character Markov models of random strings against ordinary identifiers.

Everything is built-in functions. Texts are scanned whole, each in its own row, with no shuffle of texts. The
models are first-order: bigram counts of labelled samples give the log-likelihood ratio of each character given
the one before it. The samples are random strings made by rule and words of a bounded sample of documents, and
what comes to the driver is one table of at most 95 x 95 counts for each label.

Defined results: null and empty texts have no span; repeated rows are scanned each for itself; an empty table
gives an empty result, scored by the rule-made samples alone. Texts of any length are scanned in time in proportion
to their length, but for the ends of matches, which take the root of their count each. A score equal to the threshold
is a secret. Only doc_id and text are read; columns of other names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import GAP, let, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, and the condition on a match.
BASE = (
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: F.length(m) >= 32),
)
#: Short runs of hex digits are in every word; only a text with a long one is taken apart.
PROBE = {"hex": r"[0-9a-f]{32}"}
#: What the models are asked about: runs of identifier characters, with or without a digit.
CANDIDATE = r"[A-Za-z0-9_+/=-]{8,}"
#: Words left out of the ordinary sample: those with such a run that holds a digit.
SUSPECT = r"[A-Za-z0-9_+/=-]{20,}"
KINDS = [k for k, *_ in BASE] + ["markov"]
#: Mean log-likelihood ratio per character, in nats, above which a candidate is a secret.
THRESHOLD = 0.75
#: Steps of a candidate that make the evidence whole: a shorter one must reach the sum that these reach at the threshold.
STEPS = 19
#: Documents whose words are the sample of ordinary identifiers, about as many; random strings of the other sample.
SAMPLE_DOCS, SAMPLE_RANDOM = 2000, 6000
#: Printable ASCII.
FIRST, SIZE = 32, 95


def _found(text: Column, kind: int, pattern: str) -> Column:
    """Array of (start, kind, end, match) of the leftmost non-overlapping matches, in code points."""

    def placed(gaps: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.transform(m, lambda x, i: F.char_length(x) + F.char_length(F.get(gaps, i))), lambda steps: located(gaps, m, steps)))

    def located(gaps: Column, m: Column, steps: Column) -> Column:
        # Sums over blocks of about the root of the count: the end of a match without a pass over all before it.
        width = F.ceil(F.sqrt(F.size(steps))).cast("int")
        total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        blocks = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, width), lambda b: total(F.slice(steps, b + 1, width)))
        return let(
            F.struct(width.alias("n"), blocks.alias("b")),
            lambda s: F.transform(
                m,
                lambda x, i: let(
                    total(F.slice(s["b"], F.lit(1), F.floor(i / s["n"]).cast("int"))) + total(F.slice(steps, i - i % s["n"] + 1, i % s["n"] + 1)),
                    lambda end: F.struct((end - F.char_length(x)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("match")),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    return F.when(text.rlike(PROBE.get(KINDS[kind], pattern)), let(F.split(text, pattern, -1), placed)).otherwise(none)


def _passing(text: Column, kind: int) -> Column:
    _, pattern, holds = BASE[kind]
    return F.filter(_found(text, kind, pattern), lambda s: holds(s["match"]))


def samples(docs: DataFrame) -> DataFrame:
    """Labelled samples: value, random. Ordinary ones are words of about SAMPLE_DOCS documents, as they are and, up to 64 characters, in capitals and joined by capitals, but for long runs with a digit."""
    n = docs.count()
    words = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n // SAMPLE_DOCS))) == 0).select(F.explode(F.array_distinct(F.split("text", GAP))).alias("value"))
    suspect = F.exists(F.regexp_extract_all("value", F.lit(SUSPECT), F.lit(0)), lambda x: x.rlike("[0-9]"))
    for kind_, pattern, _ in BASE:
        suspect = suspect | F.col("value").rlike(PROBE.get(kind_, pattern))
    named = words.where((F.length("value") >= 4) & ~suspect).select(F.explode(F.when(F.length("value") <= 64, F.array("value", F.upper("value"), F.repeat(F.initcap("value"), 2))).otherwise(F.array("value"))).alias("value"), F.lit(False).alias("random"))
    digest = docs.sparkSession.range(SAMPLE_RANDOM).select(F.sha2(F.col("id").cast("string"), 256).alias("x"), "id")
    kind = F.pmod(F.col("id"), F.lit(3))
    code = F.base64(F.unhex("x"))
    value = F.when(kind == 0, F.substr("x", F.lit(1), F.lit(40))).when(kind == 1, code).otherwise(F.regexp_replace(F.upper(code), "[^A-Z0-9]", ""))
    return named.unionByName(digest.select(value.alias("value"), F.lit(True).alias("random")))


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character (column) after each (row): random strings over ordinary identifiers."""
    codes = F.filter(F.transform(F.split("value", ""), lambda c: F.ascii(c) - FIRST), lambda c: (c >= 0) & (c < SIZE))
    pairs = samples(docs).select("random", codes.alias("c")).select("random", F.explode(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: a * SIZE + b)).alias("pair"))
    count = {False: [0.5] * SIZE * SIZE, True: [0.5] * SIZE * SIZE}
    for r in pairs.groupBy("random", "pair").count().collect():  # at most 2 x 95 x 95 rows
        count[r["random"]][r["pair"]] += r["count"]
    out = []
    for a in range(SIZE):
        row = {k: v[a * SIZE : (a + 1) * SIZE] for k, v in count.items()}
        whole = {k: sum(v) for k, v in row.items()}
        out += [math.log(row[True][b] / whole[True]) - math.log(row[False][b] / whole[False]) for b in range(SIZE)]
    return out


def _score(value: Column, model: Column) -> Column:
    """Log-likelihood ratio of a candidate by its steps, or by STEPS if it has fewer."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - FIRST)
    total = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: acc + F.get(model, F.get(c, i - 1) * SIZE + F.get(c, i))) / F.greatest(F.size(c) - 1, F.lit(STEPS))
    return let(codes, total)


def scanned(docs: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Columns in ``keep`` (doc_id by default), ``base`` and ``spans``: arrays of (start, kind, end) by start, then kind."""
    keep = ["doc_id"] if keep is None else keep
    docs = docs.select(*keep, *([] if "text" in keep else ["text"]))
    model = F.split(F.lit(",".join(f"{x:.4f}" for x in train(docs.select(*dict.fromkeys(["doc_id", "text"]))))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = F.sort_array(F.concat(*[bare(_passing(text, i)) for i in range(len(BASE))]))
    # The model is bound once for a row, also where Spark evaluates a local table before it folds constants.
    more = let(model, lambda m: F.filter(_found(text, len(BASE), CANDIDATE), lambda s: _score(s["match"], m) >= threshold))
    found = docs.select(*keep, base.alias("base"), more.alias("more"))
    free = F.filter(F.col("more"), lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select(*keep, "base", F.sort_array(F.concat("base", bare(free))).alias("spans"))


def _of(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each union of overlapping spans replaced by ``mark``."""

    def merged(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(a: Column, x: Column) -> Column:
            inside = x["start"] < a["at"]
            piece = F.when(inside, F.array().cast("array<string>")).otherwise(F.array(F.substr(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark)))
            return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["parts"], piece).alias("parts"))

        return F.aggregate(s, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["at"] + 1, F.char_length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, merged))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and n_chars counted anew where that changed the text."""
    out = scanned(docs, ["doc_id", "text", "lang", "source", "n_chars"])
    text = redacted(F.col("text"), F.col("spans"))
    out = out.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(text).alias("text"), "lang", "source", "n_chars", (F.size("spans") > 0).alias("changed"))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("changed"), F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
