"""Quality rules: a threshold table compiled into one projection of ratios, without user functions.

Every text is measured whole by built-in functions inside a single projection: no shuffle, no Python. A rule
bounds the ratio of two measures; all rules become one boolean column, in integer arithmetic.

Defined results: a null or empty text has no words, so base_failed is true and kept false. Repeated rows and
rows with a null doc_id are judged like any other; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import GAP, let, table

#: Words in a window that counts as a repeat when found twice or more in a text.
WINDOW = 8

#: Frequent words of English, French, German and Spanish, counted as written here or with a capital.
STOP_WORDS = (
    "the of and to in a is that it for was on are with as be by at or an this from have not but they his her "
    "le la les de des du et en un une est que qui dans pour sur par pas au aux avec ce se il elle "
    "der die das und von zu den mit ist im dem ein eine auf für nicht sich auch als es an "
    "el los las y que del por con para una su al lo como más pero sus o no se"
).split()
_STOP = sorted({w for x in STOP_WORDS for w in (x, x.capitalize())})


@dataclass(frozen=True)
class Rule:
    """Holds where low * whole <= 100 * part <= high * whole; a bound of None is open."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def column(self, m: Column) -> Column:
        part, whole = F.lit(100) * m[self.part], m[self.whole]
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (part >= F.lit(self.low) * whole)
        if self.high is not None:
            ok = ok & (part <= F.lit(self.high) * whole)
        return ok

    def sql(self) -> str:
        ends = [f"100 * {self.part} >= {self.low} * {self.whole}"] * (self.low is not None) + [f"100 * {self.part} <= {self.high} * {self.whole}"] * (self.high is not None)
        return " and ".join(ends) or "true"


#: The production table. Bounds are per cent.
RULES = (
    Rule("word length", "word_chars", "n_words", 200, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 30),
    Rule("stop words", "n_stop_words", "n_words", 2, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 40),
)


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice."""

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), covered)
        )

    def covered(ordered: Column) -> Column:
        same = lambda s, j: F.coalesce(F.get(ordered, j)["w"] == s["w"], F.lit(False))
        repeated = F.filter(ordered, lambda s, j: F.coalesce((j > 0) & same(s, F.greatest(j - 1, F.lit(0))), F.lit(False)) | same(s, j + 1))
        starts = F.sort_array(F.transform(repeated, lambda s: s["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(starts, start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")), lambda a: a["total"])

    def longer(spans: Column, step: int) -> Column:
        """Hashes of spans twice as long, from those of adjacent spans."""
        ahead = F.slice(spans, step + 1, F.greatest(F.size(spans) - step, F.lit(0)))
        return F.zip_with(F.slice(spans, 1, F.greatest(F.size(spans) - step, F.lit(0))), ahead, lambda x, y: F.xxhash64(x, y))

    windows = let(longer(hashes, 1), lambda two: let(longer(two, 2), lambda four: longer(four, 4)))
    return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(let(windows, counted))


def measures(text: Column) -> Column:
    """A struct of all measures of a whole text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    chars = lambda unwanted: F.char_length(text) - F.char_length(F.regexp_replace(text, unwanted, ""))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: x.isin(_STOP))).cast("long").alias("n_stop_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        chars(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"]


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the measures, base_failed, kept and the names of failed rules.

    The measures are bound before they are compared: a filter on the verdict computes them once.
    """

    def judged_(m: Column) -> Column:
        flat = {c: m["w"][c] for c in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")} | {c: m["l"][c] for c in ("n_lines", "n_dup_lines")} | {"n_symbols": m["n_symbols"]}
        return let(F.struct(*[flat[c].alias(c) for c in MEASURES]), with_rules)

    def with_rules(m: Column) -> Column:
        failed = (m["n_words"] < 20) | (F.lit(100) * m["n_repeat_words"] > F.lit(30) * m["n_words"])
        names = F.array_compact(F.array(*[F.when(~r.column(m), F.lit(r.name)) for r in rules]))
        kept = ~failed & (F.size(names) == 0)
        return F.struct(*[m[c].alias(c) for c in MEASURES], failed.alias("base_failed"), kept.alias("kept"), names.alias("failed_rules"))

    return let(measures(text), judged_)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, kept and failed_rules."""
    return docs.select("doc_id", verdict(F.col("text"), rules).alias("v")).select("doc_id", "v.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; their columns as they were."""
    return docs.select("doc_id", "text", "lang", "source", "n_chars").where(verdict(F.col("text"))["kept"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("failed_rules")


_SPLIT = r"[ \t\n\x0B\f\r]+"

SQL = f"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select k, doc_id, text, list_filter(regexp_split_to_array(text, '{_SPLIT}'), lambda x: x <> '') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) as lines from d),
g as (select k, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as g
      from (select k, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from w)),
r as (select k, i from (select k, i, count(*) over (partition by k, g) as n from g) where n > 1),
c as (select k, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) as n_repeat_words
      from (select k, i, lead(i) over (partition by k order by i) as nxt from r) group by k),
m as (select w.doc_id, len(words)::bigint as n_words,
        length(regexp_replace(text, '{_SPLIT}', '', 'g'))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
        len(list_filter(words, lambda x: list_contains([{", ".join("'" + s + "'" for s in _STOP)}], x)))::bigint as n_stop_words
      from w left join c using (k)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select *, not base_failed and {" and ".join(f"({r.sql()})" for r in RULES)} as kept from b
"""
