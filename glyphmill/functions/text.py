"""Text measures as columns: normal forms, edit distances and flags.

All but NFC and edits between texts (counts, breakdown, alignment) are built-in expressions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Hashable, Iterator, Sequence
from functools import cache, lru_cache
from itertools import compress, repeat, starmap
from operator import contains, ne

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All white space of Unicode, with the separators that programming languages count.
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x0b]+"
NOT_SPACE = r"[^\s\p{Z}\x{85}\x{1c}-\x{1f}\x0b]"
#: Edit alignments are left out beyond this many cells.
MAX_CELLS = 250_000
STRIDE = 256
#: What gives a transcript away as commentary.
COMMENTARY = (
    r"```",
    r"(?i)(?:\bhere(?:'s| is) (?:the )?(?:transcription|text)\b|\btranscription\s*:)",
    r"(?i)\bthe image (?:shows|contains|depicts)\b",
    r"(?i)\bthe handwriting (?:says|reads)\b",
    r"(?i)\b(?:i think|i can see|it appears to be)\b",
)
REPEATED = r"(?:^| )(\S+)(?: \1){2}(?= |$)|(?:^| )(\S+(?: \S+){1,6}) \2(?= |$)"


def normalize_text(text: Column) -> Column:
    """White space collapsed and trimmed; case and punctuation stay."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def has_text(text: Column) -> Column:
    """Whether the normal form isn't empty, known at the first character that isn't white space."""
    return text.rlike(NOT_SPACE)


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has none, so texts go through Arrow, in batches."""
    return _nfc(text)


def normalize_equation(text: Column) -> Column:
    return normalize_text(nfc(text))


def normalize_content(text: Column, composed: bool = False) -> Column:
    """Letters, digits and symbols alone: no white space, no punctuation. ``composed`` says that text is in NFC."""
    return F.regexp_replace(text if composed else nfc(text), r"[\p{P}\s\p{Z}\x{85}\x{1c}-\x{1f}\x0b]", "")


def words(text: Column) -> Column:
    return F.filter(F.split(normalize_text(text), " "), lambda w: w != "")


#: Distances up to which a band around the diagonal is tried, one after another, before the whole table.
BANDS = (32, 256)


def _or_else(whole: Column) -> Callable[[Column], Column]:
    return lambda d: F.when(d >= 0, d).otherwise(whole)


def distance(left: Column, right: Column) -> Column:
    """Levenshtein distance, in time with the distance where that is small beside the texts."""
    out = F.levenshtein(left, right)
    for band in reversed(BANDS):
        found = F.array(F.levenshtein(left, right, band))
        out = F.get(F.transform(found, _or_else(out)), F.lit(0))
    return out


SIZES = ("reference_chars", "reference_words")
COUNTS = ("char_edits", "word_edits", *SIZES)


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in SIZES]))
def sizes(text: pd.Series) -> pd.DataFrame:
    """Characters and words of a text's normal form; null where it is."""
    return pd.DataFrame(list(map(_size, text)), columns=SIZES).astype("Int64")


@F.pandas_udf(T.StructType([*[T.StructField(n, T.LongType()) for n in COUNTS], T.StructField("exact_match", T.BooleanType())]))
def edits(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """Levenshtein distances of texts' normal forms by characters and by words, sizes of the reference, and whether they are equal; null where a text is.

    Python's white space is that of SPACE, so words split here are those of ``normalize_text``, which costs several times as much.
    Equal pairs of a batch are measured once.
    """
    found = list(starmap(cache(_counts), zip(reference, prediction, strict=True)))
    return pd.DataFrame(found, columns=[*COUNTS, "exact_match"]).astype(dict.fromkeys(COUNTS, "Int64") | {"exact_match": "boolean"})


@F.pandas_udf(T.LongType())
def raw_edits(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    """Levenshtein distance of texts as they are."""
    return pd.Series([None if r is None or p is None else edit_distance(r, p) for r, p in zip(reference, prediction, strict=True)], dtype="Int64")


def score(prediction: Column, reference: Column, raw: bool = True) -> Column:
    """Struct of cer, wer, exact_match and the counts behind them, raw_cer if asked; null where the reference is empty.

    The counts are bound before they are used, so that each is computed once.
    """
    d = edits(reference, prediction)
    known = F.struct(*[d[c].alias(c) for c in (*COUNTS, "exact_match")], *([raw_edits(reference, prediction).cast("double").alias("raw")] if raw else []))

    def rates(k: Column) -> Column:
        return F.struct(
            F.try_divide(k["char_edits"].cast("double"), k["reference_chars"]).alias("cer"),
            F.try_divide(k["word_edits"].cast("double"), k["reference_words"]).alias("wer"),
            *[k[c].alias(c) for c in ("exact_match", "char_edits", "word_edits", "reference_chars", "reference_words")],
            *([F.try_divide(k["raw"], F.char_length(reference)).alias("raw_cer")] if raw else []),
        )

    return F.get(F.transform(F.when(d["reference_chars"] > 0, F.array(known)), rates), F.lit(0))


def _same_end(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """How many elements at the end are the same: halves are compared whole."""
    least, most = 0, min(len(a), len(b))
    while least < most:
        half = (least + most + 1) // 2
        if a[len(a) - half : len(a) - least] == b[len(b) - half : len(b) - least]:
            least = half
        else:
            most = half - 1
    return least


def _replaced(a: Sequence[Hashable], b: Sequence[Hashable]) -> int | None:
    """The distance, if it is the number of places that differ; None where another alignment may cost less.

    No alignment can be cheaper if no element of the differing places is on both sides: each has to go.
    """
    if len(a) != len(b):
        return None
    if isinstance(a, str) and isinstance(b, str):
        x, y = (np.frombuffer(c.encode("utf-32-le", "surrogatepass"), np.uint32) for c in (a, b))
        apart = x != y
        return int(np.count_nonzero(apart)) if set(x[apart].tolist()).isdisjoint(y[apart].tolist()) else None
    differing = list(map(ne, a, b))
    return sum(differing) if set(compress(a, differing)).isdisjoint(compress(b, differing)) else None


def _left_out(long: Sequence[Hashable], short: Sequence[Hashable]) -> bool:
    """Whether short is long with some elements left out."""
    return all(map(contains, repeat(iter(long)), short))


Bits = tuple[int, int, int]


def _rows(a: Sequence[Hashable], at: dict[Hashable, int], size: int, row: Bits) -> Iterator[Bits]:
    """The cost rows after ``row``, one for each element of a, a bit for each place of the other sequence (``at``).

    Myers' bit vectors: where the cost is that of the place before in the row before, where it rises by one from the
    place before in the row, and where it falls.
    """
    full, (_, up, down) = (1 << size) - 1, row
    for x in a:
        m = at.get(x, 0)
        same = ((((m & up) + up) ^ up) | m | down) & full
        rise = (down | (full ^ (same | up))) << 1 | 1
        down, up = rise & same & full, ((same & up) << 1 | (full & ~(same | rise))) & full
        yield same, up, down


def _places(b: Sequence[Hashable]) -> dict[Hashable, int]:
    at: dict[Hashable, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    return at


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Levenshtein distance of two texts or lists. Pairs that differ by replacements alone, or by parts left out, need no table."""
    if a == b:
        return 0
    known = _replaced(a, b)
    if known is not None:
        return known
    end = _same_end(a, b)
    a, b = a[: len(a) - end], b[: len(b) - end]
    start = _same_end(a[::-1], b[::-1])
    a, b = a[start:], b[start:]
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b) and _left_out(a, b):
        return len(a) - len(b)
    row = (0, (1 << len(b)) - 1, 0)
    for row in _rows(a, _places(b), len(b), row):  # noqa: B007
        pass
    return len(a) + row[1].bit_count() - row[2].bit_count()


def _one_sided(long: Sequence[Hashable], short: Sequence[Hashable], letter: str) -> str | None:
    """Steps from the end where short is long with some elements left out; None where it isn't."""
    out, j = [], len(short)
    for x in reversed(long):
        if j and short[j - 1] == x:
            out.append("=")
            j -= 1
        else:
            out.append(letter)
    return None if j else "".join(out)


@lru_cache(maxsize=4)
def _normal(text: str) -> tuple[list[str], str, int, int]:
    """Words of a text, its normal form and the sizes of both. The last few are kept: results of a sample lie side by side and share the reference."""
    words = text.split()
    form = " ".join(words)
    return words, form, len(form), len(words)


def _size(text: str | None) -> tuple[int | None, int | None]:
    """Characters and words of a text's normal form."""
    return (None, None) if text is None else _normal(text)[2:]


def _counts(reference: str | None, prediction: str | None) -> tuple[int | None, ...]:
    """The COUNTS of two texts and whether their normal forms are equal.

    Where one's words are the other's with some left out, so are its characters: neither distance can be under the difference in length.
    """
    if reference is None:
        return (None,) * 5
    a, left, *size = _normal(reference)
    if prediction is None:
        return None, None, *size, None
    b, right, chars, n = _normal(prediction)
    if left == right:
        return 0, 0, *size, True
    if len(a) != n and _left_out(*((a, b) if len(a) > n else (b, a))):
        return abs(size[0] - chars), abs(size[1] - n), *size, False
    return edit_distance(left, right), edit_distance(a, b), *size, False


def edit_steps(reference: str, prediction: str) -> str:
    """One letter a step of a least-cost alignment: = equal, s substituted, d deleted, i inserted.

    Among equal costs a diagonal step goes before a deletion, that before an insertion. The same end, pairs that differ
    by replacements alone and those that differ by parts left out have such steps without a table: equal elements are
    always a diagonal step, and where all that is left out is on one side, no other step fits the cost. Else cost rows
    are kept at every STRIDE and made again in between on the way back, so memory grows with one text, not with both.
    """
    end = _same_end(reference, prediction)
    a, b = reference[: len(reference) - end], prediction[: len(prediction) - end]
    if _replaced(a, b) is not None:
        return "".join(["=" if x == y else "s" for x, y in zip(a, b, strict=True)]) + "=" * end
    known = _one_sided(a, b, "d") if len(a) > len(b) else _one_sided(b, a, "i") if len(b) > len(a) else None
    if known is not None:
        return known[::-1] + "=" * end
    at, kept = _places(b), {0: (0, (1 << len(b)) - 1, 0)}
    for i, row in enumerate(_rows(a, at, len(b), kept[0]), 1):
        if i % STRIDE == 0:
            kept[i] = row
    out, i, j = ["=" * end], len(a), len(b)
    while i and j:
        base = (i - 1) // STRIDE * STRIDE
        block = [kept[base], *_rows(a[base:i], at, len(b), kept[base])]
        while i > base and j:
            if a[i - 1] == b[j - 1]:
                out.append("=")
                i, j = i - 1, j - 1
            elif not block[i - base][0] >> (j - 1) & 1:
                out.append("s")
                i, j = i - 1, j - 1
            elif block[i - base - 1][2] >> (j - 1) & 1:
                out.append("d")
                i -= 1
            else:
                out.append("i")
                j -= 1
    out += ["d" * i, "i" * j]
    return "".join(out[::-1])


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("substitutions", "deletions", "insertions")]))
def edit_breakdown(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """Edits by kind between normalised texts."""
    found = [(None, None, None) if r is None or p is None else (0, 0, 0) if r == p else tuple(map(edit_steps(r, p).count, "sdi")) for r, p in zip(reference, prediction, strict=True)]
    return pd.DataFrame(found, columns=["substitutions", "deletions", "insertions"]).astype("Int64")


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("status", "steps")]))
def edit_alignment(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """Steps of a least-cost alignment; left out beyond MAX_CELLS, which bounds the view and not the score."""

    def one(r: str | None, p: str | None) -> tuple[str | None, str | None]:
        if r is None or p is None:
            return None, None
        if (len(r) + 1) * (len(p) + 1) > MAX_CELLS:
            return "omitted_cell_limit", None
        return "available", edit_steps(r, p)

    return pd.DataFrame([one(r, p) for r, p in zip(reference, prediction, strict=True)], columns=["status", "steps"])


def has_repeated_text(text: Column) -> Column:
    """One word three times, or two to seven words twice, in a row."""
    return normalize_text(text).rlike(REPEATED)


def has_commentary(text: Column) -> Column:
    out = F.lit(False)
    for pattern in COMMENTARY:
        out = out | text.rlike(pattern)
    return out


def flags(prediction: Column, truncated: Column) -> Column:
    """Names of what a reviewer should look at."""
    return F.array_compact(
        F.array(
            F.when(normalize_text(F.coalesce(prediction, F.lit(""))) == "", F.lit("empty_output")),
            F.when(truncated, F.lit("truncated")),
            F.when(has_repeated_text(prediction), F.lit("repeated_text")),
            F.when(has_commentary(prediction), F.lit("extra_commentary")),
        )
    )


def error_flags(reference: Column, prediction: Column, status: Column, truncated: Column) -> Column:
    """The review flags with what kind of error it is; an exact match has that name alone."""
    text = F.coalesce(prediction, F.lit(""))
    p, r = normalize_text(text), normalize_text(reference)
    more = F.array_compact(
        F.array(
            F.when((p != r) & (F.lower(p) == F.lower(r)), F.lit("case_only")),
            F.when(text.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), F.lit("non_latin_output")),
            F.when(F.char_length(text) > F.greatest(F.lit(32), 4 * F.char_length(reference)), F.lit("possible_extra_content")),
            F.when(~status.eqNullSafe(F.lit("success")), F.lit("request_failure_or_missing")),
        )
    )
    found = F.array_sort(F.array_distinct(F.concat(flags(text, truncated), more)))
    found = F.when(F.size(found) == 0, F.array(F.lit("character_mismatch"))).otherwise(found)
    return F.when((p == r) & status.eqNullSafe(F.lit("success")), F.array(F.lit("exact_match"))).otherwise(found)


def label_issues(text: Column, kind: Column) -> Column:
    """What is wrong with a label; braces are unbalanced where one closes too early or stays open."""
    depth = F.aggregate(
        F.split(F.regexp_replace(text, r"[^{}]", ""), ""),
        F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda a, c: F.struct(
            (a["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("d"),
            (a["ok"] & (a["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0) >= 0)).alias("ok"),
        ),
        lambda a: a["ok"] & (a["d"] == 0),
    )
    return F.array_compact(
        F.array(
            F.when(normalize_text(text) == "", F.lit("empty_reference")),
            F.when(text != nfc(text), F.lit("non_nfc_unicode")),
            F.when(text.rlike(r"[\x00-\x08\x0b-\x1f]"), F.lit("control_character")),
            F.when(text.rlike(r"\x{FFFD}|\b(?:TODO|TBD|UNREADABLE|ILLEGIBLE)\b"), F.lit("unresolved_label")),
            F.when(~depth, F.lit("unbalanced_latex_braces")),
            F.when((kind == "prose") & (F.regexp_count(text, F.lit(r"\$")) % 2 == 1), F.lit("unbalanced_inline_math")),
            F.when(~kind.isin("prose", "equation"), F.lit("unknown_content_type")),
        )
    )


def score_equation(prediction: Column, reference: Column) -> Column:
    """The score of equations as text; null where the reference is empty. Both must be columns in canonical composition (``nfc``).

    Which equations say the same is another question, see ``equations``.
    """
    m = score(prediction, reference, raw=False)
    bound = F.transform(F.array(m), lambda x: F.when(x.isNotNull(), F.struct(x["cer"].alias("equation_cer"), x["exact_match"].alias("normalized_exact_match"), *[x[c].alias(c) for c in ("wer", "char_edits", "word_edits", "reference_chars", "reference_words")])))
    return F.get(bound, F.lit(0))


def row_error_rate(stored: Column, prediction: Column, reference: Column) -> Column:
    """A row's character error rate; what was stored, if that is a rate, where the pair is beyond MAX_CELLS or the reference empty.

    Texts of equations must be in canonical composition (``nfc``).
    """
    p, r = normalize_text(prediction), normalize_text(reference)
    known = F.when((stored >= 0) & (stored < float("inf")), stored)

    def rate(pair: Column) -> Column:
        cells = (F.char_length(pair["r"]) + 1).cast("long") * (F.char_length(pair["p"]) + 1)
        own = F.try_divide(F.when(pair["p"] == pair["r"], F.lit(0)).otherwise(distance(pair["r"], pair["p"])).cast("double"), F.char_length(pair["r"]))
        return F.when((cells > MAX_CELLS) | (pair["r"] == ""), known).otherwise(own)

    return F.get(F.transform(F.array(F.struct(p.alias("p"), r.alias("r"))), rate), F.lit(0))


#: Characters of a name that are kept.
NAME = 48


def safe_name(text: Column) -> Column:
    """A name for files: letters and digits in lower case, dashes for all else, and eight digits of the text's digest."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    kept = F.substr(plain, F.lit(1), F.lit(NAME))
    return F.concat(F.when(kept == "", F.lit("condition")).otherwise(kept), F.lit("-"), F.substr(F.sha2(text.cast("binary"), 256), F.lit(1), F.lit(8)))


def document_of_line(line_id: Column) -> Column:
    """A line's document: its id without what follows the last dash."""
    return F.regexp_replace(line_id, "-[^-]*$", "")


def csv_guard(text: Column) -> Column:
    """A quote before texts that a spreadsheet would take for a formula."""
    return F.when(text.rlike("^﻿?\\s*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)
