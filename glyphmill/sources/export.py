"""Exports: flat tables, CSV that spreadsheets read, cells cut to a sheet's size, documents as rows, HTML, one folder a run."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import csv_guard
from glyphmill.plans.cut import shared_folder

#: UTF-16 units of a cell, and what marks a text that is kept as JSON.
CELL_UNITS, JSON_MARK = 32_760, "json:"
#: Characters that XML 1.0 can't hold.
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"
#: Items above which a list is shown by its size and digest.
SHOWN_ITEMS = 1000


def flat(records: DataFrame, nested: str = "metrics") -> DataFrame:
    """The fields of a struct beside the record's own, which win where names clash."""
    own = [c for c in records.columns if c != nested]
    return records.select(*own, *[F.col(f"{nested}.{c}") for c in records.schema[nested].dataType.names if c not in own])


def error_rows(records: DataFrame) -> DataFrame:
    """Records that failed or name an error."""
    return records.where(~F.col("status").eqNullSafe(F.lit("success")) | (F.coalesce("error", F.lit("")) != ""))


def for_csv(df: DataFrame, first: list[str]) -> DataFrame:
    """Columns in ``first``, then the others by name, as texts: null is nothing, nested values are JSON, formulas made harmless. The first name bears the byte order mark."""
    order = [c for c in first if c in df.columns] + sorted(set(df.columns) - set(first))
    kinds = dict(df.dtypes)
    nested = lambda c: kinds[c].startswith(("struct", "array", "map"))
    cell = lambda c: csv_guard(F.to_json(c)) if nested(c) else csv_guard(F.col(c)) if kinds[c] == "string" else F.col(c).cast("string")
    return df.select(*[F.coalesce(cell(c), F.lit("")).alias(("﻿" if not i else "") + c) for i, c in enumerate(order)])


def write_csv(df: DataFrame, path: str, first: list[str] | None = None) -> None:
    publish(for_csv(df, first or []), path, "csv", header=True, escape='"', emptyValue="")


def publish(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Writes beside the path and renames, so that it is there whole or not at all; what is there already stays and is an error."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.part")
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(at):
        raise FileExistsError(path)
    df.write.format(kind).options(**options).mode("overwrite").save(beside.toString())
    if store.exists(at) or not store.rename(beside, at):
        raise FileExistsError(path)


def export_run(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of a run with a CSV folder for each table."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")


def utf16_units(text: Column) -> Column:
    """Characters, those beyond U+FFFF twice."""
    return F.char_length(text) + F.char_length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))


def _cut(text: str, units: int) -> list[str]:
    if len(text) <= units and len(text.encode("utf-16-le")) <= 2 * units:
        return [text]
    out, data, at = [], text.encode("utf-16-le"), 0
    while at < len(data):
        end = min(len(data), at + 2 * units)
        if end < len(data) and 0xDC <= data[end + 1] <= 0xDF and end - 2 > at:  # not between the halves of a character
            end -= 2
        out.append(data[at:end].decode("utf-16-le"))
        at = end
    return out


def overflow(df: DataFrame, key: str, text: str, units: int = CELL_UNITS) -> DataFrame:
    """Texts too long for a cell, in numbered pieces of at most so many UTF-16 units, no character cut."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _cut(x, units))

    long = df.where(utf16_units(F.col(text)) > units)
    return long.select(key, F.posexplode(cut(text)).alias("piece", "text"))


def cell(text: Column) -> Column:
    """A text as a sheet can hold it: marked JSON where it has characters that XML can't."""
    whole = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    return F.when(text.rlike(ILLEGAL), F.concat(F.lit(JSON_MARK), whole)).otherwise(text)


def escaped(text: Column) -> Column:
    """A text inside HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_rows(df: DataFrame) -> DataFrame:
    """A row of an HTML table for each row, in column ``html``."""
    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def write_html(df: DataFrame, path: str, title: str) -> None:
    """A page whose table is written by tasks; its head and foot are files before and after them."""
    spark = df.sparkSession
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    ends = spark.createDataFrame([(0, f"<!doctype html><meta charset=utf-8><title>{title}</title><table>{head}"), (2, "</table>")], "part int, html string")
    rows = html_rows(df).select(F.lit(1).alias("part"), "html").union(ends)
    publish(rows.repartitionByRange("part").sortWithinPartitions("part").select("html"), path, "text")


def six_digits(value: Column) -> Column:
    """A number to six significant digits, as it is shown: no zeros at its end, with an exponent beyond a million or under a ten-thousandth."""
    size = F.abs(value)
    science = F.format_string("%.5e", value)
    exponent = F.substring_index(science, "e", -1).cast("int")
    plain = F.coalesce(*[F.when(exponent == e, F.format_string(f"%.{5 - e}f", value)) for e in range(-4, 6)])
    short = lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)
    mantissa, sign = short(F.substring_index(science, "e", 1)), F.when(exponent < 0, "-").otherwise("+")
    wide = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
    return F.when(F.isnan(value) | (size == float("inf")), value.cast("string")).when(value == 0, F.lit("0")).when(exponent.between(-4, 5), short(plain)).otherwise(wide)


def summarised(items: Column, shown: int = SHOWN_ITEMS) -> Column:
    """A list as JSON; a long one as its size and digest."""
    return F.when(F.size(items) > shown, F.to_json(F.struct(F.size(items).alias("items"), F.sha2(F.to_json(items).cast("binary"), 256).alias("sha256")))).otherwise(F.to_json(items))


def merged(outer: dict[str, Column], inner: dict[str, Column]) -> list[Column]:
    """Metadata fields of a record, its own before the nested ones; a blank is none."""
    given = lambda c: F.when(F.trim(c.cast("string")) != "", c)
    return [F.coalesce(*[given(side[f]) for side in (outer, inner) if f in side]).alias(f) for f in sorted({*outer, *inner})]


def _walk(prefix: str, value) -> Iterator[tuple[str, str]]:
    stack = [(prefix, value)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, dict) and x:
            stack += [(f"{path}.{k}" if path else k, x[k]) for k in sorted(x, reverse=True)]
        else:
            yield path, json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) if isinstance(x, dict | list) else x if isinstance(x, str) else json.dumps(x)


def document_rows(df: DataFrame, key: str, document: str) -> DataFrame:
    """key, path and value of each leaf of a JSON object, by dotted paths; lists are leaves. What isn't an object has one row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, *leaf) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text is not None for leaf in _walk("", json.loads(text))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((batch.column(0).type, pa.string(), pa.string()))], names=[key, "path", "value"])

    df = df.select(key, document)
    return df.mapInArrow(rows, f"`{key}` {df.dtypes[0][1]}, path string, value string")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; numbers beyond JSON are an error."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def write_package(df: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines in a folder for each value of ``by``; what is there already is an error."""
    df.write.mode("errorifexists").partitionBy(*by).json(path)


def scratch(spark, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
