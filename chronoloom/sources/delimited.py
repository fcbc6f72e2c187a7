"""Delimited text replies as typed rows, and rows as prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(c: Column, kind: T.DataType) -> Column:
    """A text cell as a type; list cells look like ``[a, b]``. Unreadable cells are null."""
    if isinstance(kind, T.ArrayType):
        inner = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
        items = F.when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(x, "[\"']", ""))))
        return F.transform(items, lambda x: x.try_cast(kind.elementType))
    if isinstance(kind, T.StringType):
        return c
    return F.trim(c).try_cast(kind)


def parse_delimited(replies: DataFrame, column: str, schema: T.StructType, sep: str = "\t") -> DataFrame:
    """Rows of a header-led delimited text column: fields by header name, unknown headers ignored, rows of another width dropped. Other columns stay."""
    lines = F.filter(F.split(F.regexp_replace(F.col(column), "\r", ""), "\n"), lambda x: F.trim(x) != "")
    df = replies.withColumn("_lines", lines).filter(F.size("_lines") > 1)
    df = df.withColumn("_head", F.transform(F.split(F.get("_lines", F.lit(0)), sep), lambda x: F.lower(F.trim(x)))).withColumn("_line", F.explode(F.slice("_lines", 2, 1_000_000_000)))
    df = df.withColumn("_cells", F.split("_line", sep, -1)).filter(F.size("_cells") == F.size("_head"))
    at = F.map_from_arrays("_head", "_cells")
    return df.select(*[c for c in replies.columns if c != column], *[cell(F.element_at(at, F.lit(f.name.lower())), f.dataType).alias(f.name) for f in schema.fields])


def to_prompt_rows(df: DataFrame, columns: list[str], sep: str = ",") -> DataFrame:
    """One text line a row (``line``) with cells quoted where needed; list cells show their last element."""
    kinds = dict(df.dtypes)
    shown = [(F.element_at(F.col(c), -1) if kinds[c].startswith("array") else F.col(c)).cast("string").alias(c) for c in columns]
    return df.select(F.to_csv(F.struct(*shown), {"sep": sep}).alias("line"))


def to_json_rows(df: DataFrame, columns: list[str], pretty: bool = False) -> DataFrame:
    """One JSON text a row (``line``), null fields left out; ``pretty`` puts fields on lines of their own."""
    options = {"pretty": "true"} if pretty else {}
    return df.select(F.to_json(F.struct(*columns), options).alias("line"))


def stamped_json(df: DataFrame, columns: list[str], pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'") -> DataFrame:
    """Rows as JSON (``line``) in which every timestamp, however deep in structs, lists and maps, is text."""
    return df.select(F.to_json(F.struct(*columns), {"timestampFormat": pattern, "ignoreNullFields": "false"}).alias("line"))
