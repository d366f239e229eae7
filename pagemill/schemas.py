"""Row types: regions, pages, validation verdicts, outcomes and progress events.

Lists of the data model become tables with an explicit position (`seq`); every
order ends in it.  Pages are keyed (doc_id, page_index), pages counted from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1"
# The names of roles and sources.
ROLES = ("heading", "paragraph", "list_item", "table", "figure", "caption", "header_footer", "failure_placeholder", "unknown")
SOURCES = ("native", "ocr")

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("bbox", BBOX)])
GRID = T.StructType([T.StructField("rows", T.ArrayType(T.ArrayType(CELL)))])
MARKER = T.StructType([T.StructField("kind", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("raw_marker", T.StringType())])

REGION_FIELDS: dict[str, T.DataType] = {
    "doc_id": T.StringType(), "page_index": T.IntegerType(), "seq": T.IntegerType(),
    "x0": T.DoubleType(), "y0": T.DoubleType(), "x1": T.DoubleType(), "y1": T.DoubleType(),
    "text": T.StringType(), "role": T.StringType(), "source": T.StringType(),
    "confidence": T.DoubleType(), "heading_level": T.IntegerType(), "list_marker": MARKER, "table_grid": GRID,
    "group_id": T.StringType(), "failure_reason": T.StringType(),
    "font_size": T.DoubleType(), "merged_cells": T.BooleanType(), "meta": T.MapType(T.StringType(), T.StringType()),
}
REGION = T.StructType([T.StructField(k, v) for k, v in REGION_FIELDS.items()])

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _columns(spec: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in spec.split(", "))])


CHAR = _columns("doc_id string, page_index int, char_seq int, ch string, x0 double, y0 double, x1 double, y1 double, font_size double")
PAGE = _columns("doc_id string, page_index int, page_width double, page_height double, has_text_layer boolean")
PROGRESS = _columns("page int, of int, event string, branch string, reason string, region int, of_regions int, role string")

PAGE_KEY = ("doc_id", "page_index")


def as_regions(df: DataFrame) -> DataFrame:
    """df with all columns of a region; missing ones are null, meta an empty map. Other columns go."""
    def field(name: str, kind: T.DataType) -> Column:
        if name in df.columns:
            return F.col(name).cast(kind).alias(name)
        return (F.create_map().cast(kind) if name == "meta" else F.lit(None).cast(kind)).alias(name)

    return df.select(*(field(k, v) for k, v in REGION_FIELDS.items()))


def width() -> Column:
    return F.col("x1") - F.col("x0")


def height() -> Column:
    return F.col("y1") - F.col("y0")


def area() -> Column:
    return width() * height()


def grid_shape(grid: Column) -> tuple[Column, Column]:
    """(rows, columns) of a grid; a ragged one is as wide as its longest row."""
    rows = F.coalesce(grid["rows"], F.array().cast(GRID["rows"].dataType))
    return F.size(rows), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def checked(regions: DataFrame) -> DataFrame:
    """regions; a row with an unknown role or source fails the query."""
    bad = ~F.col("role").isin(*ROLES) | ~F.col("source").isin(*SOURCES)
    return regions.withColumn("role", F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("unknown role or source:"), "role", "source"))).otherwise(F.col("role")))


def with_meta(meta: Column, more: Column) -> Column:
    """Keys of both maps; on a clash the new one wins."""
    keep = F.map_filter(meta, lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return F.map_concat(keep, more)


def _box(b) -> Column:
    return F.array(b["x0"], b["y0"], b["x1"], b["y1"])


def to_json(df: DataFrame) -> DataFrame:
    """(doc_id, page_index, seq, json): the versioned envelope, keys sorted, nulls written."""
    grid = F.when(F.col("table_grid").isNotNull(), F.struct(F.transform(F.col("table_grid.rows"), lambda r: F.transform(r, lambda c: F.struct(_box(c["bbox"]).alias("bbox"), c["confidence"].alias("confidence"), c["text"].alias("text")))).alias("rows")))
    marker = F.when(F.col("list_marker").isNotNull(), F.struct("list_marker.kind", "list_marker.ordinal", "list_marker.raw_marker"))
    region = F.struct(F.array("x0", "y0", "x1", "y1").alias("bbox"), "confidence", "failure_reason", "group_id", "heading_level", marker.alias("list_marker"), "meta", "page_index", "role", "source", grid.alias("table_grid"), "text")
    return df.select("doc_id", "page_index", "seq", F.to_json(F.struct(region.alias("region"), F.lit(SCHEMA_VERSION).alias("schema_version")), {"ignoreNullFields": "false"}).alias("json"))


_JSON = (
    "schema_version string, region struct<bbox: array<double>, confidence: double, failure_reason: string, group_id: string, heading_level: int, "
    "list_marker: struct<kind: string, ordinal: bigint, raw_marker: string>, meta: map<string,string>, page_index: int, role: string, source: string, "
    "table_grid: struct<rows: array<array<struct<bbox: array<double>, confidence: double, text: string>>>>, text: string>"
)


def from_json(df: DataFrame) -> DataFrame:
    """Regions from (doc_id, seq, json); broken JSON and other versions fail the query."""
    j = df.withColumn("j", F.from_json("json", _JSON, {"mode": "FAILFAST"}))
    version = F.col("j.schema_version")
    j = j.withColumn("r", F.when(F.coalesce(version != SCHEMA_VERSION, F.lit(True)), F.raise_error(F.concat(F.lit("schema_version: "), F.coalesce(version, F.lit("none"))))).otherwise(F.col("j.region")))
    box = lambda b: F.struct(*(b[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))
    grid = F.when(F.col("r.table_grid").isNotNull(), F.struct(F.transform("r.table_grid.rows", lambda row: F.transform(row, lambda c: F.struct(c["text"].alias("text"), c["confidence"].alias("confidence"), box(c["bbox"]).alias("bbox")))).alias("rows")))
    plain = ("text", "role", "source", "confidence", "heading_level", "list_marker", "group_id", "failure_reason", "meta")
    return as_regions(j.select("doc_id", "seq", F.col("r.page_index"), *(F.col("r.bbox")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))), *(F.col(f"r.{c}") for c in plain), grid.alias("table_grid")))
