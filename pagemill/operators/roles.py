"""Roles: heading levels, list markers, headers and footers, captions of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ClassifyConfig
from ..functions import text
from ..functions.numbers import exclusive_tertile
from .order import packed, unpacked

KEY = ["doc_id", "page_index"]
DEFAULT_LEVEL, FEWEST_SIGNALS = 2, 3

# detectors' labels and what they stand for; Background gives no region.
LABELS = {
    "Caption": "caption", "Footnote": "header_footer", "Formula": "paragraph", "List-item": "list_item", "Page-footer": "header_footer", "Page-header": "header_footer",
    "Picture": "figure", "Section-header": "heading", "Table": "table", "Text": "paragraph", "Title": "heading",
}
LABEL_LEVELS = {"Title": 1, "Section-header": 2}
STRUCT_LABELS = {
    "title": "heading", "plain text": "paragraph", "abandon": "header_footer", "figure": "figure", "figure_caption": "caption", "table": "table",
    "table_caption": "caption", "table_footnote": "caption", "isolate_formula": "paragraph", "formula_caption": "caption",
}
DROPPED = ("Background",)
LEAST_CONFIDENCE = 0.25


def _lookup(column: Column, table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[column]


def role_of(label: Column, table: dict[str, str] = LABELS) -> Column:
    return F.coalesce(_lookup(label, table), F.lit("unknown"))


def level_of(label: Column) -> Column:
    return _lookup(label, LABEL_LEVELS)


def detections(found: DataFrame, table: dict[str, str] = LABELS) -> DataFrame:
    """Detector rows (label, confidence, ...) as regions' roles and levels; weak ones and Background go."""
    kept = found.where((F.coalesce("confidence", F.lit(1.0)) >= LEAST_CONFIDENCE) & ~F.col("label").isin(*DROPPED))
    return kept.withColumn("role", role_of(F.col("label"), table)).withColumn("heading_level", level_of(F.col("label")).cast("int"))


def size_signal() -> Column:
    """What a heading's size is judged by: font size; without it the box of recognised text, none of native text."""
    tall = F.col("y1") - F.col("y0")
    return F.when(F.col("font_size") > 0, F.col("font_size")).when(F.col("source") == "native", F.lit(None)).when(tall > 0, tall)


def heading_levels(regions: DataFrame) -> DataFrame:
    """Level 1 to 3 by the page's tertiles of heading sizes; 2 without a size or with fewer than three."""
    heading = F.col("role") == "heading"
    signal = F.when(heading, size_signal())
    page = regions.withColumn("_sizes", F.collect_list(signal).over(Window.partitionBy(*KEY)))
    page = page.withColumns({"_q1": exclusive_tertile(F.col("_sizes"), 1), "_q2": exclusive_tertile(F.col("_sizes"), 2)})
    level = F.when((F.size("_sizes") < FEWEST_SIGNALS) | signal.isNull(), DEFAULT_LEVEL).when(signal <= F.col("_q1"), 3).when(signal <= F.col("_q2"), 2).otherwise(1)
    return page.withColumn("heading_level", F.when(heading, level).otherwise(F.col("heading_level")).cast("int")).drop("_sizes", "_q1", "_q2")


def list_items(regions: DataFrame) -> DataFrame:
    """Paragraphs and list items that start with a marker become list items that carry it."""
    marker = F.when(F.col("role").isin("list_item", "paragraph"), text.list_marker(F.coalesce("text", F.lit(""))))
    found = regions.withColumn("_marker", marker)
    return found.withColumns({"role": F.when(F.col("_marker").isNotNull(), "list_item").otherwise(F.col("role")), "list_marker": F.coalesce("_marker", "list_marker")}).drop("_marker")


def header_footer(regions: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Paragraphs and unknown regions whose centre lies in the top or bottom band (page_height > 0)."""
    cy, h = (F.col("y0") + F.col("y1")) * 0.5, F.col("page_height")
    band = h * fraction
    hit = F.col("role").isin("paragraph", "unknown") & (h > 0) & ((cy < band) | (cy > h - band))
    return regions.withColumn("role", F.when(hit, "header_footer").otherwise(F.col("role")))


def _linked(regions: DataFrame, fraction: float) -> DataFrame:
    """packed() pages with pairs: figures in order each take the nearest free caption right below."""
    page = packed(regions, KEY, "seq")
    one = lambda r: F.struct(*(r[c].alias(c) for c in ("seq", "x0", "y0", "x1", "y1")))
    page = page.withColumns({
        "_figures": F.transform(F.filter("rows", lambda r: (r["role"] == "figure") & (r["page_height"] > 0)), one),
        "_captions": F.transform(F.filter("rows", lambda r: (r["role"] == "caption") & r["group_id"].isNull()), one),
        "_reach": F.get("rows", F.lit(0))["page_height"] * fraction,
    })
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<f:int,c:int>>").alias("pairs"))

    def step(s: Column, f: Column) -> Column:
        free = F.filter("_captions", lambda c: ~F.array_contains(s["used"], c["seq"]) & (c["x1"] >= f["x0"]) & (f["x1"] >= c["x0"]) & (c["y0"] - f["y1"] >= 0) & (c["y0"] - f["y1"] <= F.col("_reach")))
        near = F.slice(F.array_sort(F.transform(free, lambda c: F.struct((c["y0"] - f["y1"]).alias("dy"), c["seq"].alias("seq")))), 1, 1)
        return F.struct(F.concat(s["used"], F.transform(near, lambda c: c["seq"])).alias("used"), F.concat(s["pairs"], F.transform(near, lambda c: F.struct(f["seq"].alias("f"), c["seq"].alias("c")))).alias("pairs"))

    return page.withColumn("pairs", F.aggregate("_figures", start, step, lambda s: s["pairs"]))


def caption_pairs(regions: DataFrame, fraction: float = 0.05) -> DataFrame:
    """(page, figure seq f, caption seq c)."""
    return _linked(regions, fraction).select(*KEY, F.explode("pairs").alias("p")).select(*KEY, "p.f", "p.c")


def _uuid5(name: Column) -> Column:
    """Hex of a name-based UUID (version 5) in the OID name space."""
    raw = F.sha1(F.concat(F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8")), name.cast("binary")))
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), (F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(F.substring(raw, 1, 12), F.lit("5"), F.substring(raw, 14, 3), variant, F.substring(raw, 18, 15))


def captions(regions: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Figures and their captions get a common group_id, made from the figure's page and corner."""
    def group(r: Column) -> Column:
        # the figure of the pair that a row is in names the group
        own = F.filter("pairs", lambda p: (p["f"] == r["seq"]) | (p["c"] == r["seq"]))
        return F.get(F.filter("rows", lambda x: x["seq"] == F.get(own, F.lit(0))["f"]), F.lit(0))

    page = _linked(regions, fraction)
    corner = F.transform("rows", lambda r: F.struct(group(r)["x0"].alias("x"), group(r)["y0"].alias("y")))
    flat = unpacked(page, KEY, _corner=corner)
    name = F.concat_ws(":", F.lit("figcap"), "page_index", F.col("_corner.x").cast("string"), F.col("_corner.y").cast("string"))
    return flat.withColumn("group_id", F.when(F.col("_corner.x").isNotNull(), _uuid5(name)).otherwise(F.col("group_id"))).drop("_corner")


def classify(regions: DataFrame, config: ClassifyConfig | None = None) -> DataFrame:
    """regions (with page_height) after levels, lists, headers and footers, captions, in this order."""
    c = config or ClassifyConfig()
    out = list_items(heading_levels(regions))
    if c.prune_header_footer:
        out = header_footer(out, c.header_footer_fraction)
    return captions(out, c.caption_fraction)
