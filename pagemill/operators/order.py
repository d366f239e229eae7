"""Reading order: columns from a histogram of centres, row bands, right to left or left to right."""

from __future__ import annotations

from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bound, median_of

KEY = ["doc_id", "page_index"]
# Bins across a page, least gutter and band as fractions, columns at most, regions at least.
BINS, GUTTER, BAND, MOST_COLUMNS, FEWEST_REGIONS = 50, 0.04, 0.5, 3, 4


def centre(a: str = "x0", b: str = "x1") -> Column:
    return (F.col(a) + F.col(b)) * 0.5


def bin_of(x: Column, width: Column) -> Column:
    """The histogram bin of a centre, null outside the page."""
    return F.when((x >= 0) & (x <= width), F.least(F.lit(BINS - 1), F.floor(x / (width / BINS)).cast("int")))


def packed(df: DataFrame, group: list[str], *order: str) -> DataFrame:
    """One row a group with `rows`, its rows in order. A fold over them needs no second read of df."""
    rest = [c for c in df.columns if c not in group]
    item = F.struct(F.struct(*order).alias("_key"), F.struct(*rest).alias("_row"))

    def compare(a: Column, b: Column) -> Column:  # by the key alone: rows may hold maps, which have no order
        return F.when(a["_key"] < b["_key"], -1).when(a["_key"] > b["_key"], 1).otherwise(0)

    per = df.groupBy(*group).agg(F.array_sort(F.collect_list(item), compare).alias("_rows"))
    return per.withColumn("rows", F.transform("_rows", lambda r: r["_row"])).drop("_rows")


def unpacked(df: DataFrame, group: list[str], **added: Column) -> DataFrame:
    """The rows of packed() again, with arrays as long as theirs as further columns."""
    arrays = F.arrays_zip(F.col("rows").alias("row"), *(c.alias(n) for n, c in added.items()))
    flat = df.select(*group, F.explode(arrays).alias("z"))
    return flat.select(*group, "z.row.*", *(F.col(f"z.{n}").alias(n) for n in added))


def column_spans(centres: Column, width: Column) -> Column:
    """The columns (x0, x1) that tile a page, from its regions' centres."""
    step = width / BINS
    bins = F.array_sort(F.array_distinct(F.array_compact(F.transform(centres, lambda x: bin_of(x, width)))))
    widest = F.greatest(F.lit(1), F.floor(F.lit(GUTTER) * width / step).cast("int"))
    run = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    def grow(runs: Column, k: Column) -> Column:
        last = F.element_at(runs, -1)
        # beyond the most columns all goes into the last one
        new = (F.size(runs) == 0) | ((k - F.try_element_at(runs, F.lit(-1))["b"] - 1 >= widest) & (F.size(runs) < MOST_COLUMNS))
        return F.when(new, F.concat(runs, F.array(run(k, k)))).otherwise(F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(run(last["a"], k))))

    edge = lambda r: (r["b"] + 1) * step
    whole = F.array(F.struct(F.lit(0.0).alias("x0"), F.when(width <= 0, F.greatest(F.lit(1.0), width)).otherwise(width).alias("x1")))

    def tiles(runs: Column) -> Column:
        def tile(r: Column, k: Column) -> Column:
            left = F.when(k > 0, (edge(F.get(runs, k - 1)) + r["a"] * step) * 0.5).otherwise(0.0)
            right = F.when(k < F.size(runs) - 1, (edge(r) + F.get(runs, k + 1)["a"] * step) * 0.5).otherwise(width)
            return F.struct(left.alias("x0"), right.alias("x1"))

        return F.when(F.size(runs) > 0, F.transform(runs, tile)).otherwise(whole)

    # the fold is bound: it is worked out once however often the tiles take it
    runs = F.aggregate(bins, F.array().cast("array<struct<a:int,b:int>>"), grow)
    return F.when((width <= 0) | (F.size(centres) < FEWEST_REGIONS), whole).otherwise(bound(runs, tiles))


def _with_spans(regions: DataFrame) -> DataFrame:
    page = packed(regions, KEY, "seq")
    width = F.get("rows", F.lit(0))["page_width"]
    page = page.withColumn("_width", width).withColumn("_centres", F.transform("rows", lambda r: (r["x0"] + r["x1"]) * 0.5))
    return page.withColumn("_cols", column_spans(F.col("_centres"), F.col("_width")))


def columns(regions: DataFrame) -> DataFrame:
    """(page, col_idx, x0, x1): the columns that tile each page of regions (with page_width)."""
    page = regions.groupBy(*KEY).agg(F.collect_list(centre()).alias("centres"), F.min_by("page_width", "seq").alias("width"))
    return page.select(*KEY, F.posexplode(column_spans(F.col("centres"), F.col("width"))).alias("col_idx", "c")).select(*KEY, "col_idx", "c.x0", "c.x1")


def column_indices() -> Column:
    """Of the rows of _with_spans: the first column that holds the centre; right of all the last, else the first."""

    def pick(x: Column) -> Column:
        cols = F.transform("_cols", lambda c, k: F.struct(c["x0"].alias("x0"), c["x1"].alias("x1"), k.alias("k")))
        inside, beyond = F.filter(cols, lambda c: (c["x0"] <= x) & (x <= c["x1"])), F.filter(cols, lambda c: x > c["x1"])
        return F.coalesce(F.try_element_at(inside, F.lit(1))["k"], F.try_element_at(beyond, F.lit(-1))["k"], F.lit(0))

    return F.transform("_centres", pick)


def with_column_index(regions: DataFrame) -> DataFrame:
    """regions with col_idx."""
    return unpacked(_with_spans(regions), KEY, col_idx=column_indices())


def bands_of(tops: list[float], tolerance: float) -> list[int]:
    """Tops in order: a new band where one is more than the tolerance under the band's first."""
    out, band, first = [], -1, None
    for top in tops:
        if first is None or top - first > tolerance:
            band, first = band + 1, top
        out.append(band)
    return out


def _bands(tops: Column, tolerance: Column) -> Column:
    """A fold over a page's regions; not one of Spark's, as those copy what they have built up at each step."""

    @F.arrow_udf("array<int>")
    def fold(tops: pa.Array, tolerance: pa.Array) -> pa.Array:
        return pa.array([bands_of(v, t) for v, t in zip(tops.to_pylist(), tolerance.to_pylist(), strict=True)], pa.list_(pa.int32()))

    return fold(tops, tolerance)


def with_bands(regions: DataFrame, group: list[str]) -> DataFrame:
    """regions with band and top_rank: by top, a new band where the top is more than the tolerance under the band's first."""
    per = packed(regions, group, "y0", "x0", "seq")
    heights = F.filter(F.transform("rows", lambda r: r["y1"] - r["y0"]), lambda h: h > 0)
    per = per.withColumn("_tol", F.greatest(F.lit(1.0), F.coalesce(median_of(heights), F.lit(1.0)) * BAND))
    bands = _bands(F.transform("rows", lambda r: r["y0"]), F.col("_tol"))
    return unpacked(per, group, band=bands, top_rank=F.transform("rows", lambda r, k: k))


def column_of(x: float, spans: list[dict]) -> int:
    """As column_indices has it, for one centre."""
    inside = next((k for k, s in enumerate(spans) if s["x0"] <= x <= s["x1"]), None)
    return inside if inside is not None else max((k for k, s in enumerate(spans) if x > s["x1"]), default=0)


def tolerance_of(heights: list[float]) -> float:
    """How far under a band's first top another one may be."""
    tall = [h for h in heights if h > 0]
    return max(1.0, (median(tall) if tall else 1.0) * BAND)


def reading_order(boxes: list[dict], columns_: list[int], rtl: bool) -> list[int]:
    """The place of each box of a page (in the order of seq): columns, bands, then right or left edges, tops, and as they stood."""
    keys: list[tuple] = [()] * len(boxes)
    for column in set(columns_):
        own = sorted((k for k, c in enumerate(columns_) if c == column), key=lambda k: (boxes[k]["y0"], boxes[k]["x0"], k))
        bands = bands_of([boxes[k]["y0"] for k in own], tolerance_of([boxes[k]["y1"] - boxes[k]["y0"] for k in own]))
        for rank, (k, band) in enumerate(zip(own, bands, strict=True)):
            keys[k] = (-column if rtl else column, band, -boxes[k]["x1"] if rtl else boxes[k]["x0"], boxes[k]["y0"], rank)
    out = [0] * len(boxes)
    for place, k in enumerate(sorted(range(len(boxes)), key=keys.__getitem__)):
        out[k] = place
    return out


def reorder(regions: DataFrame, rtl: bool = True) -> DataFrame:
    """regions (with page_width) with seq in reading order; columns, bands, then right or left edges. One packed page serves all three."""

    @F.arrow_udf("array<int>")
    def places(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for a, b, c, d, cols in zip(x0.to_pylist(), y0.to_pylist(), x1.to_pylist(), y1.to_pylist(), spans.to_pylist(), strict=True):
            boxes = [{"x0": p, "y0": q, "x1": r, "y1": t} for p, q, r, t in zip(a, b, c, d, strict=True)]
            out.append(reading_order(boxes, [column_of((p + r) * 0.5, cols) for p, r in zip(a, c, strict=True)], rtl))
        return pa.array(out, pa.list_(pa.int32()))

    side = lambda c: F.transform("rows", lambda r: r[c])
    return unpacked(_with_spans(regions), KEY, _place=places(side("x0"), side("y0"), side("x1"), side("y1"), F.col("_cols"))).withColumn("seq", F.col("_place")).drop("_place")
