"""Glyphs to words, lines, tables and paragraphs, page by page.

Islands are windows; only line grouping, whose anchors depend on what came
before, is a fold over one page's words.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import charclass as cc
from ..functions.numbers import median_of
from ..schemas import as_regions

KEY = ["doc_id", "page_index"]
# Bands and gaps in heights and widths; the least table.
LINE_BAND, PARAGRAPH_GAP, COLUMN_DRIFT, MIN_ROWS, MIN_CELLS = 0.5, 1.5, 0.5, 3, 2


def flipped(chars: DataFrame) -> DataFrame:
    """Glyph boxes from the bottom-left origin (left, bottom, right, top, page_height) to the top-left one."""
    box = {"x0": F.col("left"), "y0": F.col("page_height") - F.col("top"), "x1": F.col("right"), "y1": F.col("page_height") - F.col("bottom")}
    out = chars.withColumns(box)
    return out.withColumn("font_size", F.col("y1") - F.col("y0")).select(*KEY, "char_seq", "ch", "x0", "y0", "x1", "y1", "font_size")


def box(prefix: str = "") -> list[Column]:
    """The outer box of a group."""
    return [F.min(f"{prefix}x0").alias("x0"), F.min(f"{prefix}y0").alias("y0"), F.max(f"{prefix}x1").alias("x1"), F.max(f"{prefix}y1").alias("y1")]


def joined(seq: str, value: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("k"), F.col(value).alias("v")))), lambda x: x["v"]), sep)


def words(chars: DataFrame) -> DataFrame:
    """A white-space glyph ends a word; glyphs keep the order of the content stream."""
    space = F.regexp_like("ch", F.lit(f"{cc.SPACE.replace('(?U)', '(?U)^')}+\\z"))
    order = Window.partitionBy(*KEY).orderBy("char_seq")
    marked = chars.withColumn("space", F.coalesce(space, F.lit(False)))
    marked = marked.withColumn("island", F.sum(F.col("space").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("NOT space")
    found = marked.groupBy(*KEY, "island").agg(joined("char_seq", "ch", "").alias("text"), *box())
    return found.withColumn("word_seq", F.row_number().over(Window.partitionBy(*KEY).orderBy("island")) - 1).drop("island")


def first_within(values: list[float], band: float) -> list[int]:
    """Each value's group: the first group whose first value is within band of it, else a new one."""
    heads: list[tuple[float, int]] = []
    out = []
    for v in values:
        reach = band + 1e-9 + abs(v) * 1e-12
        near = heads[bisect_left(heads, (v - reach, -1)) : bisect_right(heads, (v + reach, len(out)))]
        own = min((k for head, k in near if abs(v - head) <= band), default=len(heads))
        if own == len(heads):
            insort(heads, (v, own))
        out.append(own)
    return out


def _first_within(values: Column, band: Column) -> Column:
    """A fold over a page; not one of Spark's, as those copy what they have built up at each step."""

    @F.arrow_udf("array<int>")
    def fold(values: pa.Array, band: pa.Array) -> pa.Array:
        return pa.array([first_within(v, b) for v, b in zip(values.to_pylist(), band.to_pylist(), strict=True)], pa.list_(pa.int32()))

    return fold(values, band)


def line_numbers(words: DataFrame) -> DataFrame:
    """words with line_seq: each joins the first line whose first word's top is within half the median height."""
    item = F.struct("word_seq", "text", "x0", "y0", "x1", "y1")
    page = words.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("items"))
    middle = median_of(F.transform("items", lambda w: w["y1"] - w["y0"]))
    page = page.withColumn("band", F.when(middle != 0, middle).otherwise(1.0) * LINE_BAND)
    folded = page.withColumn("line", _first_within(F.transform("items", lambda w: w["y0"]), F.col("band")))
    each = folded.select(*KEY, F.explode(F.arrays_zip("items", "line")).alias("z"))
    return each.select(*KEY, "z.items.*", F.col("z.line").alias("line_seq"))


def lines(words: DataFrame) -> DataFrame:
    return line_numbers(words).groupBy(*KEY, "line_seq").agg(joined("word_seq", "text", " ").alias("text"), *box())


def cells(numbered: DataFrame) -> DataFrame:
    """Words with line_seq to cells: a gap to the word before of its width, or 1, at least, opens one."""
    w = Window.partitionBy(*KEY, "line_seq").orderBy("word_seq")
    before0, before1 = F.lag("x0").over(w), F.lag("x1").over(w)
    gap = F.greatest(F.col("x0") - before1, before0 - F.col("x1"), F.lit(0.0))
    opens = F.coalesce(gap >= F.greatest(before1 - before0, F.lit(1.0)), F.lit(False)).cast("int")
    marked = numbered.withColumn("opens", opens)
    marked = marked.withColumn("cell_seq", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    from ..functions.text import strip

    return marked.groupBy(*KEY, "line_seq", "cell_seq").agg(strip(joined("word_seq", "text", " ")).alias("text"), *box())


def aligned(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, aligned): whether each column's centres lie within half its cells' median width."""
    c = rows.withColumn("centre", (F.col("x0") + F.col("x1")) * 0.5).withColumn("w", F.col("x1") - F.col("x0"))
    per = c.groupBy(*group, "cell_seq").agg((F.max("centre") - F.min("centre")).alias("drift"), F.expr("percentile(w, 0.5)").alias("middle"))
    fine = F.col("drift") <= F.when(F.col("middle") != 0, F.col("middle")).otherwise(1.0) * COLUMN_DRIFT
    return per.groupBy(*group).agg(F.bool_and(fine).alias("aligned"))


def table_runs(cell_rows: DataFrame) -> DataFrame:
    """(page, run, first_line, last_line, rows, columns, boxes) of runs of lines with equally many cells."""
    box = F.collect_list(F.struct("cell_seq", "x0", "x1"))
    per_line = cell_rows.groupBy(*KEY, "line_seq").agg(F.count(F.lit(1)).alias("columns"), box.alias("boxes"))
    w = Window.partitionBy(*KEY).orderBy("line_seq")
    changed = F.coalesce(F.lag("columns").over(w) != F.col("columns"), F.lit(True)).cast("int")
    runs = per_line.withColumn("changed", changed)
    runs = runs.withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*KEY, "run", "columns").agg(F.min("line_seq").alias("first_line"), F.max("line_seq").alias("last_line"), F.count(F.lit(1)).alias("rows"), F.flatten(F.collect_list("boxes")).alias("boxes"))


def tables(cell_rows: DataFrame) -> DataFrame:
    """At most one table a page: the longest run, the earlier on ties, unless its columns drift (then none). One read of the cells."""
    good = table_runs(cell_rows).where((F.col("columns") >= MIN_CELLS) & (F.col("rows") >= MIN_ROWS))
    best = good.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("rows"), "first_line"))).where("k = 1").drop("k", "run")
    table = [*KEY, "columns", "first_line", "last_line", "rows"]
    inside = best.select(*table, F.explode("boxes").alias("b")).select(*table, "b.*")
    return aligned(inside, table).where("aligned").drop("aligned")


def grids(cell_rows: DataFrame, found: DataFrame) -> DataFrame:
    """(page, first_line, table_grid, outer box) of each table found."""
    inside = cell_rows.join(found.select(*KEY, "first_line", "last_line"), KEY).where(F.col("line_seq").between(F.col("first_line"), F.col("last_line")))
    cell = F.struct("text", F.lit(None).cast("double").alias("confidence"), F.struct("x0", "y0", "x1", "y1").alias("bbox"))
    row = inside.groupBy(*KEY, "first_line", "line_seq").agg(F.array_sort(F.collect_list(F.struct("cell_seq", cell.alias("cell")))).alias("cells"), *box())
    page = row.groupBy(*KEY, "first_line").agg(F.array_sort(F.collect_list(F.struct("line_seq", F.transform("cells", lambda c: c["cell"]).alias("cells")))).alias("rows"), *box())
    return page.withColumn("table_grid", F.struct(F.transform("rows", lambda r: r["cells"]).alias("rows"))).drop("rows")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines by top; more than 1.5 median heights below the line before is a new paragraph."""
    w = Window.partitionBy(*KEY).orderBy("y0", "line_seq")
    middle = F.expr("percentile(y1 - y0, 0.5)").over(Window.partitionBy(*KEY))
    sized = lines.withColumn("middle", middle).withColumn("middle", F.when(F.col("middle") != 0, F.col("middle")).otherwise(1.0))
    far = F.coalesce(F.col("y0") - F.lag("y1").over(w) > F.col("middle") * PARAGRAPH_GAP, F.lit(False)).cast("int")
    ranked = sized.withColumn("far", far).withColumn("k", F.row_number().over(w))
    ranked = ranked.withColumn("para_seq", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    return ranked.groupBy(*KEY, "para_seq").agg(joined("k", "text", "\n").alias("text"), *box())


def font_histogram(chars: DataFrame) -> DataFrame:
    """(page, font_size to one place, n)."""
    return chars.groupBy(*KEY, F.bround("font_size", 1).alias("font_size")).agg(F.count(F.lit(1)).alias("n"))


def layout(tops: list[float], bottoms: list[float], cells: list[list[tuple[float, float]]]) -> list[int]:
    """For each line of a page its region: 0 for the table's lines, 1 and on for paragraphs, as `tables` and `paragraphs` have them."""
    n, run, best = len(tops), 0, (0, 0)
    for k in range(1, n + 1):
        if k == n or len(cells[k]) != len(cells[run]):
            if len(cells[run]) >= MIN_CELLS and k - run >= max(MIN_ROWS, best[1] - best[0] + 1):
                best = (run, k)
            run = k
    if best[1]:
        for column in zip(*cells[best[0] : best[1]], strict=True):
            centres = [(a + b) * 0.5 for a, b in column]
            if max(centres) - min(centres) > (median(b - a for a, b in column) or 1.0) * COLUMN_DRIFT:
                best = (0, 0)
                break
    out = [0] * n
    rest = sorted((k for k in range(n) if not best[0] <= k < best[1]), key=lambda k: (tops[k], k))
    gap = (median(bottoms[k] - tops[k] for k in rest) or 1.0) * PARAGRAPH_GAP if rest else 0.0
    region = 1
    for before, k in zip([None, *rest], rest, strict=False):
        region += before is not None and tops[k] - bottoms[before] > gap
        out[k] = region
    return out


def _layout(lines: Column) -> Column:
    @F.arrow_udf("array<int>")
    def run(pages: pa.Array) -> pa.Array:
        out = [layout([x["y0"] for x in p], [x["y1"] for x in p], [[(c["x0"], c["x1"]) for c in x["cells"]] for x in p]) for p in pages.to_pylist()]
        return pa.array(out, pa.list_(pa.int32()))

    return run(F.transform(lines, lambda x: F.struct(x["y0"].alias("y0"), x["y1"].alias("y1"), F.transform(x["cells"], lambda c: F.struct(c["bbox"]["x0"].alias("x0"), c["bbox"]["x1"].alias("x1"))).alias("cells"))))


def regions_of(chars: DataFrame) -> DataFrame:
    """The native regions of each page: the table first, then paragraphs of the lines that it leaves.

    One shuffle, by page: words, cells, lines and regions are all made where the page is, and nothing is read twice.
    """
    cell = F.struct("cell_seq", "text", F.lit(None).cast("double").alias("confidence"), F.struct("x0", "y0", "x1", "y1").alias("bbox"))
    line = cells(line_numbers(words(chars))).groupBy(*KEY, "line_seq").agg(F.array_sort(F.collect_list(cell)).alias("cells"), *box())
    each = F.struct("line_seq", "x0", "y0", "x1", "y1", "cells", F.array_join(F.transform("cells", lambda c: c["text"]), " ").alias("text"))
    page = line.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("line_seq", each.alias("line"))), lambda a, b: a["line_seq"] - b["line_seq"]).alias("lines"))
    page = page.withColumn("lines", F.transform("lines", lambda x: x["line"])).withColumn("region", _layout(F.col("lines")))
    flat = page.select(*KEY, F.explode(F.arrays_zip("lines", "region")).alias("z")).select(*KEY, "z.lines.*", "z.region")
    row = F.transform("cells", lambda c: F.struct(c["text"].alias("text"), c["confidence"].alias("confidence"), c["bbox"].alias("bbox")))
    grid = F.array_sort(F.collect_list(F.when(F.col("region") == 0, F.struct("line_seq", row.alias("cells")))), lambda a, b: a["line_seq"] - b["line_seq"])
    prose = F.array_sort(F.collect_list(F.when(F.col("region") > 0, F.struct("y0", "line_seq", "text"))))
    found = flat.groupBy(*KEY, "region").agg(grid.alias("grid"), prose.alias("prose"), *box())
    table = F.col("region") == 0
    found = found.withColumns({
        "text": F.array_join(F.transform("prose", lambda p: p["text"]), "\n"), "role": F.when(table, "table").otherwise("unknown"), "source": F.lit("native"),
        "table_grid": F.when(table, F.struct(F.transform("grid", lambda r: r["cells"]).alias("rows"))),
        "seq": (F.row_number().over(Window.partitionBy(*KEY).orderBy("region")) - 1).cast("int"),
    })
    return as_regions(found)


def pages_of(chars: DataFrame, pages: DataFrame) -> DataFrame:
    """pages with has_text_layer: whether any glyph stands on them."""
    some = chars.select(*KEY).distinct().withColumn("has_text_layer", F.lit(True))
    return pages.drop("has_text_layer").join(some, KEY, "left").withColumn("has_text_layer", F.coalesce("has_text_layer", F.lit(False)))
