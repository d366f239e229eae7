"""Regions to Markdown: one block per region, list items of a run in one block, blocks in order per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import grid_shape

DOC = ["doc_id"]


def paired_groups(regions: DataFrame) -> DataFrame:
    """(doc_id, group_id) of groups that have a figure and a caption, anywhere in the document."""
    grouped = regions.where(F.col("group_id").isNotNull())
    side = lambda role: grouped.where(F.col("role") == role).select(*DOC, "group_id")
    return side("figure").intersect(side("caption"))


def with_pairing(regions: DataFrame, pick: str = "first") -> DataFrame:
    """Adds paired (the group has both) and caption_text of the group's first or last caption."""
    w = Window.partitionBy("doc_id", "group_id")
    has = lambda role: F.max(F.when(F.col("role") == role, 1)).over(w).isNotNull()
    caption = F.when(F.col("role") == "caption", F.struct("page_index", "seq", "text"))
    chosen = (F.min if pick == "first" else F.max)(caption).over(w)
    grouped = F.col("group_id").isNotNull()
    return regions.withColumns({"paired": grouped & has("figure") & has("caption"), "caption_text": F.when(grouped, chosen["text"])})


def rendered() -> Column:
    """Regions that give a block: headers and footers never do, a caption beside its figure doesn't."""
    return ~((F.col("role") == "header_footer") | ((F.col("role") == "caption") & F.col("paired")))


def table_block(form: str = "NFC") -> Column:
    """The grid as a pipe table; cells' text is in `cells` (rows of normalised strings). Empty: ''."""
    n_rows, n_cols = grid_shape(F.col("table_grid"))
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    rows = F.transform("cells", lambda r: line(F.concat(F.transform(r, text.escape_cell), F.array_repeat(F.lit(""), F.greatest(n_cols - F.size(r), F.lit(0))))))
    rule = line(F.array_repeat(F.lit("---"), n_cols))
    whole = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.greatest(n_rows, F.lit(1)))), "\n")
    note = F.when(F.coalesce("merged_cells", F.lit(False)), F.lit("<!-- v1: merged cells flattened -->\n")).otherwise("")
    return F.when((n_rows == 0) | (n_cols == 0), "").otherwise(F.concat(note, whole))


_CELL_END, _ROW_END = "\x1e", "\x1d"


def joined_cells() -> Column:
    """All cell texts of the grid as one string: normalising it is one call a region, outside any lambda."""
    rows = F.transform("table_grid.rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c["text"], F.lit(""))), _CELL_END))
    return F.coalesce(F.array_join(rows, _ROW_END), F.lit(""))


def split_cells(joined: Column) -> Column:
    """Rows of cell texts; a row without cells is one of a blank cell, as wide as a padded one."""
    return F.transform(F.split(joined, _ROW_END, -1), lambda r: F.split(r, _CELL_END, -1))


def with_cells(regions: DataFrame, form: str = "NFC") -> DataFrame:
    joined = regions.withColumn("_joined", text.normalised(joined_cells(), form))
    return joined.withColumn("cells", split_cells(F.col("_joined"))).drop("_joined")


def blocks(regions: DataFrame, form: str = "NFC", apply_bidi: bool = True) -> DataFrame:
    """(doc_id, page_index, seq, role, block): block null where a region renders nothing."""
    # one shuffle, by document: groups and runs of a document stay where it is
    base = with_pairing(regions.withColumn("text", F.coalesce("text", F.lit(""))).repartition("doc_id"))
    base = base.withColumn("plain", text.normalised(F.col("text"), form)).withColumn("alt", text.normalised(F.coalesce("caption_text", F.lit("")), form))
    base = with_cells(base, form)
    said = text.with_rlm(F.col("plain")) if apply_bidi else F.col("plain")
    base = base.withColumn("said", said)
    page = (F.col("page_index") + 1).cast("string")
    s = F.col("said")
    level = F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("heading_level", F.lit(2))))
    caption = text.strip(s)
    alt = F.when(text.strip(F.col("alt")) != "", text.strip(F.col("alt"))).otherwise(F.concat(F.lit("figure on page "), page))
    body = text.strip(text.escape_paragraph(text.without_marker(s, F.col("list_marker.raw_marker"))))
    ordered = (F.col("list_marker.kind") == "ordered") & F.col("list_marker.ordinal").isNotNull()
    role = F.col("role")
    block = (
        F.when(role == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text.escape_inline(text.strip(s))))
        .when(role == "list_item", F.concat(F.when(ordered, F.concat(F.col("list_marker.ordinal").cast("string"), F.lit(". "))).otherwise("- "), body))
        .when(role == "caption", F.when(caption != "", F.concat(F.lit("*"), text.escape_inline(caption), F.lit("*"))).otherwise(""))
        .when(role == "figure", F.concat(F.lit("!["), text.escape_alt(alt), F.lit("](#)")))
        .when(role == "table", table_block(form))
        .when(role == "failure_placeholder", F.concat(F.lit("<!-- transcription-failed: page "), page, F.lit(" reason: "), F.replace(F.when(F.coalesce("failure_reason", F.lit("")) != "", F.col("failure_reason")).otherwise("unknown"), F.lit("--"), F.lit("- -")), F.lit(" -->")))
        .otherwise(text.escape_paragraph(s))
    )
    return base.select("doc_id", "page_index", "seq", "role", F.when(rendered(), block).alias("block"))


def list_runs(rows: DataFrame) -> DataFrame:
    """Adds run: consecutive list items of a document share one; every other region is a run of its own."""
    w = Window.partitionBy("doc_id").orderBy("page_index", "seq")
    item = F.col("role") == "list_item"
    opens = F.coalesce(~(item & (F.lag("role").over(w) == "list_item")), F.lit(True)).cast("int")
    return rows.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("opens")


def markdown(regions: DataFrame, form: str = "NFC", apply_bidi: bool = True) -> DataFrame:
    """(doc_id, markdown) for every document that has regions; '' where nothing renders."""
    runs = list_runs(blocks(regions, form, apply_bidi))
    some = F.when(F.col("block") != "", F.struct("page_index", "seq", "block"))
    run = runs.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(some)).alias("parts"))
    run = run.withColumn("block", F.array_join(F.transform("parts", lambda p: p["block"]), "\n"))
    doc = run.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.size("parts") > 0, F.struct("run", "block")))).alias("blocks"))
    return doc.select("doc_id", F.when(F.size("blocks") > 0, F.concat(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"), F.lit("\n"))).otherwise("").alias("markdown"))


def sidecar(regions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(doc_id, json): page counts and a line for each region, keys sorted."""
    from .transcribe import document_counts

    one = F.struct("confidence", "failure_reason", "page_index", "role", "source", F.char_length(F.coalesce("text", F.lit(""))).alias("text_len"))
    per = regions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "seq", one.alias("r")))).alias("rows"))
    doc = document_counts(outcomes).join(per, "doc_id", "left")
    rows = F.coalesce(F.transform("rows", lambda x: x["r"]), F.array().cast("array<struct<confidence:double,failure_reason:string,page_index:int,role:string,source:string,text_len:int>>"))
    return doc.select("doc_id", F.to_json(F.struct("failed_pages", "n_pages", "ok_pages", rows.alias("regions")), {"ignoreNullFields": "false"}).alias("json"))
