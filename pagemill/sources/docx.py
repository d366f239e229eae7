"""Word files: OOXML parts written straight into a ZIP, one document a row. No other library.

The walk over regions is a DataFrame: each becomes a row with a style, its text
and whether a page break stands before it.  Only putting XML together is
Python, inside mapInArrow, and files come back as (doc_id, content).
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import kept
from ..operators.emit import rendered, with_cells, with_pairing
from ..schemas import grid_shape

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_STYLES = ("Normal", *(f"Heading {k}" for k in range(1, 10)), "List Bullet", "List Number", "Quote")


def walk(regions: DataFrame, form: str = "NFC", apply_bidi: bool = True, page_breaks: bool = True) -> DataFrame:
    """(doc_id, page_index, seq, kind, style, text, cells, n_cols, note, breaks): what the writer puts down, in order.

    A break stands before the first row after the page changes; a table that
    is empty is nothing but still uses it up.
    """
    return _walked(regions, form, apply_bidi, page_breaks).where("kind <> 'none'")


def _walked(regions: DataFrame, form: str, apply_bidi: bool, page_breaks: bool) -> DataFrame:
    """The rows of walk and, of kind none, those that put nothing down; a document's rows are in one partition."""
    base = with_pairing(regions.withColumn("text", F.coalesce("text", F.lit(""))).repartition("doc_id"), pick="last").withColumn("shown", F.coalesce(rendered(), F.lit(False)))
    role, page = F.col("role"), (F.col("page_index") + 1).cast("string")
    raw = F.when(role == "list_item", text.without_marker(F.col("text"), F.col("list_marker.raw_marker"))).otherwise(F.col("text"))
    base = with_cells(base, form)
    base = base.withColumn("plain", text.normalised(raw, form)).withColumn("caption_text", F.when(F.col("paired"), text.strip(text.normalised(F.coalesce("caption_text", F.lit("")), form))))
    said = text.with_rlm(F.col("plain")) if apply_bidi else F.col("plain")
    level = F.least(F.lit(9), F.greatest(F.lit(1), F.coalesce("heading_level", F.lit(2)))).cast("string")
    style = F.when(role == "heading", F.concat(F.lit("Heading "), level)).when(role == "list_item", F.when(F.col("list_marker.kind") == "ordered", "List Number").otherwise("List Bullet")).when(role == "failure_placeholder", "Quote").otherwise("Normal")
    figure = F.concat(F.lit("Figure on page "), page, F.when(F.coalesce("caption_text", F.lit("")) != "", F.concat(F.lit(": "), F.col("caption_text"))).otherwise(""))
    failure = F.concat(F.lit("Transcription failed (page "), page, F.lit("): "), text.failure_reason(F.when(F.coalesce("failure_reason", F.lit("")) != "", F.col("failure_reason")).otherwise("unknown")))
    body = F.when(role == "figure", figure).when(role == "failure_placeholder", failure).when(role == "table", "").otherwise(said)
    w = Window.partitionBy("doc_id").orderBy("page_index", "seq")
    # of shown rows only, a null page among them
    last = F.last(F.when(F.col("shown"), F.struct("page_index")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.coalesce(last["page_index"] != F.col("page_index"), F.lit(False)) & F.lit(page_breaks)
    n_rows, n_cols = grid_shape(F.col("table_grid"))
    kind = F.when(~F.col("shown"), "none").when(role == "table", F.when((n_rows == 0) | (n_cols == 0), "empty").otherwise("table")).when(role == "caption", "italic").otherwise("paragraph")
    return base.select("doc_id", "page_index", "seq", kind.alias("kind"), style.alias("style"), body.alias("text"), "cells", n_cols.alias("n_cols"), F.coalesce("merged_cells", F.lit(False)).alias("note"), breaks.alias("breaks"))


def _run(t: str, rtl: bool, italic: bool = False) -> str:
    clean = escape("".join(c for c in t if c in "\t\n\r" or ord(c) >= 32))
    inner = "<w:br/>".join(f'<w:t xml:space="preserve">{part}</w:t>' for part in clean.split("\n"))
    marks = "<w:i/>" * italic + "<w:rtl/>" * rtl
    return f"<w:r>{f'<w:rPr>{marks}</w:rPr>' if marks else ''}{inner}</w:r>"


def _paragraph(t: str, style: str, rtl: bool, breaks: bool = False, italic: bool = False) -> str:
    marks = f'<w:pStyle w:val="{style.replace(" ", "")}"/>' + "<w:pageBreakBefore/>" * breaks + '<w:bidi/><w:jc w:val="right"/>' * rtl
    return f"<w:p><w:pPr>{marks}</w:pPr>{_run(t, rtl, italic) if t else ''}</w:p>"


def _table(cells: list[list[str]], n_cols: int, rtl: bool) -> str:
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(r[k] if k < len(r) else '', 'Normal', rtl)}</w:tc>" for k in range(n_cols)) + "</w:tr>" for r in cells)
    return f"<w:tbl><w:tblPr>{'<w:bidiVisual/>' * rtl}</w:tblPr><w:tblGrid>{'<w:gridCol/>' * n_cols}</w:tblGrid>{rows}</w:tbl>"


def _row_xml(r: dict, rtl: bool) -> str:
    if r["kind"] not in ("table", "empty"):
        return _paragraph(r["text"], r["style"], rtl, r["breaks"], r["kind"] == "italic")
    before = _paragraph("", "Normal", rtl, breaks=True) if r["breaks"] else ""
    if r["kind"] == "empty":
        return before
    note = _paragraph("(v1: merged cells flattened)", "Normal", rtl) if r["note"] else ""
    return before + note + _table(r["cells"], r["n_cols"], rtl)


def document_xml(rows: list[dict], rtl: bool = True) -> str:
    return _whole("".join(_row_xml(r, rtl) for r in rows))


def _whole(body: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_W}"><w:body>{body}<w:sectPr/></w:body></w:document>'


def package(xml: str) -> bytes:
    """The same bytes for the same text: members have a fixed date and order."""
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{s.replace(" ", "")}"><w:name w:val="{s}"/></w:style>' for s in _STYLES)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{link}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{link}/styles" Target="styles.xml"/></Relationships>',
        "word/styles.xml": f'{head}<w:styles xmlns:w="{_W}">{styles}</w:styles>',
        "word/document.xml": xml,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), part)
    return out.getvalue()


#: Rows that are Python objects at a time, and bytes of files in one batch.
SLICE_ROWS, SLICE_BYTES = 500, 1 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _files(batches: Iterator[pa.RecordBatch], rtl: bool) -> Iterator[pa.RecordBatch]:
    """A file for each run of rows with one doc_id."""
    ids, files, last, parts = [], [], None, None

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(files, pa.binary())], ["doc_id", "content"])
        ids.clear()
        files.clear()
        return batch

    def end() -> None:
        ids.append(last)
        files.append(package(_whole("".join(parts))))

    for batch in slices(batches):
        for r in batch.to_pylist():
            if parts is None or r["doc_id"] != last:
                if parts is not None:
                    end()
                    if sum(map(len, files)) >= SLICE_BYTES:
                        yield out()
                last, parts = r["doc_id"], []
            if r["kind"] != "none":
                parts.append(_row_xml(r, rtl))
    if parts is not None:
        end()
        yield out()


def docx(regions: DataFrame, form: str = "NFC", apply_bidi: bool = True, rtl: bool = True, page_breaks: bool = True) -> DataFrame:
    """(doc_id, content): a Word file for every document that has regions.

    Rows stream through a task in order; of its documents it holds the parts of one, and files of SLICE_BYTES.
    """
    rows = _walked(regions, form, apply_bidi, page_breaks).withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.sortWithinPartitions(*rows.columns).mapInArrow(lambda b: _files(b, rtl), "doc_id string, content binary")


def write_text(markdown: DataFrame, folder: str) -> DataFrame:
    """One Markdown file a document into a folder on a store that all executors share, written where the document is.

    (doc_id, path, n_bytes) of what was written; a file is named by a hash of doc_id, so a task that runs again writes
    the same one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files_of(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                content, name = r["markdown"].encode(), f"{hashlib.sha256(r['doc_id'].encode()).hexdigest()[:16]}.md"
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
                rows.append((r["doc_id"], f"{folder}/{name}", len(content)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "path", "n_bytes"])

    return kept(markdown.select("doc_id", F.coalesce("markdown", F.lit("")).alias("markdown")).mapInArrow(run, "doc_id string, path string, n_bytes long"))


def files_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path there) of a path as Spark has it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
