"""More registered queries: emission with every role, Word files, events, whole runs, sources and settings, with their SQL.

Stand-ins for decoders, rasterisers and recognisers live here, as queries need some that any worker can import.
"""

from __future__ import annotations

import io
import json
import os
import tempfile
import uuid
import zipfile
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .. import backends, cli, config
from ..functions import text
from ..functions.numbers import scale
from ..lineage import shared
from ..operators import audit, emit, extract, recognise, roles, transcribe, validate
from ..schemas import CELL, GRID, as_regions, with_meta
from ..sources import documents, docx
from ..streaming import progress
from .catalogue import _ALIGN, _CELLS, _G, _INLINE, _KEYED, _LINES, _SIG, H, KEY, W, _as_words, _boxes, _query, _table, _texts

# -- Every role ------------------------------------------------------------------

_ALL = "CASE seq % 8 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list_item' WHEN 3 THEN 'table' WHEN 4 THEN 'failure_placeholder' WHEN 5 THEN 'header_footer' WHEN 6 THEN 'caption' ELSE 'figure' END"


def _every_role(spark, sf):
    cell = lambda t: F.struct(t.alias("text"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast(CELL["bbox"].dataType).alias("bbox"))
    grid = F.struct(F.array(F.array(cell(F.col("text")), cell(F.lit("a|b"))), F.array(cell(F.lit("x\ny")))).alias("rows")).cast(GRID)
    g = _boxes(spark, sf).withColumn("role", F.expr(_ALL))
    table = F.col("role") == "table"
    return as_regions(g.withColumns({
        "heading_level": F.when(F.col("role") == "heading", (F.col("x0") % 9).cast("int")), "table_grid": F.when(table & (F.col("x0") % 5 != 1), grid), "merged_cells": F.when(table, F.col("x0") % 2 == 0),
        "list_marker": F.when((F.col("role") == "list_item") & (F.col("x0") % 2 == 0), F.struct(F.lit("ordered").alias("kind"), F.col("x0").cast("long").alias("ordinal"), F.lit("item").alias("raw_marker"))),
        "failure_reason": F.when((F.col("role") == "failure_placeholder") & (F.col("x0") % 3 != 0), F.lit("bad -- thing")),
    }))


_E = f"e AS (SELECT doc_id, page_index, seq, {_ALL} AS role, x0, CAST(x0 AS BIGINT) AS k, text, {_INLINE.format(t='text')} AS esc FROM g)"
_CELL_TEXT = "replace(esc, '|', '\\|')"


@_query(f"""WITH {_G}, {_E} SELECT doc_id, page_index, seq, role, CASE role
  WHEN 'heading' THEN repeat('#', least(6, greatest(1, k % 9))) || ' ' || esc
  WHEN 'list_item' THEN CASE WHEN k % 2 = 0 THEN k || '. ' || {_INLINE.format(t='substring(text, 6)')} ELSE '- ' || esc END
  WHEN 'table' THEN CASE WHEN k % 5 = 1 THEN '' ELSE CASE WHEN k % 2 = 0 THEN '<!-- v1: merged cells flattened -->' || chr(10) ELSE '' END || '| ' || {_CELL_TEXT} || ' | a\\|b |' || chr(10) || '| --- | --- |' || chr(10) || '| x<br>y |  |' END
  WHEN 'failure_placeholder' THEN '<!-- transcription-failed: page ' || (page_index + 1) || ' reason: ' || CASE WHEN k % 3 = 0 THEN 'unknown' ELSE 'bad - - thing' END || ' -->'
  WHEN 'caption' THEN '*' || esc || '*' WHEN 'figure' THEN '![figure on page ' || (page_index + 1) || '](#)' WHEN 'paragraph' THEN esc END AS block FROM e""")
def emit_every_role(spark, sf):
    """The block of every region, tables, failures and headers among them."""
    return emit.blocks(_every_role(spark, sf))


_P = "'<w:p><w:pPr><w:pStyle w:val=\"' || {style} || '\"/>' || CASE WHEN {breaks} THEN '<w:pageBreakBefore/>' ELSE '' END || '<w:bidi/><w:jc w:val=\"right\"/></w:pPr>' || {run} || '</w:p>'"
_R = "'<w:r><w:rPr>' || {italic} || '<w:rtl/></w:rPr><w:t xml:space=\"preserve\">' || {t} || '</w:t></w:r>'"


def _p(style: str, t: str | None, breaks: str = "false", italic: str = "''") -> str:
    return _P.format(style=style, breaks=breaks, run=_R.format(italic=italic, t=t) if t else "''")


_TC = lambda t: f"'<w:tc>' || {_p(chr(39) + 'Normal' + chr(39), t)} || '</w:tc>'"


@_query(f"""WITH {_G}, {_E}, v AS (SELECT *, coalesce(lag(page_index) OVER (PARTITION BY doc_id ORDER BY page_index, seq) <> page_index, false) AS breaks FROM e WHERE role <> 'header_footer'),
w AS (SELECT *, CASE role WHEN 'heading' THEN 'Heading' || least(9, greatest(1, k % 9)) WHEN 'list_item' THEN CASE WHEN k % 2 = 0 THEN 'ListNumber' ELSE 'ListBullet' END WHEN 'failure_placeholder' THEN 'Quote' ELSE 'Normal' END AS style,
  CASE role WHEN 'list_item' THEN CASE WHEN k % 2 = 0 THEN substring(text, 6) ELSE text END WHEN 'figure' THEN 'Figure on page ' || (page_index + 1)
  WHEN 'failure_placeholder' THEN 'Transcription failed (page ' || (page_index + 1) || '): ' || CASE WHEN k % 3 = 0 THEN 'unknown' ELSE 'bad -- thing' END ELSE text END AS said FROM v),
x AS (SELECT doc_id, page_index, seq, CASE WHEN role <> 'table' THEN {_p('style', 'said', 'breaks', "CASE role WHEN 'caption' THEN '<w:i/>' ELSE '' END")}
  ELSE CASE WHEN breaks THEN {_p("'Normal'", None, 'true')} ELSE '' END || CASE WHEN k % 5 = 1 THEN '' ELSE CASE WHEN k % 2 = 0 THEN {_p("'Normal'", "'(v1: merged cells flattened)'")} ELSE '' END
  || '<w:tbl><w:tblPr><w:bidiVisual/></w:tblPr><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid><w:tr>' || {_TC('text')} || {_TC("'a|b'")} || '</w:tr><w:tr>' || {_TC("'x</w:t><w:br/><w:t xml:space=\"preserve\">y'")} || {_TC(None)} || '</w:tr></w:tbl>' END END AS part FROM w)
SELECT doc_id, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' || coalesce(string_agg(part, '' ORDER BY page_index, seq), '') || '<w:sectPr/></w:body></w:document>' AS xml
FROM (SELECT DISTINCT doc_id FROM e) LEFT JOIN x USING (doc_id) GROUP BY 1""")
def docx_every_role(spark, sf):
    """The main part of every document's Word file."""

    def main_part(batches):
        for batch in docx.slices(batches):
            xml = [zipfile.ZipFile(io.BytesIO(f)).read("word/document.xml").decode() for f in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(xml, pa.string())], ["doc_id", "xml"])

    return docx.docx(_every_role(spark, sf)).mapInArrow(main_part, "doc_id string, xml string")


# -- Text ---------------------------------------------------------------------------


@_query("""SELECT doc_id, k, t AS text FROM (SELECT doc_id, unnest([0, 1, 2, 3]) AS k, unnest(['  ' || plain, plain, '٣) ' || plain, plain]) AS t FROM (SELECT doc_id, trim(translate(text, '-' || chr(8226) || chr(8211) || chr(8212) || chr(10), '     ')) AS plain FROM documents))""")
def without_markers(spark, sf):
    """Texts without the marker that they start with; a marker that isn't there takes nothing away."""
    plain = F.trim(F.translate("text", "-•–—\n", "     "))
    d = _texts(spark, sf).select("doc_id", plain.alias("plain"))
    both = lambda t, m: F.struct(t.alias("t"), m.alias("m"))
    cases = F.array(both(F.concat(F.lit("  - "), "plain"), F.lit("-")), both(F.concat(F.lit("12. "), "plain"), F.lit("12.")), both(F.concat(F.lit("٣) "), "plain"), F.lit("•")), both(F.col("plain"), F.lit(None).cast("string")))
    return d.select("doc_id", F.posexplode(cases).alias("k", "c")).select("doc_id", "k", text.without_marker(F.col("c.t"), F.col("c.m")).alias("text"))


@_query("SELECT doc_id, substring(sha256(text || '|' || lang || '|200'), 1, 16) AS key FROM documents")
def cache_keys(spark, sf):
    return _texts(spark, sf).select("doc_id", text.cache_key(F.col("text"), F.col("lang"), F.lit("200")).alias("key"))


@_query("SELECT doc_id, translate(text, '$<' || chr(92), '') || chr(10) || 'x' AS text FROM documents")
def recognised_lines(spark, sf):
    """Lines of a recogniser as one text without formula marks."""
    d = _texts(spark, sf).select("doc_id", F.translate("text", "$<\\", "").alias("plain"))
    return d.select("doc_id", text.joined_lines(F.concat(F.split("plain", "\n", -1), F.array(F.lit("<math>x</math>")))).alias("text"))


# -- Boxes ----------------------------------------------------------------------------


@_query(f"WITH RECURSIVE {_G}, {_LINES} SELECT r.doc_id, r.page_index, CAST(pos - 1 AS INT) AS line_seq, string_agg(text, ' ' ORDER BY r.seq) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r JOIN g ON g.doc_id = r.doc_id AND g.page_index = r.page_index AND g.seq = r.seq GROUP BY 1, 2, 3")
def line_boxes(spark, sf):
    return extract.lines(_as_words(_boxes(spark, sf))).select(*KEY, "line_seq", "text", "x0", "y0", "x1", "y1")


@_query(f"WITH {_G} SELECT doc_id, page_index, seq, CAST(greatest(0, CAST(x0 AS INT) - 4) AS INT) AS x0, CAST(greatest(0, CAST(y0 AS INT) - 4) AS INT) AS y0, CAST(least(612, CAST(x1 AS INT) + 4) AS INT) AS x1, CAST(least(792, CAST(y1 AS INT) + 4) AS INT) AS y1 FROM g")
def crop_boxes(spark, sf):
    return recognise.clipped(_boxes(spark, sf)).select(*KEY, "seq", "x0", "y0", "x1", "y1")


@_query(f"WITH {_G} SELECT DISTINCT doc_id, page_index, 0 AS seq, 1700.0e0 AS x1, 2200.0e0 AS y1, 'paragraph' AS role, 'ocr' AS source, '' AS text FROM g")
def full_pages(spark, sf):
    """The detector that takes a page as one region, at 200 dots an inch."""
    pages = _boxes(spark, sf).select(*KEY, "page_width", "page_height").distinct()
    return recognise.full_page(pages).select(*KEY, "seq", "x1", "y1", "role", "source", "text")


@_query(f"WITH {_G} SELECT doc_id, page_index, seq, x1 - x0 AS width, y1 - y0 AS height, (x1 - x0) * (y1 - y0) AS area, 'new' AS k, 'kept' AS j FROM g")
def region_changes(spark, sf):
    """Widths, heights, areas, and meta maps joined so that new keys win."""
    from ..schemas import area, height, width

    one, two = F.create_map(F.lit("k"), F.lit("old"), F.lit("j"), F.lit("kept")), F.create_map(F.lit("k"), F.lit("new"))
    g = _boxes(spark, sf).withColumn("meta", with_meta(one, two))
    return g.select(*KEY, "seq", width().alias("width"), height().alias("height"), area().alias("area"), F.col("meta")["k"].alias("k"), F.col("meta")["j"].alias("j"))


_UUID = "substring({h}, 1, 12) || '5' || substring({h}, 14, 3) || ['8', '9', 'a', 'b'][CAST('0x' || substring({h}, 17, 1) AS INT) % 4 + 1] || substring({h}, 18, 15)"
_LINKED = """fg AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY seq) AS k FROM g WHERE role = 'figure'),
cp AS (SELECT doc_id, page_index, list(struct_pack(s := seq, a := x0, b := x1, y := y0) ORDER BY seq) AS cs FROM g WHERE role = 'caption' GROUP BY 1, 2),
st AS (SELECT doc_id, page_index, 0::BIGINT AS k, []::INT[] AS used, NULL::INT AS f, NULL::INT AS c FROM cp
  UNION ALL SELECT st.doc_id, st.page_index, fg.k, CASE WHEN ch.c IS NULL THEN st.used ELSE list_append(st.used, ch.c) END, fg.seq, ch.c
  FROM st JOIN fg ON fg.doc_id = st.doc_id AND fg.page_index = st.page_index AND fg.k = st.k + 1 JOIN cp ON cp.doc_id = st.doc_id AND cp.page_index = st.page_index,
  LATERAL (SELECT list_sort(list_transform(list_filter(cp.cs, lambda x: NOT list_contains(st.used, x.s) AND x.b >= fg.x0 AND fg.x1 >= x.a AND x.y - fg.y1 >= 0 AND x.y - fg.y1 <= 792.0e0 * {fraction}), lambda x: struct_pack(dy := x.y - fg.y1, s := x.s)))[1].s AS c) ch),
nm AS (SELECT st.doc_id, st.page_index, st.f, st.c, lower(sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('figcap:' || st.page_index || ':' || g.x0 || ':' || g.y0))) AS h FROM st JOIN g ON g.doc_id = st.doc_id AND g.page_index = st.page_index AND g.seq = st.f WHERE st.c IS NOT NULL),
gr AS (SELECT doc_id, page_index, unnest([f, c]) AS seq, {uuid} AS group_id FROM nm)"""


@_query(f"WITH RECURSIVE {_G}, {_LINKED.format(fraction='0.25e0', uuid=_UUID.format(h='h'))} SELECT doc_id, page_index, seq, group_id FROM gr")
def caption_groups(spark, sf):
    """Names of the groups of figures and their captions: version-5 UUIDs of page and corner."""
    return roles.captions(as_regions(_boxes(spark, sf)).withColumn("page_height", F.lit(H)), 0.25).where("group_id IS NOT NULL").select(*KEY, "seq", "group_id")


_PRUNED = "CASE WHEN role IN ('paragraph', 'unknown') AND ((y0 + y1) * 0.5e0 < 792.0e0 * 0.05e0 OR (y0 + y1) * 0.5e0 > 792.0e0 - 792.0e0 * 0.05e0) THEN 'header_footer' ELSE role END"


@_query(f"WITH RECURSIVE {_G}, {_LINKED.format(fraction='0.05e0', uuid=_UUID.format(h='h'))} SELECT g.doc_id, g.page_index, g.seq, {_PRUNED} AS role, group_id FROM g LEFT JOIN gr ON gr.doc_id = g.doc_id AND gr.page_index = g.page_index AND gr.seq = g.seq")
def classified_pages(spark, sf):
    """Levels, lists, headers and footers, captions, in this order, over every page."""
    return roles.classify(as_regions(_boxes(spark, sf)).withColumns({"page_width": F.lit(W), "page_height": F.lit(H)})).select(*KEY, "seq", "role", "group_id")


# -- Runs -------------------------------------------------------------------------------


@_query(f"""WITH {_G} SELECT doc_id, page_index, seq, {_PRUNED} AS role, text, 'native' AS branch FROM g WHERE page_index % 2 = 0
UNION ALL SELECT DISTINCT doc_id, page_index, 0, 'paragraph', '', 'ml' FROM g WHERE page_index % 2 = 1 AND page_index % 5 <> 3
UNION ALL SELECT DISTINCT doc_id, page_index, 0, 'failure_placeholder', '', 'failed' FROM g WHERE page_index % 2 = 1 AND page_index % 5 = 3""")
def run_with_plug_ins(spark, sf):
    """A run whose validator, order and recogniser are given: even pages are taken as they are, of the others some give nothing."""
    g = _boxes(spark, sf)
    pages = g.select(*KEY, "page_width", "page_height").distinct().withColumn("has_text_layer", F.lit(True))

    def even(p, r):
        return p.select(*KEY, (F.col("page_index") % 2 == 0).alias("accept"), F.array().cast("array<string>").alias("reasons"))

    def seen(p):
        found = recognise.full_page(p.where("page_index % 5 <> 3"))
        return found.withColumns({"page_width": F.lit(1700.0), "page_height": F.lit(2200.0)})

    done = transcribe.transcribe(pages, as_regions(g), config.EngineConfig(), validator=even, recognise=seen, reorder=lambda r, rtl: r)
    return done.regions.join(done.outcomes, KEY).select(*KEY, "seq", "role", "text", "branch")


_JUDGED = f"""{_G}, {_SIG.replace(_KEYED, "t AS (SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY seq) AS text FROM g GROUP BY 1, 2)")},
ok AS (SELECT doc_id, page_index, len(reasons) = 0 AND page_index % 3 <> 2 AS accept FROM v)"""


@_query(f"""WITH {_JUDGED}, o AS (SELECT g.doc_id, g.source, {_PRUNED} AS role FROM g JOIN ok USING (doc_id, page_index) WHERE accept UNION ALL SELECT doc_id, 'ocr', 'header_footer' FROM ok WHERE NOT accept)
SELECT doc_id, source, role, count(*) AS n FROM o GROUP BY 1, 2, 3""")
def transcribe_documents(spark, sf):
    """The whole run: validation, routing, order, roles; pages that are rejected go to a full-page stand-in."""
    g = _boxes(spark, sf)
    pages = g.select(*KEY, "page_width", "page_height").distinct().withColumn("has_text_layer", F.col("page_index") % 3 != 2)
    result = transcribe.transcribe(pages, as_regions(g), config.EngineConfig(), recognise=lambda p: recognise.full_page(p).join(p.select(*KEY, "page_width", "page_height"), KEY))
    return result.regions.groupBy("doc_id", "source", "role").agg(F.count(F.lit(1)).alias("n"))


class BlankPages:
    """A rasteriser: some pages fail."""

    def render(self, doc_id: str, page_index: int, scale: float) -> np.ndarray:
        if page_index % 5 == 4:
            raise MemoryError
        if page_index % 5 == 3:
            raise RuntimeError("no page")
        return np.zeros((20, 30, 3), np.uint8)


class TwoRegions:
    """A detector: a figure above a paragraph."""

    def detect(self, image: np.ndarray, page_index: int) -> list[dict]:
        h, w = image.shape[:2]
        return [{"x0": 0.0, "y0": 0.0, "x1": float(w), "y1": h / 2, "role": "figure"}, {"x0": 0.0, "y0": h / 2, "x1": float(w), "y1": float(h), "role": "paragraph", "confidence": 0.5}]


class SizeReader:
    """A recogniser that reads the size of the region."""

    def transcribe(self, region: dict, image: np.ndarray) -> str:
        return f"${region['x1']:.0f}$ by {region['y1'] - region['y0']:.0f}"


@_query(f"""WITH {_G}, p AS (SELECT DISTINCT doc_id, page_index FROM g)
SELECT doc_id, page_index, k AS seq, ['figure', 'paragraph'][k + 1] AS role, ['', '30 by 10'][k + 1] AS text, NULL AS failure_reason FROM (SELECT *, unnest([0, 1]) AS k FROM p WHERE page_index % 5 < 3)
UNION ALL SELECT doc_id, page_index, NULL, NULL, NULL, CASE page_index % 5 WHEN 4 THEN 'out_of_memory' ELSE 'RuntimeError:no page' END FROM p WHERE page_index % 5 >= 3""")
def recognised_pages(spark, sf):
    """Rasterising, layout and recognition with stand-ins; a page that fails is a row that says why."""
    pages = _boxes(spark, sf).select(*KEY, "page_width", "page_height").distinct()
    return recognise.recogniser(BlankPages, TwoRegions, SizeReader)(pages).select(*KEY, "seq", "role", "text", "failure_reason")


@_query(f"""WITH {_G}, p AS (SELECT DISTINCT doc_id, page_index FROM g)
SELECT doc_id, page_index, k AS seq, ['figure', 'paragraph'][k + 1] AS role, ['', '30 by 10'][k + 1] AS text, NULL AS failure_reason FROM (SELECT *, unnest([0, 1]) AS k FROM p WHERE page_index % 5 < 3)
UNION ALL SELECT doc_id, page_index, NULL, NULL, NULL, CASE page_index % 5 WHEN 4 THEN 'out_of_memory' ELSE 'RuntimeError:no page' END FROM p WHERE page_index % 5 >= 3""")
def phased_pages(spark, sf):
    """The same in phases, each with a table of its own, so that a recogniser that fails repeats nothing before it."""
    pages = _boxes(spark, sf).select(*KEY, "page_width", "page_height").distinct()
    return recognise.phased(BlankPages, TwoRegions, SizeReader)(pages).select(*KEY, "seq", "role", "text", "failure_reason")


# -- Events --------------------------------------------------------------------------------

_SAID = "CASE event_id % 9 WHEN 0 THEN 'phase:start:ocr:5' WHEN 1 THEN 'start' WHEN 2 THEN 'rasterise' WHEN 3 THEN 'layout' WHEN 4 THEN concat('region:', CAST(event_id % 7 + 1 AS {s}), '/9:table') WHEN 5 THEN 'complete:native' WHEN 6 THEN 'failure:Type:msg' WHEN 7 THEN 'complete:ml' ELSE 'failure:' END"
_SEEN = f"e AS (SELECT event_id, CAST(user_id % 50 AS VARCHAR) AS doc_id, event_id % 40 AS page, event_id % 9 AS k, event_id % 7 + 1 AS r, {_SAID.format(s='VARCHAR')} AS event FROM events)"


def _events(spark, sf):
    e = _table(spark, sf, "events")
    return e.select("event_id", (F.col("user_id") % 50).cast("string").alias("doc_id"), (F.col("event_id") % 40).cast("int").alias("page_index"), F.lit(40).alias("total"), F.expr(_SAID.format(s="STRING")).alias("event"))


@_query(f"""WITH {_SEEN} SELECT 'page ' || (page + 1) || ' of 40 — ' || CASE k WHEN 1 THEN 'start' WHEN 3 THEN 'layout (ml)' WHEN 4 THEN 'region ' || r || '/9 (table)' WHEN 5 THEN 'complete (native)' WHEN 6 THEN 'FAILED: Type:msg' WHEN 7 THEN 'complete (ml)' ELSE 'FAILED: None' END AS value FROM e WHERE k NOT IN (0, 2)""")
def event_lines(spark, sf):
    return progress.as_text(progress.line_events(progress.parsed(_events(spark, sf))))


@_query(f"""WITH {_SEEN} SELECT '{{"page":' || (page + 1) || ',"of":40,"event":"' || ['start', 'x', 'layout', 'region', 'complete', 'failure', 'complete', 'failure'][k] || '","branch":' || CASE k WHEN 5 THEN '"native"' WHEN 7 THEN '"ml"' ELSE 'null' END || ',"reason":' || CASE k WHEN 6 THEN '"Type:msg"' ELSE 'null' END
|| CASE k WHEN 4 THEN ',"region":' || r || ',"of_regions":9,"role":"table"' ELSE '' END || '}}' AS value FROM e WHERE k NOT IN (0, 2)""")
def event_json(spark, sf):
    return progress.as_json(progress.line_events(progress.parsed(_events(spark, sf))))


@_query(f"WITH {_SEEN} SELECT doc_id, CAST(page AS INT) AS page_index FROM (SELECT DISTINCT doc_id, page FROM e) ANTI JOIN (SELECT DISTINCT doc_id, page FROM e WHERE k >= 5) USING (doc_id, page)")
def resumable_pages(spark, sf):
    """Pages of which no event says that they ended."""
    raw = _events(spark, sf)
    return progress.resumable(raw.select("doc_id", "page_index").distinct(), progress.finished_pages(progress.parsed(raw)))


@_query(f"WITH {_SEEN} SELECT doc_id, event_id FROM e WHERE event_id > 500 AND k = 0")
def phase_headers(spark, sf):
    """Replay after an event: the phase headers, which logs leave out."""
    return progress.after(progress.parsed(_events(spark, sf)), 500).where("event = 'phase' AND phase = 'ocr' AND count = 5").select("doc_id", "event_id")


@_query(f"WITH {_SEEN} SELECT doc_id, count(DISTINCT page) FILTER (k >= 5) AS finished, 40 AS of, bool_or(k = 0) AS any_phase FROM e GROUP BY 1")
def progress_bars(spark, sf):
    """What a display of two bars shows: pages finished of all, and the phase that runs."""
    return progress.bars(progress.parsed(_events(spark, sf))).select("doc_id", "finished", "of", F.col("phase").isNotNull().alias("any_phase"))


# -- Sources ----------------------------------------------------------------------------------


@_query("""SELECT 'item-' || item_id AS doc_id, CASE WHEN item_id % 7 = 1 THEN 'encrypted:password needed' WHEN item_id % 7 = 2 THEN 'corrupted:no pages' END AS error, CASE WHEN item_id % 7 IN (1, 2) THEN 0 ELSE length(text) END AS glyphs,
CASE WHEN item_id % 7 IN (1, 2) THEN NULL ELSE 800.0e0 - 10 - 12 END AS top FROM benchmark""")
def decoded_files(spark, sf):
    """Files through a decoder: glyphs from the top-left corner, and why a file could not be read."""

    @F.pandas_udf("binary")
    def as_file(item: pd.Series, body: pd.Series) -> pd.Series:
        def one(i, t):
            if i % 7 == 1:
                return b'"encrypted"'
            if i % 7 == 2:
                return b"7"
            return json.dumps([{"width": 600, "height": 800, "glyphs": [[c, k * 6, 10, k * 6 + 6, 22] for k, c in enumerate(t)]}]).encode()

        return pd.Series([one(i, t) for i, t in zip(item, body, strict=True)])

    b = _table(spark, sf, "benchmark")
    files = b.select(F.concat(F.lit("item-"), "item_id").alias("path"), as_file("item_id", "text").alias("content"))
    chars, _, errors = documents.glyph_tables(documents.decoded(files, documents.TableDecoder()))
    per = chars.groupBy("doc_id").agg(F.count(F.lit(1)).alias("glyphs"), F.max("y0").alias("top"))
    return files.select(F.col("path").alias("doc_id")).join(errors, "doc_id", "left").join(per, "doc_id", "left").select("doc_id", "error", F.coalesce("glyphs", F.lit(0)).alias("glyphs"), "top")


_WORDS = "w AS (SELECT CAST(item_id AS VARCHAR) AS doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word, unnest(range(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))) AS k, item_id % 3 = 0 AS grid FROM benchmark)"


@_query(f"""WITH {_WORDS}, l AS (SELECT doc_id, grid, k // 3 AS line, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM w GROUP BY 1, 2, 3),
t AS (SELECT doc_id, count(*) AS rows FROM l WHERE grid AND n = 3 GROUP BY 1 HAVING count(*) >= 3),
rest AS (SELECT l.*, line // 4 AS para FROM l LEFT JOIN t USING (doc_id) WHERE rows IS NULL OR n < 3),
p AS (SELECT doc_id, para, string_agg(text, chr(10) ORDER BY line) AS text FROM rest GROUP BY 1, 2)
SELECT doc_id, 'table' AS role, '' AS text, rows * 3 AS cells FROM t UNION ALL SELECT doc_id, 'unknown', text, 0 FROM p""")
def native_regions(spark, sf):
    """Glyphs to words, lines, tables and paragraphs: three words a line, four lines a paragraph, every third text a grid."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    b = _table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), (F.col("item_id") % 3 == 0).alias("grid"), F.posexplode(words).alias("k", "word"))
    n, line = F.char_length("word"), F.floor(F.col("k") / 3)
    # in a grid a word's middle is that of its column; else words follow each other closely
    left = F.when(F.col("grid"), (F.col("k") % 3) * 1000.0 - n * 0.5).otherwise((F.col("k") % 3) * 1000.0)
    pitch = F.when(F.col("grid"), F.lit(1.0)).otherwise(998.0 / n)
    top = line * 12.0 + F.when(F.col("grid"), 0.0).otherwise(F.floor(line / 4) * 30.0)
    glyph = b.select("doc_id", "page_index", "k", left.alias("left"), pitch.alias("pitch"), top.alias("top"), F.posexplode(F.split(F.concat("word", F.lit(" ")), "")).alias("j", "ch"))
    x = F.col("left") + F.col("j") * F.col("pitch")
    chars = glyph.withColumns({"char_seq": (F.col("k") * 10_000 + F.col("j")).cast("int"), "x0": x, "x1": x + F.col("pitch"), "y0": F.col("top"), "y1": F.col("top") + 10.0, "font_size": F.lit(10.0)})
    found = extract.regions_of(chars.select("doc_id", "page_index", "char_seq", "ch", "x0", "y0", "x1", "y1", "font_size"))
    cells = F.coalesce(F.aggregate(F.transform("table_grid.rows", F.size), F.lit(0), lambda a, n: a + n), F.lit(0))
    return found.select("doc_id", "role", "text", cells.cast("long").alias("cells"))


@_query("WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS t FROM documents), n AS (SELECT CAST(least(length(t), 12) AS INT) AS token_length, count(*) AS n FROM t GROUP BY 1) SELECT token_length, round(n / (SELECT sum(n) FROM n), 4) AS share FROM n")
def reference_file(spark, sf):
    """A reference distribution made from the corpus, written, and read back."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "lengths.json")
        documents.write_reference_lengths(validate.length_distribution(_texts(spark, sf)), path)
        read = documents.reference_lengths(path)
    return spark.createDataFrame(sorted(read.items()), "token_length int, share double")


# -- Settings and tools --------------------------------------------------------------------------


_REGION, _BLANK = {"x0": 0.0, "y0": 0.0, "x1": 4.0, "y1": 4.0, "role": "paragraph"}, np.zeros((8, 8, 3), np.uint8)
_ABSENT = {"absent": (lambda **_: None, ("no_such_library",))}


def _caused(inner: Exception) -> Exception:
    outer = ValueError("outer")
    outer.__cause__ = inner
    return outer


def _surya(failures: int):
    """A reader whose device runs out of memory so many times."""

    class Reader(backends.SuryaReader):
        seen: list = []
        text = ""

        def read(self, images):
            out = super().read(images)
            self.text = "|".join(out[0])
            return out

    reader = Reader(batch_size=8)
    reader.seen = []

    def recognise(images, **options):
        reader.seen.append(options["recognition_batch_size"])
        if len(reader.seen) <= failures:
            raise RuntimeError("CUDA out of memory")
        return [SimpleNamespace(text_lines=[SimpleNamespace(text="a"), SimpleNamespace(text="b")]) for _ in images]

    reader.tools, reader.picture = (recognise, None), lambda image: image
    return reader


def _easy():
    reader = backends.EasyReader("cpu")
    reader.reader = SimpleNamespace(readtext=lambda image, **options: [(0, "x"), (1, "y")])
    return reader


def _yolo():
    listed = lambda v: SimpleNamespace(tolist=lambda: v)
    found = SimpleNamespace(names={0: "title", 1: "odd"}, boxes=SimpleNamespace(xyxy=listed([[1, 2, 3, 4], [5, 6, 7, 8]]), cls=listed([0, 1]), conf=listed([0.9, 0.4])))
    layout = backends.YoloLayout("cpu")
    layout.model = SimpleNamespace(predict=lambda *args, **options: [found])
    return layout


def _outcome(call, *args) -> str:
    try:
        return str(call(*args))
    except config.TranscriptionError as e:
        return f"{type(e).__name__} {e.exit_code}"
    except ValueError:
        return "ValueError"


#: (setting, what it must come to), by hand.
_SETTINGS = (
    ("pages 1-3,7", "(0, 1, 2, 6)"), ("pages 2, 2 ,1", "(0, 1)"), ("pages 0", "ValueError"), ("pages 3-1", "ValueError"), ("pages none", "None"), ("format a.MD", "md"), ("format a.docx", "docx"), ("format a.docx/md", "FormatMismatch 4"), ("format /docx", "docx"), ("format a.txt", "md"),
    ("workers 3", "3"), ("workers 0", "ValueError"), ("dpi 0", "ValueError"), ("dpi 72", "72"), ("dpi from file", "96"), ("dpi option over file", "300"), ("device from file", "cpu"), ("dtype default", "auto"), ("batch 0", "ValueError"), ("docx without output", "FormatMismatch 4"),
    ("validator round trip", "True"), ("validator top level", "2.5"), ("encrypted", "EncryptedDocument 3"), ("corrupted", "CorruptedDocument 4"), ("model", "ModelUnavailable 5"), ("memory", "OutOfMemory 2"), ("recognition", "RecognitionError 2"),
    ("device cpu", "cpu"), ("device tpu", "ValueError"), ("dtype auto on cpu", "float32"), ("dtype auto on cuda", "float16"), ("dtype int8", "ValueError"), ("back end unknown", "ValueError"), ("back end without library", "None"), ("pair without library", "None"),
    ("prefetch without library", "ModelUnavailable 5"), ("decoder without library", "ModelUnavailable 5"), ("scale 144", "2.0"), ("scale 0", "ValueError"), ("memory error in a cause", "True"), ("other error", "False"),
    ("reader again at batch 1", "8 1 / a|b"), ("reader fails twice", "RecognitionError 2"), ("reader of regions", "x|y"), ("layout labels", "heading unknown"), ("released", "None"), ("progress quiet", "quiet"), ("progress json", "json"), ("progress text", "text"),
)


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SETTINGS) + ") AS t(setting, outcome)")
def settings(spark, sf):
    """Options, files and defaults, and what errors end with."""
    import tomllib

    def fail(kind):
        raise kind

    surya, again = _surya(1), _surya(2)
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "engine.toml")
        with open(path, "w") as f:
            f.write('[render]\ndpi = 96\n[runtime]\ndevice = "cpu"\n')
        made = config.ValidatorConfig(max_word_boundary_kl=2.5)
        back = config.ValidatorConfig.of(tomllib.loads(made.to_toml()))
        engine = lambda **o: config.engine_config(**o)
        calls = {
            "pages 1-3,7": lambda: config.parse_pages("1-3,7"), "pages 2, 2 ,1": lambda: config.parse_pages("2, 2 ,1"), "pages 0": lambda: config.parse_pages("0"), "pages 3-1": lambda: config.parse_pages("3-1"), "pages none": lambda: config.parse_pages(None),
            "format a.MD": lambda: config.output_format("a.MD", None), "format a.docx": lambda: config.output_format("a.docx", None), "format a.docx/md": lambda: config.output_format("a.docx", "md"), "format /docx": lambda: config.output_format(None, "docx"), "format a.txt": lambda: config.output_format("a.txt", None),
            "workers 3": lambda: config.workers("3"), "workers 0": lambda: config.workers(0), "dpi 0": lambda: engine(dpi=0), "dpi 72": lambda: engine(dpi=72).dpi, "dpi from file": lambda: engine(config=path).dpi, "dpi option over file": lambda: engine(config=path, dpi=300).dpi,
            "device from file": lambda: engine(config=path).device, "dtype default": lambda: engine(config=path).dtype, "batch 0": lambda: engine(batch_size=0), "docx without output": lambda: engine(format="docx"),
            "validator round trip": lambda: back == made, "validator top level": lambda: config.ValidatorConfig.of({"max_word_boundary_kl": 2.5, "other": 1}).max_word_boundary_kl,
            "encrypted": lambda: fail(config.EncryptedDocument), "corrupted": lambda: fail(config.CorruptedDocument), "model": lambda: fail(config.ModelUnavailable), "memory": lambda: fail(config.OutOfMemory), "recognition": lambda: fail(config.RecognitionError),
            "device cpu": lambda: backends.device("cpu"), "device tpu": lambda: backends.device("tpu"), "dtype auto on cpu": lambda: backends.dtype(None, "cpu"), "dtype auto on cuda": lambda: backends.dtype("auto", "cuda"), "dtype int8": lambda: backends.dtype("int8", "cpu"),
            "back end unknown": lambda: backends.build(backends.READERS, "other"), "back end without library": lambda: backends.build(_ABSENT, "absent"), "pair without library": lambda: backends.pair("full-page", "absent", readers=_ABSENT), "prefetch without library": lambda: backends.prefetch("full-page", "absent", readers=_ABSENT),
            "decoder without library": lambda: backends._load("no_such_library"), "scale 144": lambda: scale(144), "scale 0": lambda: scale(0), "memory error in a cause": lambda: backends.out_of_device_memory(_caused(RuntimeError("CUDA out of memory"))), "other error": lambda: backends.out_of_device_memory(_caused(KeyError("x"))),
            "reader again at batch 1": lambda: " ".join(map(str, (surya.transcribe(_REGION, _BLANK), surya.seen)[1])) + " / " + surya.text, "reader fails twice": lambda: again.transcribe(_REGION, _BLANK), "reader of regions": lambda: _easy().transcribe(_REGION, _BLANK).replace("\n", "|"),
            "layout labels": lambda: " ".join(r["role"] for r in _yolo().detect(_BLANK, 0)), "released": lambda: (surya.release(), surya.tools)[1], "progress quiet": lambda: cli.progress_mode(True, True), "progress json": lambda: cli.progress_mode(False, True), "progress text": lambda: cli.progress_mode(False, False),
        }
        rows = [(name, _outcome(call)) for name, call in calls.items()]
    return spark.createDataFrame(rows, "setting string, outcome string")


_MODELS = """[[models]]
name = "a"
revision = "1"
license = "MIT\\n"
stage = "ocr"
[[models]]
name = "b"
license = "GPL-3.0"
stage = "ocr"
[[models]]
revision = "2"
license = "one\\ntwo"
stage = "layout"
"""


@_query("""SELECT * FROM (VALUES ('model', 'b', 'missing required key revision'), ('model', 'b', 'license not allowed: GPL-3.0'), ('model', 'models[2]', 'missing required key name'), ('model', 'models[2]', 'license not understood')) AS t(kind, name, detail)
UNION ALL SELECT 'dist', 'n' || n_nationkey || '==1', CASE n_nationkey % 4 WHEN 1 THEN 'not allowed: GPL-3.0' ELSE 'no license found' END FROM nation WHERE n_nationkey % 4 IN (1, 3) AND n_nationkey <> 3 AND n_nationkey IN (SELECT CAST(substring(name, 2) AS INT) FROM
(WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'n' || ((n_nationkey * 2 + 1) % 25) AS b FROM nation UNION ALL SELECT 'n3', 'n8'), r(name) AS (SELECT 'n3' UNION SELECT e.b FROM r JOIN e ON e.a = r.name) SELECT name FROM r))""")
def whole_audit(spark, sf):
    """What is wrong with the distributions that a root needs and with a registry's models."""
    from .catalogue import _requirements

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "models.toml")
        with open(path, "w") as f:
            f.write(_MODELS.replace("\\\\n", "\\n"))
        models = documents.model_registry(spark, path)
    return audit.audit(_requirements(spark, sf), models, "n3", ("x",))


@_query(f"WITH {_G}, h AS (SELECT *, 0 AS line_seq FROM g), {_CELLS.format(src='h')}, {_ALIGN.format(src='cells')} SELECT doc_id, page_index, aligned, count(*) AS cells FROM al JOIN cells USING (doc_id, page_index) GROUP BY 1, 2, 3")
def one_line_grids(spark, sf):
    """Pages as one line of cells: how many, and whether their columns are aligned, which single cells always are."""
    c = extract.cells(_as_words(_boxes(spark, sf)).withColumn("line_seq", F.lit(0)))
    return extract.aligned(c, KEY).join(c.groupBy(*KEY).agg(F.count(F.lit(1)).alias("cells")), KEY).select(*KEY, "aligned", "cells")


# -- Files out, pictures, runs --------------------------------------------------------------------


@_query("""WITH d AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, string_agg('<!-- page ' || (turn + 1) || ' -->' || chr(10) || chr(10) || trim(text, ' ' || chr(10)), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1)
SELECT doc_id, CAST(strlen(markdown) AS BIGINT) AS n_bytes, markdown FROM d""")
def text_files(spark, sf):
    """A Markdown file a document, written by the tasks, and what stands in it."""
    from .catalogue import queries

    told = docx.write_text(queries()["assemble_crops"](spark, sf), f"{shared(spark)}/text-files-{uuid.uuid4().hex}")

    @F.pandas_udf("string")
    def content(paths: pd.Series) -> pd.Series:
        def one(path: str) -> str:
            store, where = docx.files_of(path)
            with store.open_input_stream(where) as f:
                return f.read().decode()

        return paths.map(one)

    return told.select("doc_id", "n_bytes", content("path").alias("markdown"))


@_query("""SELECT 'doc' || p_partkey AS doc_id, k AS page_index, layout, 'size' AS model, CASE layout WHEN 'full-page' THEN '$30$ by 20' ELSE chr(10) || chr(10) || '$30$ by 10' END AS text
FROM (SELECT p_partkey, unnest([0, 1, 2]) AS k FROM part), (SELECT unnest(['full-page', 'two']) AS layout)""")
def picture_survey(spark, sf):
    """Pages rendered once for equal contents, and every pair of back ends over the pictures."""
    pages = _table(spark, sf, "part").select(F.concat(F.lit("doc"), "p_partkey").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("page_index"), (F.col("p_partkey") % 5).cast("string").alias("digest"))
    folder = f"{shared(spark)}/survey-{uuid.uuid4().hex}"
    pictures = backends.cached_pictures(pages, BlankPages, f"{folder}/pictures")
    keyed = pictures.withColumn("key", F.concat_ws(":", "digest", "page_index"))
    found = backends.survey(keyed.select("key", "height", "width", "pixels").dropDuplicates(["key"]), ["full-page", "two"], ["size"], f"{folder}/runs", make=_stand_in)
    return keyed.select("doc_id", "page_index", "key").join(found, "key").select("doc_id", "page_index", "layout", "model", "text")


def _stand_in(registry: dict, name: str):
    return {"size": FigureSkipper, "two": TwoRegions}[name]() if name in ("size", "two") else backends.build(registry, name)


class FigureSkipper(SizeReader):
    def transcribe(self, region: dict, image: np.ndarray) -> str:
        return "" if region["role"] == "figure" else super().transcribe(region, image)


@_query("""SELECT * FROM (VALUES (0, 'phase:start:validate:3'), (0, 'start'), (1, 'start'), (2, 'start'), (0, 'phase:start:rasterise:2'), (0, 'phase:start:layout:2'), (0, 'phase:start:ocr:2'), (0, 'complete:native'), (1, 'complete:ml'), (2, 'failure:RuntimeError:dark')) AS t(page_index, event)""")
def events_of_a_run(spark, sf):
    """What a run over a file of three pages reports: one with text, one that is recognised, one that can't be."""
    words = "this page has a layer of text which reads like any other page of words does".split()
    glyphs = [[c, 50 + 6 * (10 * k + j), 700, 56 + 6 * (10 * k + j), 710] for k, w in enumerate(words) for j, c in enumerate(w + " ")]
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "three.json")
        with open(path, "w") as f:
            json.dump([{"width": 612, "height": 792, "glyphs": g} for g in (glyphs, [], [])], f)
        rows: list = []
        cli.run(spark, path, config.EngineConfig(), rasteriser=DarkPages, tools=(TwoRegions, SizeReader), report=rows.extend)
    return spark.createDataFrame([(page, event) for _, page, _, event in rows], "page_index int, event string")


class DarkPages(BlankPages):
    def render(self, doc_id: str, page_index: int, scale: float) -> np.ndarray:
        if page_index == 2:
            raise RuntimeError("dark")
        return super().render(doc_id, page_index, scale)


@_query("SELECT 'pyspark' AS name, true AS has_version, true AS needs_py4j")
def installed_library(spark, sf):
    """The distributions of this installation, by one that is always among them."""
    d = documents.installed(spark).where("lower(name) = 'pyspark'").dropDuplicates(["name"])
    return d.select(F.lower("name").alias("name"), (F.col("version") != "0").alias("has_version"), F.exists("requires", lambda r: F.startswith(F.lower(r), F.lit("py4j"))).alias("needs_py4j"))
