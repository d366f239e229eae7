"""The registered queries of the core library, over whole tables, and their SQL.

The driver's tables hold no pages, so geometry comes from lineitem (a page is
an order, a region a line; all coordinates are whole numbers in doubles) and
damaged or right-to-left text from documents, the same way in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import parse_pages
from ..functions import numbers, text
from ..operators import audit, emit, extract, images, order, recognise, roles, transcribe, validate
from ..schemas import as_regions, from_json, to_json
from ..sources import docx
from ..streaming import progress

W, H = 612.0, 792.0
KEY = ["doc_id", "page_index"]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents, dealt out where the files have fewer splits than there are cores."""
    d, cores = _table(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    return d if d.rdd.getNumPartitions() >= cores else d.repartition(cores)


# -- Derived inputs, in both engines ------------------------------------------

_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_ROLE = "CASE l_linenumber % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'heading' WHEN 2 THEN 'caption' ELSE CASE l_returnflag WHEN 'R' THEN 'paragraph' WHEN 'A' THEN 'unknown' ELSE 'list_item' END END"
_TEXT = "concat('item ', CAST(l_partkey AS {s}), ' | _', l_returnflag, CAST(l_linenumber AS {s}), '_ [x]')"
_BOXED = """
SELECT CAST(l_orderkey {div} 10 AS {s}) AS doc_id, CAST(l_orderkey % 10 AS INT) AS page_index,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {line}) - 1 AS INT) AS seq,
       CAST(l_partkey * 37 % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 53 % 700 AS DOUBLE) AS y0,
       CAST(l_partkey * 37 % 500 + 20 + l_partkey % 80 AS DOUBLE) AS x1, CAST(l_suppkey * 53 % 700 + 8 + l_linenumber * 7 % 30 AS DOUBLE) AS y1,
       {role} AS role, {text} AS text, CAST(l_quantity AS DOUBLE) AS size, l_returnflag AS flag
FROM {source}"""


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions; page_width and page_height beside them."""
    sql = _BOXED.format(div="div", s="STRING", line=_LINE, role=_ROLE, text=_TEXT.format(s="STRING"), source="{lines}")
    return spark.sql(sql, lines=_table(spark, sf, "lineitem")).withColumns({"page_width": F.lit(W), "page_height": F.lit(H), "source": F.when(F.col("flag") == "R", "native").otherwise("ocr"), "font_size": F.when(F.col("flag") == "A", F.col("size"))})


_G = "g AS (SELECT *, CASE flag WHEN 'R' THEN 'native' ELSE 'ocr' END AS source, CASE flag WHEN 'A' THEN size END AS font_size FROM (" + _BOXED.format(div="//", s="VARCHAR", line=_LINE, role=_ROLE, text=_TEXT.format(s="VARCHAR"), source="lineitem") + "))"


def _as_words(g: DataFrame) -> DataFrame:
    return g.select(*KEY, F.col("seq").alias("word_seq"), "text", "x0", "y0", "x1", "y1")


_ARABIC = "ابتثجحخد"
_SHAPED = "".join(chr(c) for c in (0xFE8D, 0xFE8F, 0xFE95, 0xFE99, 0xFE9D, 0xFEA1, 0xFEA5, 0xFEA9))
_DAMAGED = f"CASE doc_id % 4 WHEN 1 THEN translate(text, 'abcdefgh', '{_ARABIC}') WHEN 2 THEN replace(text, 'e', '�') WHEN 3 THEN translate(text, 'abcdefgh', '{_SHAPED}') ELSE text END"


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("doc_id", "lang", F.expr(_DAMAGED).alias("text"))


# documents are Latin, so DuckDB's \p{L} and Python's tables agree on them
_KEYED = f"t AS (SELECT doc_id, lang, {_DAMAGED} AS text FROM documents)"
_SIG = f"""
{_KEYED},
c AS (SELECT *, CAST(len(regexp_extract_all(text, '\\p{{L}}')) AS BIGINT) AS n_letters,
      CAST(len(regexp_extract_all(text, '[\\x{{600}}-\\x{{6FF}}]')) AS BIGINT) AS n_arabic,
      CAST(len(regexp_extract_all(text, '[\\x{{FB50}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFF}}]')) AS BIGINT) AS n_presentation,
      CAST(len(regexp_extract_all(regexp_replace(text, '\\s+', '', 'g'), '[^\\x00-\\x7F]|[A-Za-z0-9]|[\\x00-\\x08\\x0E-\\x1B\\x7F]')) AS BIGINT) AS n_glyphs,
      CAST(len(regexp_extract_all(text, '\\x{{FFFD}}')) AS BIGINT) AS n_replaced,
      list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS tokens FROM t),
l AS (SELECT *, list_transform(tokens, lambda x: least(length(x), 12)) AS lens FROM c),
s AS (SELECT * EXCLUDE (tokens, lens),
      CASE WHEN n_letters > 0 THEN n_arabic / n_letters ELSE 0.0e0 END AS arabic_codepoint_ratio,
      CASE WHEN n_glyphs > 0 THEN n_replaced / n_glyphs ELSE 0.0e0 END AS replacement_glyph_ratio,
      CASE WHEN n_arabic + n_presentation > 0 THEN n_presentation / (n_arabic + n_presentation) ELSE 0.0e0 END AS presentation_form_ratio,
      CASE WHEN len(lens) < 8 THEN 0.0e0 ELSE greatest(0.0e0, {" + ".join(
          f"(CASE WHEN list_contains(lens, {k}) THEN (len(list_filter(lens, lambda x: x = {k})) / len(lens)) * ln(((len(list_filter(lens, lambda x: x = {k})) / len(lens)) + 1e-9) / ({q}e0 + 1e-9)) ELSE 0.0e0 END)"
          for k, q in numbers.WORD_LENGTHS.items())}) END AS word_boundary_kl FROM l),
v AS (SELECT *, list_filter([
      CASE WHEN replacement_glyph_ratio > 0.05 THEN 'replacement_glyph_ratio' END,
      CASE WHEN n_letters = 0 AND replacement_glyph_ratio <= 0.05 THEN 'empty_text_layer' END,
      CASE WHEN n_arabic + n_presentation > 0 AND n_letters >= 30 AND arabic_codepoint_ratio < 0.5 THEN 'arabic_codepoint_ratio' END,
      CASE WHEN word_boundary_kl > 1.0 THEN 'word_boundary_kl' END,
      CASE WHEN n_arabic + n_presentation >= 30 AND presentation_form_ratio > 0.5 THEN 'presentation_form_ratio' END], lambda x: x IS NOT NULL) AS reasons FROM s)"""

_Q: dict = {}
_S: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        _Q[fn.__name__] = fn
        if sql:
            _S[fn.__name__] = sql
        return fn

    return add


# -- Validation ----------------------------------------------------------------


@_query(f"WITH {_G} SELECT doc_id, page_index, count(*) AS n, min(y0) AS top FROM g WHERE page_index IN (0, 1, 2, 6, 8) GROUP BY 1, 2")
def page_filter(spark, sf):
    """Page ranges of every document."""
    chosen = transcribe.select_pages(_boxes(spark, sf), parse_pages("1-3,7, 9,2"))
    return chosen.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("y0").alias("top"))


@_query("WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS t FROM documents), n AS (SELECT CAST(least(length(t), 12) AS INT) AS token_length, count(*) AS n FROM t GROUP BY 1) SELECT token_length, n, round(n / (SELECT sum(n) FROM n), 9) AS share FROM n")
def token_length_hist(spark, sf):
    return validate.length_distribution(_texts(spark, sf)).withColumn("share", F.round("share", 9))


@_query(f"WITH {_SIG} SELECT doc_id, n_letters, n_arabic, n_presentation, n_glyphs, n_replaced, round(arabic_codepoint_ratio, 6) AS arabic_codepoint_ratio, round(replacement_glyph_ratio, 6) AS replacement_glyph_ratio, round(presentation_form_ratio, 6) AS presentation_form_ratio FROM s")
def text_signals(spark, sf):
    s = validate.signals(_damaged(spark, sf))
    r = [F.round(c, 6).alias(c) for c in ("arabic_codepoint_ratio", "replacement_glyph_ratio", "presentation_form_ratio")]
    return s.select("doc_id", "n_letters", "n_arabic", "n_presentation", "n_glyphs", "n_replaced", *r)


@_query(f"WITH {_SIG} SELECT doc_id, round(word_boundary_kl, 6) AS kl FROM s")
def word_boundary_kl(spark, sf):
    return validate.counts(_damaged(spark, sf)).select("doc_id", F.round(numbers.lengths_divergence(F.col("lengths")), 6).alias("kl"))


def _judged(spark, sf):
    return validate.verdict(validate.signals(_damaged(spark, sf)).withColumn("has_text_layer", F.lit(True)))


@_query(f"WITH {_SIG} SELECT doc_id, len(reasons) = 0 AS accept, array_to_string(reasons, ',') AS reasons FROM v")
def validate_pages(spark, sf):
    names = F.array_join(F.transform("reasons", lambda r: F.element_at(F.split(r, " "), 1)), ",")
    return _judged(spark, sf).select("doc_id", "accept", names.alias("reasons"))


@_query(f"WITH {_SIG} SELECT lang, count(*) AS n_pages, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (list_contains(reasons, 'word_boundary_kl')) AS odd_words, count(*) FILTER (list_contains(reasons, 'replacement_glyph_ratio')) AS damaged FROM v GROUP BY 1")
def validate_summary(spark, sf):
    has = lambda name: F.count_if(F.exists("reasons", lambda r: F.startswith(r, F.lit(name))))
    return _judged(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("accept").alias("accepted"), has("word_boundary_kl").alias("odd_words"), has("replacement_glyph_ratio").alias("damaged"))


@_query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0 AS page_index, false AS accept, 'forced_ml_cli' AS reasons FROM documents")
def force_ml(spark, sf):
    pages = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page_index"))
    return validate.force_ml(pages).select("doc_id", "page_index", "accept", F.array_join("reasons", ",").alias("reasons"))


# -- Extraction ------------------------------------------------------------------


@_query(f"WITH {_G} SELECT doc_id, page_index, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY 1, 2")
def outer_bbox(spark, sf):
    return _boxes(spark, sf).groupBy(*KEY).agg(*extract.box())


@_query(f"WITH {_G} SELECT doc_id, page_index, median(y1 - y0) AS height FROM g GROUP BY 1, 2")
def page_median_height(spark, sf):
    return _boxes(spark, sf).groupBy(*KEY).agg(numbers.median_of(F.collect_list(F.col("y1") - F.col("y0"))).alias("height"))


@_query(f"WITH {_G} SELECT doc_id, page_index, y1 - y0 AS font_size, count(*) AS n FROM g GROUP BY 1, 2, 3")
def font_size_hist(spark, sf):
    return extract.font_histogram(_boxes(spark, sf).withColumn("font_size", F.col("y1") - F.col("y0")))


@_query("""WITH c AS (SELECT CAST(item_id AS VARCHAR) AS doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS k, text FROM benchmark),
m AS (SELECT *, sum(CASE WHEN ch IN (' ', chr(10), chr(9), chr(13)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM c),
w AS (SELECT doc_id, island, string_agg(ch, '' ORDER BY k) AS text, CAST(min(k) AS DOUBLE) AS x0, CAST(max(k) + 1 AS DOUBLE) AS x1 FROM m WHERE ch NOT IN (' ', chr(10), chr(9), chr(13)) GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INT) AS word_seq, text, x0, x1 FROM w""")
def group_words(spark, sf):
    b = _table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.posexplode(F.split("text", "")).alias("char_seq", "ch"))
    k = F.col("char_seq").cast("double")
    glyphs = b.withColumns({"x0": k, "y0": F.lit(0.0), "x1": k + 1, "y1": F.lit(10.0)})
    return extract.words(glyphs).select("doc_id", "word_seq", "text", "x0", "x1")


_LINES = """
b AS (SELECT doc_id, page_index, (CASE WHEN median(y1 - y0) <> 0 THEN median(y1 - y0) ELSE 1.0e0 END) * 0.5e0 AS band FROM g GROUP BY 1, 2),
r AS (SELECT g.doc_id, g.page_index, seq, [y0] AS tops, 1 AS pos FROM g WHERE seq = 0
  UNION ALL SELECT g.doc_id, g.page_index, g.seq,
    CASE WHEN list_position(list_transform(r.tops, lambda t: abs(g.y0 - t) <= b.band), true) > 0 THEN r.tops ELSE list_append(r.tops, g.y0) END,
    CASE WHEN list_position(list_transform(r.tops, lambda t: abs(g.y0 - t) <= b.band), true) > 0 THEN list_position(list_transform(r.tops, lambda t: abs(g.y0 - t) <= b.band), true) ELSE len(r.tops) + 1 END
  FROM r JOIN g ON g.doc_id = r.doc_id AND g.page_index = r.page_index AND g.seq = r.seq + 1 JOIN b ON b.doc_id = g.doc_id AND b.page_index = g.page_index)"""


@_query(f"WITH RECURSIVE {_G}, {_LINES} SELECT doc_id, page_index, seq AS word_seq, CAST(pos - 1 AS INT) AS line_seq FROM r")
def group_lines(spark, sf):
    return extract.line_numbers(_as_words(_boxes(spark, sf))).select(*KEY, "word_seq", "line_seq")


@_query(f"""WITH {_G}, m AS (SELECT doc_id, page_index, CASE WHEN median(y1 - y0) <> 0 THEN median(y1 - y0) ELSE 1.0e0 END AS mid FROM g GROUP BY 1, 2),
f AS (SELECT g.*, CASE WHEN y0 - lag(y1) OVER w > mid * 1.5e0 THEN 1 ELSE 0 END AS far FROM g JOIN m USING (doc_id, page_index) WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY y0, seq)),
p AS (SELECT *, CAST(sum(far) OVER (PARTITION BY doc_id, page_index ORDER BY y0, seq) AS INT) AS para_seq FROM f)
SELECT doc_id, page_index, para_seq, string_agg(text, chr(10) ORDER BY y0, seq) AS text, min(x0) AS x0, max(y1) AS y1 FROM p GROUP BY 1, 2, 3""")
def group_paragraphs(spark, sf):
    lines = _boxes(spark, sf).withColumnRenamed("seq", "line_seq")
    return extract.paragraphs(lines).select(*KEY, "para_seq", "text", "x0", "y1")


# cells: a page's regions as one line
_CELLS = """
o AS (SELECT *, lag(x0) OVER w AS p0, lag(x1) OVER w AS p1 FROM {src} WINDOW w AS (PARTITION BY doc_id, page_index, line_seq ORDER BY seq)),
k AS (SELECT *, CASE WHEN greatest(x0 - p1, p0 - x1, 0.0e0) >= greatest(p1 - p0, 1.0e0) THEN 1 ELSE 0 END AS opens FROM o),
cw AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_id, page_index, line_seq ORDER BY seq) AS INT) AS cell_seq FROM k),
cells AS (SELECT doc_id, page_index, line_seq, cell_seq, string_agg(text, ' ' ORDER BY seq) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM cw GROUP BY 1, 2, 3, 4)"""


@_query(f"WITH {_G}, h AS (SELECT *, 0 AS line_seq FROM g), {_CELLS.format(src='h')} SELECT doc_id, page_index, cell_seq, text, x0, x1 FROM cells")
def split_cells(spark, sf):
    return extract.cells(_as_words(_boxes(spark, sf)).withColumn("line_seq", F.lit(0))).select(*KEY, "cell_seq", "text", "x0", "x1")


def _grid_words(spark, sf):
    """Pages on which runs of lines with two or three cells come about: words by thirds, a line each three."""
    return _as_words(_boxes(spark, sf)).withColumn("line_seq", F.floor(F.col("word_seq") / 2).cast("int")).withColumn("x0", (F.col("word_seq") % 2) * 200.0 + F.col("x0") % 20).withColumn("x1", F.col("x0") + 30.0)


_GRID = "h AS (SELECT doc_id, page_index, seq, text, seq // 2 AS line_seq, (seq % 2) * 200.0e0 + x0 % 20 AS x0, y0, (seq % 2) * 200.0e0 + x0 % 20 + 30.0e0 AS x1, y1 FROM g)"
_ALIGN = """
al AS (SELECT doc_id, page_index, bool_and(drift <= (CASE WHEN mid <> 0 THEN mid ELSE 1.0e0 END) * 0.5e0) AS aligned FROM (
  SELECT doc_id, page_index, cell_seq, max((x0 + x1) * 0.5e0) - min((x0 + x1) * 0.5e0) AS drift, median(x1 - x0) AS mid FROM {src} GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@_query(f"WITH {_G}, {_GRID}, {_CELLS.format(src='h')}, {_ALIGN.format(src='cells')} SELECT * FROM al")
def columns_aligned(spark, sf):
    return extract.aligned(extract.cells(_grid_words(spark, sf)), KEY)


@_query(f"""WITH {_G}, {_GRID}, {_CELLS.format(src='h')},
n AS (SELECT doc_id, page_index, line_seq, count(*) AS columns FROM cells GROUP BY 1, 2, 3),
ch AS (SELECT *, CASE WHEN lag(columns) OVER w = columns THEN 0 ELSE 1 END AS changed FROM n WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY line_seq)),
ru AS (SELECT *, sum(changed) OVER (PARTITION BY doc_id, page_index ORDER BY line_seq) AS run FROM ch),
rn AS (SELECT doc_id, page_index, run, columns, min(line_seq) AS first_line, max(line_seq) AS last_line, count(*) AS rows FROM ru GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3 AND columns >= 2),
best AS (SELECT * FROM rn QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY rows DESC, first_line) = 1),
ins AS (SELECT cells.* FROM cells JOIN best USING (doc_id, page_index) WHERE line_seq BETWEEN first_line AND last_line), {_ALIGN.format(src='ins')}
SELECT best.doc_id, best.page_index, columns, CAST(first_line AS INT) AS first_line, CAST(last_line AS INT) AS last_line, rows FROM best JOIN al USING (doc_id, page_index) WHERE aligned""")
def detect_table(spark, sf):
    return extract.tables(extract.cells(_grid_words(spark, sf)))


# -- Order -------------------------------------------------------------------------

_COLS = """
pg AS (SELECT doc_id, page_index, count(*) AS n FROM g GROUP BY 1, 2),
bn AS (SELECT DISTINCT g.doc_id, g.page_index, least(49, CAST(floor(((x0 + x1) * 0.5e0) / (612.0e0 / 50)) AS INT)) AS bin FROM g JOIN pg USING (doc_id, page_index) WHERE n >= 4 AND (x0 + x1) * 0.5e0 BETWEEN 0 AND 612.0e0),
op AS (SELECT *, CASE WHEN bin - lag(bin) OVER w - 1 >= 2 THEN 1 ELSE 0 END AS opens FROM bn WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY bin)),
ci AS (SELECT *, least(2, CAST(sum(opens) OVER (PARTITION BY doc_id, page_index ORDER BY bin) AS INT)) AS col_idx FROM op),
sp AS (SELECT doc_id, page_index, col_idx, min(bin) * (612.0e0 / 50) AS a, (max(bin) + 1) * (612.0e0 / 50) AS b FROM ci GROUP BY 1, 2, 3),
ti AS (SELECT doc_id, page_index, col_idx, coalesce((lag(b) OVER w + a) * 0.5e0, 0.0e0) AS x0, coalesce((b + lead(a) OVER w) * 0.5e0, 612.0e0) AS x1 FROM sp WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY col_idx)),
cols AS (SELECT * FROM ti UNION ALL SELECT doc_id, page_index, 0, 0.0e0, 612.0e0 FROM pg ANTI JOIN ti USING (doc_id, page_index)),
pl AS (SELECT doc_id, page_index, list(struct_pack(i := col_idx, a := x0, b := x1) ORDER BY col_idx) AS cs FROM cols GROUP BY 1, 2),
asg AS (SELECT g.*, coalesce(list_filter(cs, lambda c: c.a <= (x0 + x1) * 0.5e0 AND (x0 + x1) * 0.5e0 <= c.b)[1].i, list_filter(cs, lambda c: (x0 + x1) * 0.5e0 > c.b)[-1].i, 0) AS col_idx FROM g JOIN pl USING (doc_id, page_index))"""
_BANDS = """
tl AS (SELECT doc_id, page_index, col_idx, greatest(1.0e0, coalesce(median(y1 - y0) FILTER (y1 > y0), 1.0e0) * 0.5e0) AS tol FROM asg GROUP BY 1, 2, 3),
rk AS (SELECT asg.*, tol, row_number() OVER (PARTITION BY doc_id, page_index, col_idx ORDER BY y0, x0, seq) AS k FROM asg JOIN tl USING (doc_id, page_index, col_idx)),
bd AS (SELECT doc_id, page_index, col_idx, seq, k, y0 AS top, 0 AS band, x0, x1, y0 FROM rk WHERE k = 1
  UNION ALL SELECT rk.doc_id, rk.page_index, rk.col_idx, rk.seq, rk.k, CASE WHEN rk.y0 - bd.top > rk.tol THEN rk.y0 ELSE bd.top END, CASE WHEN rk.y0 - bd.top > rk.tol THEN bd.band + 1 ELSE bd.band END, rk.x0, rk.x1, rk.y0
  FROM bd JOIN rk ON rk.doc_id = bd.doc_id AND rk.page_index = bd.page_index AND rk.col_idx = bd.col_idx AND rk.k = bd.k + 1)"""


@_query(f"WITH {_G}, {_COLS} SELECT doc_id, page_index, CAST(col_idx AS INT) AS col_idx, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM cols")
def detect_columns(spark, sf):
    return order.columns(_boxes(spark, sf)).select(*KEY, "col_idx", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@_query(f"WITH {_G}, {_COLS} SELECT doc_id, page_index, seq, CAST(col_idx AS INT) AS col_idx FROM asg")
def assign_columns(spark, sf):
    g = _boxes(spark, sf)
    return order.with_column_index(g).select(*KEY, "seq", "col_idx")


@_query(f"WITH RECURSIVE {_G}, {_COLS}, {_BANDS} SELECT doc_id, page_index, seq, CAST(col_idx AS INT) AS col_idx, CAST(band AS INT) AS band FROM bd")
def row_bands(spark, sf):
    g = _boxes(spark, sf)
    return order.with_bands(order.with_column_index(g), [*KEY, "col_idx"]).select(*KEY, "seq", "col_idx", "band")


def _ordered(spark, sf, rtl):
    g = _boxes(spark, sf).withColumn("old_seq", F.col("seq"))
    return order.reorder(g, rtl).select(*KEY, "seq", "old_seq")


@_query(f"WITH RECURSIVE {_G}, {_COLS}, {_BANDS} SELECT doc_id, page_index, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY col_idx DESC, band, x1 DESC, y0, k) - 1 AS INT) AS seq, seq AS old_seq FROM bd")
def reading_order_rtl(spark, sf):
    return _ordered(spark, sf, True)


@_query(f"WITH RECURSIVE {_G}, {_COLS}, {_BANDS} SELECT doc_id, page_index, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY col_idx, band, x0, y0, k) - 1 AS INT) AS seq, seq AS old_seq FROM bd")
def reading_order_ltr(spark, sf):
    return _ordered(spark, sf, False)


# -- Roles ---------------------------------------------------------------------------

_CUT = "(v[{j}] * (3 - d{i}) + v[{j} + 1] * d{i}) / 3"


@_query(f"""WITH {_G}, sg AS (SELECT *, CASE WHEN role = 'heading' THEN CASE WHEN font_size > 0 THEN font_size WHEN source = 'native' THEN NULL WHEN y1 > y0 THEN y1 - y0 END END AS sig FROM g),
pv AS (SELECT doc_id, page_index, list(sig ORDER BY sig) FILTER (sig IS NOT NULL) AS v, count(sig) AS n FROM sg GROUP BY 1, 2),
j AS (SELECT *, greatest(1, least(n - 1, (n + 1) // 3)) AS j1, greatest(1, least(n - 1, 2 * (n + 1) // 3)) AS j2 FROM pv),
d AS (SELECT *, (n + 1) - 3 * j1 AS d1, 2 * (n + 1) - 3 * j2 AS d2 FROM j),
q AS (SELECT *, {_CUT.format(i=1, j="j1")} AS q1, {_CUT.format(i=2, j="j2")} AS q2 FROM d)
SELECT sg.doc_id, sg.page_index, seq, CAST(CASE WHEN n < 3 OR sig IS NULL THEN 2 WHEN sig <= q1 THEN 3 WHEN sig <= q2 THEN 2 ELSE 1 END AS INT) AS heading_level FROM sg JOIN q USING (doc_id, page_index) WHERE role = 'heading'""")
def heading_levels(spark, sf):
    return roles.heading_levels(as_regions(_boxes(spark, sf))).where("role = 'heading'").select(*KEY, "seq", "heading_level")


_MARKED = "CASE doc_id % 5 WHEN 0 THEN concat('- ', text) WHEN 1 THEN concat(CAST(doc_id AS {s}), '. ', text) WHEN 2 THEN concat('  ٣) ', text) WHEN 3 THEN '•' ELSE text END"


@_query(f"""WITH m AS (SELECT doc_id, {_MARKED.format(s='VARCHAR')} AS text FROM documents), x AS (SELECT doc_id, regexp_extract(ltrim(text, ' ' || chr(10) || chr(9)), '^([-•–*—])(?: |$)', 1) AS b, regexp_extract(ltrim(text, ' ' || chr(10) || chr(9)), '^([0-9٠-٩]+)\\s*[.)]\\s+', 1) AS o, regexp_extract(ltrim(text, ' ' || chr(10) || chr(9)), '^[0-9٠-٩]+\\s*[.)]\\s+', 0) AS w FROM m)
SELECT doc_id, CASE WHEN b <> '' OR w <> '' THEN 'list_item' ELSE 'paragraph' END AS role, CASE WHEN b <> '' THEN 'bullet' WHEN w <> '' THEN 'ordered' END AS kind, CASE WHEN b = '' AND w <> '' THEN CAST(translate(o, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS BIGINT) END AS ordinal, CASE WHEN b <> '' THEN b WHEN w <> '' THEN rtrim(w, ' ' || chr(10)) END AS raw_marker FROM x""")
def list_markers(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", F.expr(_MARKED.format(s="STRING")).alias("text"))
    found = roles.list_items(d.withColumns({"role": F.lit("paragraph"), "list_marker": F.lit(None).cast("struct<kind:string,ordinal:bigint,raw_marker:string>")}))
    return found.select("doc_id", "role", "list_marker.kind", "list_marker.ordinal", "list_marker.raw_marker")


@_query(f"WITH {_G} SELECT doc_id, page_index, seq, CASE WHEN role IN ('paragraph', 'unknown') AND ((y0 + y1) * 0.5e0 < 792.0e0 * 0.05e0 OR (y0 + y1) * 0.5e0 > 792.0e0 - 792.0e0 * 0.05e0) THEN 'header_footer' ELSE role END AS role FROM g")
def header_footer_prune(spark, sf):
    return roles.header_footer(_boxes(spark, sf)).select(*KEY, "seq", "role")


@_query(f"WITH {_G} SELECT f.doc_id, f.page_index, f.seq AS f, c.seq AS c, c.y0 - f.y1 AS dy FROM g f JOIN g c USING (doc_id, page_index) WHERE f.role = 'figure' AND c.role = 'caption' AND c.x1 >= f.x0 AND f.x1 >= c.x0 AND c.y0 - f.y1 BETWEEN 0 AND 792.0e0 * 0.25e0")
def caption_candidates(spark, sf):
    """The pairs that the greedy linkage chooses from, within a quarter of the page here."""
    g = _boxes(spark, sf)
    f = g.where("role = 'figure'").select(*KEY, F.col("seq").alias("f"), F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("y1").alias("bottom"))
    c = g.where("role = 'caption'").select(*KEY, F.col("seq").alias("c"), "x0", "x1", "y0")
    dy = F.col("y0") - F.col("bottom")
    return f.join(c, KEY).where((F.col("x1") >= F.col("a")) & (F.col("b") >= F.col("x0")) & dy.between(0, H * 0.25)).select(*KEY, "f", "c", dy.alias("dy"))


@_query(f"""WITH RECURSIVE {_G}, fg AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY seq) AS k FROM g WHERE role = 'figure'),
cp AS (SELECT doc_id, page_index, list(struct_pack(s := seq, a := x0, b := x1, y := y0) ORDER BY seq) AS cs FROM g WHERE role = 'caption' GROUP BY 1, 2),
st AS (SELECT doc_id, page_index, 0::BIGINT AS k, []::INT[] AS used, NULL::INT AS f, NULL::INT AS c FROM cp
  UNION ALL SELECT st.doc_id, st.page_index, fg.k, CASE WHEN ch.c IS NULL THEN st.used ELSE list_append(st.used, ch.c) END, fg.seq, ch.c
  FROM st JOIN fg ON fg.doc_id = st.doc_id AND fg.page_index = st.page_index AND fg.k = st.k + 1 JOIN cp ON cp.doc_id = st.doc_id AND cp.page_index = st.page_index,
  LATERAL (SELECT list_sort(list_transform(list_filter(cp.cs, lambda x: NOT list_contains(st.used, x.s) AND x.b >= fg.x0 AND fg.x1 >= x.a AND x.y - fg.y1 >= 0 AND x.y - fg.y1 <= 792.0e0 * 0.25e0), lambda x: struct_pack(dy := x.y - fg.y1, s := x.s)))[1].s AS c) ch)
SELECT doc_id, page_index, f, c FROM st WHERE c IS NOT NULL""")
def caption_linkage(spark, sf):
    return roles.caption_pairs(as_regions(_boxes(spark, sf)).withColumn("page_height", F.lit(H)), 0.25)


_GROUPED = "CASE WHEN role IN ('figure', 'caption') THEN concat('g', CAST(CAST(x0 AS INT) % 7 AS {s})) END"


@_query(f"WITH {_G}, p AS (SELECT doc_id, role, {_GROUPED.format(s='VARCHAR')} AS group_id FROM g) SELECT doc_id, group_id FROM p WHERE role = 'figure' AND group_id IS NOT NULL INTERSECT SELECT doc_id, group_id FROM p WHERE role = 'caption'")
def paired_groups(spark, sf):
    return emit.paired_groups(_boxes(spark, sf).withColumn("group_id", F.expr(_GROUPED.format(s="STRING"))))


@_query(f"""WITH {_G}, p AS (SELECT doc_id, page_index, seq, role, {_GROUPED.format(s='VARCHAR')} AS group_id FROM g)
SELECT doc_id, page_index, seq FROM p WHERE role = 'caption' AND NOT EXISTS (SELECT 1 FROM p f WHERE f.doc_id = p.doc_id AND f.group_id = p.group_id AND f.role = 'figure')""")
def orphan_captions(spark, sf):
    g = _boxes(spark, sf).withColumn("group_id", F.expr(_GROUPED.format(s="STRING")))
    return emit.with_pairing(g).where("role = 'caption' AND NOT paired").select(*KEY, "seq")


# -- Text ------------------------------------------------------------------------------

_INLINE = "regexp_replace({t}, '([\\\\`*_\\[\\]<>])', '\\\\\\1', 'g')"
_SPICED = "concat('# ', replace(text, ' the ', ' *the* '), chr(10), '1. [x] | ', CAST(doc_id AS {s}), chr(10), '+ end')"


@_query(f"WITH m AS (SELECT doc_id, {_INLINE.format(t=_SPICED.format(s='VARCHAR'))} AS t FROM documents) SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^(#{{1,6}}\\s|[-*+]\\s|[0-9]+[.)]\\s)') THEN '\\' || x ELSE x END), chr(10)) AS block FROM m")
def md_escape(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.escape_paragraph(F.expr(_SPICED.format(s="STRING"))).alias("block"))


@_query(f"SELECT doc_id, replace(replace({_INLINE.format(t=_SPICED.format(s='VARCHAR'))}, '|', '\\|'), chr(10), '<br>') AS cell FROM documents")
def md_table_cell(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.escape_cell(F.expr(_SPICED.format(s="STRING"))).alias("cell"))


# what the marks are around, and what is no mark: escaped dollars, pairs over a line's end, lone ones; written as pairs of
# (text with marks, what must come out), with % for the document's own text, that holds no mark
_MATH = (
    ("<math x>%</math>", "%"), ("< MATH >%</ math >", "%"), ("< math a='1'\nb>x</\nmath>", "x"), ("<mathx>y</math>", "<mathx>y</math>"),
    ("$$a%$$", "a%"), ("\\[b\n%\\]", "b\n%"), ("\\(c\\)", "c"), ("$d %$".replace("%", "e"), "d e"), ("cost \\$5 and \\$6", "cost \\$5 and \\$6"),
    ("from $5\nto $6", "from $5\nto $6"), ("one $ only", "one $ only"), ("\\[\\]", "\\[\\]"), ("$a\\$ b$", "$a\\$ b$"),
)


def _math(k: int, plain: str) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return ", ".join(f"replace({quoted(pair[k])}, '%', {plain})" for pair in _MATH)


@_query(f"SELECT doc_id, unnest(range({len(_MATH)})) AS k, unnest([{_math(1, 'translate(text, chr(36) || chr(60) || chr(92) || chr(10), chr(32))')}]) AS text FROM documents")
def strip_math(spark, sf):
    """Texts in and beside formula marks; the SQL puts together what must be left."""
    plain = F.translate("text", "$<\\\n", " ")
    d = _texts(spark, sf).select("doc_id", plain.alias("plain"))
    marked = F.array(*(F.replace(F.lit(a), F.lit("%"), F.col("plain")) for a, _ in _MATH))
    return d.select("doc_id", F.posexplode(marked).alias("k", "text")).select("doc_id", F.col("k").cast("long").alias("k"), text.strip_math(F.col("text")).alias("text"))


_TRACE = "concat('Traceback:', chr(10), '  File: x', chr(10), 'ValueError: ', replace(text, chr(10), ' '), chr(27), chr(10), 'end')"


@_query(f"WITH m AS (SELECT doc_id, list_filter(string_split(replace({_TRACE}, chr(27), ''), chr(10)), lambda x: contains(x, ':') AND NOT starts_with(x, ' '))[-1] AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 400 THEN substring(t, 1, 399) || '…' ELSE t END AS reason FROM m")
def sanitise_reason(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.failure_reason(F.expr(_TRACE)).alias("reason"))


@_query(f"""WITH t AS (SELECT doc_id, {_DAMAGED} AS text FROM documents), c AS (SELECT *, len(regexp_extract_all(text, '[\\x{{600}}-\\x{{6FF}}\\x{{FB50}}-\\x{{FEFF}}]')) AS r, len(regexp_extract_all(text, '\\p{{Latin}}')) AS l FROM t)
SELECT doc_id, CASE WHEN r > 0 AND r > l AND l > 0 THEN chr(8207) ELSE '' END || text AS text FROM c""")
def rlm_prefix(spark, sf):
    return _damaged(spark, sf).select("doc_id", text.with_rlm(F.col("text")).alias("text"))


@_query("SELECT doc_id, nfc_normalize(concat(text, 'e', chr(769), chr(233))) AS text FROM documents")
def nfc(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.normalised(F.concat("text", F.lit("éé"))).alias("text"))


@_query("SELECT doc_id, nfc_normalize(concat(replace(replace(text, chr(160), ' '), '…', '...'), 'fi1')) AS text FROM documents")
def nfkc(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.normalised(F.concat("text", F.lit("ﬁ①")), "NFKC").alias("text"))


# distance in code points: that of the same length over bytes is not known to this engine, so a recursion over rows of the table
@_query("""WITH RECURSIVE b AS (SELECT item_id, text, upper(replace(text, 'ß', 'ss')) AS shouted, string_split(text, '') AS x, string_split(upper(replace(text, 'ß', 'ss')), '') AS y FROM benchmark),
d AS (SELECT item_id, 0 AS i, list_transform(range(0, CAST(length(shouted) AS BIGINT) + 1), lambda v: CAST(v AS BIGINT)) AS line FROM b
  UNION ALL SELECT d.item_id, d.i + 1, list_reduce(list_transform(range(1, CAST(length(b.shouted) AS BIGINT) + 1), lambda j: [CAST(j AS BIGINT)]),
    lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, d.line[j[1] + 1] + 1, d.line[j[1]] + CASE WHEN b.x[d.i + 1] = b.y[j[1]] THEN 0 ELSE 1 END)), [CAST(d.i + 1 AS BIGINT)])
  FROM d JOIN b USING (item_id) WHERE d.i < length(b.text))
SELECT item_id, shouted, CAST(length(text) AS BIGINT) AS n, round(line[len(line)] / greatest(length(text), 1), 9) AS cer FROM d JOIN b USING (item_id) WHERE i = length(text)""")
def cer(spark, sf):
    """Character error rate of a shouted copy, in code points."""
    b = _table(spark, sf, "benchmark")
    return b.select("item_id", F.upper("text").alias("shouted"), F.char_length("text").cast("long").alias("n"), F.round(numbers.character_error_rate(F.col("text"), F.upper("text")), 9).alias("cer"))


# -- Emission -----------------------------------------------------------------------------

_TALK = "CASE role WHEN 'user' THEN 'list_item' WHEN 'system' THEN 'heading' ELSE 'paragraph' END"


@_query(f"""WITH r AS (SELECT conv_id, turn, {_TALK} AS role FROM conversations), o AS (SELECT *, CASE WHEN role = 'list_item' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'list_item' THEN 0 ELSE 1 END AS opens FROM r),
u AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM o) SELECT conv_id, CAST(run AS BIGINT) AS run, count(*) AS n FROM u GROUP BY 1, 2""")
def list_blocks(spark, sf):
    c = _table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_index"), F.col("turn").alias("seq"), F.expr(_TALK).alias("role"))
    return emit.list_runs(c).groupBy(F.col("doc_id").alias("conv_id"), "run").agg(F.count(F.lit(1)).alias("n"))


def _for_emission(spark, sf):
    return as_regions(_boxes(spark, sf).withColumn("group_id", F.expr(_GROUPED.format(s="STRING"))))


_EMIT = f"""
p AS (SELECT doc_id, page_index, seq, role, text, {_GROUPED.format(s='VARCHAR')} AS group_id FROM g),
pr AS (SELECT doc_id, group_id, bool_or(role = 'figure') AND bool_or(role = 'caption') AS paired, (list(text ORDER BY page_index, seq) FILTER (role = 'caption'))[1] AS cap FROM p WHERE group_id IS NOT NULL GROUP BY 1, 2),
e AS (SELECT p.*, coalesce(paired, false) AS paired, cap, {_INLINE.format(t='text')} AS esc FROM p LEFT JOIN pr ON p.doc_id = pr.doc_id AND p.group_id = pr.group_id),
bl AS (SELECT *, CASE WHEN role = 'caption' AND paired THEN NULL WHEN role = 'heading' THEN '## ' || esc WHEN role = 'list_item' THEN '- ' || esc WHEN role = 'caption' THEN '*' || esc || '*'
  WHEN role = 'figure' THEN '![' || replace(replace(coalesce(cap, 'figure on page ' || (page_index + 1)), '[', '\\['), ']', '\\]') || '](#)' ELSE esc END AS block FROM e),
ob AS (SELECT *, CASE WHEN role = 'list_item' AND lag(role) OVER w = 'list_item' THEN 0 ELSE 1 END AS opens FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, seq)),
rb AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY page_index, seq) AS run FROM ob),
rr AS (SELECT doc_id, run, string_agg(block, chr(10) ORDER BY page_index, seq) FILTER (block IS NOT NULL) AS block FROM rb GROUP BY 1, 2)"""


@_query(f"WITH {_G}, {_EMIT} SELECT doc_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY run) FILTER (block IS NOT NULL) || chr(10), '') AS markdown FROM rr GROUP BY 1")
def emit_markdown(spark, sf):
    return emit.markdown(_for_emission(spark, sf))


@_query(f"""WITH {_G}, p AS (SELECT doc_id, page_index, seq, role, text, {_GROUPED.format(s='VARCHAR')} AS group_id FROM g), pr AS (SELECT doc_id, group_id FROM p WHERE group_id IS NOT NULL GROUP BY 1, 2 HAVING bool_or(role = 'figure') AND bool_or(role = 'caption')),
v AS (SELECT p.* FROM p LEFT JOIN pr ON p.doc_id = pr.doc_id AND p.group_id = pr.group_id WHERE NOT (role = 'caption' AND pr.group_id IS NOT NULL))
SELECT doc_id, page_index, seq, CASE role WHEN 'heading' THEN 'Heading 2' WHEN 'list_item' THEN 'List Bullet' ELSE 'Normal' END AS style, coalesce(lag(page_index) OVER (PARTITION BY doc_id ORDER BY page_index, seq) <> page_index, false) AS breaks FROM v""")
def docx_walk(spark, sf):
    return docx.walk(_for_emission(spark, sf)).select(*KEY, "seq", "style", "breaks")


@_query(f"WITH {_G} SELECT DISTINCT doc_id, '[Content_Types].xml _rels/.rels word/_rels/document.xml.rels word/styles.xml word/document.xml' AS parts, '1980' AS years, 'Normal Heading 1 Heading 2 Heading 3 Heading 4 Heading 5 Heading 6 Heading 7 Heading 8 Heading 9 List Bullet List Number Quote' AS styles, true AS whole FROM g")
def docx_files(spark, sf):
    """Word files of all documents: their parts, the styles that they name, and whether every part is sound."""

    def opened(batches):
        import io
        import re
        import zipfile

        import pyarrow as pa

        names = ["doc_id", "parts", "years", "styles", "whole"]
        for batch in docx.slices(batches):
            rows = []
            for key, f in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                z = zipfile.ZipFile(io.BytesIO(f))
                styles = re.findall('<w:name w:val="([^"]*)"', z.read("word/styles.xml").decode())
                rows.append((key, " ".join(z.namelist()), " ".join(sorted({str(i.date_time[0]) for i in z.infolist()})), " ".join(styles), z.testzip() is None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return docx.docx(_for_emission(spark, sf)).mapInArrow(opened, "doc_id string, parts string, years string, styles string, whole boolean")


@_query(f"WITH {_G} SELECT doc_id, page_index, seq, x0, y1, role, source, text, font_size IS NULL AS no_size FROM g")
def region_json(spark, sf):
    """Regions through their JSON envelope and back."""
    back = from_json(to_json(as_regions(_boxes(spark, sf))))
    sizes = _boxes(spark, sf).select(*KEY, "seq", F.col("font_size").isNull().alias("no_size"))
    return back.select(*KEY, "seq", "x0", "y1", "role", "source", "text").join(sizes, [*KEY, "seq"])


# -- Pipeline --------------------------------------------------------------------------------


def _outcomes(g: DataFrame) -> DataFrame:
    """A page fails where it has a single region, is recognised where its number ends in an odd digit, and is native else."""
    per = g.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    branch = F.when(F.col("n") == 1, "failed").when(F.col("page_index") % 2 == 1, "ml").otherwise("native")
    return per.select(*KEY, branch.alias("branch"), F.when(F.col("n") == 1, F.lit("RuntimeError:single")).alias("failure_reason"))


_OUT = "o AS (SELECT doc_id, page_index, CASE WHEN count(*) = 1 THEN 'failed' WHEN page_index % 2 = 1 THEN 'ml' ELSE 'native' END AS branch FROM g GROUP BY 1, 2)"


@_query(f"WITH {_G}, {_OUT} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (branch <> 'failed') AS ok_pages, count(*) FILTER (branch = 'failed') AS failed_pages, bool_and(branch = 'failed') AS all_failed FROM o GROUP BY 1")
def page_outcomes(spark, sf):
    return transcribe.document_counts(_outcomes(_boxes(spark, sf)))


@_query(f"WITH {_G}, {_OUT} SELECT doc_id, page_index, 0 AS seq, 612.0e0 AS x1, 792.0e0 AS y1, 'failure_placeholder' AS role, 'RuntimeError:single' AS failure_reason FROM o WHERE branch = 'failed'")
def failure_placeholders(spark, sf):
    bad = _outcomes(_boxes(spark, sf)).where("branch = 'failed'").withColumns({"page_width": F.lit(W), "page_height": F.lit(H)})
    return transcribe.placeholder(bad, "ocr").select(*KEY, "seq", "x1", "y1", "role", "failure_reason")


@_query(f"""WITH {_G}, {_OUT}, c AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (branch <> 'failed') AS ok, count(*) FILTER (branch = 'failed') AS bad FROM o GROUP BY 1),
r AS (SELECT doc_id, string_agg('{{"confidence":null,"failure_reason":null,"page_index":' || page_index || ',"role":"' || role || '","source":"' || source || '","text_len":' || length(text) || '}}', ',' ORDER BY page_index, seq) AS rows FROM g GROUP BY 1)
SELECT c.doc_id, '{{"failed_pages":' || bad || ',"n_pages":' || n_pages || ',"ok_pages":' || ok || ',"regions":[' || rows || ']}}' AS json FROM c JOIN r USING (doc_id)""")
def debug_sidecar(spark, sf):
    g = _boxes(spark, sf)
    return emit.sidecar(as_regions(g), _outcomes(g))


_EVENT = "CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN concat('region:', CAST(user_id % 9 AS {s}), '/9:table') WHEN 'purchase' THEN 'complete:ml' ELSE concat('failure:', event_type) END"


@_query(f"""WITH e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS doc_id, event_id % 100 AS page, {_EVENT.format(s='VARCHAR')} AS event FROM events)
SELECT doc_id, count(*) AS n_events, count(DISTINCT page) FILTER (event = 'complete:ml' OR starts_with(event, 'failure:')) AS pages_finished, count(DISTINCT page) FILTER (event = 'complete:ml') AS pages_done,
count(DISTINCT page) FILTER (starts_with(event, 'failure:')) AS pages_failed, count(*) FILTER (starts_with(event, 'region:')) AS regions FROM e GROUP BY 1""")
def progress_rollup(spark, sf):
    raw = _table(spark, sf, "events").select((F.col("user_id") % 50).cast("string").alias("doc_id"), (F.col("event_id") % 100).cast("int").alias("page_index"), F.lit(100).alias("total"), F.expr(_EVENT.format(s="STRING")).alias("event"))
    return progress.rollup(progress.parsed(raw))


# -- Tools -------------------------------------------------------------------------------------


def _requirements(spark, sf) -> DataFrame:
    """Nations as packages that need the next two; odd ones by an extra."""
    n = _table(spark, sf, "nation")
    need = lambda k: F.concat(F.lit("N"), ((F.col("n_nationkey") * 2 + k) % 25).cast("string"))
    specs = F.array(F.concat(need(1), F.lit(" >=1")), F.concat(need(2), F.lit('; extra == "x"')))
    lic = F.element_at(F.array(*map(F.lit, ("MIT License", "GPL-3.0", "(Apache-2.0 OR GPL-2.0) AND ISC", ""))), F.col("n_nationkey") % 4 + 1)
    return n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("expression"), F.array().cast("array<string>").alias("classifiers"), lic.alias("license"), specs.alias("requires"))


@_query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'n' || ((n_nationkey * 2 + 1) % 25) AS b FROM nation UNION ALL SELECT 'n3', 'n8'),
r(name) AS (SELECT 'n3' UNION SELECT e.b FROM r JOIN e ON e.a = r.name) SELECT name FROM r""")
def dep_closure(spark, sf):
    return audit.closure(_requirements(spark, sf), "n3", ("x",))


# (expression, classifiers, licence, what the audit says; None: allowed), worked out by hand
_DECLARED = (
    (None, [], "MIT\n", None), (None, [], " \t", "no license found"), ("GPL-3.0 OR (MIT)", [], None, None), ("GPL-3.0\tAND LGPL-2.1", [], None, "not allowed: GPL-3.0 / LGPL-2.1"),
    (None, ["License :: OSI Approved :: \n", "License :: OSI Approved :: BSD License"], None, None), (None, ["Topic :: X"], "line one\nline two", "no license found"),
    (None, ["License :: OSI Approved :: GNU Affero"], "the Unlicense (Unlicense)", None), (None, [], "Apache 2.0 OR GPL", None), ("", [], "x" * 201, "no license found"), (None, [], "Beerware", "not allowed: Beerware"),
)


@_query(f"SELECT 'dist' AS kind, 'p' || p_partkey || '==2' AS name, ([{', '.join(repr(d[3]) if d[3] else 'NULL' for d in _DECLARED)}])[p_partkey % {len(_DECLARED)} + 1] AS detail FROM part WHERE detail IS NOT NULL AND p_partkey % 50 <> 3")
def licence_audit(spark, sf):
    """Parts as distributions; one in fifty has an override."""
    one = F.element_at(F.array(*(F.struct(F.lit(e).cast("string").alias("expression"), F.array(*map(F.lit, c)).cast("array<string>").alias("classifiers"), F.lit(v).cast("string").alias("license")) for e, c, v, _ in _DECLARED)), F.col("p_partkey").cast("int") % len(_DECLARED) + 1)
    p = _table(spark, sf, "part")
    d = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"), F.lit("2").alias("version"), one.alias("d")).select("name", "version", "d.*")
    top = p.agg(F.max("p_partkey")).first()[0] or 0
    return audit.audit_distributions(d, overrides={f"p{k}==2": "MIT" for k in range(3, top + 1, 50)})


def _told(table: dict) -> str:
    return "CASE label " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items())


_LABELS, _STRUCT_LABELS = ([*t, "Background", "Other"] for t in (roles.LABELS, roles.STRUCT_LABELS))


@_query(f"SELECT p_partkey, label, {_told(roles.LABELS)} ELSE 'unknown' END AS role, {_told(roles.LABEL_LEVELS)} END AS heading_level FROM (SELECT p_partkey, {_LABELS}[p_partkey % {len(_LABELS)} + 1] AS label, CASE WHEN p_size % 7 <> 0 THEN p_size / 100 END AS confidence FROM part) WHERE label <> 'Background' AND coalesce(confidence, 1) >= 0.25")
def label_roles(spark, sf):
    """Parts as detections, with every label, one that is dropped and one that isn't known."""
    return roles.detections(_detected(spark, sf, _LABELS)).select("p_partkey", "label", "role", "heading_level")


def _detected(spark, sf, labels):
    label = F.element_at(F.array(*map(F.lit, labels)), F.col("p_partkey").cast("int") % len(labels) + 1)
    return _table(spark, sf, "part").select("p_partkey", label.alias("label"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 100).alias("confidence"))


@_query(f"SELECT p_partkey, {_told(roles.STRUCT_LABELS)} ELSE 'unknown' END AS role FROM (SELECT p_partkey, {_STRUCT_LABELS}[p_partkey % {len(_STRUCT_LABELS)} + 1] AS label, CASE WHEN p_size % 7 <> 0 THEN p_size / 100 END AS confidence FROM part) WHERE label <> 'Background' AND coalesce(confidence, 1) >= 0.25")
def struct_label_roles(spark, sf):
    return roles.detections(_detected(spark, sf, _STRUCT_LABELS), roles.STRUCT_LABELS).select("p_partkey", "role")


@_query("SELECT conv_id, turn AS page_index, CAST(sum(length(text)) FILTER (role = 'user') AS DECIMAL(38, 0)) AS \"user\", CAST(sum(length(text)) FILTER (role = 'assistant') AS DECIMAL(38, 0)) AS assistant FROM conversations GROUP BY 1, 2")
def survey_lengths(spark, sf):
    c = _table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("page_index"), F.col("role").alias("model"), "text")
    return recognise.lengths_by_model(c, ["user", "assistant"], ("conv_id", "page_index")).select("conv_id", "page_index", F.col("user").cast("decimal(38,0)").alias("user"), F.col("assistant").cast("decimal(38,0)").alias("assistant"))


@_query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, string_agg('<!-- page ' || (turn + 1) || ' -->' || chr(10) || chr(10) || trim(text, ' ' || chr(10)), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def assemble_crops(spark, sf):
    c = _table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), F.lit(0).alias("seq"), "text")
    return recognise.assembled(c)


@_query("""WITH s AS (SELECT p_partkey AS image_id, 8 + p_size % 5 * 8 AS step FROM part), r AS (SELECT image_id, step, unnest(range(0, 80 // step)) AS i FROM s), c AS (SELECT *, unnest(range(0, 5)) AS j FROM r)
SELECT image_id, CAST(i AS INT) AS row, CAST(j AS INT) AS col, CAST(5 + j * 22 AS DOUBLE) AS x0, CAST(5 + i * step AS DOUBLE) AS y0, CAST(27 + j * 22 AS DOUBLE) AS x1, CAST(5 + (i + 1) * step AS DOUBLE) AS y1 FROM c""")
def table_cells(spark, sf):
    """Cells of ruled grids drawn from the parts' sizes."""
    import numpy as np

    @F.pandas_udf("binary")
    def drawn(k):
        def one(size: int) -> bytes:
            image = np.full((90, 120), 255, np.uint8)
            image[5 : 86 : 8 + size % 5 * 8, 5:116] = 0
            image[5:86, 5 : 116 : 22] = 0
            return image.tobytes()

        return k.map(one)

    p = _table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.lit(120).alias("width"), F.lit(90).alias("height"), drawn(F.col("p_size")).alias("pixels"), *(F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 120.0), ("y1", 90.0))))
    return images.find_table_cells(p)


def queries() -> dict:
    from . import composites  # noqa: F401  registers its own

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from . import composites  # noqa: F401

    return dict(_S)
