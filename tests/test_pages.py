"""Extraction, order, roles, emission and the whole run on small hand-made pages."""

import io
import json
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill import config, schemas
from pagemill.operators import audit, emit, extract, images, order, recognise, roles, transcribe, validate
from pagemill.sources import documents, docx
from pagemill.streaming import progress


def regions(spark, rows, **same):
    """rows: dicts; doc d, page 0, seq by position unless given."""
    fields = list(schemas.REGION_FIELDS)
    base = {"doc_id": "d", "page_index": 0, "text": "", "role": "paragraph", "source": "native", "x0": 0.0, "y0": 0.0, "x1": 10.0, "y1": 10.0, "meta": {}}
    data = [tuple({**base, "seq": k, **same, **r}.get(f) for f in fields) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, schemas.REGION)


def glyphs(spark, words, doc="d"):
    """words: (text, x0, y0); each glyph 5 wide, 10 high, a space glyph behind each word."""
    rows, k = [], 0
    for word, x, y in words:
        for j, c in enumerate([*word, " "]):
            rows.append((doc, 0, k, c, float(x + 5 * j), float(y), float(x + 5 * j + 5), float(y + 10), 10.0))
            k += 1
    return spark.createDataFrame(rows, schemas.CHAR)


def test_words_and_lines_keep_stream_order(spark):
    chars = glyphs(spark, [("c", 200, 0), ("b", 100, 1), ("a", 0, 0), ("next", 0, 30)])
    got = extract.lines(extract.words(chars)).orderBy("line_seq").select("text").collect()
    assert [r[0] for r in got] == ["c b a", "next"]


def test_line_fold_equals_plain_loop(spark):
    rng = random.Random(3)
    pages = [[(rng.randrange(0, 60), rng.randrange(5, 15)) for _ in range(rng.randrange(1, 15))] for _ in range(40)]
    rows = [("d", p, k, "w", 0.0, float(y), 1.0, float(y + h)) for p, page in enumerate(pages) for k, (y, h) in enumerate(page)]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, word_seq int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page_index, r.word_seq): r.line_seq for r in extract.line_numbers(df).collect()}
    for p, page in enumerate(pages):
        heights = sorted(h for _, h in page)
        n = len(heights)
        band = 0.5 * (heights[n // 2] if n % 2 else (heights[n // 2 - 1] + heights[n // 2]) / 2)
        tops = []
        for k, (y, _) in enumerate(page):
            hit = next((i for i, t in enumerate(tops) if abs(y - t) <= band), None)
            if hit is None:
                hit = len(tops)
                tops.append(y)
            assert got[p, k] == hit


def test_table_among_noise(spark):
    words = [("noise here", 0, 0), ("more", 0, 20)]
    words += [(f"r{r}c{c}", 100 * c, 40 + 20 * r) for r in range(3) for c in range(3)]
    found = extract.regions_of(glyphs(spark, words)).orderBy("seq").collect()
    assert [r.role for r in found][0] == "table"
    grid = found[0].table_grid.rows
    assert [[c.text for c in row] for row in grid] == [[f"r{r}c{c}" for c in range(3)] for r in range(3)]
    assert "noise here" in found[1].text


def test_prose_is_no_table(spark):
    words = [("word", 25 * c, 20 * r) for r in range(4) for c in range(3)]
    assert {r.role for r in extract.regions_of(glyphs(spark, words)).collect()} == {"unknown"}


@pytest.mark.parametrize(("centres", "n"), [([150] * 10 + [450] * 10, 2), ([60, 60, 180, 180, 300, 300, 420, 420, 540, 540], 3), ([150, 165] * 5, 1), ([100, 500, 500], 1)])
def test_columns(spark, centres, n):
    df = regions(spark, [{"x0": c - 5.0, "x1": c + 5.0, "y0": 10.0 * k, "y1": 10.0 * k + 8} for k, c in enumerate(centres)]).withColumn("page_width", F.lit(600.0))
    cols = order.columns(df).orderBy("col_idx").collect()
    assert len(cols) == n and cols[0].x0 == 0.0 and cols[-1].x1 == 600.0


def test_order_is_free_of_input_order(spark):
    rng = random.Random(5)
    rows = [{"x0": rng.randrange(500) + 0.0, "y0": rng.randrange(700) + 0.0} for _ in range(30)]
    rows = [{**r, "x1": r["x0"] + 50, "y1": r["y0"] + 12, "seq": k} for k, r in enumerate(rows)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    read = lambda data, n: [(r.seq, r.x0) for r in order.reorder(regions(spark, data).repartition(n).withColumn("page_width", F.lit(600.0))).orderBy("seq").collect()]
    assert read(rows, 1) == read(shuffled, 3)


@pytest.mark.parametrize(("rows", "levels"), [
    ([{"font_size": s} for s in (24.0, 16.0, 12.0)], [1, 2, 3]),
    ([{"source": "ocr", "y1": h} for h in (60.0, 40.0, 20.0)], [1, 2, 3]),
    ([{"y1": 0.0}], [2]),
])
def test_heading_levels(spark, rows, levels):
    got = roles.heading_levels(regions(spark, rows, role="heading")).orderBy("seq").collect()
    assert [r.heading_level for r in got] == levels


def test_caption_goes_to_nearest_figure_once(spark):
    rows = [{"role": "figure", "y1": 100.0, "x1": 100.0}, {"role": "figure", "y1": 105.0, "x1": 100.0}, {"role": "caption", "y0": 110.0, "x1": 90.0}, {"role": "caption", "y0": 106.0, "x1": 90.0}]
    df = regions(spark, rows).withColumn("page_height", F.lit(800.0))
    assert sorted((r.f, r.c) for r in roles.caption_pairs(df).collect()) == [(0, 3), (1, 2)]
    import uuid

    got = {r.seq: r.group_id for r in roles.captions(df).collect()}
    assert got[0] == got[3] == uuid.uuid5(uuid.NAMESPACE_OID, "figcap:0:0.0:0.0").hex


def grid(rows):
    return {"rows": [[{"text": t, "confidence": None, "bbox": None} for t in r] for r in rows]}


SNAPSHOT = [
    {"role": "heading", "heading_level": 1, "text": "Title"}, {"text": "Body *x*"},
    {"role": "list_item", "text": "- one", "list_marker": {"kind": "bullet", "ordinal": None, "raw_marker": "-"}},
    {"role": "header_footer", "text": "never"},
    {"role": "list_item", "text": "٢. two", "list_marker": {"kind": "ordered", "ordinal": 2, "raw_marker": "٢."}},
    {"role": "list_item", "text": "three"},
    {"role": "figure", "group_id": "g"}, {"role": "caption", "group_id": "g", "text": "A [cap]"}, {"role": "caption", "text": "alone"}, {"role": "figure"},
    {"role": "table", "table_grid": grid([["a|b", "c"], ["d"]])}, {"role": "table", "table_grid": grid([])},
    {"role": "failure_placeholder", "failure_reason": "a--b"},
]


def test_markdown_snapshot(spark):
    got = emit.markdown(regions(spark, SNAPSHOT).repartition(3)).collect()[0].markdown
    assert got == "\n\n".join([
        "# Title", "Body \\*x\\*", "- one", "2. two\n- three", "![A \\[cap\\]](#)", "*alone*", "![figure on page 1](#)",
        "| a\\|b | c |\n| --- | --- |\n| d |  |", "<!-- transcription-failed: page 1 reason: a- -b -->",
    ]) + "\n"


def test_docx(spark):
    rows = [*SNAPSHOT, {"page_index": 1, "role": "table", "table_grid": grid([["x"]])}, {"page_index": 2, "text": "last"}]
    df = regions(spark, rows)
    one, two = (docx.docx(df.repartition(n)).collect()[0].content for n in (1, 4))
    assert bytes(one) == bytes(two)
    xml = zipfile.ZipFile(io.BytesIO(bytes(one))).read("word/document.xml").decode()
    assert xml.count("<w:pageBreakBefore/>") == 2 and "ListNumber" in xml and "Figure on page 1: A [cap]" in xml and "never" not in xml and xml.count("<w:tbl>") == 2


def test_docx_streams(spark):
    """Files come out while rows still come in, and documents that show nothing or cross a batch are whole."""
    df = regions(spark, [{"doc_id": f"d{k // 6:04d}", "seq": k % 6, "text": f"t{k} {'x' * 200}", "role": "header_footer" if k // 6 % 10 == 0 else "paragraph"} for k in range(30_000)])
    rows = docx._walked(df, "NFC", True, True).toArrow().sort_by([(c, "ascending") for c in ("doc_id", "page_index", "seq")])
    read = 0

    def batches():
        nonlocal read
        for batch in rows.to_batches(max_chunksize=1000):
            read += 1
            yield batch

    out = docx._files(batches(), True)
    first = next(out)
    assert read < 25 and first.nbytes < 3 * docx.SLICE_BYTES
    files = [f for batch in (first, *out) for f in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True)]
    assert [k for k, _ in files] == [f"d{k:04d}" for k in range(5000)]
    for k, content in files[::99]:
        xml, at = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode(), int(k[1:])
        assert [f"t{j} " in xml for j in range(6 * at - 6, 6 * at + 12)] == [False] * 6 + [at % 10 > 0] * 6 + [False] * 6
    assert {r.doc_id: bytes(r.content) for r in docx.docx(df.where("doc_id < 'd0300'")).collect()} == dict(files[:300])


def test_json_envelope(spark):
    df = regions(spark, SNAPSHOT)
    j = schemas.to_json(df)
    first = json.loads(j.orderBy("seq").first().json)
    assert first["schema_version"] == "1" and list(first["region"]) == sorted(first["region"])
    back = schemas.from_json(j).orderBy("seq").collect()
    assert [r.text for r in back] == [r.get("text", "") for r in SNAPSHOT] and back[10].table_grid.rows[0][0].text == "a|b"
    with pytest.raises(Exception, match="schema_version"):
        schemas.from_json(j.withColumn("json", F.regexp_replace("json", '"schema_version":"1"', '"schema_version":"9"'))).collect()


def test_run_with_stubs(spark):
    long = " ".join(["كتاب الدرس في المدرسة"] * 10)
    native = regions(spark, [{"text": long, "page_index": 0}, {"text": "a " * 100, "page_index": 1}, {"text": "", "page_index": 2}])
    pages = spark.createDataFrame([("d", p, 600.0, 800.0, p != 2) for p in range(4)], "doc_id string, page_index int, page_width double, page_height double, has_text_layer boolean")

    class Raster:
        def render(self, doc_id, page_index, scale):
            if page_index == 2:
                raise MemoryError
            return np.zeros((80, 60, 3), np.uint8)

    class Ocr:
        def transcribe(self, region, image):
            return "seen $x$"

    seen = recognise.recogniser(Raster, recognise.FullPage, Ocr)
    result = transcribe.transcribe(pages, native, recognise=seen)
    out = {r.page_index: (r.branch, r.failure_reason) for r in result.outcomes.collect()}
    assert out == {0: ("native", None), 1: ("ml", None), 2: ("failed", "out_of_memory"), 3: ("ml", None)}
    texts = {r.page_index: (r.text, r.role, r.x1) for r in result.regions.collect()}
    assert texts[1] == ("seen x", "paragraph", 60.0) and texts[2] == ("", "failure_placeholder", 600.0)
    counts = result.counts().collect()[0]
    assert (counts.n_pages, counts.ok_pages, counts.failed_pages, counts.all_failed) == (4, 3, 1, False)
    only = transcribe.transcribe(pages, native, config.EngineConfig(pages=(0,)))
    assert [r.page_index for r in only.regions.collect()] == [0]
    with pytest.raises(Exception, match="page 2 failed"):
        transcribe.transcribe(pages, native, config.EngineConfig(strict=True)).outcomes.collect()


def test_verdicts(spark):
    rows = ["a " * 100, "�" * 20 + "abc", "123", "ب" + " latin" * 30, "ﺍﺏﺕﺙ" * 10, " ".join(["كتاب الدرس في المدرسة"] * 10)]
    df = spark.createDataFrame([(k, t, True) for k, t in enumerate(rows)], "k int, text string, has_text_layer boolean")
    got = [[x.split(" ")[0] for x in r.reasons] for r in validate.verdict(validate.signals(df)).orderBy("k").collect()]
    assert got == [["word_boundary_kl"], ["replacement_glyph_ratio"], ["empty_text_layer"], ["arabic_codepoint_ratio", "word_boundary_kl"], ["arabic_codepoint_ratio", "presentation_form_ratio"], []]


def test_decoder_errors_are_rows(spark):
    pages = json.dumps([{"width": 100, "height": 200, "glyphs": [["a", 0.0, 180.0, 5.0, 190.0]]}, {"width": 1, "height": 1, "glyphs": []}])
    files = spark.createDataFrame([("a", pages.encode()), ("b", b'"encrypted"'), ("c", b"{")], "path string, content binary")
    chars, sizes, errors = documents.glyph_tables(documents.decoded(files, documents.TableDecoder()))
    assert chars.select("ch", "y0", "y1").collect()[0] == ("a", 10.0, 20.0)
    assert sorted((r.page_index, r.has_text_layer) for r in sizes.collect()) == [(0, True), (1, False)]
    assert sorted(r.error.split(":")[0] for r in errors.collect()) == ["corrupted", "encrypted"]


def test_ruled_grid():
    image = np.full((100, 150), 255, np.uint8)
    for y in (10, 40, 41, 70, 95):
        image[y, 5:145] = 0
    for x in (5, 50, 100, 144):
        image[8:97, x] = 0
    cells = images.table_cells(image, (0, 0, 150, 100))
    assert (len(cells), len(cells[0])) == (4, 3) or (len(cells), len(cells[0])) == (3, 3)
    assert images.table_cells(np.full((50, 50), 255, np.uint8), (0, 0, 50, 50)) is None
    with pytest.raises(ValueError):
        images.crop(image, (200, 200, 210, 210))


def test_settings(tmp_path):
    assert config.parse_pages("1-3, 7,") == (0, 1, 2, 6) and config.parse_pages(None) is None
    for bad in ("0", "3-1", "x"):
        with pytest.raises(ValueError):
            config.parse_pages(bad)
    assert config.output_format("a.DOCX", None) == "docx"
    with pytest.raises(config.FormatMismatch):
        config.output_format("a.md", "docx")
    path = tmp_path / "c.toml"
    path.write_text(config.ValidatorConfig(max_word_boundary_kl=2.0).to_toml() + "[render]\ndpi = 72\n")
    made = config.engine_config(config=path)
    assert made.validator.max_word_boundary_kl == 2.0 and made.dpi == 72 and config.engine_config(config=path, dpi=100).dpi == 100


def test_stream_equals_batch(spark, tmp_path):
    events = [("d", k, k % 5, 5, e) for k, e in enumerate(["start", "complete:ml", "complete:ml", "failure:x:y", "region:1/2:table", "phase:start:ocr:3", "complete:native"])]
    df = spark.createDataFrame(events, "doc_id string, event_id long, page_index int, total int, event string")
    df.write.json(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing new
        progress.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    streamed = sorted(r.page for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert streamed == sorted(r.page for r in progress.finished_pages(progress.parsed(df)).collect()) == [2, 3, 4]
    roll = progress.rollup(progress.parsed(df)).collect()[0]
    assert (roll.n_events, roll.pages_finished, roll.pages_done, roll.pages_failed, roll.regions) == (7, 3, 2, 1, 1)
    lines = [r.value for r in progress.as_json(progress.line_events(progress.parsed(df))).collect()]
    assert len(lines) == 6 and '"reason":"x:y"' in "".join(lines)


def test_text_files_are_written_where_documents_are(spark, tmp_path):
    rows = [("a", "one\n"), ("b/c", "zwei é"), ("d", None)]
    told = docx.write_text(spark.createDataFrame(rows, "doc_id string, markdown string").repartition(2), str(tmp_path / "new" / "out")).collect()
    assert {r.doc_id: open(r.path, encoding="utf-8").read() for r in told} == {k: v or "" for k, v in rows}
    assert {r.doc_id: r.n_bytes for r in told} == {k: len((v or "").encode()) for k, v in rows}


def test_folds_equal_plain_loops():
    rng = random.Random(5)
    for _ in range(300):
        values, band = [rng.choice([0.0, 1.0, 2.5, 4.0, 5.5, 9.0]) + rng.random() * 0.2 for _ in range(rng.randrange(0, 30))], rng.choice([0.0, 0.5, 1.5])
        heads, want = [], []
        for v in values:
            k = next((k for k, h in enumerate(heads) if abs(v - h) <= band), len(heads))
            heads += [v] * (k == len(heads))
            want.append(k)
        assert extract.first_within(values, band) == want
        tops, first, n, bands = sorted(values), None, -1, []
        for t in tops:
            if first is None or t - first > band:
                first, n = t, n + 1
            bands.append(n)
        assert order.bands_of(tops, band) == bands


def test_a_page_of_many_words_is_quick():
    begin = time.time()
    extract.first_within([float(k % 5000) for k in range(100_000)], 0.4)
    order.bands_of([k * 0.1 for k in range(100_000)], 1.0)
    assert time.time() - begin < 20


def test_closure_of_a_long_chain_with_a_cycle(spark):
    rows = [(f"N{k}", [f"n{(k + 1) % 30} >=1", "other; extra == 'x'"]) for k in range(30)] + [("far", ["n1"])]
    d = spark.createDataFrame(rows, "name string, requires array<string>")
    assert {r.name for r in audit.closure(d, "n0").collect()} == {f"n{k}" for k in range(30)}
    assert {r.name for r in audit.closure(d, "n0", ("x",)).collect()} == {f"n{k}" for k in range(30)} | {"other"}
    assert {r.name for r in audit.shipped(d, "n3").collect()} == {f"N{k}" for k in range(30)} - {"N3"}
    assert audit.shipped(d, "absent").count() == 31
