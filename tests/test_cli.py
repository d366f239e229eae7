"""The command line and the back ends, with stand-ins for the libraries."""

import io
import json
import sys
import types
import zipfile

import numpy as np
import pytest

from pagemill import backends, cli, config
from pagemill.plans.composites import BlankPages, SizeReader, TwoRegions
from pagemill.streaming import progress


def page(words, y=700):
    glyphs, x = [], 50
    for w in words:
        for c in w + " ":
            glyphs.append([c, x, y, x + 6, y + 10])
            x += 6
    return {"width": 612, "height": 792, "glyphs": glyphs}


GOOD = "this page has a layer of text which reads like any other page of words does".split()


@pytest.fixture
def folder(tmp_path):
    for name, doc in {"two": [page(GOOD), page(GOOD[:9] * 3)], "mixed": [page(GOOD), {"width": 612, "height": 792, "glyphs": []}], "blank": [{"width": 612, "height": 792, "glyphs": []}], "locked": "encrypted", "broken": 7}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    return tmp_path


def test_markdown_to_a_file_and_to_stdout(spark, folder, capsys):
    out = folder / "new" / "two.md"
    assert cli.main([str(folder / "two.json"), "-o", str(out), "--debug-json", str(folder / "d.json")], spark) == 0
    said = capsys.readouterr()
    assert out.read_text().startswith("this page has") and "summary: 2 pages, ok=2 failed=0" in said.err and "complete (native)" in said.err
    assert json.loads((folder / "d.json").read_text())["n_pages"] == 2
    assert cli.main([str(folder / "two.json"), "--pages", "2", "--quiet"], spark) == 0
    said = capsys.readouterr()
    assert said.out.endswith("\n") and said.err == ""


def test_word_file_and_json_lines(spark, folder, capsys):
    out = folder / "two.docx"
    assert cli.main([str(folder / "two.json"), "-o", str(out), "--json-logs", "--no-page-breaks"], spark) == 0
    xml = zipfile.ZipFile(out).read("word/document.xml").decode()
    assert "this page has" in xml and "pageBreakBefore" not in xml
    lines = [json.loads(x) for x in capsys.readouterr().err.splitlines()]
    assert lines[-1] == {"event": "summary", "of": 2, "ok": 2, "failed": 0} and {x["event"] for x in lines} >= {"start", "complete"}


@pytest.mark.parametrize(("args", "code"), [
    (["locked.json"], 3), (["broken.json"], 4), (["none.json"], 4), (["two.json", "-o", "x.md", "--format", "docx"], 4), (["two.json", "--format", "docx"], 4),
    (["two.json", "--pages", "0"], 2), (["two.json", "--max-workers", "0"], 2), (["blank.json"], 2), (["mixed.json", "--quiet"], 0), (["mixed.json", "--strict"], 2),
])
def test_exit_codes(spark, folder, args, code, capsys):
    assert cli.main([str(folder / args[0]), *args[1:]], spark) == code
    assert ("error:" in capsys.readouterr().err) == (code > 0)


def test_prefetch_and_missing_inputs(capsys):
    assert cli.main(["--prefetch-models"]) == 5
    for args in ([], ["x.pdf", "--prefetch-models"]):
        with pytest.raises(SystemExit):
            cli.main(args)


def test_recognised_pages_come_in_phases(spark, folder, capsys):
    assert cli.main([str(folder / "mixed.json"), "-o", str(folder / "m.md"), "--no-formula"], spark, rasteriser=BlankPages, tools=(TwoRegions, SizeReader)) == 0
    text = (folder / "m.md").read_text()
    assert "30 by 10" in text and "![figure on page 2](#)" in text
    assert "complete (ml)" in capsys.readouterr().err


def test_progress_never_ends_a_run(spark, folder):
    def broken(rows):
        raise ValueError("no terminal")

    result, _ = cli.run(spark, str(folder / "two.json"), config.EngineConfig(), report=broken)
    assert result.counts().first().n_pages == 2


def test_bars_count_a_page_once(spark):
    class Terminal(io.StringIO):
        def isatty(self):
            return True

    ui = cli.Reporter("text", Terminal())
    ui.event(spark, [("d", 0, 2, "phase:start:ocr:2"), ("d", 0, 2, "complete:ml"), ("d", 0, 2, "failure:x"), ("d", 1, 2, "complete:ml")])
    assert len(ui.done) == 2 and "2/2 pages" in ui.stream.getvalue()
    assert cli.is_terminal(types.SimpleNamespace()) is False and cli.progress_mode(False, True) == "json"
    events = spark.createDataFrame([(k, "d", p, 2, e) for k, (p, e) in enumerate([(0, "phase:start:ocr:2"), (0, "complete:ml"), (0, "failure:x")])], "event_id long, doc_id string, page_index int, total int, event string")
    assert tuple(progress.bars(progress.parsed(events)).first()) == ("d", 1, 2, "ocr", 2)


# -- back ends ------------------------------------------------------------------------


def test_devices(monkeypatch, caplog):
    monkeypatch.setitem(sys.modules, "torch", None)
    assert backends.device("auto") == backends.device("cuda") == backends.device(None) == "cpu"
    cuda = types.SimpleNamespace(is_available=lambda: True, empty_cache=lambda: None)
    monkeypatch.setitem(sys.modules, "torch", types.SimpleNamespace(cuda=cuda))
    assert (backends.device("auto"), backends.device("cpu")) == ("cuda", "cpu")
    assert (backends.dtype("auto", "cpu"), backends.dtype(None, "cuda"), backends.dtype("auto", "cuda", True), backends.dtype("float16", "cpu")) == ("float32", "float16", "bfloat16", "float16")
    for call in (lambda: backends.device("tpu"), lambda: backends.dtype("int8", "cpu")):
        with pytest.raises(ValueError):
            call()


def test_registry():
    assert backends.build(backends.LAYOUTS, "full-page").detect(np.zeros((4, 6, 3)), 0)[0]["x1"] == 6.0
    assert backends.build(backends.READERS, "surya") is None and backends.pair("full-page", "surya") is None
    with pytest.raises(ValueError):
        backends.build(backends.READERS, "other")
    with pytest.raises(config.ModelUnavailable):
        backends.SuryaReader().load()
    with pytest.raises(config.ModelUnavailable):
        list(backends.Pdfium().pages(b"", None))


class OutOfMemoryError(RuntimeError):
    pass


OutOfMemoryError.__module__ = "torch.cuda"


@pytest.mark.parametrize(("errors", "works"), [([], True), ([OutOfMemoryError("x")], True), ([RuntimeError("wrapped: CUDA out of memory")], True), ([OutOfMemoryError("x"), OutOfMemoryError("y")], False), ([KeyError("z")], False)])
def test_one_more_call_at_batch_one(monkeypatch, errors, works):
    calls = []

    def recognise(images, **options):
        calls.append(options.get("recognition_batch_size"))
        if len(calls) <= len(errors):
            try:
                raise errors[len(calls) - 1]
            except Exception as e:
                raise ValueError("outer") from e
        return [types.SimpleNamespace(text_lines=[types.SimpleNamespace(text="a"), types.SimpleNamespace(text="b")]) for _ in images]

    reader = backends.SuryaReader(batch_size=8)
    reader.tools = recognise, None
    reader.picture = lambda i: i
    regions = [{"x0": 0, "y0": 0, "x1": 3, "y1": 3, "role": r} for r in ("figure", "paragraph", "table")]
    if works:
        assert reader.transcribe_page(regions, np.zeros((9, 9, 3), np.uint8)) == ["", "a\nb", "a\nb"]
    else:
        with pytest.raises(config.RecognitionError):
            reader.transcribe_page(regions, np.zeros((9, 9, 3), np.uint8))
    assert calls == [8, 1][: len(calls)] and len(calls) == (2 if errors and not isinstance(errors[0], KeyError) else 1)
    reader.release()
    assert reader.tools is None


def test_yolo_boxes(monkeypatch):
    listed = lambda v: types.SimpleNamespace(tolist=lambda: v)
    found = types.SimpleNamespace(names={0: "title", 1: "odd"}, boxes=types.SimpleNamespace(xyxy=listed([[1, 2, 3, 4], [5, 6, 7, 8]]), cls=listed([0, 1]), conf=listed([0.9, 0.4])))
    monkeypatch.setitem(sys.modules, "doclayout_yolo", types.SimpleNamespace(YOLOv10=lambda path: types.SimpleNamespace(predict=lambda *a, **k: [found])))
    monkeypatch.setitem(sys.modules, "huggingface_hub", types.SimpleNamespace(hf_hub_download=lambda **k: "weights"))
    assert [(r["role"], r["x1"], r["confidence"]) for r in backends.YoloLayout("cpu").detect(np.zeros((9, 9, 3)), 0)] == [("heading", 3.0, 0.9), ("unknown", 7.0, 0.4)]


def test_easy_reader(monkeypatch):
    monkeypatch.setitem(sys.modules, "easyocr", types.SimpleNamespace(Reader=lambda langs, gpu: types.SimpleNamespace(readtext=lambda i, **k: [(0, "x"), (1, "y")])))
    assert backends.EasyReader("cpu").transcribe({"x0": 0, "y0": 0, "x1": 2, "y1": 2, "role": "paragraph"}, np.zeros((4, 4, 3), np.uint8)) == "x\ny"


def test_pdf_decoder(monkeypatch):
    class Text:
        def count_chars(self):
            return 3

        def get_text_range(self, k, n):
            return "abc"[k]

        def get_charbox(self, k, loose):
            if k == 1:
                raise ValueError("broken glyph")
            return (k, 0, k + 1, 10)

    class Document(list):
        closed = 0

        def close(self):
            Document.closed += 1

    def opened(content):
        if content == b"bad":
            raise OSError("bad")
        return Document([types.SimpleNamespace(get_size=lambda: (600, 800), get_textpage=Text)] * 3)

    revision = [0]
    pdfium = types.SimpleNamespace(PdfDocument=opened, PdfiumError=RuntimeError, raw=types.SimpleNamespace(FPDF_GetSecurityHandlerRevision=lambda d: revision[0]))
    monkeypatch.setitem(sys.modules, "pypdfium2", pdfium)
    got = list(backends.Pdfium().pages(b"x", (0, 2, 9)))
    assert [g[0] for g in got] == [0, 2] and got[0][3] == [("a", 0, 0, 1, 10), ("c", 2, 0, 3, 10)] and Document.closed == 1
    with pytest.raises(config.CorruptedDocument):
        list(backends.Pdfium().pages(b"bad", None))
    revision[0] = 3
    with pytest.raises(config.EncryptedDocument):
        list(backends.Pdfium().pages(b"x", None))
    assert Document.closed == 2


class CountedPages:
    """Notes each page that it renders in a folder named by the doc_id."""

    def render(self, doc_id, page_index, scale):
        with open(f"{doc_id}/{page_index}", "a") as f:
            f.write("x")
        return np.full((4, 5, 3), page_index, np.uint8)


def test_pictures_and_surveys_are_cached(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    pages = spark.createDataFrame([(str(notes), k % 3, "same") for k in range(6)], "doc_id string, page_index int, digest string")
    for _ in range(2):
        got = backends.cached_pictures(pages, CountedPages, str(tmp_path / "cache"))
        assert got.count() == 6 and {(r.page_index, bytes(r.pixels)[0]) for r in got.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert sorted(p.read_text() for p in notes.iterdir()) == ["x", "x", "x"]
    pictures = got.select((got.page_index.cast("string")).alias("key"), "height", "width", "pixels").dropDuplicates(["key"])
    for _ in range(2):
        rows = backends.survey(pictures, ["full-page"], ["size"], str(tmp_path / "runs"), make=stand_in).collect()
        assert sorted((r.key, r.model, r.text) for r in rows) == [(str(k), "size", "$5$ by 4") for k in range(3)]


def stand_in(registry, name):
    return SizeReader() if name == "size" else backends.build(registry, name)


def test_prefetch(monkeypatch):
    seen = []
    tool = types.SimpleNamespace(detect=lambda i, k: seen.append("layout"), transcribe=lambda r, i: seen.append("ocr"))
    monkeypatch.setitem(backends.LAYOUTS, "l", (lambda **_: tool, ()))
    monkeypatch.setitem(backends.READERS, "r", (lambda **_: tool, ()))
    backends.prefetch("l", "r")
    assert seen == ["layout", "ocr"]
    monkeypatch.setitem(backends.READERS, "r", (lambda **_: types.SimpleNamespace(), ()))
    with pytest.raises(config.ModelUnavailable):
        backends.prefetch("l", "r")
