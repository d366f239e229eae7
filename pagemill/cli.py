"""The command line: one document in, Markdown or a Word file out.

Exit codes: 0 done, if only in part; 2 every page failed, a failed page with
--strict, or a wrong option; 3 encrypted; 4 corrupted, missing, or a format
that doesn't fit; 5 a model is not to be had.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import TextIO

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backends, config
from .lineage import kept
from .operators import emit, extract, recognise, transcribe
from .sources import documents, docx
from .streaming import progress


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagemill", description="Pages of a document as text, tables and headings.")
    add = p.add_argument
    add("input", nargs="?", help="a PDF file, or a JSON file of pages with glyphs")
    add("--prefetch-models", action="store_true", help="load the chosen models once, then end")
    add("-o", "--output", help="file to write; standard output without it")
    add("--format", choices=("md", "docx"))
    add("--pages", help="pages such as 1-3,7")
    add("--strict", action="store_true", help="a failed page ends the run")
    add("--quiet", action="store_true", help="no progress")
    add("--json-logs", action="store_true", help="progress as JSON lines")
    add("--config", help="a TOML file of settings")
    add("--debug-json", help="a file for counts and a line for each region")
    add("--max-workers", default="1", help="a number, or auto")
    add("--dpi", type=int)
    add("--device", choices=backends.DEVICES)
    add("--dtype", choices=backends.DTYPES)
    add("--layout", choices=tuple(backends.LAYOUTS), default="full-page")
    add("--ocr", choices=tuple(backends.READERS), default="surya")
    add("--no-formula", action="store_true", help="formula marks are taken out")
    add("--batch-size", type=int)
    add("--ltr", action="store_true", help="a Word file from left to right")
    add("--no-page-breaks", action="store_true")
    add("--force-ml", action="store_true", help="every page is recognised")
    return p


def progress_mode(quiet: bool, json_logs: bool) -> str:
    return "quiet" if quiet else "json" if json_logs else "text"


def is_terminal(stream: TextIO) -> bool:
    try:
        return bool(stream.isatty())
    except (AttributeError, ValueError, OSError):
        return False


class Reporter:
    """Progress on a stream: nothing, log lines, JSON lines, or, on a terminal, two bars that are drawn over."""

    def __init__(self, mode: str, stream: TextIO):
        self.mode, self.stream, self.bars = mode, stream, mode == "text" and is_terminal(stream)
        self.done: set[tuple[str, int]] = set()
        self.phase, self.phase_total, self.phase_done = "", 0, 0

    def event(self, spark: SparkSession, rows: list[tuple[str, int, int, str]]) -> None:
        """Events (doc_id, page_index, total, event) as they come."""
        if self.mode == "quiet" or not rows:
            return
        if self.bars:
            for doc, page, total, event in rows:
                self._bar(doc, page, total, event)
            return
        raw = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "position int, doc_id string, page_index int, total int, event string")
        shown = progress.line_events(progress.parsed(raw)).orderBy("position")
        lines = (progress.as_json if self.mode == "json" else progress.as_text)(shown)
        self.stream.writelines(f"{r.value}\n" for r in lines.collect())

    def _bar(self, doc: str, page: int, total: int, event: str) -> None:
        if event.startswith("phase:start:"):
            _, _, self.phase, count = event.split(":")
            self.phase_total, self.phase_done = max(1, int(count)), int(int(count) == 0)
        elif event.startswith(("complete:", "failure:")):
            if (doc, page) not in self.done:
                self.done.add((doc, page))
            self.phase_done = min(self.phase_total, self.phase_done + 1)
        bar = lambda n, of: "#" * (20 * n // max(1, of)) + "." * (20 - 20 * n // max(1, of))
        self.stream.write(f"\r[{bar(len(self.done), total)}] {len(self.done)}/{total} pages  [{bar(self.phase_done, self.phase_total)}] {self.phase}")

    def summary(self, n: int, ok: int, failed: int) -> None:
        if self.bars:
            self.stream.write("\n")
        if self.mode == "json":
            self.stream.write(f'{{"event":"summary","of":{n},"ok":{ok},"failed":{failed}}}\n')
        elif self.mode == "text":
            self.stream.write(f"summary: {n} pages, ok={ok} failed={failed}\n")


def decoder_of(path: str):
    return documents.TableDecoder() if Path(path).suffix.lower() == ".json" else backends.Pdfium()


def run(spark: SparkSession, path: str, settings: config.EngineConfig, layout: str = "full-page", ocr: str = "surya", decoder=None, rasteriser: Callable | None = None, tools: tuple[Callable, Callable] | None = None, report: Callable[[list], None] | None = None) -> tuple[transcribe.Result, DataFrame]:
    """(result, errors) of a file; report gets each phase's events as it ends, and what it raises is left alone."""

    def tell(rows: list) -> None:
        if report:
            try:
                report(rows)
            except Exception as e:  # progress never ends a run
                backends.LOG.warning("progress: %s", e)

    files = documents.pdf_files(spark, path, "*")
    glyphs, pages, errors = documents.glyph_tables(kept(documents.decoded(files, decoder or decoder_of(path), settings.pages)))
    bad = errors.first()
    if bad:
        kind, _, why = bad.error.partition(":")
        raise (config.EncryptedDocument if kind == "encrypted" else config.CorruptedDocument)(why)
    pages, regions = kept(extract.pages_of(glyphs, pages)), kept(extract.regions_of(glyphs))
    total = pages.count()
    tell([(path, 0, total, f"phase:start:validate:{total}")] + [(path, r.page_index, total, "start") for r in pages.select("page_index").orderBy("page_index").toLocalIterator()])
    found = tools or backends.pair(layout, ocr, device_name=settings.device, batch_size=settings.batch_size, formulas=not settings.strip_formulas)
    seen = None
    if found:

        def seen(todo: DataFrame) -> DataFrame:
            n = todo.count()
            tell([(path, 0, total, f"phase:start:{phase}:{n}") for phase in ("rasterise", "layout", "ocr")])
            return recognise.phased(rasteriser or backends.FilePages, *found, dpi=settings.dpi, strip_formulas=settings.strip_formulas)(todo)

    result = transcribe.transcribe(pages, regions, settings, recognise=seen)
    result.outcomes, result.regions = kept(result.outcomes), kept(result.regions)
    ends = progress.outcome_events(result.outcomes).where("event <> 'start'").orderBy("page_index")
    tell([(path, r.page_index, total, r.event) for r in ends.toLocalIterator()])
    return result, errors


def write_output(result: transcribe.Result, settings: config.EngineConfig, output: str | None, stdout: TextIO, rtl: bool = True, page_breaks: bool = True) -> None:
    """Markdown to a file as it is, to standard output with a line end; a Word file to its path. Folders are made."""
    if settings.output_format == "docx":
        row = docx.docx(result.regions, settings.normalisation, settings.apply_bidi, rtl, page_breaks).first()
        target = Path(output)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(row.content if row else docx.package(docx.document_xml([], rtl)))
        return
    row = emit.markdown(result.regions, settings.normalisation, settings.apply_bidi).first()
    said = row.markdown if row else ""
    if output is None:
        stdout.write(said if said.endswith("\n") else said + "\n")
        return
    target = Path(output)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(said, encoding="utf-8")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, decoder=None, rasteriser: Callable | None = None, tools: tuple[Callable, Callable] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)

    def end(code: int, why: str) -> int:
        print(f"error: {why}", file=sys.stderr)
        return code

    if a.prefetch_models:
        if a.input:
            p.error("--prefetch-models takes no input")
        try:
            backends.prefetch(a.layout, a.ocr, device_name="cpu")
        except config.ModelUnavailable as e:
            return end(e.exit_code, str(e))
        return 0
    if not a.input:
        p.error("an input is needed")
    try:
        workers = config.workers(a.max_workers)
        settings = config.engine_config(config=a.config, output=a.output, format=a.format, pages=a.pages, dpi=a.dpi, device=a.device, dtype=a.dtype, batch_size=a.batch_size or 1, strict=a.strict, force_ml=a.force_ml, strip_formulas=a.no_formula)
    except config.FormatMismatch as e:
        return end(e.exit_code, str(e))
    except (ValueError, OSError) as e:
        return end(2, str(e))
    if not Path(a.input).is_file():
        return end(4, f"no such file: {a.input}")
    spark = spark or SparkSession.builder.master(f"local[{max(2, workers)}]").appName("pagemill").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    ui = Reporter(progress_mode(a.quiet, a.json_logs), sys.stderr)
    try:
        result, _ = run(spark, a.input, settings, a.layout, a.ocr, decoder, rasteriser, tools, lambda rows: ui.event(spark, rows))
        counts = result.counts().agg(F.sum("n_pages"), F.sum("ok_pages"), F.sum("failed_pages")).first()
    except config.TranscriptionError as e:
        return end(e.exit_code, str(e))
    except PySparkException as e:
        lost = "ModelUnavailable" in str(e)
        return end(5 if lost else 2, str(e).splitlines()[0])
    n, ok, failed = (int(x or 0) for x in counts)
    ui.summary(n, ok, failed)
    if n and not ok:
        return end(2, "every page failed")
    write_output(result, settings, a.output, sys.stdout, not a.ltr, not a.no_page_breaks)
    if a.debug_json:
        row = emit.sidecar(result.regions, result.outcomes).first()
        Path(a.debug_json).write_text(row.json if row else "{}", encoding="utf-8")
    return 0
