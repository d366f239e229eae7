"""Layout detection and recognition as plug-ins over page images.

A detector and a recogniser are objects that are built once in each Python
worker.  What they raise becomes a failure_reason of the page.  The full-page
detector needs no model.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import scale
from ..lineage import kept
from ..schemas import as_regions


class Rasteriser(Protocol):
    def render(self, doc_id: str, page_index: int, scale: float) -> np.ndarray:
        """RGB pixels of a page."""
        ...


class LayoutDetector(Protocol):
    def detect(self, image: np.ndarray, page_index: int) -> list[dict]:
        """Regions as dicts (x0, y0, x1, y1 in pixels, role, optional heading_level, confidence)."""
        ...


class Recogniser(Protocol):
    def transcribe(self, region: dict, image: np.ndarray) -> str: ...


class FullPage:
    """One paragraph over the whole image."""

    def detect(self, image: np.ndarray, page_index: int) -> list[dict]:
        h, w = image.shape[:2]
        return [{"x0": 0.0, "y0": 0.0, "x1": float(w), "y1": float(h), "role": "paragraph"}]


def full_page(pages: DataFrame, dpi: int = 200) -> DataFrame:
    """FullPage as a projection from page sizes in points."""
    s = scale(dpi)
    w, h = F.floor(F.col("page_width") * s).cast("double"), F.floor(F.col("page_height") * s).cast("double")
    return as_regions(pages.withColumns({"seq": F.lit(0), "x0": F.lit(0.0), "y0": F.lit(0.0), "x1": w, "y1": h, "text": F.lit(""), "role": F.lit("paragraph"), "source": F.lit("ocr")}))


_SCHEMA = "doc_id string, page_index int, seq int, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, text string, role string, source string, confidence double, heading_level int, font_size double, group_id string, failure_reason string"


def reason_of(e: BaseException) -> str:
    """Memory errors by what they are, others as Type:message."""
    kind = type(e)
    if isinstance(e, MemoryError):
        return "out_of_memory"
    if isinstance(e, RuntimeError) and kind.__name__ == "OutOfMemoryError" and kind.__module__.split(".")[0] == "torch":
        return "cuda_out_of_memory"
    return f"{kind.__name__}:{e}"


def _released(tools: list) -> None:
    """Tools that hold a device or a model give it back when a task ends."""
    for tool in tools:
        if callable(give_back := getattr(tool, "release", None)):
            give_back()


def _read(tool, regions: list[dict], image: np.ndarray) -> list[str]:
    batch_call = getattr(tool, "transcribe_page", None)
    if callable(batch_call):
        return batch_call(regions, image)
    return [None if r["role"] == "figure" else tool.transcribe(r, image) for r in regions]


def _rows(batch: list[dict]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in batch], schema=_ARROW)


def _finished(found: DataFrame, strip_formulas: bool) -> DataFrame:
    from ..schemas import REGION_FIELDS

    out = found.withColumn("text", text.strip_math(F.col("text"))) if strip_formulas else found
    return out.withColumns({n: F.lit(None).cast(REGION_FIELDS[n]) for n in ("list_marker", "table_grid", "merged_cells")})


def _failed(key: dict, page: dict, e: BaseException) -> dict:
    return key | {"page_width": page["page_width"], "page_height": page["page_height"], "failure_reason": reason_of(e)}


def recogniser(rasteriser: Callable[[], Rasteriser], detector: Callable[[], LayoutDetector], ocr: Callable[[], Recogniser], dpi: int = 200, strip_formulas: bool = True) -> Callable[[DataFrame], DataFrame]:
    """What transcribe() calls with the pages to recognise, in one pass. Figures are left as they are; a page is one unit of failure."""
    s = scale(dpi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools: list = []
        try:
            for batch in batches:
                out = []
                for page in batch.select(["doc_id", "page_index", "page_width", "page_height"]).to_pylist():
                    key = {"doc_id": page["doc_id"], "page_index": page["page_index"]}
                    try:
                        if not tools:
                            tools = [rasteriser(), detector(), ocr()]
                        image = tools[0].render(page["doc_id"], page["page_index"], s)
                        h, w = image.shape[:2]
                        size = {"page_width": float(w), "page_height": float(h)}
                        regions = tools[1].detect(image, page["page_index"])
                        texts = _read(tools[2], regions, image)
                        out += [key | size | {"seq": k, "source": "ocr", "text": t or ""} | r for k, (r, t) in enumerate(zip(regions, texts, strict=True))]
                    except Exception as e:  # a page's failure is a row
                        out.append(_failed(key, page, e))
                if out:
                    yield _rows(out)
        finally:
            _released(tools)

    return lambda pages: _finished(pages.select("doc_id", "page_index", "page_width", "page_height").mapInArrow(run, _SCHEMA), strip_formulas)


_IMAGE = "doc_id string, page_index int, page_width double, page_height double, height int, width int, pixels binary, regions string, failure_reason string"
_IMAGE_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in _IMAGE.split(", "))])


def _phase(make: Callable[[], object], work: Callable[[object, dict], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A phase over rows of _IMAGE: pages that failed before pass, others get what work(tool, page) gives, or fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools: list = []
        try:
            for batch in batches:
                out = []
                for page in batch.to_pylist():
                    if page["failure_reason"] is None:
                        try:
                            tools = tools or [make()]
                            page |= work(tools[0], page)
                        except Exception as e:
                            page |= {"failure_reason": reason_of(e), "pixels": None}
                    out.append(page)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_IMAGE_ARROW)
        finally:
            _released(tools)

    return run


def pixels_of(page: dict) -> np.ndarray:
    return np.frombuffer(page["pixels"], np.uint8).reshape(page["height"], page["width"], -1)


def phased(rasteriser: Callable[[], Rasteriser], detector: Callable[[], LayoutDetector], ocr: Callable[[], Recogniser], dpi: int = 200, strip_formulas: bool = True, keep: Callable[[DataFrame], DataFrame] = kept) -> Callable[[DataFrame], DataFrame]:
    """The same in phases - rasterise, layout, recognise - with `keep` after the first two: a phase that fails repeats none before it,
    and only one phase's tool is loaded at a time."""
    s = scale(dpi)

    def render(tool, page: dict) -> dict:
        image = np.ascontiguousarray(tool.render(page["doc_id"], page["page_index"], s))
        return {"height": image.shape[0], "width": image.shape[1], "pixels": image.tobytes()}

    def detect(tool, page: dict) -> dict:
        return {"regions": json.dumps(tool.detect(pixels_of(page), page["page_index"]))}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools: list = []
        try:
            for batch in batches:
                out = []
                for page in batch.to_pylist():
                    key = {"doc_id": page["doc_id"], "page_index": page["page_index"]}
                    if page["failure_reason"] is not None:
                        out.append(key | {"page_width": page["page_width"], "page_height": page["page_height"], "failure_reason": page["failure_reason"]})
                        continue
                    try:
                        tools = tools or [ocr()]
                        regions = json.loads(page["regions"])
                        size = {"page_width": float(page["width"]), "page_height": float(page["height"])}
                        out += [key | size | {"seq": k, "source": "ocr", "text": t or ""} | r for k, (r, t) in enumerate(zip(regions, _read(tools[0], regions, pixels_of(page)), strict=True))]
                    except Exception as e:
                        out.append(_failed(key, page, e))
                if out:
                    yield _rows(out)
        finally:
            _released(tools)

    def apply(pages: DataFrame) -> DataFrame:
        typed = {n: F.lit(None).cast(k) for n, k in (f.split() for f in _IMAGE.split(", ")) if n not in ("doc_id", "page_index", "page_width", "page_height")}
        blank = pages.select("doc_id", "page_index", F.col("page_width").cast("double"), F.col("page_height").cast("double")).withColumns(typed)
        images = keep(blank.mapInArrow(_phase(rasteriser, render), _IMAGE))
        found = keep(images.mapInArrow(_phase(detector, detect), _IMAGE))
        return _finished(found.mapInArrow(read, _SCHEMA), strip_formulas)

    return apply


_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[k]) for n, k in (f.split() for f in _SCHEMA.split(", "))])


def lengths_by_model(results: DataFrame, models: list[str], keys: tuple[str, ...] = ("page_index",)) -> DataFrame:
    """(keys, one column a model): characters of text that each model gave."""
    return results.withColumn("n", F.char_length("text")).groupBy(*keys).pivot("model", models).agg(F.first("n"))


def assembled(crops: DataFrame) -> DataFrame:
    """(doc_id, markdown): for each page a comment and its non-blank crop texts in order."""
    body = F.when(text.strip(F.coalesce("text", F.lit(""))) != "", F.struct("seq", text.strip(F.col("text")).alias("text")))
    page = crops.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(body)).alias("parts"))
    block = F.array_join(F.concat(F.array(F.concat(F.lit("<!-- page "), F.col("page_index") + 1, F.lit(" -->"))), F.transform("parts", lambda p: p["text"])), "\n\n")
    doc = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", block.alias("block")))).alias("blocks"))
    return doc.select("doc_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("markdown"))


def clipped(boxes: DataFrame, padding: int = 4) -> DataFrame:
    """Boxes in whole pixels with a margin, inside (page_width, page_height)."""
    cut = lambda c: F.col(c).cast("int")
    return boxes.withColumns({"x0": F.greatest(F.lit(0), cut("x0") - padding), "y0": F.greatest(F.lit(0), cut("y0") - padding), "x1": F.least(cut("page_width"), cut("x1") + padding), "y1": F.least(cut("page_height"), cut("y1") + padding)})
