"""Decoders, rasterisers, detectors and recognisers by name; each loads its library when it is first used.

None of the libraries comes with this package.  A name whose library is missing
gives ModelUnavailable, at the first use or by `available`.
"""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
import logging
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import CorruptedDocument, EncryptedDocument, ModelUnavailable, RecognitionError
from .functions.numbers import scale
from .operators.images import crop
from .operators.recognise import FullPage, reason_of
from .operators.roles import LEAST_CONFIDENCE, STRUCT_LABELS

LOG = logging.getLogger(__name__)
DEVICES, DTYPES = ("auto", "cuda", "cpu"), ("auto", "float32", "float16", "bfloat16")


def _load(name: str):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ModelUnavailable(f"{name} is not installed") from e


# -- Devices ------------------------------------------------------------------


def has_cuda() -> bool:
    with suppress(ImportError):
        return bool(importlib.import_module("torch").cuda.is_available())
    return False


def device(wanted: str | None) -> str:
    """cuda or cpu; cuda that isn't there is cpu, with a warning."""
    value = (wanted or "auto").lower()
    if value not in DEVICES:
        raise ValueError(f"unknown device: {wanted}")
    if value == "cpu" or not has_cuda():
        if value == "cuda":
            LOG.warning("no CUDA device; the CPU is used")
        return "cpu"
    return "cuda"


def dtype(wanted: str | None, on: str, bfloat16: bool = False) -> str:
    """The precision of a model: by name, else float32 on a CPU and half precision on CUDA."""
    value = (wanted or "auto").lower()
    if value not in DTYPES:
        raise ValueError(f"unknown dtype: {wanted}")
    if value != "auto":
        return value
    return "float32" if on == "cpu" else "bfloat16" if bfloat16 else "float16"


def causes(e: BaseException | None) -> Iterator[BaseException]:
    """An exception and what it came from, each once."""
    seen: set[int] = set()
    while e is not None and id(e) not in seen:
        seen.add(id(e))
        yield e
        e = e.__cause__ or e.__context__


def out_of_device_memory(e: BaseException) -> bool:
    return any(reason_of(x) == "cuda_out_of_memory" or (isinstance(x, RuntimeError) and "CUDA out of memory" in str(x)) for x in causes(e))


def give_back() -> None:
    """Unused device memory goes back, if there is any."""
    with suppress(Exception):
        torch = importlib.import_module("torch")
        if torch.cuda.is_available():
            torch.cuda.empty_cache()


# -- PDF files ------------------------------------------------------------------


class Pdfium:
    """Glyphs of a PDF, and pictures of its pages."""

    def _open(self, content: bytes):
        pdfium = _load("pypdfium2")
        try:
            doc = pdfium.PdfDocument(content)
        except (pdfium.PdfiumError, OSError) as e:
            raise CorruptedDocument(str(e)) from e
        revision = pdfium.raw.FPDF_GetSecurityHandlerRevision(doc)
        if revision and revision != -1:
            doc.close()
            raise EncryptedDocument("a password is needed")
        return doc

    def pages(self, content: bytes, wanted: tuple[int, ...] | None) -> Iterable[tuple[int, float, float, list]]:
        doc = self._open(content)
        try:
            for index in range(len(doc)) if wanted is None else [k for k in wanted if k < len(doc)]:
                page = doc[index]
                width, height = page.get_size()
                layer, glyphs = page.get_textpage(), []
                for k in range(layer.count_chars()):
                    with suppress(Exception):  # a broken glyph is none
                        glyphs.append((layer.get_text_range(k, 1), *layer.get_charbox(k, loose=False)))
                yield index, width, height, glyphs
        finally:
            doc.close()

    def picture(self, content: bytes, index: int, by: float) -> np.ndarray:
        doc = self._open(content)
        try:
            return np.asarray(doc[index].render(scale=by).to_pil().convert("RGB"))
        finally:
            doc.close()


class FilePages:
    """Renders pages of files that every worker can open by their doc_id."""

    def __init__(self, decoder=None):
        self.decoder = decoder or Pdfium()

    def render(self, doc_id: str, page_index: int, scale: float) -> np.ndarray:
        with open(doc_id.removeprefix("file:").replace("//", "/", 1) if doc_id.startswith("file:") else doc_id, "rb") as f:
            return self.decoder.picture(f.read(), page_index, scale)


_PICTURE = "key string, height int, width int, pixels binary"


def cached_pictures(pages: DataFrame, rasteriser: Callable[[], object], cache_path: str, dpi: int = 200) -> DataFrame:
    """pages (doc_id, page_index, digest of the file) with height, width, pixels, from a Parquet cache keyed by content.

    Pages that the cache lacks are rendered, each key once, and appended.
    """
    by = scale(dpi)
    spark = pages.sparkSession
    keyed = pages.withColumn("key", F.substring(F.sha2(F.concat_ws("|", "digest", "page_index", F.lit(dpi)).cast("binary"), 256), 1, 16))
    spark.createDataFrame([], _PICTURE).write.mode("append").parquet(cache_path)
    known = spark.read.schema(_PICTURE).parquet(cache_path)
    todo = keyed.join(known.select("key"), "key", "left_anti").select("key", "doc_id", "page_index").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = None
        for batch in batches:
            for r in batch.to_pylist():
                tool = tool or rasteriser()
                image = np.ascontiguousarray(tool.render(r["doc_id"], r["page_index"], by))
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), pa.array([image.shape[0]], pa.int32()), pa.array([image.shape[1]], pa.int32()), pa.array([image.tobytes()], pa.binary())], ["key", "height", "width", "pixels"])

    todo.mapInArrow(run, _PICTURE).write.mode("append").parquet(cache_path)
    return keyed.join(spark.read.schema(_PICTURE).parquet(cache_path).dropDuplicates(["key"]), "key").drop("key")


# -- Models ------------------------------------------------------------------------


class YoloLayout:
    """Boxes of a document layout model, with its labels as roles."""

    # fixed values: where the public weights are, and the side that the model takes
    REPOSITORY, FILE, SIZE = "juliozhao/DocLayout-YOLO-DocStructBench", "doclayout_yolo_docstructbench_imgsz1024.pt", 1024

    def __init__(self, device_name: str = "auto", **_):
        self.device, self.model = device(device_name), None

    def detect(self, image: np.ndarray, page_index: int) -> list[dict]:
        if self.model is None:
            library, hub = _load("doclayout_yolo"), _load("huggingface_hub")
            try:
                self.model = library.YOLOv10(hub.hf_hub_download(repo_id=self.REPOSITORY, filename=self.FILE))
            except Exception as e:
                raise ModelUnavailable(str(e)) from e
        out = []
        for found in self.model.predict(image, imgsz=self.SIZE, conf=LEAST_CONFIDENCE, device=self.device):
            for box, label, sure in zip(found.boxes.xyxy.tolist(), found.boxes.cls.tolist(), found.boxes.conf.tolist(), strict=True):
                out.append(dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True)) | {"role": STRUCT_LABELS.get(found.names[int(label)], "unknown"), "confidence": float(sure)})
        return out

    def release(self) -> None:
        self.model = None
        give_back()


class _Reader:
    """Texts of regions; figures have none."""

    def transcribe(self, region: dict, image: np.ndarray) -> str:
        return self.transcribe_page([region], image)[0]

    def transcribe_page(self, regions: list[dict], image: np.ndarray) -> list[str]:
        read = [k for k, r in enumerate(regions) if r["role"] != "figure"]
        parts = self.read([crop(image, tuple(regions[k][c] for c in ("x0", "y0", "x1", "y1")), 0) for k in read]) if read else []
        out = [""] * len(regions)
        for k, lines in zip(read, parts, strict=True):
            out[k] = "\n".join(lines)
        return out


class SuryaReader(_Reader):
    """All regions of a page in one call; where the device's memory runs out it is called once more, one image at a time."""

    def __init__(self, batch_size: int | None = None, formulas: bool = True, **_):
        self.batch_size, self.formulas, self.tools = batch_size, formulas, None

    @staticmethod
    def picture(image: np.ndarray):
        return _load("PIL.Image").fromarray(image)

    def load(self):
        if self.tools is None:
            detection, foundation, recognition = (_load(f"surya.{m}") for m in ("detection", "foundation", "recognition"))
            try:
                self.tools = recognition.RecognitionPredictor(foundation.FoundationPredictor()), detection.DetectionPredictor()
            except Exception as e:
                raise ModelUnavailable(str(e)) from e
        return self.tools

    def read(self, images: list[np.ndarray]) -> list[list[str]]:
        recognise, detect = self.load()
        sizes = lambda n: {} if n is None else {"recognition_batch_size": n, "detection_batch_size": n}
        pictures = [self.picture(i) for i in images]
        give_back()
        try:
            found = recognise(pictures, det_predictor=detect, math_mode=self.formulas, **sizes(self.batch_size))
        except Exception as e:
            if not out_of_device_memory(e):
                raise RecognitionError(str(e)) from e
            give_back()
            try:
                found = recognise(pictures, det_predictor=detect, math_mode=self.formulas, **sizes(1))
            except Exception as again:
                raise RecognitionError(f"again: {again}") from again
            finally:
                give_back()
        return [[line.text for line in page.text_lines] for page in found]

    def release(self) -> None:
        self.tools = None
        give_back()


class EasyReader(_Reader):
    """Region by region; batch size and formulas mean nothing to it."""

    def __init__(self, device_name: str = "auto", **_):
        self.device, self.reader = device(device_name), None

    def read(self, images: list[np.ndarray]) -> list[list[str]]:
        if self.reader is None:
            library = _load("easyocr")
            try:
                self.reader = library.Reader(["ar"], gpu=self.device == "cuda")
            except Exception as e:
                raise ModelUnavailable(str(e)) from e
        try:
            return [[r[1] for r in self.reader.readtext(i, detail=1, paragraph=True)] for i in images]
        except Exception as e:
            raise RecognitionError(str(e)) from e


#: name -> (class, libraries that it needs)
LAYOUTS: dict[str, tuple[Callable, tuple[str, ...]]] = {"full-page": (lambda **_: FullPage(), ()), "doclayout-yolo": (YoloLayout, ("doclayout_yolo", "huggingface_hub"))}
READERS: dict[str, tuple[Callable, tuple[str, ...]]] = {"surya": (SuryaReader, ("surya",)), "easyocr-ara": (EasyReader, ("easyocr",))}


def build(registry: dict, name: str, **options):
    """The back end of this name, None if one of its libraries is missing; an unknown name is a ValueError."""
    if name not in registry:
        raise ValueError(f"unknown back end: {name}")
    make, needs = registry[name]
    return None if any(importlib.util.find_spec(n) is None for n in needs) else make(**options)


def pair(layout: str, reader: str, readers: dict | None = None, **options) -> tuple[Callable, Callable] | None:
    """Factories of a detector and a recogniser for every worker; None unless both are there."""
    readers = readers or READERS
    if build(LAYOUTS, layout, **options) is None or build(readers, reader, **options) is None:
        return None
    return lambda: build(LAYOUTS, layout, **options), lambda: build(readers, reader, **options)


def prefetch(layout: str, reader: str, readers: dict | None = None, **options) -> None:
    """Loads both models by running them once on a blank picture; ModelUnavailable if that fails."""
    blank = np.full((32, 32, 3), 255, np.uint8)
    region = {"x0": 0.0, "y0": 0.0, "x1": 32.0, "y1": 32.0, "role": "paragraph"}
    for registry, name, use in ((LAYOUTS, layout, lambda t: t.detect(blank, 0)), (readers or READERS, reader, lambda t: t.transcribe(region, blank))):
        tool = build(registry, name, **options)
        if tool is None:
            raise ModelUnavailable(f"{name} lacks a library")
        try:
            use(tool)
        except Exception as e:
            raise ModelUnavailable(f"{name}: {e}") from e


def survey(pictures: DataFrame, layouts: list[str], readers: list[str], cache_path: str, make: Callable = build) -> DataFrame:
    """(key, layout, model, text) of every pair of back ends over pictures (key, height, width, pixels); runs are cached by pair and key."""
    schema = "key string, layout string, model string, text string"
    spark = pictures.sparkSession
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    for layout in layouts:
        for reader in readers:
            done = spark.read.schema(schema).parquet(cache_path).where((F.col("layout") == layout) & (F.col("model") == reader))

            def run(batches: Iterator[pa.RecordBatch], layout=layout, reader=reader) -> Iterator[pa.RecordBatch]:
                tools = []
                for batch in batches:
                    rows = []
                    for p in batch.to_pylist():
                        tools = tools or [make(LAYOUTS, layout), make(READERS, reader)]
                        image = np.frombuffer(p["pixels"], np.uint8).reshape(p["height"], p["width"], -1)
                        found = tools[0].detect(image, 0)
                        rows.append((p["key"], layout, reader, "\n\n".join(tools[1].transcribe(r, image) or "" for r in found)))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["key", "layout", "model", "text"])

            pictures.join(done.select("key"), "key", "left_anti").mapInArrow(run, schema).write.mode("append").parquet(cache_path)
    return spark.read.schema(schema).parquet(cache_path).where(F.col("layout").isin(layouts) & F.col("model").isin(readers)).dropDuplicates(["key", "layout", "model"])


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()
