"""Sources: files as bytes, a pluggable PDF decoder, glyph tables, and driver-side small tables.

Decoding a PDF, rasterising and recognising need libraries that are not part of
this package, so they come in as objects.  A decoder runs inside `mapInArrow`,
one file at a time; a file that it refuses is an error row, never a task
failure.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from importlib import metadata
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CorruptedDocument, EncryptedDocument, load_toml
from ..functions.numbers import LONGEST, WORD_LENGTHS, rounded
from ..schemas import CHAR


class PdfDecoder(Protocol):
    """Opens one file's bytes; raises EncryptedDocument or CorruptedDocument."""

    def pages(self, content: bytes, wanted: tuple[int, ...] | None) -> Iterable[tuple[int, float, float, list[tuple[str, float, float, float, float]]]]:
        """(page_index, width, height, glyphs) of each wanted page; a glyph is (text, left, bottom, right, top)."""
        ...


def pdf_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of many files; spark.readStream takes the same options."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


_GLYPHS = "doc_id string, page_index int, page_width double, page_height double, char_seq int, ch string, left double, bottom double, right double, top double, error string"


def decoded(files: DataFrame, decoder: PdfDecoder, pages: tuple[int, ...] | None = None) -> DataFrame:
    """A row for each glyph, one without glyph for a page that has none, one with error for a file that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _GLYPHS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.string()]
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                try:
                    for index, width, height, glyphs in decoder.pages(r["content"], pages):
                        rows += [(r["path"], index, width, height, k, *g, None) for k, g in enumerate(glyphs)] or [(r["path"], index, width, height, *[None] * 7)]
                except EncryptedDocument as e:
                    rows = [(r["path"], *[None] * 9, f"encrypted:{e}")]
                except (CorruptedDocument, ValueError, OSError) as e:
                    rows = [(r["path"], *[None] * 9, f"corrupted:{e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, _GLYPHS)


def glyph_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chars from the top-left origin, pages, errors) from decoded()."""
    from ..operators.extract import flipped

    good = rows.where("error IS NULL")
    pages = good.groupBy("doc_id", "page_index").agg(F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"), (F.count("char_seq") > 0).alias("has_text_layer"))
    return flipped(good.where("char_seq IS NOT NULL")), pages, rows.where("error IS NOT NULL").select("doc_id", "error")


def chars(spark: SparkSession, path: str) -> DataFrame:
    """A glyph table stored as Parquet; page predicates reach its scan."""
    return spark.read.schema(CHAR).parquet(path)


class TableDecoder:
    """A decoder for tests: a file is JSON, a list of {width, height, glyphs} or an error's name."""

    def pages(self, content: bytes, wanted: tuple[int, ...] | None):
        doc = json.loads(content)
        if doc == "encrypted":
            raise EncryptedDocument("password needed")
        if not isinstance(doc, list):
            raise CorruptedDocument("no pages")
        for k, page in enumerate(doc):
            if wanted is None or k in wanted:
                yield k, page["width"], page["height"], [tuple(g) for g in page["glyphs"]]


def reference_lengths(path: str | Path | None = None) -> dict[int, float]:
    """Word-length shares: the built-in ones, or `frequencies` of a JSON file."""
    if path is None:
        return dict(WORD_LENGTHS)
    return {int(k): float(v) for k, v in json.loads(Path(path).read_text(encoding="utf-8"))["frequencies"].items()}


def write_reference_lengths(distribution: DataFrame, path: str | Path) -> None:
    """(token_length, n) as JSON, four decimals, sorted; twelve rows reach the driver."""
    n = {r["token_length"]: float(r["n"]) for r in distribution.select("token_length", "n").collect()}
    out = {"version": "1", "min_length": 1, "max_length": LONGEST, "frequencies": {str(k): v for k, v in rounded(n).items()}}
    Path(path).write_text(json.dumps(out, indent=2), encoding="utf-8")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "text")


def model_registry(spark: SparkSession, path: str | Path) -> DataFrame:
    """(position, name, revision, license, stage) of [[models]]; what an entry lacks is null."""
    keys = ("name", "revision", "license", "stage")
    rows = [(k, *(None if e.get(x) is None else str(e[x]) for x in keys)) for k, e in enumerate(load_toml(path).get("models", []))]
    return spark.createDataFrame(rows, "position int, name string, revision string, license string, stage string")


def installed(spark: SparkSession) -> DataFrame:
    """(name, version, expression, classifiers, license, requires) of the driver's distributions."""
    rows = []
    for d in metadata.distributions():
        m = d.metadata
        if m.get("Name"):
            rows.append((m["Name"], m.get("Version") or "0", m.get("License-Expression"), m.get_all("Classifier") or [], m.get("License"), list(d.requires or [])))
    return spark.createDataFrame(rows, "name string, version string, expression string, classifiers array<string>, license string, requires array<string>")
