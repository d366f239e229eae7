"""Media columns: bytes kept as the coefficients of progressive JPEG files, and RGB tensors from them.

`encode_media` pads a text's UTF-8 with zero bytes to a positive multiple of
64 and stores each 64 bytes as the coefficients of one block (zigzag order, a
byte a coefficient: the format's own unit, so nothing is rounded).
`decode_media` reads the stored bytes back: coefficients accumulated over all
scans, the payload from them, and the picture - inverse transform, chroma
repeated to full resolution, RGB.

Null text is empty and gives 64 zero bytes.  Equal texts give equal files and
features: the transform sums integers in float64, exactly, in any order.  Rows
repeat as given, columns other than doc_id and text are dropped, an empty
table gives no rows.  Texts are worked on in groups of GROUP_BYTES; a longer
one is a group of its own, and pictures get wider as texts get longer (one
picture holds 4,095 x 4,095 MCUs, 6.4 GB of text, more than a Spark string).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import forget, scratch, table, written
from .shingles import blocks, buffers

GROUP_BYTES = 1 << 19
#: Parts in which tensors are stored and read: they take some 3.2 times the input, a part of them 0.1.
ROUNDS = 32
#: Media of many short texts are alike in their headers and in whole words: level 6 makes them a tenth smaller than 3.
LEVEL = "6"

_MEDIA = "doc_id long, n_bytes long, media binary"
_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_TENSOR = ", height int, width int, rgb binary, payload binary"


def payload_blocks(raw: np.ndarray) -> np.ndarray:
    n = max(1, -(-len(raw) // 64))
    out = np.zeros(n * 64, np.int64)
    out[: len(raw)] = raw
    return out.reshape(n, 64)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (without padding), media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            raw, off = buffers(batch.column("text"))
            for i, j in blocks(off, GROUP_BYTES):
                files = jpeg.encode([payload_blocks(raw[off[k] : off[k + 1]]) for k in range(i, j)])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, _MEDIA)


def payload_of(image: jpeg.Image, coefficients: np.ndarray) -> bytes:
    """The blocks in the order of their MCUs, as many as the file's comment says."""
    w, h = image.mcus
    order = np.empty(6 * w * h, np.int64)
    for c, which in enumerate("012"):
        order[jpeg._order(w, h, which)] = np.arange(image.first[c], image.first[c + 1])
    return coefficients[order[: image.blocks]].astype(np.uint8).tobytes()


def _features(images: list[jpeg.Image], coefficients: list[np.ndarray]) -> list[str]:
    """Size, and mean and mean square of R, G and B (as sums of integers), over the full-resolution picture."""
    order = [np.concatenate([jpeg._order(*m.mcus, which) for which in "012"]) for m in images]
    where = np.concatenate([[0], np.cumsum([len(o) for o in order])])
    flat = np.empty((int(where[-1]), 64), np.int64)
    flat[np.concatenate([at + o for o, at in zip(order, where, strict=False)])] = np.concatenate([jpeg.dequantised(m, c) for m, c in zip(images, coefficients, strict=True)])
    tiles = jpeg.clipped(flat)
    mcu = tiles.reshape(-1, 6, 8, 8)
    y = mcu[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    cb, cr = (mcu[:, k].repeat(2, 1).repeat(2, 2) for k in (4, 5))
    first = where[:-1] // 6
    sums = []
    for channel in jpeg.channels(y, cb, cr):
        flat = channel.reshape(len(channel), 256)
        sums.append(np.add.reduceat(flat.sum(1, dtype=np.int64), first))
        sums.append(np.add.reduceat(np.einsum("ij,ij->i", flat, flat, dtype=np.int64), first))
    return [f"{m.height}x{m.width}:" + ":".join(str(int(s[i])) for s in sums) for i, m in enumerate(images)]


def decode_media(media: DataFrame, tensors: bool = False) -> DataFrame:
    """What the stored bytes hold; with tensors also height, width, rgb (height * width * 3 bytes) and payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("media"))
            for i, j in blocks(off, 2 * GROUP_BYTES):
                files = [raw[off[k] : off[k + 1]].tobytes() for k in range(i, j)]
                images, coefficients = jpeg.coefficients_of(files)
                payloads = [payload_of(m, c) for m, c in zip(images, coefficients, strict=True)]
                out = [
                    batch.column("doc_id").slice(i, j - i), batch.column("n_bytes").slice(i, j - i),
                    pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array(_features(images, coefficients)),
                ]
                names = [x.split()[0] for x in _READ.split(", ")]
                if tensors:
                    rgb = [jpeg.rgb(m, jpeg.samples(m, c)) for m, c in zip(images, coefficients, strict=True)]
                    out += [pa.array([m.height for m in images], pa.int32()), pa.array([m.width for m in images], pa.int32()), pa.array([t.tobytes() for t in rgb], pa.binary()), pa.array(payloads, pa.binary())]
                    names += ["height", "width", "rgb", "payload"]
                yield pa.RecordBatch.from_arrays(out, names)

    return media.mapInArrow(run, _READ + _TENSOR * tensors)


def tensor_features(stored: DataFrame) -> DataFrame:
    """The columns of _READ, with the feature worked out from the stored tensors: size, and sums and sums of squares of R, G and B."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("rgb"))
            found = []
            for k, (h, w) in enumerate(zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)):
                pixels = raw[off[k] : off[k + 1]].reshape(-1, 3)
                sums = np.zeros((3, 2), np.int64)
                for at in range(0, len(pixels), 1 << 20):
                    part = pixels[at : at + (1 << 20)].astype(np.int64)
                    sums += np.stack([part.sum(0), (part * part).sum(0)], 1)
                found.append(f"{h}x{w}:" + ":".join(map(str, sums.ravel().tolist())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(found, pa.string())], [x.split()[0] for x in _READ.split(", ")])

    names = [x.split()[0] for x in _READ.split(", ")][:-1]
    return stored.select(*names, "height", "width", "rgb").mapInArrow(run, _READ)


def media_features(docs: DataFrame) -> DataFrame:
    """Media stored as a table of the shared folder and read back, RGB tensors of it stored as tables, features from those.

    Tensors take more than the texts, so they are made, stored and read in ROUNDS parts; a part's table goes when its
    features are written.  Media lie in a folder a part, so each is read once.
    """
    spark = docs.sparkSession
    media = encode_media(docs).withColumn("_round", F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).cast("int"))
    path, folder = scratch(spark, "media"), scratch(spark, "features")
    media.write.partitionBy("_round").options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": LEVEL}).parquet(path)
    media = spark.read.schema(media.schema).parquet(path)
    names = [x.split()[0] for x in (_READ + _TENSOR).split(", ")]
    for k in range(ROUNDS):
        part = decode_media(media.where(F.col("_round") == k).drop("_round"), tensors=True).select(*(c for c in names if c not in ("feature", "payload")))
        stored = written(part, "tensors")
        tensor_features(stored).write.mode("append").option("compression", "zstd").parquet(folder)
        forget(stored)
    return spark.read.schema(_READ).parquet(folder)


def op10_media(spark, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
