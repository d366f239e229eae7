"""Quality scores: random-indexing word vectors pooled per document, and a small network.

A token is a run of letters, digits and non-ASCII bytes, or a run of other
visible characters, case kept, and lands in one of 2 ** 15 rows.  Each row has
a fixed sparse index vector of +1 and -1; a token's vector is the sum of the
index vectors of its neighbours (two on each side, inside a document) over the
whole corpus, scaled to unit length.  A document is the mean of its tokens'
vectors and of their squares.  A network of two layers, fitted in numpy,
scores it; a temperature fitted on rows kept out of the fit calibrates the
probabilities.

The vectors cover all documents.  The network learns from at most
MAX_LABELLED labelled rows (a documented bound: the ids of the least
xxhash64), none with crc32(doc_id) mod 3 = 1; labels, lang, source and doc_id are no inputs.
Null or empty texts are the zero vector and get a score too; rows repeat as
given; without usable labels every score is 0.5 and `predicted` is 1.  A
doc_id with several labels has the largest, one with several texts is learnt
from the text of the least vector.  Equal texts have equal scores; long texts
are pooled whole, block by block.  An empty table gives no rows.  Columns of
documents go along, but for those named like the two that are added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import few_large_tasks, merged_tables, table
from .shingles import CASED, blocks, buffers, words

ROWS, DIM, NONZERO, WINDOW = 1 << 15, 32, 4, 2
MAX_LABELLED = 6000
HIDDEN, EPOCHS, BATCH, SEED = 32, 60, 128, 7
#: The table of vectors travels in so many pieces.
PIECES = 16

_KINDS = np.full(256, 2, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1

_rng = np.random.Generator(np.random.PCG64(SEED))
_INDEX_AT = _rng.integers(0, DIM, (ROWS, NONZERO))
_INDEX_SIGN = _rng.choice([-1.0, 1.0], (ROWS, NONZERO))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each token, its document)."""
    h, doc = words(raw, offsets, _KINDS, CASED)
    return (h & np.uint64(ROWS - 1)).astype(np.int64), doc


def _neighbours(total: np.ndarray, row: np.ndarray, doc: np.ndarray) -> None:
    for d in range(1, WINDOW + 1):
        same = doc[d:] == doc[:-d]
        a, b = row[:-d][same], row[d:][same]
        for word, context in ((a, b), (b, a)):
            for j in range(NONZERO):
                total += np.bincount(word * DIM + _INDEX_AT[context, j], _INDEX_SIGN[context, j], ROWS * DIM)


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """(ROWS, DIM) unit vectors. Each task adds up one table; tables meet piece by piece. 4 MB reach the driver."""
    size = ROWS * DIM // PIECES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIM)
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for i, j in blocks(off):
                _neighbours(total, *tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
        yield _pieces({p: total[p * size : (p + 1) * size] for p in range(PIECES)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, values in zip(batch.column("piece").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(zlib.decompress(values), np.int64)
        if sums:
            yield _pieces(sums)

    def _pieces(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        # sums of +1 and -1: whole numbers, most of them small
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.astype(np.int64).tobytes(), 1) for v in sums.values()], pa.binary())], ["piece", "sums"])

    parts = merged_tables(few_large_tasks(docs.select("text"), 16).mapInArrow(gather, "piece int, sums binary"), merge, PIECES)
    out = np.zeros(ROWS * DIM)
    for piece, values in parts.collect():
        out[piece * size : (piece + 1) * size] = np.frombuffer(zlib.decompress(values), np.int64)
    out = out.reshape(ROWS, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, 2 * DIM): means of the tokens' vectors and of their squares."""
    n = len(offsets) - 1
    out = np.zeros((n, 2 * DIM))
    # a token's vector is 32 times its bytes and more: small blocks
    for i, j in blocks(offsets, 1 << 17):
        row, doc = tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if not len(row):
            continue
        count = np.bincount(doc, minlength=j - i)
        some = np.flatnonzero(count)
        first = (np.cumsum(count) - count)[some]
        v = vectors[row].astype(np.float64)
        out[i + some, :DIM] = np.add.reduceat(v, first) / count[some, None]
        np.multiply(v, v, out=v)
        out[i + some, DIM:] = np.add.reduceat(v, first) / count[some, None]
    return out


class Network:
    """tanh layer, logistic output, Adam; inputs are standardised."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Every fifth row is kept out and fits the temperature."""
        held = np.arange(len(y)) % 5 == 4
        a, b = x[~held], y[~held].astype(float)
        self.mean, self.scale = a.mean(0), a.std(0) + 1e-6
        a = (a - self.mean) / self.scale
        rng = np.random.Generator(np.random.PCG64(SEED))
        w = [rng.normal(0, 1 / np.sqrt(a.shape[1]), (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(b))
            for at in range(0, len(order), BATCH):
                k = order[at : at + BATCH]
                h = np.tanh(a[k] @ w[0] + w[1])
                d = (_sigmoid(h @ w[2] + w[3]) - b[k]) / len(k)
                dh = d[:, None] * w[2] * (1 - h * h)
                grads = [a[k].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
                t += 1
                for p, g, mm, vv in zip(w, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    p -= 0.005 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        z, truth = self.logit(x[held]), y[held].astype(float)
        loss = lambda s: -np.mean(truth * np.log(_sigmoid(z / s) + 1e-12) + (1 - truth) * np.log(1 - _sigmoid(z / s) + 1e-12))
        if len(z):
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh((x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network | None:
    """At most MAX_LABELLED rows of both labels, chosen by a hash of doc_id, reach the driver as pooled vectors."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()
    if len({r["quality"] for r in chosen}) < 2:
        return None
    ids = docs.sparkSession.createDataFrame([(int(r["doc_id"]), int(r["quality"])) for r in chosen], "id long, quality int")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "quality", "text")
    table_ = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(table_.value, *buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "quality", "x"])

    # one row an id, so no more than MAX_LABELLED rows come, however often an id repeats
    one = rows.mapInArrow(run, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("row"))
    got = sorted((r["doc_id"], r["row"]["quality"], bytes(r["row"]["x"])) for r in one.collect())
    order = np.random.Generator(np.random.PCG64(SEED)).permutation(len(got))
    x, y = np.array([np.frombuffer(got[k][2]) for k in order]), np.array([got[k][1] for k in order])
    return Network().fit(x, y) if len(got) and len(set(y.tolist())) == 2 else None


def scored(docs: DataFrame, labels: DataFrame, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with the columns score (double) and predicted (int) under these names; clashing columns give way."""
    vectors = corpus_vectors(docs)
    model = fitted(docs, labels, vectors)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))
    base = docs.drop(score, predicted)
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, net = shared.value
        for batch in batches:
            raw, off = buffers(batch.column(at))
            p = net.score(pooled(table_, raw, off)) if net else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, score, predicted])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField(score, DoubleType()), StructField(predicted, IntegerType())]))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "score", "predicted")
