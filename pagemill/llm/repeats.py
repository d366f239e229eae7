"""Bytes that repeat earlier text: threshold-bounded interval expansion on a positional Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in
a document with a smaller doc_id, or before in the same one.  Strings never
cross documents; all are judged on the input.

A transform of a whole corpus is one global sort.  Here it is taken bucket by
bucket, over windows of text that hold every string that may repeat: of each
string of LENGTH bytes the smallest-hashed GRAM bytes are an anchor, equal
strings have equal anchors at equal places, so two of them meet in one bucket,
at one offset of their windows.

1. Equal texts: all but the first are removed whole (from LENGTH bytes on).
2. Anchors of all texts are counted by hash; those that come once are dropped.
   A filter of bits brings the others' hashes to the tasks.
3. Each remaining anchor goes with the bytes around it to its hash's bucket.
   Of equal windows only the earliest goes on, from a task and in the bucket.
4. `expand` sorts a bucket's suffixes backwards, offset by offset.  The bytes
   before the sorted suffixes are that offset's column of the transform, and
   its LF mapping - a stable counting sort by those bytes - extends all
   intervals at once, breadth first.  An extension adds one to the common
   prefix of neighbours that stay together, by the least value between them;
   others start again from none: the values come out by the extension alone, in
   increasing order, and stop at LENGTH.
5. Where LENGTH is reached, neighbours form an interval: one string.  All its
   suffixes but the earliest are covered.
6. Anchors of more than HOT_ROWS windows, which no single task should hold, go
   string by string instead: digests of their strings, first places by
   aggregation, hot digests broadcast.

Null text is empty.  Texts shorter than LENGTH stay.  Rows that repeat a
doc_id and its text are one text at one place, not earlier than each other; a
null doc_id comes after all others, and rows of one doc_id with unlike texts
are texts at one place.  Long texts are worked on whole (a text is one row).
An empty table gives no rows; input columns besides doc_id and text don't
matter, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_of, has_bits, spread_join, table, text_or_empty, written
from .shingles import blocks, buffers, mix

LENGTH, GRAM = 100, 32
#: Grams of a string; bytes before an anchor that its strings may reach.
SPREAD = LENGTH - GRAM
#: Bits of the filter of repeated anchors: one for each four bytes of text, within these bounds (16 and 64 MB).  Beyond
#: some 1e9 repeated anchors it lets single ones through too, which costs shuffled windows and changes no result.
LEAST_BITS, MOST_BITS = 1 << 27, 1 << 29
#: Windows of one anchor that a bucket may get.
HOT_ROWS = 1 << 17
#: Bytes of text for each partition of windows, about; and partitions at most.
PARTITION_BYTES, MOST_PARTITIONS = 8 << 20, 100_000
#: The same for partitions of hashes, each of which sends a filter.
TABLE_BYTES, MOST_TABLES = 64 << 20, 4096
#: Spans are merged by stretches of so many bytes (a power of two) of a text before they meet by text.
STRETCH_BITS = 14
TEXT_FILTER_BITS = 1 << 24
PIECES = 32
#: Bytes of text for each bucket, about.
BUCKET_BYTES = 8 << 20
_BLOCK = 1 << 19
_LAST = (1 << 63) - 1

_rng = np.random.Generator(np.random.PCG64(66))
_VALUE = _rng.integers(1, 2**32, 256, dtype=np.uint32)
_ROW = np.dtype([("key", "<u8"), ("order", "<i8"), ("tid", "<i8"), ("pos", "<i8"), ("before", "u1"), ("after", "u1"), ("bytes", "u1", (SPREAD + LENGTH,))])


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the anchors in raw, their documents)."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, step, factor = _VALUE[raw], 1, 0x9E3779B1
    while step < GRAM:
        h = h[:-step] * np.uint32(factor) + h[step:]
        factor = factor * factor & 0xFFFFFFFF
        step *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    low = h.astype(np.uint64) << np.uint64(32)
    low |= np.arange(len(h), dtype=np.uint64)
    width, step = SPREAD + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[width - step : width - step + n - LENGTH + 1])
    starts_here = np.zeros(n - LENGTH + 2, np.int32)
    room = np.diff(offsets) - LENGTH + 1
    some = np.flatnonzero(room > 0)
    np.add.at(starts_here, offsets[some], 1)
    np.add.at(starts_here, offsets[some] + room[some], -1)
    inside = np.cumsum(starts_here[:-1]) > 0
    at = (low[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    mark = np.zeros(n, bool)
    mark[at] = True
    at = np.flatnonzero(mark)
    return at, np.searchsorted(offsets, at, "right") - 1


def anchor_keys(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48-bit hashes of the grams at these offsets."""
    grams = np.lib.stride_tricks.sliding_window_view(raw, GRAM)[at]
    parts = np.ascontiguousarray(grams).view("<u8").reshape(len(at), -1)
    h = np.zeros(len(at), np.uint64)
    for k in range(parts.shape[1]):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + parts[:, k])
    return h >> np.uint64(16)


def _by_bucket(bucket: np.ndarray, blobs: list[bytes], size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blobs, pa.binary()), pa.array([size] * len(blobs), pa.int32())], ["bucket", "rows", "size"])


_BUCKETS = "bucket long, rows binary, size int"
#: A bucket's windows, and spans (four numbers of eight bytes) of windows that equal an earlier one of them.
_WINDOWS = "bucket long, rows binary, done binary"


def _text_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the texts (tid, order) in ids; as many texts as there may be, it has TEXT_FILTER_BITS bits."""
    words = ids.select(_bit().alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 AS int))")).alias("bits")).collect()
    return bits_of(words, TEXT_FILTER_BITS)


def _bit():
    return F.pmod(F.xxhash64("tid", "order"), F.lit(TEXT_FILTER_BITS))


def _repeated_anchors(texts: DataFrame, chosen, n_buckets: int, n_bits: int, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits of the hashes of anchors that come at least twice, and of those that come more than HOT_ROWS times."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_bits(chosen.value, batch.column("bit").to_numpy())))
            raw, off = buffers(batch.column("text"))
            for i, j in blocks(off, _BLOCK):
                part = raw[off[i] : off[j]]
                if len(part) < LENGTH:
                    continue
                # a hash and, in the low 16 bits, how often it comes here; a range of hashes is a bucket
                key, n = np.unique(anchor_keys(part, anchors(part, off[i : j + 1] - off[i])[0]), return_counts=True)
                if not len(key):
                    continue
                bucket = (key >> np.uint64(16)).astype(np.int64) * n_buckets >> 32
                packed = key << np.uint64(16) | np.minimum(n, 0xFFFF).astype(np.uint64)
                ids, first = np.unique(bucket, return_index=True)
                ends = np.append(first[1:], len(key))
                yield _by_bucket(ids, [packed[a:b].tobytes() for a, b in zip(first, ends, strict=True)], 8)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((2, n_bits // 8), np.uint8)
        seen: dict[int, list[bytes]] = {}

        def settle() -> None:
            for own in seen.values():
                packed = np.sort(np.frombuffer(b"".join(own), np.uint64))
                key = packed >> np.uint64(16)
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                total = np.add.reduceat((packed & np.uint64(0xFFFF)).astype(np.int64), first)
                for k, least in enumerate((1, HOT_ROWS)):
                    where = _slot(key[first][total > least], n_bits)
                    np.bitwise_or.at(bits[k], where >> 3, np.left_shift(1, where & 7).astype(np.uint8))
            seen.clear()

        for batch in batches:  # sorted by bucket: those before the last are complete
            for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if seen and bucket not in seen:
                    settle()
                seen.setdefault(bucket, []).append(rows)
        settle()
        if bits.any():
            size = bits.shape[1] // PIECES
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([zlib.compress(bits[:, p * size : (p + 1) * size].tobytes(), 1) for p in range(PIECES)], pa.binary())], ["piece", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, bits in zip(batch.column("piece").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(bits), np.uint8)
                sums[piece] = sums[piece] | more if piece in sums else more
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["piece", "bits"])

    keys = texts.select("text", _bit().alias("bit")).mapInArrow(gather, _BUCKETS)
    # a task sends a table of fixed size: few tasks, each over a sorted run of buckets
    found = keys.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(repeated, "piece int, bits binary").repartition(PIECES, "piece").mapInArrow(merge, "piece int, bits binary")
    out = np.zeros((2, n_bits // 8), np.uint8)
    size = out.shape[1] // PIECES
    for piece, bits in found.collect():
        out[:, piece * size : (piece + 1) * size] = np.frombuffer(zlib.decompress(bits), np.uint8).reshape(2, size)
    return out[0], out[1]


def _slot(key: np.ndarray, n_bits: int) -> np.ndarray:
    return (key & np.uint64(n_bits - 1)).astype(np.int64)


def _around(raw: np.ndarray, offsets: np.ndarray, at: np.ndarray, doc: np.ndarray, key: np.ndarray, order: np.ndarray, tid: np.ndarray) -> np.ndarray:
    """A row for each anchor: its bytes from SPREAD before it to LENGTH behind its start, zeros beyond the text."""
    row = np.zeros(len(at), _ROW)
    row["key"], row["order"], row["tid"], row["pos"] = key, order[doc], tid[doc], at - offsets[doc]
    before, after = np.minimum(at - offsets[doc], SPREAD), np.minimum(offsets[doc + 1] - at, LENGTH)
    row["before"], row["after"] = before, after
    padded = np.concatenate([np.zeros(SPREAD, np.uint8), raw, np.zeros(LENGTH, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, SPREAD + LENGTH)[at]
    k = np.arange(SPREAD + LENGTH)
    row["bytes"] = np.where((k >= SPREAD - before[:, None]) & (k < SPREAD + after[:, None]), around, 0)
    return row


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first + 1 : last + 1], for many pairs first < last: from minima over powers of two."""
    size = last - first
    out = values[last].copy()
    tall = int(size.max(initial=1)).bit_length() - 1
    height = np.frexp(size.astype(np.float64))[1] - 1
    for k in range(1, tall + 1):
        step = 1 << (k - 1)
        values = np.minimum(values[:-step], values[step:])
        own = np.flatnonzero(height == k)
        if len(own):
            out[own] = np.minimum(values[first[own] + 1], values[last[own] - (1 << k) + 1])
    return out


def expand(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the least and the largest number of bytes before its anchor with which a string of it is covered; (1, 0): none."""
    n = len(row)
    least, most = np.full(n, SPREAD + 1), np.full(n, -1)
    if n < 2:
        return np.ones(n, np.int64), np.zeros(n, np.int64)
    # rows at one doc_id and start are equally early
    by = np.lexsort((row["pos"], row["order"]))
    same = (row["order"][by][1:] == row["order"][by][:-1]) & (row["pos"][by][1:] == row["pos"][by][:-1])
    place = np.empty(n, np.int64)
    place[by] = np.concatenate([[0], np.cumsum(~same)])
    before, after = row["before"].astype(np.int64), row["after"].astype(np.int64)
    columns = np.ascontiguousarray(row["bytes"].T)
    width = SPREAD + LENGTH
    # suffixes in order, and for each the offset at which its common prefix with the one before ends
    order, ends = np.arange(n), np.full(n, width, np.uint8)
    for offset in range(width - 1, -1, -1):
        byte = columns[offset][order]
        rank = np.argsort(byte, kind="stable")
        byte, order = byte[rank], order[rank]
        extended = np.full(n, offset, np.uint8)
        stay = np.flatnonzero(byte[1:] == byte[:-1])
        # nothing longer than LENGTH is told apart
        extended[stay + 1] = np.minimum(_least_between(ends, rank[stay], rank[stay + 1]), min(offset + LENGTH, width))
        ends = extended
        b = SPREAD - offset
        if b < 0:
            continue
        reached = ends == offset + LENGTH
        if not reached[1:].any():
            continue
        first = np.flatnonzero(~reached | (np.arange(n) == 0))
        valid = (before[order] >= b) & (after[order] >= LENGTH - b)
        when = np.where(valid, place[order], n)
        earliest = np.minimum.reduceat(when, first)
        covered = order[valid & (when > np.repeat(earliest, np.diff(np.append(first, n))))]
        least[covered] = np.minimum(least[covered], b)
        most[covered] = b
    return least, most


_SPANS = "tid long, order long, start long, end long"
_SPAN_NAMES = ["tid", "order", "start", "end"]


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: spans (tid, order, start, end) that the anchors' strings cover."""
    last, held = None, []

    def spans() -> Iterator[pa.RecordBatch]:
        row = np.concatenate(held)
        held.clear()
        later = _later(row)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _reach(row[later])], _SPAN_NAMES)
        row = row[~later]
        least, most = expand(row)
        some = least <= most
        yield pa.RecordBatch.from_arrays([pa.array(row["tid"][some]), pa.array(row["order"][some]), pa.array(row["pos"][some] - most[some]), pa.array(row["pos"][some] - least[some] + LENGTH)], _SPAN_NAMES)

    for batch in batches:
        for bucket, rows, done in zip(batch.column("bucket").to_pylist(), batch.column("rows"), batch.column("done"), strict=True):
            if held and bucket != last:
                yield from spans()
            last = bucket
            held.append(np.frombuffer(rows.as_buffer(), _ROW))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.frombuffer(done.as_buffer(), np.int64).reshape(-1, 4).T], _SPAN_NAMES)
    if held:
        yield from spans()


def _later(row: np.ndarray) -> np.ndarray:
    """Which windows equal an earlier one: all that they reach is covered."""
    digest = mix(row["key"] * np.uint64(3) + row["before"] + (row["after"].astype(np.uint64) << np.uint64(8)))
    text = np.ascontiguousarray(row["bytes"]).view("<u8").reshape(len(row), -1)
    for k in range(text.shape[1]):
        digest = mix(digest * np.uint64(0x9FB21C651E98DF25) + text[:, k])
    o = np.lexsort((row["pos"], row["order"], digest))
    sorted_ = row[["order", "pos"]][o]
    head = np.concatenate([[True], digest[o][1:] != digest[o][:-1]])
    source = np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))
    out = np.zeros(len(row), bool)
    out[o] = ~head & (sorted_ != sorted_[source])
    return out


def _reach(row: np.ndarray) -> np.ndarray:
    """(tid, order, start, end) of windows that are covered as far as their strings reach."""
    least = np.maximum(0, LENGTH - row["after"].astype(np.int64))
    some = least <= row["before"]
    row, least = row[some], least[some]
    return np.stack([row["tid"], row["order"], row["pos"] - row["before"], row["pos"] - least + LENGTH])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by (tid, order, start) with those that touch or overlap as one."""
    held = np.zeros((4, 0), np.int64)
    for batch in batches:
        tid, order, start, end = rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in _SPAN_NAMES])], 1)
        if not len(tid):
            continue
        text = np.concatenate([[0], np.cumsum((tid[1:] != tid[:-1]) | (order[1:] != order[:-1]))]) << 40
        reach = np.maximum.accumulate(end + text)
        first = np.flatnonzero(np.concatenate([[True], start[1:] + text[1:] > reach[:-1]]))
        out = rows[:, first]
        out[3] = np.append(reach[first[1:] - 1], reach[-1]) - text[first]
        # the last one may go on in the next batch
        held = out[:, -1:]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out[:, :-1]], _SPAN_NAMES)
    if held.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], _SPAN_NAMES)


def _hot_spans(texts: DataFrame, chosen, hot, n_bits: int) -> DataFrame:
    """Spans of the strings of hot anchors, by digests of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_bits(chosen.value, batch.column("bit").to_numpy())))
            raw, off = buffers(batch.column("text"))
            order, tid = batch.column("order").to_numpy(), batch.column("tid").to_numpy()
            for i, j in blocks(off, _BLOCK):
                part, own = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                at, doc = anchors(part, own)
                if not len(at):
                    continue
                hit = has_bits(hot.value, _slot(anchor_keys(part, at), n_bits))
                low, high = np.maximum(own[doc], at - SPREAD)[hit], np.minimum(own[doc + 1] - LENGTH, at)[hit]
                edge = np.zeros(len(part) + 1, np.int32)
                good = low <= high
                np.add.at(edge, low[good], 1)
                np.add.at(edge, high[good] + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                for k in range(0, len(starts), 1 << 14):
                    start = starts[k : k + (1 << 14)]
                    padded = np.zeros((len(start), -(-LENGTH // 8) * 8), np.uint8)
                    padded[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(part, LENGTH)[start]
                    words = padded.view("<u8")
                    one, two = np.zeros(len(start), np.uint64), np.full(len(start), 0x5851F42D4C957F2D, np.uint64)
                    for w in range(words.shape[1]):
                        one = mix(one * np.uint64(0x9FB21C651E98DF25) + words[:, w])
                        two = mix((two ^ words[:, w]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(w))
                    d = np.searchsorted(own, start, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(order[i:j][d]), pa.array(tid[i:j][d]), pa.array(start - own[d])], ["one", "two", "order", "tid", "start"])

    strings = texts.select("text", "tid", "order", _bit().alias("bit")).mapInArrow(run, "one long, two long, order long, tid long, start long")
    strings = written(strings.select(F.struct("one", "two").alias("string"), "order", "tid", "start"), "strings")
    first = strings.groupBy("string").agg(F.min(F.struct("order", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = spread_join(strings, written(first, "firsts"), "string", "n").where(F.struct("order", "start") > F.col("first"))
    return later.select("tid", "order", "start", (F.col("start") + LENGTH).alias("end"))


def _records(texts: DataFrame, chosen, wanted, hot, n_buckets: int, n_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_bits(chosen.value, batch.column("bit").to_numpy())))
            raw, off = buffers(batch.column("text"))
            order, tid = batch.column("order").to_numpy(), batch.column("tid").to_numpy()
            for i, j in blocks(off, _BLOCK):
                part, own = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                at, doc = anchors(part, own)
                if not len(at):
                    continue
                key = anchor_keys(part, at)
                where = _slot(key, n_bits)
                hit = has_bits(wanted.value, where) & ~has_bits(hot.value, where)
                if not hit.any():
                    continue
                at, doc, key = at[hit], doc[hit], key[hit]
                bucket = (mix(key) % np.uint64(n_buckets)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                row, bucket = _around(part, own, at[o], doc[o], key[o], order[i:j], tid[i:j]), bucket[o]
                later = _later(row)
                ids, first = np.unique(bucket, return_index=True)
                ends = np.append(first[1:], len(row))
                live = [row[a:b][~later[a:b]].tobytes() for a, b in zip(first, ends, strict=True)]
                done = [_reach(row[a:b][later[a:b]]).T.tobytes() for a, b in zip(first, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(live, pa.binary()), pa.array(done, pa.binary())], ["bucket", "rows", "done"])

    return texts.select("text", "tid", "order", _bit().alias("bit")).mapInArrow(run, _WINDOWS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tid, order, text, spans in zip(*(batch.column(c).to_pylist() for c in ("tid", "order", "text", "spans")), strict=True):
            raw, kept, at, removed, n = text.encode(), [], 0, 0, 0
            for span in sorted((s["start"], s["end"]) for s in spans):
                if span[0] > at or n == 0:
                    kept.append(raw[at : span[0]])
                    n += 1
                    at = span[0]
                if span[1] > at:
                    removed += span[1] - at
                    at = span[1]
            kept.append(raw[at:])
            rest = b"".join(kept)
            rows.append((tid, order, removed, n, hashlib.sha256(rest).hexdigest(), rest.decode(errors="replace")))
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]), pa.array(columns[5])], ["tid", "order", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every row with doc_id, tid, order, digest, n_bytes and whether an equal text is earlier; texts; spans to remove)."""
    spark = docs.sparkSession
    text = text_or_empty()
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("order")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"), order)
    every = written(texts.select("doc_id", "tid", "order", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    first = written(every.groupBy("digest").agg(F.min("order").alias("first"), F.first("tid").alias("tid"), F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("copies")), "first")
    total = first.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(64, total // BUCKET_BYTES)
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (total // 4).bit_length()))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = min(MOST_PARTITIONS, max(shuffled, total // PARTITION_BYTES))
    chosen = spark.sparkContext.broadcast(_text_filter(first.select("tid", F.col("first").alias("order"))))
    wanted, hot = (spark.sparkContext.broadcast(bits) for bits in _repeated_anchors(texts, chosen, n_buckets, n_bits, min(MOST_TABLES, max(shuffled, total // TABLE_BYTES))))
    records = _records(texts, chosen, wanted, hot, n_buckets, n_bits).repartition(n_parts, "bucket").sortWithinPartitions("bucket")
    found = records.mapInArrow(_covered, _SPANS)
    if hot.value.any():
        found = found.unionByName(_hot_spans(texts, chosen, hot, n_bits))
    # a long text's spans meet stretch by stretch first
    stretches = found.repartition("tid", "order", F.shiftright("start", STRETCH_BITS)).sortWithinPartitions("tid", "order", "start")
    spans = written(stretches.mapInArrow(_merged, _SPANS), "spans")
    # copies of one text may be a large share of all rows
    return spread_join(every, first.select("digest", "first", "copies"), "digest", "copies").drop("copies"), texts, spans


def without_repeats(docs: DataFrame, kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with kept_text also kept, undecodable ends replaced."""
    every, texts, spans = repeated_spans(docs)
    by_text = spans.groupBy("tid", "order").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    touched = docs.sparkSession.sparkContext.broadcast(_text_filter(by_text.select("tid", "order")))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bits(touched.value, batch.column("bit").to_numpy())))

    near = texts.select("tid", "order", "text", _bit().alias("bit")).mapInArrow(hits, "tid long, order long, text string, bit long")
    cut = near.join(by_text, ["tid", "order"]).select("tid", "order", "text", "spans").mapInArrow(_cut, "tid long, order long, n_removed long, n_spans long, kept_sha256 string, kept string")
    cut = cut.dropDuplicates(["tid", "order"]) if kept_text else cut.drop("kept").distinct()
    # only the first row of a text can have spans; its copies, be they many, need no join
    head = (F.col("order") == F.col("first")) & (F.col("n_bytes") >= LENGTH)
    joined = every.where(head).join(cut, ["tid", "order"], "left").unionByName(every.where(~head), allowMissingColumns=True)
    copy = (F.col("order") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    out = joined.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if kept_text else []),
    )
    return out


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


#: Texts as hexadecimal digits, two a byte; every string of LENGTH bytes by its digest.
OP6_SQL = f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
places AS (SELECT doc_id, unnest(range(1, n - {LENGTH} + 2)) AS p0, h FROM docs WHERE n >= {LENGTH}),
strings AS (SELECT doc_id, p0, md5_number(substring(h, CAST(2 * p0 - 1 AS BIGINT), {2 * LENGTH})) AS string FROM places),
first_at AS (SELECT string, min(doc_id) AS doc_id FROM strings GROUP BY 1 HAVING count(*) > 1),
earliest AS (SELECT f.string, f.doc_id, min(s.p0) AS p0 FROM first_at f JOIN strings s ON s.string = f.string AND s.doc_id = f.doc_id GROUP BY ALL),
later AS (SELECT s.doc_id, s.p0 FROM strings s JOIN earliest e ON s.string = e.string WHERE s.doc_id <> e.doc_id OR s.p0 <> e.p0),
opened AS (SELECT doc_id, p0, CASE WHEN p0 > lag(p0) OVER w + {LENGTH} OR lag(p0) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY p0)),
runs AS (SELECT doc_id, p0, sum(opens) OVER (PARTITION BY doc_id ORDER BY p0) AS run FROM opened),
spans AS (SELECT doc_id, run, min(p0) AS a, max(p0) + {LENGTH} AS b FROM runs GROUP BY ALL),
per AS (SELECT doc_id, list(struct_pack(a := a, b := b) ORDER BY a) AS spans, CAST(sum(b - a) AS BIGINT) AS removed FROM spans GROUP BY 1),
kept AS (SELECT docs.*, coalesce(spans, []) AS spans, coalesce(removed, 0) AS removed FROM docs LEFT JOIN per USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, removed AS n_removed, CAST(len(spans) AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(0, len(spans) + 1), lambda k: substring(h, CAST(CASE WHEN k = 0 THEN 1 ELSE 2 * spans[k].b - 1 END AS BIGINT), CAST(CASE WHEN k = len(spans) THEN 2 * n ELSE 2 * spans[k + 1].a - 2 END - CASE WHEN k = 0 THEN 0 ELSE 2 * spans[k].b - 2 END AS BIGINT))), ''))) AS kept_sha256
FROM kept
"""
