"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and cut to their runs of word characters,
joined by one space, with a space at either end.  An item of m characters may
be found with up to k = floor(ERROR_RATE * m) edits.  It is cut into k + 1
pieces: a passage within k edits holds at least one piece unchanged.  One
Aho-Corasick pass over a text finds all pieces of all items; where a piece
stands, Myers' bit-parallel search gives the least edit distance of the item to
a passage around it.

Items reach the tasks as a broadcast of at most BLOCK_CHARS characters; a
larger benchmark goes in blocks of that size, one pass and one written table
each, so the driver and the tasks never hold more than one block.  Null or
empty texts and items match nothing, equal items are reported each, repeated
documents too.  Texts are searched whole.  Of passages of equal distance the
first found is told.  An empty table on either side gives no rows (or all
documents, where those without items are asked for); other columns of documents
go along there, whatever they are called.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

ERROR_RATE = 0.06
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\w+")
_SCHEMA = "doc_id long, item_id long, distance long, start long, end long"


def normalised(text: str | None) -> str:
    found = _WORD.findall((text or "").lower())
    return f" {' '.join(found)} " if found else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of an item as (offset, piece), as even as can be."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for k, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << k
    return found


def least_distance(m: int, peq: dict[str, int], text: str, limit: int) -> tuple[int, int] | None:
    """(edits, end) of the passage of text nearest to a pattern of m characters, the first one, if within limit."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp) & full
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        vp, vn = hn | ~(xv | hp) & full, hp & xv
        if score <= limit and (best is None or score < best[0]):
            best = (score, at + 1)
            if score == 0:
                break
    return best


class Matcher:
    """Pieces of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if item := normalised(text):
                errors = int(rate * len(item))
                for offset, piece in pieces(item, errors):
                    owners.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, item, errors, masks(item)))
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def find(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """item -> (distance, start, end) in the normalised text; start is where a match without edits would begin."""
        whole = normalised(text)
        found: dict[int, tuple[int, int, int]] = {}
        if not whole or not self.any:
            return found
        seen: dict[int, tuple[int, int]] = {}
        for end, (n, where) in self.automaton.iter(whole):
            for k, offset in where:
                begin = end + 1 - n - offset
                item_id, item, errors, peq = self.items[k]
                if k in found and found[k][0] == 0:
                    continue
                if whole.startswith(item, begin) and begin >= 0:
                    found[k] = (0, begin, begin + len(item))
                    continue
                # the passage begins and ends within errors of where the piece puts it
                lo, hi = max(0, begin - errors), begin + len(item) + errors
                if k in seen and seen[k][0] <= lo and hi <= seen[k][1]:
                    continue
                lo, hi = max(0, lo - errors), hi + errors
                seen[k] = (lo, hi)
                got = least_distance(len(item), peq, whole[lo:hi], errors)
                if got and (k not in found or got[0] < found[k][0]):
                    found[k] = (got[0], max(0, lo + got[1] - len(item)), lo + got[1])
        return found


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, start, end: a row for each item that a text holds within its error budget."""

    def find(matcher: Matcher, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                for k, (distance, start, end) in matcher.find(text.as_py()).items():
                    rows.append((doc_id.as_py(), matcher.items[k][0], distance, start, end))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = _n_blocks(benchmark)
    if n == 0:
        return spark.createDataFrame([], _SCHEMA)
    if n == 1:
        return docs.mapInArrow(_with_matcher(spark, _items(benchmark, 0, 1), rate, find)[0], _SCHEMA)
    path = scratch(spark, "leaks")
    for k in range(n):
        run, shared = _with_matcher(spark, _items(benchmark, k, n), rate, find)
        docs.mapInArrow(run, _SCHEMA).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(_SCHEMA).parquet(path)


def _n_blocks(benchmark: DataFrame) -> int:
    return -(-(benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0) // BLOCK_CHARS)


def _items(benchmark: DataFrame, k: int, n: int) -> list[tuple[int, str]]:
    rows = benchmark.where((F.pmod(F.xxhash64("text"), F.lit(n)) == k) & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").collect()
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


#: The matcher that a worker has built last, with the name of its items: tasks of one block share it.
_BUILT: list = []


def _built(name: str, shared: Broadcast, rate: float) -> Matcher:
    if not _BUILT or _BUILT[0] != name:
        _BUILT[:] = [name, Matcher(shared.value, rate)]
    return _BUILT[1]


def _with_matcher(spark: SparkSession, items: list[tuple[int, str]], rate: float, work: Callable) -> tuple[Callable, Broadcast]:
    """(function of batches that calls work(matcher, batches), broadcast of the items)."""
    shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(_built(name, shared, rate), batches)

    return run, shared


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns."""
    n, at, kept, spark = _n_blocks(benchmark), docs.columns.index("text"), docs, docs.sparkSession

    def clean(matcher: Matcher, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

    for k in range(n):
        run, shared = _with_matcher(spark, _items(benchmark, k, n), rate, clean)
        kept = kept.mapInArrow(run, docs.schema)
        if n > 1:
            kept = written(kept, "clean")
            shared.destroy()
    return kept


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
