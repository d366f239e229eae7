"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, content, n_tokens): tokenizer is the
SHA-256 of the tokenizer's file with the normalisation's name, content the
SHA-256 of the normalised text.  A run joins its digests to the cache, encodes
each missing text once, appends the new counts, and answers from the cache.

The library cuts no text and adds no token; special strings inside a text
count as the library's default has it.  Null text counts as empty (0 bytes,
0 tokens), a null or repeated doc_id is carried through, other columns of the
input don't reach the result, whatever they are called.  A long text is one
call of the library; equal texts are one miss, whichever of them comes first.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread_join, text_or_empty, written
from .shingles import blocks, buffers

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"
#: Texts go to the tokenizer in groups of about so many bytes.
GROUP_BYTES = 1 << 19


def normalised(name: str = "text") -> Column:
    """The identity on content: the count is that of the text as it stands, null as empty."""
    return text_or_empty(name)


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|identity").hexdigest()


class Counter:
    """Counts tokens with the library that the file's suffix names; loaded once in each worker."""

    loaded: dict[str, object] = {}

    def __init__(self, path: str):
        self.path = path

    def __call__(self, texts: list[str]) -> list[int]:
        if self.path not in self.loaded:
            if self.path.endswith(".model"):
                import sentencepiece

                self.loaded[self.path] = sentencepiece.SentencePieceProcessor(model_file=self.path)
            else:
                import os

                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                from tokenizers import Tokenizer

                t = Tokenizer.from_file(self.path)
                t.no_truncation()
                t.no_padding()
                self.loaded[self.path] = t
        t = self.loaded[self.path]
        if self.path.endswith(".model"):
            return [len(x) for x in t.encode(texts, num_threads=1)]
        return [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, content (the digest as hex) for every row of docs.

    cache_path is a folder in shared storage; it need not exist.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = normalised()
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    digests = keyed.select("doc_id", "content", "n_bytes")

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    #: One row of each missing content is encoded: that of the smallest doc_id.
    groups = written(digests.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "contents")
    # of the cache, be it of many runs, only what this run asks for is grouped
    known = written(cache.join(groups.select("content"), "content", "left_semi").groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "known")
    chosen = groups.join(known, "content", "left_anti").select(F.col("content").alias("wanted"), "doc_id")
    misses = keyed.join(chosen, keyed.doc_id.eqNullSafe(chosen.doc_id) & (keyed.content == chosen.wanted), "left_semi").select("content", "text")

    count = Counter(tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, content = batch.column("text"), batch.column("content")
            for i, j in blocks(buffers(text)[1], GROUP_BYTES):
                n = count(text.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), content.slice(i, j - i), pa.array(n, pa.int64())], ["tokenizer", "content", "n_tokens"])

    # rows that repeat a chosen doc_id and its text are appended once
    fresh = written(misses.mapInArrow(encode, CACHE_SCHEMA).dropDuplicates(["content"]), "fresh")
    fresh.write.mode("append").option("compression", "zstd").parquet(cache_path)
    answered = written(groups.select("content", "copies").join(known.unionByName(fresh.select("content", "n_tokens")), "content"), "answered")
    # copies of one text may be a large share of all rows
    return spread_join(digests, answered, "content", "copies").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("content")).alias("content"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    # a cache of this run's own: its cost is that of a cold cache
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"))
