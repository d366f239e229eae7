"""Is a page's text layer to be trusted? Four signals, one projection over the text."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ValidatorConfig
from ..functions import charclass as cc
from ..functions import numbers, text

#: Bits of what a code point is, for `_kinds`.
LETTER, BASE, PRESENTATION, SPACE, REPLACED = 1, 2, 4, 8, 16


@cache
def _kinds() -> np.ndarray:
    """The bits of every code point, from Python's tables."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    letters = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])
    out[letters] |= LETTER
    for bit, ranges in ((BASE, cc.ARABIC), (PRESENTATION, cc.PRESENTATION)):
        for lo, hi in ranges:
            out[lo : hi + 1] |= np.where(letters[lo : hi + 1], bit, 0).astype(np.uint8)
    out[[c for c in range(sys.maxunicode + 1) if chr(c).isspace()]] |= SPACE
    for lo, hi in (*cc.CONTROLS, *cc.REPLACEMENT):
        out[lo : hi + 1] |= REPLACED
    # glyphs that can be damaged: all but ASCII's punctuation and white space
    seen = np.ones(len(out), bool)
    seen[:128] = [chr(c).isalnum() or any(lo <= c <= hi for lo, hi in cc.CONTROLS) for c in range(128)]
    out[seen & (out & SPACE == 0)] |= GLYPH
    out[out & SPACE > 0] &= ~np.uint8(REPLACED)
    return out


GLYPH = 32
_COUNTED = {"n_letters": LETTER, "n_arabic": BASE, "n_presentation": PRESENTATION, "n_glyphs": GLYPH, "n_replaced": REPLACED}
_COUNTS = ", ".join(f"{c}: long" for c in _COUNTED) + ", lengths: array<int>"


def counted(texts: pa.Array) -> pa.StructArray:
    """Counts of each text's letters, glyphs and so on, and how many tokens of each length (1 to LONGEST and over) it has."""
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    flat = texts.fill_null("").to_pylist()
    kind = _kinds()[np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), "<u4")]
    n = len(flat)
    size = np.fromiter(map(len, flat), np.int64, n)
    ends = np.cumsum(size)
    doc = np.repeat(np.arange(n), size)
    columns = [pa.array(np.bincount(doc[kind & bit > 0], minlength=n), pa.int64(), mask=~known) for bit in _COUNTED.values()]
    word = kind & SPACE == 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(kind))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    at = np.flatnonzero(first)
    length = np.minimum(np.flatnonzero(last) - at + 1, numbers.LONGEST)
    table = np.bincount(doc[at] * numbers.LONGEST + length - 1, minlength=n * numbers.LONGEST).astype(np.int32)
    lengths = pa.ListArray.from_arrays(pa.array(np.arange(0, n * numbers.LONGEST + 1, numbers.LONGEST), pa.int32()), pa.array(table))
    return pa.StructArray.from_arrays([*columns, lengths], [*_COUNTED, "lengths"])


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


#: Texts that are counted at a time.
SLICE = 256


def counts(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds the integer counts that the ratios come from, and lengths (tokens by length): one pass over a batch's code points."""

    @F.arrow_udf(f"struct<{_COUNTS}>")
    def count(texts: pa.Array) -> pa.Array:
        # a few texts at a time: a code point takes some 20 bytes on the way
        parts = [counted(texts.slice(k, SLICE)) for k in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else counted(texts)

    return df.withColumn("_counts", count(F.col(column).cast("string"))).select("*", "_counts.*").drop("_counts")


def signals(df: DataFrame, column: str = "text", reference: dict[int, float] | None = None) -> DataFrame:
    """Adds arabic_codepoint_ratio, replacement_glyph_ratio, word_boundary_kl, presentation_form_ratio."""
    return counts(df, column).select(
        *df.columns, "n_letters", "n_arabic", "n_presentation", "n_glyphs", "n_replaced",
        _share(F.col("n_arabic"), F.col("n_letters")).alias("arabic_codepoint_ratio"),
        _share(F.col("n_replaced"), F.col("n_glyphs")).alias("replacement_glyph_ratio"),
        numbers.lengths_divergence(F.col("lengths"), reference).alias("word_boundary_kl"),
        _share(F.col("n_presentation"), F.col("n_presentation") + F.col("n_arabic")).alias("presentation_form_ratio"),
    )


def _reason(name: str, value: str, sign: str, bound: str, limit: float) -> Column:
    return F.format_string(f"{name} %.3f {sign} {bound} {limit:.3f}", F.col(value))


def verdict(df: DataFrame, config: ValidatorConfig | None = None) -> DataFrame:
    """Adds accept and reasons, in the order of the rules; equality accepts. Needs has_text_layer and signals()."""
    c = config or ValidatorConfig()
    r, a, k, p = (F.col(x) for x in ("replacement_glyph_ratio", "arabic_codepoint_ratio", "word_boundary_kl", "presentation_form_ratio"))
    arabic = F.col("n_arabic") + F.col("n_presentation")
    rules = [
        (r > c.max_replacement_ratio, _reason("replacement_glyph_ratio", "replacement_glyph_ratio", ">", "max", c.max_replacement_ratio)),
        ((F.col("n_letters") == 0) & (r <= c.max_replacement_ratio), F.lit("empty_text_layer")),
        ((arabic > 0) & (F.col("n_letters") >= c.min_letter_count) & (a < c.min_arabic_ratio), _reason("arabic_codepoint_ratio", "arabic_codepoint_ratio", "<", "min", c.min_arabic_ratio)),
        (k > c.max_word_boundary_kl, _reason("word_boundary_kl", "word_boundary_kl", ">", "max", c.max_word_boundary_kl)),
        ((arabic >= c.min_letter_count) & (p > c.max_presentation_form_ratio), _reason("presentation_form_ratio", "presentation_form_ratio", ">", "max", c.max_presentation_form_ratio)),
    ]
    found = F.array_compact(F.array(*(F.when(rule, reason) for rule, reason in rules)))
    reasons = F.when(F.col("has_text_layer"), found).otherwise(F.array(F.lit("no_text_layer")))
    return df.withColumn("reasons", reasons).withColumn("accept", F.size("reasons") == 0)


_SIGNALS = ("arabic_codepoint_ratio", "replacement_glyph_ratio", "word_boundary_kl", "presentation_form_ratio")


def page_texts(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """pages with text: their regions' texts by seq, one line break between; table texts live in cells, so they add ''."""
    t = F.when(F.col("role") == "table", F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    joined = regions.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("seq", t.alias("text")))).alias("parts"))
    joined = joined.select("doc_id", "page_index", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    return pages.join(joined, ["doc_id", "page_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def validate_pages(pages: DataFrame, regions: DataFrame, config: ValidatorConfig | None = None) -> DataFrame:
    """doc_id, page_index, accept, the four signals (null without a text layer), reasons."""
    texts = page_texts(pages, regions).withColumn("text", text.normalised(F.col("text")))
    judged = verdict(signals(texts), config)
    shown = [F.when(F.col("has_text_layer"), F.col(s)).alias(s) for s in _SIGNALS]
    return judged.select("doc_id", "page_index", "accept", *shown, "reasons")


def force_ml(pages: DataFrame) -> DataFrame:
    """Rejects every page with one reason."""
    nothing = [F.lit(None).cast("double").alias(s) for s in _SIGNALS]
    return pages.select("doc_id", "page_index", F.lit(False).alias("accept"), *nothing, F.array(F.lit("forced_ml_cli")).alias("reasons"))


def length_distribution(df: DataFrame, column: str = "text") -> DataFrame:
    """(token_length, n, share) over all texts, lengths from 12 on together."""
    each = counts(df.select(column), column).select(F.posexplode("lengths").alias("k", "n"))
    n = each.where("n > 0").groupBy((F.col("k") + 1).alias("token_length")).agg(F.sum("n").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    # one row beside at most twelve
    return n.crossJoin(F.broadcast(total)).select("token_length", "n", (F.col("n") / F.col("total")).alias("share"))
