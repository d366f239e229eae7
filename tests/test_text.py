"""Text functions against plain Python on fuzzed strings, and the known cases."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagemill.functions import numbers, text
from pagemill.operators import validate


def values(spark, rows, column, name="t"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, {name} string")
    return [r[0] for r in df.select("k", column.alias("v")).orderBy("k").select("v").collect()]


def fuzz(alphabet, n=400, seed=1, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_escape_paragraph(spark):
    rows = fuzz("#-+*1.)> a\n\t\\`_[<", 600)
    opens = re.compile(r"^(#{1,6}\s|[-*+]\s|\d+[.)]\s|>\s?)")

    def plain(t):
        out = []
        for line in t.split("\n"):
            safe = re.sub(r"([\\`*_\[\]<>])", r"\\\1", line)
            out.append("\\" + safe if opens.match(safe) else safe)
        return "\n".join(out)

    assert values(spark, rows, text.escape_paragraph(F.col("t"))) == [plain(t) for t in rows]


def test_list_markers(spark):
    rows = fuzz("-•–*—12٣٠.) a \n", 800) + ["- a", "•", "٣) x", "12. y", "12.y"]

    def plain(t):
        body = t.lstrip()
        for glyph in text.BULLETS:
            if body.startswith(glyph + " ") or body == glyph:
                return ("bullet", None, glyph)
        m = re.match(r"^([0-9٠-٩]+)\s*[.)]\s+", body)
        return ("ordered", int(m[1]), m[0].strip()) if m else None

    assert [tuple(v) if v else None for v in values(spark, rows, text.list_marker(F.col("t")))] == [plain(t) for t in rows]


def test_without_marker(spark):
    df = spark.createDataFrame([("  - a", "-"), ("-  a", "-"), ("a", "-"), ("1) x", "1)"), ("- a", None)], "t string, m string")
    assert [r[0] for r in df.select(text.without_marker(F.col("t"), F.col("m"))).collect()] == ["  a", " a", "a", "x", "- a"]


def test_rlm(spark):
    rows = ["abc", "مرحبا", "مرحبا بالعالم abc", "مر abc", "‏مرحبا بالعالم abc", "שלום עולם a"]

    def plain(t):
        kinds = [unicodedata.bidirectional(c) for c in t]
        right, left = sum(k in ("R", "AL") for k in kinds), kinds.count("L")
        return "‏" + t if right > left > 0 and not t.startswith("‏") else t

    assert values(spark, rows, text.with_rlm(F.col("t"))) == [plain(t) for t in rows]


def test_strip_math_and_reasons(spark):
    assert values(spark, ["<math>x</math>", "$$a$$ \\[b\\] \\(c\\) $d$", "<MATH a=1>y\nz</math>"], text.strip_math(F.col("t"))) == ["x", "a b c d", "y\nz"]
    long = "Error: " + "x" * 500
    got = values(spark, ["a\n  b: c\nValueError: no\nend", "plain", long, "\x1b[31mE: x"], text.failure_reason(F.col("t")))
    assert got == ["ValueError: no", "plain", long[:399] + "…", "[31mE: x"]


def test_normalised(spark):
    rows = ["é", "é", "ﬁ", None, "abc"]
    assert values(spark, rows, text.normalised(F.col("t"))) == ["é", "é", "ﬁ", None, "abc"]
    assert values(spark, rows, text.normalised(F.col("t"), "NFKC"))[2] == "fi"
    with pytest.raises(ValueError):
        text.normalised(F.col("t"), "NFD")


def signals(spark, rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, text string")
    return validate.signals(df).orderBy("k").collect()


def test_signals_known_cases(spark):
    rows = ["abcdابتث", "123 !?", "�" * 5 + "hello", "".join(map(chr, range(1, 9))) + "hello", "\t\n\r\x0b\x0chello", "ابتث" + "ﺍﺏﺕﺙ", "a b c d", " ".join(["a"] * 30)]
    got = signals(spark, rows)
    assert [got[k]["arabic_codepoint_ratio"] for k in (0, 1)] == [0.5, 0.0]
    assert [got[k]["replacement_glyph_ratio"] for k in (2, 3, 4)] == [0.5, 8 / 13, 0.0]
    assert got[5]["presentation_form_ratio"] == 0.5
    assert got[6]["word_boundary_kl"] == 0.0 and got[7]["word_boundary_kl"] > 1.0


def test_signals_fuzz(spark):
    alphabet = "aé ١ابﺍ�\x01■ 中𝐀1.\n"
    rows = fuzz(alphabet, 500, longest=40)
    for t, r in zip(rows, signals(spark, rows), strict=True):
        letters = [c for c in t if unicodedata.category(c)[0] == "L"]
        assert r["n_letters"] == len(letters)
        assert r["n_arabic"] == sum(0x600 <= ord(c) <= 0x6FF for c in letters)


def test_tertiles_and_median(spark):
    import statistics

    rng = random.Random(2)
    lists = [[rng.uniform(0, 50) for _ in range(rng.randrange(3, 12))] for _ in range(100)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<double>")
    got = df.select("k", numbers.exclusive_tertile(F.col("v"), 1), numbers.exclusive_tertile(F.col("v"), 2), numbers.median_of(F.col("v"))).orderBy("k").collect()
    for r, v in zip(got, lists, strict=True):
        assert [r[1], r[2]] == statistics.quantiles(v, n=3)
        assert r[3] == statistics.median(v)


def test_error_rate(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("ab", "ba"), ("", "")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(numbers.character_error_rate(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]
