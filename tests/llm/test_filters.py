"""Classifier, decontamination and personal data."""

import random
import re

import numpy as np
import pytest

from pagemill.llm import boosting, decontaminate, pii, quality

DOC = "doc_id long, text string"


# -- quality -------------------------------------------------------------------


def labelled(n=900):
    rng = random.Random(3)
    words = ["river", "stone", "walk", "green", "house", "light", "over", "under", "small", "great"]
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        w = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        rows.append((k, " ".join(w) + "." if good else " ".join(x.upper() + rng.choice(["!!", "$$$", "***"]) for x in w)))
        labels.append((k, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (0, rows[0][1])], DOC)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.scored(docs, known).withColumn("held_out", quality.held_out()).collect()
    truth = {k: q for k, q, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(out) == len(rows) + 3 and len(held) > 200
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 9.0), (2, None, None)], DOC + ", score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in quality.scored(docs, none).collect()] == [(0.5, 1)] * 2
    assert quality.scored(docs.limit(0), none).count() == 0


def test_vectors_equal_a_plain_sum(spark):
    texts = ["ab cd!! ab", "cd ab", None, "x " * 50]
    got = quality.corpus_vectors(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], DOC).repartition(2))
    want = np.zeros((quality.ROWS, quality.DIM))
    from pagemill.llm.shingles import buffers
    import pyarrow as pa

    for t in texts:
        row, _ = quality.tokens(*buffers(pa.array([t or ""])))
        for i, a in enumerate(row):
            for j in range(max(0, i - quality.WINDOW), min(len(row), i + quality.WINDOW + 1)):
                if i != j:
                    np.add.at(want[a], quality._INDEX_AT[row[j]], quality._INDEX_SIGN[row[j]])
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.maximum(norm, 1e-9), atol=1e-6)


# -- decontamination --------------------------------------------------------------


def sellers(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        prev, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            prev, row[j] = row[j], min(prev + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_least_distance_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
        got = decontaminate.least_distance(len(p), decontaminate.masks(p), t, len(p))
        assert (got[0] if got else len(p)) == min(sellers(p, t), len(p))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 40)))) for k in range(15)] + [(90, None), (91, ""), (92, "!!")]
    docs = []
    for k in range(80):
        body = [word() for _ in range(60)]
        if k % 2:
            p = list(rng.choice(items[:15])[1])
            for _ in range(rng.randrange(0, 14)):
                p[rng.randrange(len(p))] = rng.choice("abcdefgh ")
            body[30:30] = "".join(p).upper().split(" ") if k % 3 else "".join(p).split()
        docs.append((k, ", ".join(body[:20]) + " " + " ".join(body[20:])))
    docs += [(200, None), (201, "")]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, p in items:
            a, b = decontaminate.normalised(t), decontaminate.normalised(p)
            if a and b:
                n = sellers(b, a)
                if n <= int(decontaminate.ERROR_RATE * len(b)):
                    want[d, i] = n
    assert got == want and len(want) > 20 and max(want.values()) > 2


def test_without_leaks_keeps_clean_rows_and_columns(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, "clean text", 7), (2, f"x {item.upper()}. y", 8), (3, None, None)], DOC + ", distance int")
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.without_leaks(docs, bench).orderBy("doc_id").collect()] == [(1, "clean text", 7), (3, None, None)]
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == 3
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 == decontaminate.leaks(docs, bench.limit(0)).count()


# -- personal data ------------------------------------------------------------------

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = {}
    for kind, pattern in _PLAIN.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out[kind].append(m.span())
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-1253+ ()é%") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain_spans(t), t
    for _ in range(300):
        t = " ".join(str(rng.randrange(10**15, 10**17)) for _ in range(3))
        assert pii.base_spans(t) == plain_spans(t), t


CARD = "4316522678525456"


@pytest.mark.parametrize(("text", "kind", "found"), [
    (f"pay {CARD} {CARD} now", "card", 2), ("call +1 (293) 555-9179 4316522678525450 now", "phone", 1), ("write joe.12[at]mail[dot]com now", "email", 1),
    ("order 9870157079875990 now", "card", 0), ("token 2321bac4d15ec8f90433955bf9d3cf61da5bdd1e", "card", 0), ("we met at home. then left", "email", 0), ("version 999.888.777.666", "ip", 0), ("plain words only", "email", 0),
])
def test_added_spans(text, kind, found):
    base, every = pii.find(text)
    assert len(every[kind]) == found
    assert all(set(base[k]) <= set(every[k]) for k in pii.KINDS)


def test_spans_and_redaction(spark):
    rows = [(1, "é a.b@c.de 1.2.3.4", 1), (2, None, None), (3, "", 0), (4, "clean " * 30_000, 5), (1, "é a.b@c.de 1.2.3.4", 1)]
    df = spark.createDataFrame(rows, DOC + ", n_chars long")
    got = pii.pii_spans(df).where("doc_id < 3").orderBy("doc_id").collect()
    assert got[0].spans == "email:2:10,ip:11:18" and (got[0].n_email, got[0].n_ip, got[2].n_spans) == (1, 1, 0)
    new = pii.redact(df).where("doc_id <> 4").orderBy("doc_id").collect()
    assert new[0].text == "é [EMAIL] [IP]" and new[0].n_chars == 14 and new[2].text is None and new[3].text == ""
    assert pii.pii_spans(df.limit(0)).count() == 0


def test_boosting_separates_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.1)
    m = boosting.BoostedTrees(depth=3).fit(x[:2000], y[:2000])
    p = m.score(x[2000:])
    assert np.mean((p > 0.5) == y[2000:]) > 0.8 and abs(p.mean() - y[2000:].mean()) < 0.05


def test_held_out_is_crc32(spark):
    import zlib

    df = spark.createDataFrame([(k,) for k in [*range(50), -3, None]], "doc_id long")
    for r in df.select("doc_id", quality.held_out().alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


