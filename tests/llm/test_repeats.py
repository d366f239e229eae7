import random

import numpy as np

from pagemill.llm import repeats

from . import brute

SCHEMA = "doc_id long, text string"


def compare(spark, rows):
    got = sorted(map(tuple, repeats.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == sorted(brute.repeated_bytes(sorted(rows, key=lambda r: r[0])))


def test_passages_copies_and_overlaps(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 60)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(60, 260)], word()]
        rows.append((k, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + "x"), (102, "ab" * 300), (103, "z" * 99), (104, "z" * 99), (105, "z" * 100), (106, "z" * 250), (-5, rows[7][1])]
    compare(spark, rows)


def mixed_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(3)]
    rows = []
    for k in range(80):
        p = rng.choice(passages)
        a = rng.randrange(len(p) // 2)
        rows.append((k // 2, word() + p[a : a + rng.randrange(90, 260)] + word() + p * rng.randrange(2)))
    return rows


def test_hot_anchors_go_string_by_string(spark, monkeypatch):
    """Whether some, all or no anchors count as hot, the bytes are the same; two rows share each doc_id."""
    rows = [(k, t) for k, (_, t) in enumerate(mixed_rows(11))] + [(200, "z" * 400), (201, "yz" * 90)]
    want = sorted(brute.repeated_bytes(rows))
    for hot in (1, 6, 1 << 17):
        monkeypatch.setattr(repeats, "HOT_ROWS", hot)
        got = sorted(map(tuple, repeats.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()))
        assert got == want


def test_expansion_equals_comparing_strings():
    """The transform of a bucket against a comparison of all its windows."""
    rng = np.random.default_rng(8)
    core = rng.integers(97, 99, (4, 300), dtype=np.uint8)
    rows = np.zeros(120, repeats._ROW)
    for k in range(len(rows)):
        text = core[rng.integers(4)].copy()
        text[rng.integers(0, 300, rng.integers(0, 3))] = 120
        at = int(rng.choice([45, 90, 120, 230]))
        before, after = min(at, repeats.SPREAD), min(300 - at, repeats.LENGTH)
        rows[k]["order"], rows[k]["pos"], rows[k]["before"], rows[k]["after"] = rng.integers(30), at, before, after
        rows[k]["bytes"][repeats.SPREAD - before : repeats.SPREAD + after] = text[at - before : at + after]
    least, most = repeats.expand(rows)
    hits = 0
    for k, r in enumerate(rows):
        own = []
        for b in range(repeats.SPREAD + 1):
            cut = slice(repeats.SPREAD - b, repeats.SPREAD - b + repeats.LENGTH)
            fits = lambda x: x["before"] >= b and x["after"] >= repeats.LENGTH - b  # noqa: B023, E731
            if fits(r) and any(fits(x) and (x["order"], x["pos"]) < (r["order"], r["pos"]) and (x["bytes"][cut] == r["bytes"][cut]).all() for x in rows):
                own.append(b)
        assert (least[k], most[k]) == (min(own), max(own)) if own else least[k] > most[k]
        hits += bool(own)
    assert hits > 20


def test_edges(spark):
    compare(spark, [(1, None), (2, ""), (3, "a" * 100), (4, "a" * 100), (5, "b" * 99), (6, "b" * 99)])
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range(300))
    twice = repeats.without_repeats(spark.createDataFrame([(1, text, "x"), (1, text, "y")], "doc_id long, text string, tid string")).collect()
    assert [r.n_removed for r in twice] == [0, 0]


def test_long_text(spark):
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    compare(spark, [(1, part + "|" + part[1000:3000] + "|" + part), (2, part[50_000:90_000])])


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, 3000, dtype=np.uint8)
    at, _ = repeats.anchors(text, np.array([0, len(text)]))
    for start in range(0, 2900, 7):
        alone, _ = repeats.anchors(text[start : start + 100].copy(), np.array([0, 100]))
        assert len(alone) == 1 and start + alone[0] in at


def test_kept_text(spark):
    rng = random.Random(7)
    p = "".join(rng.choice("abcdefgh") for _ in range(400))
    rows = [(1, p), (2, "head " + p[:200] + " tail"), (3, p)]
    got = {r.doc_id: r.kept for r in repeats.without_repeats(spark.createDataFrame(rows, SCHEMA), kept_text=True).collect()}
    assert got[2] == "head  tail" and got[3] == ""
