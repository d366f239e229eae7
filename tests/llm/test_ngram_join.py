import random

import pytest

from pagemill.llm import ngram_join

from . import brute

SCHEMA = "doc_id long, text string"


def compare(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()) if all(r[0] is not None for r in rows) else None
    want = brute.jaccard_components(rows)
    assert sorted(map(tuple, got), key=str) == want


def edited(rng, words, share):
    return " ".join(rng.choice("xyzuvw") * 3 + str(rng.randrange(10**6)) if rng.random() < share else w for w in words)


def test_groups_of_many_sizes(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, k = [], 0
    for size, copies in ((3, 4), (6, 5), (12, 6), (40, 8), (120, 40), (300, 6)):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(rng.randrange(1, copies)):
                rows.append((k, edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))))
                k += 1
    compare(spark, rows)


def test_large_group_in_blocks(spark):
    # more than a list that gives pairs and more than a block; a passage that all share besides
    rng = random.Random(2)
    base = [f"b{k}" for k in range(80)]
    shared = " ".join(f"s{k}" for k in range(50))
    rows = [(k, edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.06])) + " " + shared) for k in range(420)]
    rows += [(1000 + k, " ".join(f"o{rng.randrange(10**6)}" for _ in range(30)) + " " + shared) for k in range(60)]
    compare(spark, rows)


def test_salted_lists_of_many_sizes(spark, monkeypatch):
    # common shingles are equally common, and lists that hold a long text hold short ones too: chains of salted parts break
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 48)
    base = [f"b{k}" for k in range(300)]
    rows = [(k, " ".join([*(base * 2)[k : k + 84], f"s{k}"])) for k in range(300)]
    rows += [(1000 + k, " ".join([*base, *base[:4], *(f"l{k}x{m}" for m in range(36))])) for k in range(40)]
    compare(spark, rows)


def test_links_and_pairs(spark, monkeypatch):
    # groups of all kinds: one group, blocks of several classes and salts, copies of linked texts
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(90)]
    rows = [(k, edited(rng, base[: rng.choice([60, 70, 80, 90])], rng.choice([0.0, 0.01, 0.015]))) for k in range(240)]
    rows += [(500, "x y z u v w"), (501, "x y z u v w"), (502, None), (503, ""), (504, "p q r s t"), (505, " ".join(base)), (506, " ".join(base))]
    small = [f"c{k}" for k in range(40)]
    rows += [(600 + k, " ".join([*small, f"d{k // 2}"])) for k in range(6)]
    sets = {d: brute.shingle_set(t) for d, t in rows}
    links = {d: [e for e in sets if e != d and sets[d] and 100 * len(sets[d] & sets[e]) >= 75 * len(sets[d] | sets[e])] for d in sets}
    found, pairs = ngram_join.ngram_join(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id: r.n_links for r in found.collect()} == {d: len(v) for d, v in links.items()}
    first = {s: min(d for d in sets if sets[d] == s) for s in sets.values()}
    alike = lambda d: sum(sets[e] == sets[d] for e in sets)
    want = [(d, e, len(sets[d]), len(sets[e]), len(sets[d] & sets[e]), alike(d), alike(e)) for d in first.values() for e in links[d] if d < e and e in first.values() and sets[d] != sets[e]]
    got = [r if r[0] < r[1] else (r[1], r[0], r[3], r[2], r[4], r[6], r[5]) for r in map(tuple, pairs.collect())]
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_large_component_is_stored_once(spark, monkeypatch):
    """A component of many blocks takes disk in proportion to its sets, and both ways give the same."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(400)]
    rows = [(k, edited(rng, base, 0.004)) for k in range(300)] + [(1000 + k, " ".join(f"o{rng.randrange(10**6)}" for _ in range(30))) for k in range(20)]
    stored, met, result = [], [], {}
    keep = ngram_join._stored_blocks
    monkeypatch.setattr(ngram_join, "_stored_blocks", lambda *a: stored.append(keep(*a)) or stored[0])
    whole = ngram_join._whole_groups
    monkeypatch.setattr(ngram_join, "_whole_groups", lambda p: met.append(whole(p)) or met[-1])
    df = spark.createDataFrame(rows, SCHEMA)
    result["ranges"] = sorted(map(tuple, ngram_join.ngram_components(df).collect()))
    sets = {brute.shingle_set(t) for _, t in rows[:300]}
    assert len(sets) > 200 and met[0].count() == 0
    assert sum(r.raw for r in stored[0].collect()) < sum(6 * len(s) + 24 + 8 for s in sets) + 8 * len(sets)
    monkeypatch.setattr(ngram_join, "files_of", lambda path: None)
    result["shuffle"] = sorted(map(tuple, ngram_join.ngram_components(df).collect()))
    assert result["ranges"] == result["shuffle"] and [r[:3] for r in result["ranges"]] == sorted(brute.jaccard_components(rows))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c d e"), (7, "A B C D E"), (8, "a b c d e"), (8, "a b c d e"), (9, "é ñ"), (10, "É ñ"), (11, "x " * 20000), (12, "x " * 300), (13, "a b c d"), (13, "q r s t")]
    compare(spark, rows)


def test_sets_without_an_id(spark):
    # 3 and 4 meet only through texts whose rows have no id; the last two have nobody to name them
    w = [f"w{k}" for k in range(40)]
    rows = [(3, " ".join(w)), (None, " ".join([*w, "a", "b", "c", "d", "e"])), (4, " ".join([*w, *"abcdefghij"]))]
    rows += [(None, rows[1][1]), (5, "q " * 9), (None, "one two three four five six seven eight nine"), (None, "one two three four five six seven eight nine ten"), (None, None)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute.jaccard_components(rows)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == want and (4, 46, 3) in want
    assert sorted(r.n_links for r in got if r.n_shingles in (5, 6)) == [1, 1]


def test_empty_table_and_extra_columns(spark):
    assert ngram_join.ngram_components(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "k", 2.0), (2, "a b c d e f", "l", 3.0), (3, None, "m", None)], "doc_id long, text string, node string, n double")
    assert sorted(map(tuple, ngram_join.one_of_each(df).collect()), key=str) == [(1, "a b c d e f", "k", 2.0), (3, None, "m", None)]


def test_one_of_each_of_shared_ids(spark):
    # 5 stands on a copy of 1's text, on the text that names 5 and 7, on one of its own and on an empty one; 6 on copies only
    w = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcd"]
    rows = [(1, w[0]), (5, w[0]), (5, w[1]), (7, w[1]), (5, w[2]), (5, None), (6, w[0]), (6, w[1]), (8, w[3]), (None, w[0])]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, w[0]), (5, w[1]), (5, w[2]), (5, None), (8, w[3]), (None, w[0])], key=str)


def test_threshold_is_met_exactly(spark):
    # 7 shingles each, 6 shared: 6 / 8 = 0.75
    w = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join(w[:11])), (2, " ".join([*w[:10], "end"])), (3, " ".join(["start", *w[1:11]]))]
    compare(spark, rows)


@pytest.mark.parametrize("n", [3, 5, 10, 40])
def test_boundary_is_a_cost(n):
    cheap = ngram_join.boundary_of([(n, 100, 1e9)])
    assert cheap >= n and ngram_join.boundary_of([(n, 100, 1.0)]) < n


def test_near_copies_give_rows_in_proportion(spark, monkeypatch):
    """Clusters of as many near copies as a light list holds: rows of lists by the postings, not by the pairs of each; tables
    of a step that is over are gone."""
    import os

    from pagemill.llm import common

    rng = random.Random(6)
    rows = []
    for c in range(10):
        base = [f"c{c}w{k}" for k in range(100)]
        rows += [(100 * c + k, edited(rng, base, 0.008)) for k in range(30)]
    made, keep = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name, **o: made.append((name, (out := keep(df, name, **o)).count())) or out)
    own = os.path.dirname(common.scratch(spark, "x")).removeprefix("file:")
    there = set(os.listdir(own))
    compare(spark, rows)
    sets = {brute.shingle_set(t) for _, t in rows}
    assert sum(n for name, n in made if name == "lists") < sum(len(s) - ngram_join.need(len(s)) + 1 for s in sets)
    assert {f.split("-")[0] for f in set(os.listdir(own)) - there} <= {"rows", "members", "named"}


def test_texts_that_stay_cross_no_shuffle(spark):
    """Of the documents only those that a filter of the ids that go lets through are joined."""
    rows = [(k, f"text {k} of five words {k}", "z") for k in range(60)] + [(100 + k, f"text {k} of five words {k}", "z") for k in range(6)]
    df = spark.createDataFrame(rows, SCHEMA + ", score string").localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ngram_join.one_of_each(df)
        assert sorted(r.doc_id for r in out.collect()) == list(range(60)) and out.columns == df.columns
        assert out._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "Union"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffles_of_stored_tables_go(spark):
    import time

    from pagemill.llm import common

    def files():
        return sum("shuffle_" in str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))

    there = files()
    df = spark.range(1000).repartition(7, "id")
    out = common.written(df, "x")
    until = time.time() + 20
    while files() > there and time.time() < until:
        time.sleep(0.2)
    assert files() <= there and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert out.count() == 1000
