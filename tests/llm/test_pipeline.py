"""The corpus pipeline on a small folder of tables, against plain decisions."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"word{k}" for k in range(500)]
    item = " ".join(rng.choice(words) for _ in range(30))
    docs, labels = [], []
    for k in range(400):
        body = [rng.choice(words) for _ in range(rng.randrange(30, 80))]
        good = k % 5 != 0
        text = " ".join(body) if good else " ".join(w.upper() + "$$$" for w in body)
        if k % 5 == 1 and k > 200:
            text += " " + item
        if k % 5 == 2:
            text += f" mail joe.{k}@site.example.com"
        docs.append((k, text, rng.choice(["en", "de"]), f"src{k % 8}", len(text), "extra"))
        labels.append((k, int(good), 0))
    docs += [(1000 + k, docs[3 + 5 * k][1] + " tail", "en", "src0", 5, None) for k in range(20)]
    docs += [(2000, None, None, None, None, None), (2001, "", "en", "src1", 0, "x")]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, seen = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "mixture":
            assert docs.schema.names == schema.names
    kept = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert not {k for k in kept["quality"] if k < 400 and k % 5 == 0}
    assert {k for k in range(400) if k % 5} <= kept["quality"]
    assert not {k for k in kept["near_copies"] if 1000 <= k < 2000} and {k for k in range(400) if k % 5} <= kept["near_copies"]
    assert kept["near_copies"] - kept["decontaminate"] == {k for k in range(201, 400) if k % 5 == 1}
    texts = {r.doc_id: r for r in seen["pii"].collect()}
    assert all(("[EMAIL]" in (r.text or "")) == (k < 400 and k % 5 == 2) for k, r in texts.items())
    assert texts[2].n_chars == len(texts[2].text) and kept["pii"] == kept["decontaminate"]
    assert kept["mixture"] <= kept["pii"] and set(seen["mixture"].columns) == {"doc_id", "domain", "lang", "source", "epoch", "n_tokens"}


def test_run_is_the_stages(spark, folder):
    a, b = corpus_pipeline.run(spark, folder), spark.read.parquet(f"{folder}/mixture")
    assert a.exceptAll(b.select(a.columns)).count() == 0 == b.select(a.columns).exceptAll(a).count()


def test_registry_imports():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names and len([n for n in names if n.startswith("op")]) == 10
