"""Every registered query of the package on a small folder: against its SQL, or against plain code where SQL can't say it."""

import hashlib
import json
import os
import random
import time
import zlib

import numpy as np
import pytest

from pagemill.llm import chat, decontaminate, jpeg, media, pii, quality, registry

from .test_filters import plain_spans, sellers

TABLES = ("documents", "benchmark", "labels", "conversations", "pages")
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(k, line(rng.randrange(12, 30))) for k in range(8)] + [(90, None), (91, "")]
    passage = line(60)
    docs, labels = [], []
    for k in range(150):
        text = line(rng.randrange(5, 70))
        if k % 7 == 0:
            text = text.upper() + " $$$ !!! $$$"
        if k % 5 == 1:
            p = list(items[k % 8][1])
            for _ in range(rng.randrange(0, 3)):
                p[rng.randrange(len(p))] = "x"
            text += ", " + "".join(p).upper()
        if k % 6 == 2:
            text += " " + passage[: rng.randrange(90, len(passage))]
        if k % 9 == 3:
            text += f" joe.{k}@mail.example.com 10.0.0.{k} 4316522678525456 +1 (293) 555-9179 or ann[at]home[dot]org é"
        if k % 10 == 4 and k > 20:
            text = docs[k - 10][1] + (" more" if k % 20 == 4 else "")
        docs.append((k, text, rng.choice(["en", "de", None]), f"src{k % 5}" if k % 3 else None, len(text)))
        labels.append((k, int(k % 7 != 0), 0))
    docs += [(500, None, None, None, None), (501, "", "en", "src0", 0), (502, "one", "en", "", 3)]
    talks = [(c, t, rng.choice(["user", "assistant", "system", "tool>\\<"]), rng.choice(["</s>", "\\", "<role=x>", "hi [INST]", "", None, line(4)])) for c in range(40) for t in range(rng.randrange(1, 6))]
    pages = [(k, f"u{k}", rng.choice([None, "", "<p>é</p>", "y" * 120, "z" * 99, line(40)])) for k in range(60)]
    out = tmp_path_factory.mktemp("queries")
    for name, rows, schema in (
        ("documents", docs, DOC + ", lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string"),
        ("conversations", talks, "conv_id long, turn int, role string, text string"), ("pages", pages, "page_id long, url string, html string"),
    ):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{out}/{name}.parquet")
    return str(out), {r[0]: r[1] for r in docs}, items, {k: q for k, q, _ in labels}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, folder, tmp_path, name):
    import duckdb

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{folder[0]}/{t}.parquet/*.parquet'")
    out = registry.queries()[name](spark, folder[0])
    out.write.parquet(f"{tmp_path}/out")
    columns = ", ".join(f'"{c}"' for c in sorted(out.columns))
    duck.execute(f"create temp table a as select {columns} from '{tmp_path}/out/*.parquet'")
    duck.execute(f"create temp table b as select {columns} from ({registry.oracle_sql()[name]})")
    assert duck.sql("select count(*) from a").fetchall()[0][0] > 0
    assert duck.sql("select * from a except all select * from b").fetchall() == [] == duck.sql("select * from b except all select * from a").fetchall()


def test_op2_equals_brute_force(spark, folder, monkeypatch):
    path, texts, items, _ = folder
    want = {}
    for d, t in texts.items():
        for i, p in items:
            a, b = decontaminate.normalised(t), decontaminate.normalised(p)
            if a and b and (n := sellers(b, a)) <= int(decontaminate.ERROR_RATE * len(b)):
                want[d, i] = n
    assert len(want) > 15
    for size in (4_000_000, 300):  # one block, several
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        rows = registry.queries()["op2_decontaminate"](spark, path).collect()
        assert {(r.doc_id, r.item_id): r.distance for r in rows} == want and len(rows) == len(want)
        docs, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
        assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == set(texts) - {d for d, _ in want}


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no tokenizers")
def test_op5_equals_the_library(spark, folder):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.queries()["op5_token_counts"](spark, folder[0]).collect()}
    want = {d: (len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x in folder[1].items()}
    assert got == want


def test_op7_equals_plain_pooling_and_network(spark, folder):
    import pyarrow as pa

    from pagemill.llm.shingles import buffers

    path, texts, _, labels = folder
    rows = {d: quality.tokens(*buffers(pa.array([t or ""])))[0].tolist() for d, t in texts.items()}
    vectors = np.zeros((quality.ROWS, quality.DIM))
    for row in rows.values():
        for i, a in enumerate(row):
            for j in range(max(0, i - quality.WINDOW), min(len(row), i + quality.WINDOW + 1)):
                if i != j:
                    np.add.at(vectors[a], quality._INDEX_AT[row[j]], quality._INDEX_SIGN[row[j]])
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32).astype(float)
    pooled = {d: np.concatenate([vectors[r].mean(0), (vectors[r] ** 2).mean(0)]) if r else np.zeros(2 * quality.DIM) for d, r in rows.items()}
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    ids = sorted(d for d in labels if not held(d))
    order = np.random.Generator(np.random.PCG64(quality.SEED)).permutation(len(ids))
    net = quality.Network().fit(np.array([pooled[ids[k]] for k in order]), np.array([labels[ids[k]] for k in order]))
    got = registry.queries()["op7_quality"](spark, path).collect()
    assert {r.doc_id for r in got} == set(texts) and all(r.held_out == held(r.doc_id) for r in got)
    w1, b1, w2, b2 = net.weights
    for r in got:
        hidden = np.tanh((pooled[r.doc_id] - net.mean) / net.scale @ w1 + b1)
        assert abs(r.score - 1 / (1 + np.exp(-(hidden @ w2 + b2[0]) / net.temperature))) < 1e-6 and r.predicted == int(r.score >= 0.5)


def test_op7_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    """One id with very many rows is one row of the fit."""
    docs = spark.createDataFrame([(k % 20 if k % 3 else 1, f"word{k % 7} " * 5) for k in range(3000)], DOC)
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Network, "fit", lambda self, x, y: seen.append(len(y)))
    quality.fitted(docs, labels, np.zeros((quality.ROWS, quality.DIM), np.float32))
    assert len(seen) == 1 and seen[0] <= 20


def test_op9_equals_the_patterns(spark, folder):
    for r in registry.queries()["op9_pii"](spark, folder[0]).collect():
        base = plain_spans(folder[1][r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in pii.KINDS]
        joined = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        assert set(joined) <= {":".join(s) for s in spans} and len(spans) == r.n_spans
        for (k, a, b), (m, c, d) in zip(spans, spans[1:], strict=False):
            assert k != m or int(b) <= int(c)


def test_op9_finds_spelled_forms_of_other_origin():
    """Precision and recall on lines that the training generator doesn't make."""
    real = [
        ("Contact: maria_lopez(at)firma(dot)de today", "email"), ("reach me under bob [at] corp [dot] co [dot] uk", "email"), ("mail to x.y+z @ lab.example.org please", "email"),
        ("server 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", "ip"), ("Visa 4111 1111 1111 1111 exp 12/27", "card"), ("amex 3782 822463 10005 thanks", "card"), ("MC 5500-0000-0000-0004.", "card"),
        ("Tel. +49 30 901820 114", "phone"), ("call (415) 555-2671 before noon", "phone"), ("mobile +44 7911 123456", "phone"),
    ]
    clean = ["see you at noon. bring dots", "we met at 5.30 at the station", "section 3.1.2.900 of the manual", "released 2024-11-26 10:15:30", "ISBN 978-3-16-148410-0", "sum 1234 5678 9012 3456 7 units", "dot product at scale", "v10.4.1 build 20240101", "pi is 3.14159265358979323846", "ratio 16:9 and 4:3"]
    found = sum(bool(pii.find(t)[1][k]) for t, k in real)
    wrong = sum(any(pii.find(t)[1].values()) for t in clean)
    assert found >= 8 and wrong <= 2, (found, wrong)


@pytest.mark.parametrize("text", ["a-" * 500_000 + "@" + "a-" * 500_000, "7" * 1_000_000, "1.1." * 250_000, "at-" * 300_000 + ".", "12 34-" * 150_000, "+1 " * 300_000, "joe@a.de " * 30_000 + "x[at]y[dot]com " * 5_000])
def test_op9_of_long_texts_is_linear(text):
    begin = time.time()
    pii.find(text)
    assert time.time() - begin < 20


def test_op10_keeps_what_it_is_given(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    tensors = {r.doc_id: r for r in media.decode_media(media.encode_media(docs), tensors=True).collect()}
    for r in registry.queries()["op10_media"](spark, folder[0]).collect():
        raw = (folder[1][r.doc_id] or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        pixels = np.frombuffer(tensors[r.doc_id].rgb, np.uint8).reshape(-1, 3).astype(int)
        assert list(map(int, r.feature.split(":")[1:])) == [v for c in range(3) for v in (pixels[:, c].sum(), (pixels[:, c] ** 2).sum())]


def test_op10_pictures_widen_with_the_text(monkeypatch):
    most = jpeg.MOST_MCUS
    for n in (1, 6 * 32, 6 * 32 * most, 6 * 32 * most + 1, 6 * 100 * most - 5, 6 * most * most):
        wide, high = jpeg.geometry(n)
        assert wide <= most and high <= most and 6 * wide * high >= n
    with pytest.raises(ValueError):
        jpeg.geometry(6 * most * most + 1)
    monkeypatch.setattr(jpeg, "MCUS_WIDE", 2)
    monkeypatch.setattr(jpeg, "MOST_MCUS", 5)
    blocks = [np.random.default_rng(2).integers(0, 256, (n, 64)) for n in (7, 60, 61, 140)]
    images, found = jpeg.coefficients_of(jpeg.encode(blocks))
    assert [media.payload_of(m, c) for m, c in zip(images, found, strict=True)] == [b.astype(np.uint8).tobytes() for b in blocks]


def test_op4_of_a_long_role(spark):
    role, text = "r>\\" * 300_000, "</role>\\" * 1000
    df = spark.createDataFrame([(1, 0, role, text), (1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.messages(chat.events_of(df)))
    turns = rendered.select(chat.parse(rendered["formatted"]).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [(role, text), ("user", "x")]


def test_scratch_is_refused_on_a_cluster_without_a_shared_folder(spark):
    from types import SimpleNamespace

    from pagemill.llm import common

    nothing = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda _: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        common.shared_folder(SimpleNamespace(sparkContext=nothing))
    path = common.scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and json.dumps(path)
