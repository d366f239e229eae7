"""Token counts, archives, chats, mixing: exact round trips and plain versions."""

import hashlib
import os
import random
import struct
import zipfile
import io

import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, mixing, token_counts, warc
from pagemill.llm.common import scratch

from . import brute

DOC = "doc_id long, text string"
TOKENIZERS = "/opt/tokenizers"


# -- tokens -----------------------------------------------------------------------

TEXTS = [None, "", "hello world", "hello world", "<|endoftext|> special", "é" * 700, "long words " * 20_000, " \n\t ", "😀"]


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizers")
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library_and_the_cache_grows_by_misses(spark, name):
    path = f"{TOKENIZERS}/{name}"
    cache = scratch(spark, "test-cache")
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "hello world"), (2, "hello world")], DOC)
    got = token_counts.token_counts(docs.withColumn("content", F.lit("x")), path, cache).collect()
    if name.endswith("json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lambda x: len(s.encode(x))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(TEXTS):
        assert all((r.n_tokens, r.n_bytes, r.over_limit) == (n(text or ""), len((text or "").encode()), n(text or "") > 1024) for r in by[k])
    assert len(got) == len(TEXTS) + 2
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})
    more = spark.createDataFrame([(1, "hello world"), (2, "brand new")], DOC)
    assert token_counts.token_counts(more, path, cache).count() == 2
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS}) + 1
    assert token_counts.token_counts(more.limit(0), path, cache).count() == 0


# -- archives ------------------------------------------------------------------------


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide):
    members = [("archive/a", os.urandom(3000)), ("indexes/i", b"x y"), ("empty", b"")]
    raw = warc.zip_package(members, zip64=wide)
    reads = []

    def read(at, n):
        reads.append(n)
        return raw[at : at + n]

    found = warc.zip_members(read, len(raw))
    assert {k: raw[a : a + n] for k, (a, n) in found.items()} == dict(members)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:  # an independent reader agrees
        assert {n: z.read(n) for n in z.namelist()} == dict(members) and z.testzip() is None
    with pytest.raises(ValueError):
        warc.zip_members(lambda a, n: b"\0" * n, 500)


def test_reader_takes_files_of_others_with_a_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a", b"data")
        z.writestr(zipfile.ZipInfo("deflated"), b"z" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment"
    raw = out.getvalue()
    assert list(warc.zip_members(lambda a, n: raw[a : a + n], len(raw))) == ["archive/a"]


def test_archives_round_trip(spark):
    rng = random.Random(1)
    big = "payload é " * 30
    pages = [(k, f"http://x/{k}", rng.choice([None, "", "short", big, big + str(k), "\r\n\r\nWARC/1.1 " * 12])) for k in range(200)] + [(3, "again", big), (None, None, big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    rows = warc.read_packages(warc.write_packages(df)).collect()
    first = {}
    for k, _, h in pages:
        if h and len(h.encode()) >= 100 and k is not None:
            first[h] = min(first.get(h, k), k)
    want = []
    for k, _, h in pages:
        raw = (h or "").encode()
        other = first.get(h) if len(raw) >= 100 else None
        revisit = other is not None and k is not None and k != other
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", other if revisit else None, None if revisit else raw))
    key = lambda r: str(r)
    assert sorted(((*r[:5], None if r.block is None else bytes(r.block)) for r in rows), key=key) == sorted(want, key=key)
    assert warc.read_packages(warc.write_packages(df.limit(0))).count() == 0


def test_packages_are_read_by_ranges(spark, monkeypatch):
    """As files and as cells the records are the same; a file is never read as a whole."""
    df = spark.createDataFrame([(k, None, f"page {k} " * 50) for k in range(50)], "page_id long, url string, html string").repartition(2)
    files = warc.write_packages(df)
    assert files.where("content IS NOT NULL").count() == 0 < files.count()
    store, path = warc.files_of(files.first().package)
    asked = []
    with store.open_input_file(path) as f:
        size = f.size()
        got = list(warc.package_records(lambda at, n: asked.append(n) or f.read_at(n, at), size))
    assert got and len(asked) == len(got) + 5 and max(asked[1:]) < size / 2
    want = sorted(map(str, warc.read_packages(files).collect()))
    monkeypatch.setattr(warc, "files_of", lambda path: None)
    cells = warc.write_packages(df)
    assert cells.where("content IS NULL").count() == 0 and sorted(map(str, warc.read_packages(cells).collect())) == want


def test_zip64_end_record_holds_the_figures():
    raw = warc.zip_package([("a", b"1")], zip64=True)
    assert struct.unpack_from("<H", raw, len(raw) - 12)[0] == 0xFFFF and b"PK\x06\x07" in raw


# -- chats ---------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "\\", "\\\\</s>", "<<SYS>><</SYS>>", "<role=x>y</role>", "a<", "[", "<s", "é😀", "", None, "x" * 50_000]


def test_chats_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool>\\<", None, ""]), rng.choice(NASTY)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(5, 0, "user", "tie"), (5, 0, "user", "tie"), (None, 1, "assistant", "no conversation")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    rendered = chat.render(chat.messages(chat.events_of(df)))
    turns = {}
    for c, t, r, x in rows:
        turns.setdefault(c, []).append((t, r or "", x or ""))
    parsed = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rendered.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    for c, own in turns.items():
        assert parsed[c] == [(r, x) for _, r, x in sorted(own, key=lambda v: (v[0], v[1].encode(), v[2].encode()))]
    for r in rendered.join(chat.read_back(rendered), "conv_id").collect():
        own = [(role, x) for _, role, x in sorted(turns[r.conv_id], key=lambda v: (v[0], v[1].encode(), v[2].encode()))]
        loss = "".join(x for role, x in own if role == "assistant")
        spans = "".join(chat_unescape(r.formatted[s.start : s.end]) for s in r.loss_spans)
        assert spans == loss and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest() and r.n_turns == len(own)
    assert chat.read_back(chat.render(chat.messages(chat.events_of(df.limit(0))))).count() == 0


def chat_unescape(t):
    out, k = [], 0
    while k < len(t):
        k += t[k] == "\\"
        out.append(t[k])
        k += 1
    return "".join(out)


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, "start", "assistant", None), (1, 1, 1, "delta", None, "wrong"), (1, 2, 1, "regenerate", None, None), (1, 3, 1, "delta", None, "Hel"), (1, 5, 1, "delta", None, "o"), (1, 4, 1, "delta", None, "l"),
        (1, 9, 2, "start", "user", None), (1, 10, 2, "delta", None, "old"), (1, 11, 2, "edit", None, "new"), (1, 12, 2, "delta", None, "er"), (1, 6, 3, "start", "system", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, text string").repartition(3)
    got = [(r.role, r.text) for r in chat.messages(df).orderBy("first_seq").collect()]
    assert got == [("assistant", "Hello"), ("system", ""), ("user", "newer")]


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.render(chat.messages(chat.events_of(df))))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow")) and plan.count("Exchange hashpartitioning") == 1


# -- mixing -----------------------------------------------------------------------------------


def table_budgets(spark, leaves, budget, weights, epochs):
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, tokens long")
    found = mixing.budgets(df, ("domain", "lang"), budget / max(1, sum(leaves.values())), weights, epochs).collect()
    return {(r.domain, r.lang): round(r.goal, 6) for r in found}


def test_shares_and_shortages(spark):
    families = [(10, [(1, 100), (1, 100)], [5, 5]), (10, [(1, 2), (1, 100), (2, 3)], [2, 5, 3]), (10, [(0, 100), (1, 4)], [6, 4]), (10, [(1, 3), (1, 3)], [3, 3]), (9, [(0, 100), (0, 2), (1, 1)], [6, 2, 1]), (5, [(1, 0), (2, 10)], [0, 5])]
    for budget, children, want in families:
        assert [round(x, 6) for x in brute.shared_out(budget, children)] == want
        df = spark.createDataFrame([("f", f"c{k}", float(w), float(c), float(budget)) for k, (w, c) in enumerate(children)], "family string, name string, weight double, capacity double, budget double")
        assert [round(r.part, 6) for r in mixing.shared_out(df, ["family"], ["family", "name"]).orderBy("name").collect()] == want
    leaves = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 20}
    # a's short leaf gives to its sibling first; b's shortage goes up to a
    want = {("a", "x"): 10, ("a", "y"): 270, ("b", "x"): 20}
    assert brute.budgets(leaves, 300, {}, 1) == want
    assert table_budgets(spark, leaves, 300, {}, 1) == want


def test_budgets_equal_plain_version(spark):
    rng = random.Random(4)
    for _ in range(4):
        leaves = {(f"d{rng.randrange(4)}", f"l{rng.randrange(9)}"): rng.choice([0, 1, 7, 50, 900]) for _ in range(20)}
        weights = {(f"d{k}",): rng.choice([0.0, 0.5, 2.0, 5.0]) for k in range(3)} | {("d1", "l1"): 4.0, ("d2", "l2"): 0.0}
        budget = rng.choice([0.1, 0.6, 1.7]) * sum(leaves.values())
        want = {k: round(v, 6) for k, v in brute.budgets(leaves, budget, weights, 2).items()}
        assert table_budgets(spark, leaves, budget, weights, 2) == want


def plain_mix(small, weights, share, epochs, seed):
    leaves = {}
    for row in small:
        leaves.setdefault(row[1:4], []).append(row)
    tokens = {k: sum(r[4] for r in v) for k, v in leaves.items()}
    goal = brute.budgets(tokens, share * sum(tokens.values()), weights, epochs)
    place = lambda e, d: hashlib.md5(f"{seed}:{e}:{'' if d is None else d}".encode()).hexdigest()[:15]
    out = []
    for leaf, own in leaves.items():
        if not tokens[leaf]:
            continue
        full = int(goal[leaf] // tokens[leaf])
        rest = int(goal[leaf] - full * tokens[leaf])
        out += [(*r[:4], e, r[4]) for e in range(full) for r in own]
        total = 0
        for r in sorted(own, key=lambda r: (place(full, r[0]), r[0] or 0, r[4])) if rest > 0 else ():
            total += r[4]
            if total > rest:
                break
            out.append((*r[:4], full, r[4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("copies", [2, 1 << 16])
def test_mix_equals_plain_version(spark, monkeypatch, copies):
    """Any size of leaf has one order; null and repeated ids, blank texts and clashing names come along."""
    monkeypatch.setattr(mixing, "COPIES", copies)
    rng = random.Random(9)
    data = []
    for k in range(3000):
        source = "src0" if rng.random() < 0.35 else f"src{rng.randrange(1, 7)}"
        data.append((k, rng.choice(["web", "books"]), rng.choice(["en", "de", None]), source, " ".join("w" * 3 for _ in range(rng.randrange(0, 40)))))
    data += [(1, "web", "en", "src0", None), (2, "books", "xx", None, "one two")]
    data += [(None, "web", "en", "src0", "w " * (k % 5)) for k in range(400)] + [(7, "web", "de", "src1", "a b c")] * 300
    df = spark.createDataFrame(data, "doc_id long, domain string, lang string, source string, text string").withColumn("full", F.lit("clash")).withColumn("weight", F.lit(3))
    weights = {("books",): 3.0, ("books", "en"): 2.0, ("web", "de"): 0.0}
    small = [(d, a, b or "", c or "", len((t or "").split())) for d, a, b, c, t in data]
    for share in (0.35, 0.9):
        got = sorted(((r.doc_id, r.domain, r.lang, r.source, r.epoch, r.n_tokens) for r in mixing.mixed(df, weights=weights, share=share, epochs=3).collect()), key=str)
        assert got == plain_mix(small, weights, share, 3, mixing.SEED)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, domain string, lang string, source string, text string")
    assert mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, "web", "en", "s", ""), (2, None, None, None, None)], empty.schema)
    assert mixing.mixed(blank).count() == 0
