"""Core queries over every row of small tables, against plain Python."""

from pagemill.plans import catalogue


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_survey_lengths_of_all_conversations(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "é" * (c + t)) for c in range(1, 6) for t in range(3)]
    sf = saved(spark, tmp_path, "conversations", rows, "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.page_index): (r.user, r.assistant) for r in catalogue.queries()["survey_lengths"](spark, sf).collect()}
    assert got == {(c, t): ((c + t, None) if t % 2 == 0 else (None, c + t)) for c, t, _, _ in rows}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_cer_of_all_items(spark, tmp_path):
    texts = ["plain text", "Größe und Maß", "café déjà vu", "ΑΒΓ αβγ", "\U0001d7d8 ok", "ابتث abc", "", "x"]
    sf = saved(spark, tmp_path, "benchmark", list(enumerate(texts)), "item_id long, text string")
    got = {r.item_id: (r.shouted, r.n, r.cer) for r in catalogue.queries()["cer"](spark, sf).collect()}
    assert got == {k: (t.upper(), len(t), round(edits(t, t.upper()) / max(len(t), 1), 9)) for k, t in enumerate(texts)}
