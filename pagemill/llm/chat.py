"""Chat formatting from an event log, in DataFrame operations alone.

A log has rows (conv_id, seq, message_id, kind, role, text).  Kinds: `start`
opens a message and gives its role, `delta` appends text, `edit` replaces what
the message holds, `regenerate` empties it.  A message holds what its events
since the last `edit` or `regenerate` leave; messages stand by their first
seq.  Rendering puts marks around each message and escapes marks inside texts;
parsing gives the messages back.

Every mark starts with `<` or `[`.  In a text each backslash is doubled, then a
backslash goes behind the first character of each mark, so no mark is left in
the text, and dropping one backslash before each character undoes it.

One shuffle, by conversation: message folds, offsets and rendering all use it.
A conversation is one output string, so it has to fit into one row.  Null text
is empty, a null role is the empty role, a null conv_id is a conversation of
its own.  Rows with the same turn stand by role, then text; repeated rows are
turns of their own.  An empty table gives no rows.  Roles and texts may be of
any length and hold any characters; columns besides those named don't matter,
whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

# The template's marks.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER = ("<role=", "</role>")
MARKS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<role=", "</role>")
_TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|<role=.*?</role>"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in MARKS:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of(conversations: DataFrame) -> DataFrame:
    """A log for finished turns: start, two deltas; for assistants a first try that is regenerated and an edit."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, text = F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text).withColumn("message_id", F.row_number().over(w).cast("long"))
    event = lambda k, kind, text: F.struct((F.col("message_id") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    head, tail = F.expr("substring(text, 1, cast(floor(char_length(text) / 2) AS int))"), F.expr("substring(text, cast(floor(char_length(text) / 2) AS int) + 1)")
    plain = F.array(event(0, "start", F.lit("")), event(5, "delta", head), event(6, "delta", tail))
    again = F.array(event(0, "start", F.lit("")), event(1, "delta", F.lit("first try")), event(2, "regenerate", F.lit("")), event(3, "delta", F.lit("draft")), event(4, "edit", head), event(6, "delta", tail))
    rows = turns.select("conv_id", "message_id", "role", F.explode(F.when(F.col("role") == "assistant", again).otherwise(plain)).alias("e"))
    return rows.select("conv_id", "e.seq", "message_id", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text")


def messages(events: DataFrame) -> DataFrame:
    """conv_id, first_seq, role, text: the messages that a log leaves."""
    folded = events.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first_seq"),
        F.coalesce(F.max("role"), F.lit("")).alias("role"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).alias("reset"),
        F.collect_list(F.when(F.col("kind").isin("delta", "edit"), F.struct("seq", F.coalesce(F.col("text"), F.lit("")).alias("text")))).alias("parts"),
    )
    live = F.filter("parts", lambda p: F.col("reset").isNull() | (p["seq"] >= F.col("reset")))
    return folded.select("conv_id", "first_seq", "role", F.array_join(F.transform(F.array_sort(live), lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: code-point spans [start, end) of the assistant texts in formatted."""
    pick = lambda marks, other: F.coalesce(*(F.when(F.col("role") == r, F.lit(m)) for r, m in marks.items()), other)
    role = F.replace(escaped(F.col("role")), F.lit(">"), F.lit("\\>"))
    head = pick(OPEN, F.concat(F.lit(OTHER[0]), role, F.lit(">")))
    piece = messages.select("conv_id", "first_seq", "role", head.alias("head"), escaped(F.col("text")).alias("body"), pick(CLOSE, F.lit(OTHER[1])).alias("tail"))
    w = Window.partitionBy("conv_id").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("head") + F.char_length("body") + F.char_length("tail")
    placed = piece.withColumn("end", F.sum(size.cast("long")).over(w) - F.char_length("tail"))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("end") - F.char_length("body")).alias("start"), F.col("end").alias("end")))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", F.concat("head", "body", "tail").alias("piece")))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return rows.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    def one(turn: Column) -> Column:
        def between(head: str, tail: str) -> Column:
            return F.substring(turn, F.lit(len(head) + 1), F.char_length(turn) - len(head) - len(tail))

        inner = between(*OTHER)
        # the role ends at the first > without a backslash: pairs of a backslash and what it escapes are blotted out, in order
        blotted = F.replace(F.replace(inner, F.lit("\\\\"), F.lit("__")), F.lit("\\>"), F.lit("__"))
        ends = F.instr(blotted, ">")
        struct = lambda role, text: F.struct(role.alias("role"), unescaped(text).alias("text"))
        return F.coalesce(
            *(F.when(F.startswith(turn, F.lit(OPEN[r])), struct(F.lit(r), between(OPEN[r], CLOSE[r]))) for r in OPEN),
            struct(unescaped(F.substring(inner, F.lit(1), ends - 1)), F.substring(inner, ends + 1, F.char_length(inner))),
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), 0), one)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what parsing gives; the loss text is that of the assistant turns in order."""
    turns = rendered.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), F.size("loss_spans").cast("long").alias("n_loss_spans"), parse(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every.cast("binary"), 256).alias("turns_sha256"), F.char_length(said).cast("long").alias("loss_chars"), F.sha2(said.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_loss_spans")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    conversations = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(planted)
    return read_back(render(messages(events_of(conversations))))


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in MARKS:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP4_SQL = f"""
WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     m AS (SELECT *, length({_sql_escaped("text")}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                  ELSE 14 + length(replace({_sql_escaped("role")}, '>', '\\>')) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_loss_spans
FROM m GROUP BY conv_id
"""
