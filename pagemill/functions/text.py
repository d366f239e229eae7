"""Text functions as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charclass as cc

RLM = "‏"
# The list bullets, and the decimal digits that markers may use.
BULLETS = "-•–*—"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
REASON_CHARS = 400


def _spaces(side: str) -> str:
    return {"left": "^" + cc.SPACES, "right": cc.SPACES + r"\z"}[side].replace("^(?U)", "(?U)^")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, _spaces("left"), "")


def strip(text: Column) -> Column:
    return F.regexp_replace(lstrip(text), _spaces("right"), "")


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, cc.SPACES), lambda t: t != "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def normalised(text: Column, form: str = "NFC") -> Column:
    """Unicode NFC or NFKC; Spark has no such expression, so batches go through Arrow."""
    if form not in ("NFC", "NFKC"):
        raise ValueError(f"unsupported form: {form}")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    # below U+0300 all text is NFC already, and ASCII is NFKC: only the rest crosses, the others go along as nulls
    other = F.regexp_like(text, F.lit(r"[^\x00-\x{2FF}]" if form == "NFC" else r"[^\x00-\x7F]"))
    return F.coalesce(run(F.when(other, text)), text)


# -- Markdown escapes --------------------------------------------------------


def escape_inline(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>])", r"\\$1")


def escape_paragraph(text: Column) -> Column:
    """Inline escapes, and a backslash before what a line's start would turn into a block."""
    opens = r"(?U)^(?:#{1,6}[\s\x1c-\x1f]|[-*+][\s\x1c-\x1f]|\d+[.)][\s\x1c-\x1f]|>)"

    def line(t: Column) -> Column:
        safe = escape_inline(t)
        # a line keeps its text; its end is the end of the string, so `\s` needs a character behind the mark
        return F.when(F.regexp_like(safe, F.lit(opens)), F.concat(F.lit("\\"), safe)).otherwise(safe)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def escape_cell(text: Column) -> Column:
    return F.replace(F.replace(escape_inline(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def escape_alt(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


# -- Direction ---------------------------------------------------------------


def arabic_dominant(text: Column) -> Column:
    right = count_of(text, cc.bidi("R"))
    return (right > 0) & (right > count_of(text, cc.bidi("L")))


def has_ltr_run(text: Column) -> Column:
    return F.regexp_like(text, F.lit(cc.bidi("L")))


def with_rlm(text: Column) -> Column:
    """A right-to-left mark before right-to-left text that has a left-to-right run; once only."""
    # the cheap test first: rows without any right-to-left letter skip the large classes
    maybe = F.regexp_like(text, F.lit("[\\x{590}-\\x{8FF}\\x{200F}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}\\x{10800}-\\x{10FFF}\\x{1E800}-\\x{1EFFF}]"))
    return F.when(maybe & ~F.startswith(text, F.lit(RLM)) & arabic_dominant(text) & has_ltr_run(text), F.concat(F.lit(RLM), text)).otherwise(text)


def prepared(text: Column, form: str = "NFC", apply_bidi: bool = True) -> Column:
    out = normalised(text, form)
    return with_rlm(out) if apply_bidi else out


# -- Lists -------------------------------------------------------------------


def digits_to_long(text: Column) -> Column:
    """Western and Arabic-Indic digits, mixed; null beyond 64 bits."""
    return F.translate(text, ARABIC_DIGITS, "0123456789").try_cast("long")


def list_marker(text: Column) -> Column:
    """The marker struct that a text's start gives, or null."""
    body = lstrip(text)
    bullet = F.regexp_extract(body, rf"^([{BULLETS}])(?: |\z)", 1)
    ordered = r"(?U)^([0-9٠-٩]+)[\s\x1c-\x1f]*[.)][\s\x1c-\x1f]+"
    whole = F.regexp_extract(body, ordered, 0)
    nothing = F.lit(None)
    mark = lambda kind, ordinal, raw: F.struct(F.lit(kind).alias("kind"), ordinal.cast("long").alias("ordinal"), raw.alias("raw_marker"))
    return F.when(bullet != "", mark("bullet", nothing, bullet)).when(whole != "", mark("ordered", digits_to_long(F.regexp_extract(body, ordered, 1)), strip(whole)))


def without_marker(text: Column, raw: Column) -> Column:
    """text without its marker and one space behind it; white space before the marker stays."""
    body = lstrip(text)
    lead = F.substring(text, F.lit(1), F.char_length(text) - F.char_length(body))
    rest = F.substring(body, F.char_length(raw) + 1, F.char_length(body))
    rest = F.when(F.startswith(rest, F.lit(" ")), F.substring(rest, F.lit(2), F.char_length(rest))).otherwise(rest)
    return F.when(raw.isNotNull() & (raw != "") & F.startswith(body, raw), F.concat(lead, rest)).otherwise(text)


# -- Recognised and diagnostic text -------------------------------------------


# What counts as a formula's marks, in the order in which they go. A dollar that is escaped marks nothing, a
# pair of single ones stands on one line.
MATH_MARKS = (
    r"(?isU)<[\s\x1c-\x1f]*math\b[^>]*>(.*?)<[\s\x1c-\x1f]*/[\s\x1c-\x1f]*math[\s\x1c-\x1f]*>",
    r"(?s)\$\$(.+?)\$\$", r"(?s)\\\[(.+?)\\\]", r"(?s)\\\((.+?)\\\)", r"(?<!\\)\$(?!\$)([^\n$]+?)(?<!\\)\$",
)


def strip_math(text: Column) -> Column:
    """Formula marks go, what they hold stays: tags, then $$, brackets, parentheses, single $."""
    for pattern in MATH_MARKS:
        text = F.regexp_replace(text, pattern, "$1")
    return text


def joined_lines(lines: Column, strip_formulas: bool = True) -> Column:
    """A recogniser's lines as one text, without formula marks if asked for."""
    whole = F.array_join(lines, "\n")
    return strip_math(whole) if strip_formulas else whole


# The control characters that a reason loses, and its line ends.
CONTROLS, LINE_ENDS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]", r"\r\n|[\n\r\x85\x{2028}\x{2029}]"


def failure_reason(reason: Column, limit: int = REASON_CHARS) -> Column:
    """Control characters go; of a trace only its last unindented line with a colon stays; a long one is cut."""
    clean = F.regexp_replace(reason, CONTROLS, "")
    lines = F.filter(F.split(clean, LINE_ENDS), lambda s: s.contains(":") & ~F.startswith(s, F.lit(" ")))
    pretty = F.coalesce(F.try_element_at(lines, F.lit(-1)), clean)
    return F.when(F.char_length(pretty) > limit, F.concat(F.substring(pretty, 1, limit - 1), F.lit("…"))).otherwise(pretty)


def cache_key(*parts: Column) -> Column:
    """The first sixteen hex digits of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 16)


def event_line(event: str = "event") -> Column:
    """A progress event as a log line (its words are fixed values)."""
    page = F.concat(F.lit("page "), F.col("page"), F.lit(" of "), F.col("of"), F.lit(" — "))
    text = lambda *parts: F.concat(page, *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    e = F.col(event)
    return (
        F.when(e == "summary", F.concat(F.lit("summary: "), F.col("of"), F.lit(" pages, "), F.coalesce("reason", F.lit("None"))))
        .when(e == "start", text("start", F.when(F.coalesce("branch", F.lit("")) != "", F.concat(F.lit(" ["), F.col("branch"), F.lit("]"))).otherwise("")))
        .when(e == "complete", text("complete (", F.coalesce("branch", F.lit("None")), ")"))
        .when(e == "failure", text("FAILED: ", F.coalesce("reason", F.lit("None"))))
        .when(e == "layout", text("layout (ml)"))
        .when(e == "region", text("region ", F.col("region").cast("string"), "/", F.col("of_regions").cast("string"), " (", F.col("role"), ")"))
        .otherwise(text(e))
    )
