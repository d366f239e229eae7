"""Personal data: base patterns, plus spans that boosted trees choose among overlapping candidates.

Base spans are the leftmost non-overlapping matches of each kind's pattern;
one that fails its check (octets, Luhn, number of digits) is dropped without a
second try, so a card next to another number is lost to them.  High-recall
generators propose narrower, unprefixed or spelled-out forms, which may overlap
each other and the base spans.  Trees score each by format and context, and a
calibrated threshold per kind decides.  Chosen spans stay clear of the base
spans of their kind and of each other (higher score first, then start).

The trees learn from TRAINING_CANDIDATES invented candidates a kind, built
from a seed; no row of the corpus is used.  Offsets count code points, end
exclusive.  Null or empty text has no span; rows repeat as given; an empty
table gives no rows; other columns are left alone by `redact` and dropped by
`pii_spans`.  Texts are searched whole; the work grows with a text's length
(candidates look at most a few hundred characters around them), so a text of
many MB takes seconds.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees, unseen

KINDS = ("email", "ip", "card", "phone")
TRAINING_CANDIDATES = 1500
#: Candidates of a text that are scored at a time.
SCORED = 20_000
SEED = 9

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a match never begins inside a run of digits; saying so keeps long runs from being tried digit by digit
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY = re.compile(r"[0-9@]|[\[(]at[\])]|\bdot\b")
_SPELLED = re.compile(r"@|[\[(]at[\])]|\bdot\b")

# E-mail candidates go from each sign outwards, as far as an address may reach (RFC 5321: 64 and 255 characters).
_AT = re.compile(r"[ ]?(?:@|\[at\]|\(at\)|\bat\b)[ ]?")
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:[ ]?(?:\.|\[dot\]|\(dot\)|\bdot\b)[ ]?[A-Za-z0-9-]+)+")
LOCAL_CHARS, DOMAIN_CHARS = 64, 255

# High-recall generators of the other kinds; none looks further than a few dozen characters.
_PROPOSE = {
    "ip": [re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"), re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")],
    "card": [re.compile(r"(?<![0-9])[0-9]{16,19}(?![0-9])"), re.compile(r"(?=((?<![0-9])[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}(?![0-9])))"), re.compile(r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])")],
    "phone": [re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"), re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"), re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")],
}
_CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "carte", "tarjeta", "karte"), "phone": ("phone", "tel", "call", "mobile", "fax")}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ is tried by itself: the local part is the run before it, not before the last match's end."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else [],
    }


def _spelled_emails(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _AT.finditer(text):
        start = m.start()
        least = max(0, start - LOCAL_CHARS)
        while start > least and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start == m.start() or (start == least > 0 and text[start - 1] in _LOCAL_CHARS):
            continue
        until = m.end() + DOMAIN_CHARS
        near = text[m.end() : until]
        if ("." in near or "dot" in near) and (d := _SPELLED_DOMAIN.match(text, m.end(), until)):
            found.append((start, d.end()))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    found = {("email", *s) for s in _spelled_emails(text)} if _SPELLED.search(text) else set()
    for kind, patterns in _PROPOSE.items():
        for p in patterns:
            found.update((kind, *(m.span(1) if m.re.groups and m.end() == m.start() else m.span())) for m in p.finditer(text))
    return sorted(found)


class _Clear:
    """Spans that don't overlap, in order; whether another one is clear of them is a search by halves."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = list(spans)

    def of(self, start: int, end: int) -> int | None:
        """Where (start, end) may be put in, None if it overlaps."""
        k = bisect_left(self.spans, (end,))
        return k if k == 0 or self.spans[k - 1][1] <= start else None


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, d = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - 32) : start], text[end : end + 1]
    parts = [int(p) for p in re.split(r"[.:]", s) if p.isascii() and p.isdigit() and len(p) < 5]
    seps = [c for c in s if c in " -.()"]
    return [
        KINDS.index(kind), len(s), len(d), len(seps), len(set(seps)), len(d) / len(s), s.count("."), s.count(":"), float("@" in s), float("[" in s or "(at)" in s or "(dot)" in s),
        float(bool(re.search(r"\bdot\b", s))), float(s.startswith("+")), float(len(d) >= 12 and luhn(d)), max(parts, default=0), len(parts), float(len(set(d)) if d else 0), float(d[:1] in "3456" if d else 0),
        float(any(c in before.lower() for c in _CUES[kind])), float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in "./:=_-#$" and before != ""), float(s[:1].isdigit()), float(bool(re.search(r"\.[A-Za-z]{2,}$|dot\b ?[A-Za-z]{2,}$", s))),
    ]


def _invented(rng: np.random.Generator, kind: str, real: bool) -> tuple[str, str]:
    """A text before and a candidate of the kind, personal data or something that only looks like it."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstuv"), rng.integers(3, 9)))
    cue = rng.choice(_CUES[kind]) + " " if rng.random() < 0.4 else word() + " "
    if kind == "email":
        if real:
            at, dot = [("@", "."), (" @ ", "."), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot ")][rng.integers(7)]
            name = [f"{word()}.{n(2)}", word(), f"{word()}_{word()}"][rng.integers(3)]
            return cue, f"{name}{at}{word()}{dot}{rng.choice([word() + dot, ''], p=[0.3, 0.7])}{rng.choice(['com', 'org', 'example', 'net', 'de', 'uk'])}"
        return word() + " ", [f"{word()} at {word()}.{word().capitalize()}", f"{word()} at {n(1)}.{n(2)}", f"{word()} at {word()} . {word()}"][rng.integers(3)]
    if kind == "ip":
        if real:
            if rng.random() < 0.3:
                return cue, ":".join(f"{x:x}" for x in rng.integers(0, 65536, 8))
            return cue, ".".join(map(str, rng.integers(0, 256, 4)))
        v = rng.integers(0, 1000, 4)
        v[rng.integers(4)] = rng.integers(256, 1000)
        return word() + " ", ".".join(map(str, v))
    if kind == "card":
        d = str(rng.integers(3, 7)) + n(14)
        d += next(str(c) for c in range(10) if luhn(d + str(c)) == real)
        sep = rng.choice(["", "", " ", "-"])
        return cue if real or rng.random() < 0.3 else word() + " ", sep.join(d[k : k + 4] for k in range(0, 16, 4))
    if real:
        a, b, c = n(3), n(3), n(4)
        return cue, [f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}"][rng.integers(4)]
    return word() + " ", [f"{n(3)}.{n(3)}.{n(4)}", f"+{n(3)}{n(4)}", f"+{n(1)}.{n(2)}.{n(2)}.{n(2)}", f"{n(3)} {n(3)} {n(4)}"][rng.integers(4)]


@lru_cache(maxsize=1)
def trained(precision: float = 0.99) -> tuple[BoostedTrees, dict[str, float]]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    rows, labels = [], []
    for kind in KINDS:
        for i in range(TRAINING_CANDIDATES):
            real = bool(rng.random() < 0.5)
            before, s = _invented(rng, kind, real)
            text = f"{before}{s} and"
            rows.append(features(text, kind, len(before), len(before) + len(s)))
            labels.append(real)
    order = rng.permutation(len(rows))
    x, y = np.array(rows)[order], np.array(labels)[order]
    model = BoostedTrees().fit(x, y)
    held = unseen(len(y))
    return model, {kind: model.threshold(x[held & (x[:, 0] == k)], y[held & (x[:, 0] == k)], precision) for k, kind in enumerate(KINDS)}


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, all spans), each by kind and sorted by start."""
    nothing = {k: [] for k in KINDS}
    if not text or not _ANY.search(text):
        return nothing, nothing
    base = base_spans(text)
    taken = {k: _Clear(v) for k, v in base.items()}
    fresh = [c for c in candidates(text) if taken[c[0]].of(c[1], c[2]) is not None]
    if not fresh:
        return base, base
    model, limits = trained()
    chosen = []
    for at in range(0, len(fresh), SCORED):
        part = fresh[at : at + SCORED]
        scores = model.score(np.array([features(text, *c) for c in part]))
        chosen += [(-p, *c) for p, c in zip(scores.tolist(), part, strict=True) if p >= limits[c[0]]]
    for _, kind, start, end in sorted(chosen):
        k = taken[kind].of(start, end)
        if k is not None:
            taken[kind].spans.insert(k, (start, end))
    return base, {k: v.spans for k, v in taken.items()}


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def redacted(text: str | None) -> str | None:
    """Each span, or run of overlapping spans, becomes the kind of its first one in brackets."""
    if not text:
        return text
    _, spans = find(text)
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, digest of the base spans, all spans, their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                base, every = find(text.as_py())
                rows.append([doc_id.as_py(), *(len(base[k]) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), sum(map(len, every.values()))])
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, _SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind; n_chars, where present, follows the new text."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [redacted(t.as_py()) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array([len(t) if t is not None else None for t in new]).cast(batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pii_spans(table(spark, sf_dir, "documents"))
