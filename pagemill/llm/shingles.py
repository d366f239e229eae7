"""Vectorised word-shingle sets over Arrow string buffers.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``, with A-Z
lower-cased; UTF-8 continuation bytes are never white space, so the byte view
and the code-point view cut the same words.  A document's set holds the
distinct hashes of its five-word shingles; a text of one to four words is one
shingle, an empty or null text has the empty set.

Hashes have 48 bits.  They are compared between two documents at a time, never
as a global key of identity, so a wrong link needs a collision between two
given documents (about n*m / 2**48).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
HASH_BITS = 48
MASK = np.uint64((1 << HASH_BITS) - 1)
MAX_DOCS = 2048
MAX_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
#: As _BYTE, but upper and lower case differ.
CASED = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C13)
_PLACE = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def blocks(offsets: np.ndarray, max_bytes: int = MAX_BYTES, max_docs: int = MAX_DOCS) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of about max_bytes; a longer document is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(i + max_docs, max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1), n)
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray, kinds: np.ndarray | None = None, values: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the document it stands in).

    With kinds, a table of the kind of each byte, 0 for white space, a word
    also ends where the kind changes; values are what bytes add to a hash.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if kinds is None:
        space = _SPACE[raw]
        start = ~space
        start[1:] &= space[:-1]
    else:
        kind = kinds[raw]
        space = kind == 0
        start = ~space
        start[1:] &= kind[1:] != kind[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = ~space[first]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # offset of each byte in its word; white space before a word's successor adds nothing
    place = np.arange(len(raw), dtype=np.int32)
    place[at[0] :] -= np.repeat(at, np.diff(np.append(at, len(raw)))).astype(np.int32)
    place[: at[0]] = 0
    place[space] = 0
    powers = np.full(int(place.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    value = values[raw]
    value *= powers[place]
    value[space] = 0
    return mix(np.add.reduceat(value, at)), np.searchsorted(offsets, at, "right") - 1


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hash of each shingle with repeats, its document), documents in order."""
    h, doc = words(raw, offsets)
    if not len(h):
        return h, doc
    n = np.bincount(doc, minlength=len(offsets) - 1)
    whole = 0
    m = len(h) - width + 1
    if m > 0:
        whole = h[:m] * _PLACE[0]
        for k in range(1, width):
            whole += h[k : k + m] * _PLACE[k]
        full = doc[:m] == doc[width - 1 :]
        whole, owner = mix(whole[full]) & MASK, doc[:m][full]
    else:
        whole, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(n)])[:-1]
        one = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            here = n[short] > k
            one[here] += h[begin[short[here]] + k] * _PLACE[k]
        one = mix(one + n[short].astype(np.uint64)) & MASK
        whole, owner = np.concatenate([whole, one]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        whole, owner = whole[order], owner[order]
    return whole, owner


def ordered_sets(raw: np.ndarray, offsets: np.ndarray, level: np.ndarray | None = None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of at most MAX_DOCS documents: (hash, rank level, set sizes).

    Within a document they stand by (level, hash); level is looked up by the
    hash's low bits in a table whose length is a power of two.
    """
    h, doc = shingles(raw, offsets, width)
    key = h | (doc.astype(np.uint64) << np.uint64(HASH_BITS + 5))
    if level is not None:
        key |= level[(h & np.uint64(len(level) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    doc = (key >> np.uint64(HASH_BITS + 5)).astype(np.int64)
    return key & MASK, ((key >> np.uint64(HASH_BITS)) & np.uint64(31)).astype(np.uint8), np.bincount(doc, minlength=len(offsets) - 1)
