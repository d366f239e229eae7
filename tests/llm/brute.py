"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width=5):
    w = _WORD.findall((text or "").translate(_LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def jaccard_components(docs):
    """docs: (doc_id, text) rows; -> sorted (doc_id, n_shingles, component_id)."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = defaultdict(list)
    first = {}
    for k, s in enumerate(sets):
        if s and first.setdefault(s, k) != k:
            parent[find(k)] = find(first[s])
        else:
            for x in s:
                lists[x].append(k)
    shared = defaultdict(int)
    for own in lists.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(sets[k]), d if not sets[k] else least.get(find(k))) for k, (d, _) in enumerate(docs)), key=str)


def repeated_bytes(docs, length=100):
    """docs: (doc_id, text) in order of doc_id; -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), []
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            piece = raw[k : k + length]
            if piece in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(piece)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shared_out(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Parts of a budget for children (weight, capacity): by weight, none above its capacity, shortages to siblings."""
    parts, left = [0.0] * len(children), min(budget, sum(c for _, c in children))
    open_ = [k for k, (_, c) in enumerate(children) if c > 0]
    while open_ and left > 1e-9:
        weight = sum(children[k][0] for k in open_)
        share = {k: left * (children[k][0] / weight if weight > 0 else 1 / len(open_)) for k in open_}
        full = [k for k in open_ if share[k] >= children[k][1] - parts[k]]
        if not full:
            for k in open_:
                parts[k] += share[k]
            return parts
        for k in full:
            left -= children[k][1] - parts[k]
            parts[k] = children[k][1]
        open_ = [k for k in open_ if k not in set(full)]
    return parts


def budgets(leaves: dict[tuple[str, ...], int], budget: float, weights: dict[tuple[str, ...], float], epochs: int) -> dict[tuple[str, ...], float]:
    """The tokens that each leaf is to give."""
    out: dict[tuple[str, ...], float] = {}

    def down(node: tuple[str, ...], tokens: float, below: dict[tuple[str, ...], int]) -> None:
        depth = len(node)
        if node in below:
            out[node] = tokens
            return
        families: dict[tuple[str, ...], dict] = {}
        for leaf, n in below.items():
            families.setdefault(leaf[: depth + 1], {})[leaf] = n
        names = sorted(families)
        parts = shared_out(tokens, [(weights.get(x, 1.0), float(sum(families[x].values()) * epochs)) for x in names])
        for x, part in zip(names, parts, strict=True):
            down(x, part, families[x])

    if leaves:
        down((), budget, leaves)
    return out
