"""Plain Python versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def near_components(docs, size, part, whole):
    """doc_id -> (set size, smallest doc_id reachable); docs is a list of (doc_id, text) with distinct ids."""
    sets = {}
    for doc, text in docs:
        w = words(ascii_lower(text))
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for doc, s in sets.items():
        for shingle in s:
            holders[shingle].add(doc)
    for doc, s in sets.items():
        common = defaultdict(int)
        for shingle in s:
            for other in holders[shingle]:
                if other < doc:
                    common[other] += 1
        for other, c in common.items():
            if whole * c >= part * (len(s) + len(sets[other]) - c):
                a, b = root(doc), root(other)
                parent[max(a, b)] = min(a, b)
    return {doc: (len(s), root(doc)) for doc, s in sets.items()}


def mix_targets(sizes, weights, budget=1.5, repeats=2):
    """source -> words to take, by resharing round after round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, budget * sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        share = sum(weight[s] for s in order if s not in capped)
        over = [s for s in order if s not in capped and weight[s] * rest / share > repeats * sizes[s]]
        if not over:
            return {s: capped.get(s, weight[s] * rest / share if share else 0.0) for s in order}
        capped.update({s: float(repeats * sizes[s]) for s in over})


def crc(text):
    return zlib.crc32((text or "").encode())
