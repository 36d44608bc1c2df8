"""A dictionary Kneser-Ney model over a few rows, from the definitions, by recursion over orders."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

from brute import WORD


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def discounts(counts: list[int]) -> tuple[float, float, float]:
    n = [sum(c == k for c in counts) for k in range(5)]
    if not n[1]:
        return 0.5, 0.5, 0.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] else 0.5 for k in (1, 2, 3))


def lm(docs: list[tuple[int, str | None]], order: int) -> dict[int, tuple]:
    tokens = {i: [*WORD.findall((t or "").encode().lower()), b""] for i, t in docs}
    train = [w for i, w in tokens.items() if crc(i) % 5 != 1]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)

    def grams(w: list[bytes]) -> list[tuple]:
        padded = [b""] * (order - 1) + w
        return [tuple(padded[k : k + order]) for k in range(len(w))]

    levels = [Counter(g for w in train for g in grams(w))]
    while len(next(iter(levels[-1]))) > 1:  # a shorter n-gram counts the different words before it
        levels.append(Counter(g[1:] for g in levels[-1]))
    less = [discounts(list(x.values())) for x in levels]
    followers = [defaultdict(list) for _ in levels]
    for found, by in zip(levels, followers, strict=True):
        for g, k in found.items():
            by[g[:-1]].append(k)
    cut = lambda k, d: d[min(k, 3) - 1] if k else 0.0
    sums = [{g: (sum(own), sum(cut(x, d) for x in own)) for g, own in by.items()} for by, d in zip(followers, less, strict=True)]

    def p(gram: tuple, at: int) -> float:
        if at == len(levels):
            return 1 / (v + 1)
        below = p(gram[1:], at + 1)
        if gram[:-1] not in sums[at]:
            return below
        total, left = sums[at][gram[:-1]]
        k = levels[at][gram]
        return max(k - cut(k, less[at]), 0) / total + left / total * below

    out = {}
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out[i] = (crc(i) % 5 == 1, len(w), sum(x in c for x in w), n, base, sum(math.log10(p(g, 0)) for g in grams(w)))
    return out
