"""Plain re-statements of the contracts, over small lists of rows."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def block_dedup(docs: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple[int, int, str]]:
    words = {i: WORD.findall((t or "").encode()) for i, t in docs}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def suffix_dedup(docs: list[tuple[int, str | None]], least: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(docs):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - least + 1):
            piece = data[s : s + least]
            if piece in seen:
                gone[s : s + least] = b"\1" * least
            seen.add(piece)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(data), sum(gone), spans, sha(bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return out


def near(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    holders: dict[tuple, list[int]] = {}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in sorted(sets):
        common: dict[int, int] = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            holders[s].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = 10) -> dict[int, tuple[int, int, int, str, bool]]:
    def tokens(t: str | None) -> list[bytes]:
        return ALNUM.findall((t or "").encode().lower())

    windows: dict[tuple, set[str]] = {}
    for item, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in docs:
        w, gone, found = tokens(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    gone.update(range(k, k + n))
                    found |= windows[key]
        out[i] = (len(w), len(gone), len(found), sha(",".join(sorted(found)).encode()), bool(gone))
    return out
