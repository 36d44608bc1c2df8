"""Rows for the tests: ordinary ones with copies, and rows at the edges."""

from __future__ import annotations

import random

#: Names that operators use inside; they must not disturb them as extra columns.
CLASHING = ["_id", "key", "pos", "bucket", "hash", "src", "node", "count", "n", "size", "words", "held_out", "lang_pred", "kept", "score", "family", "host", "page", "low", "found", "items"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def ordinary(seed: int = 3, n: int = 60) -> list[tuple]:
    """Documents of which some copy others, whole, nearly or in passages."""
    rng = random.Random(seed)
    rows: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        text = sentence(rng, rng.choice([1, 3, 12, 40, 90]))
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.35:
            words = rng.choice(rows)[1].split(" ")
            words[rng.randrange(len(words))] = "zz"
            text = " ".join(words)
        elif rows and kind < 0.6:
            words = rng.choice(rows)[1].split(" ")
            at = rng.randrange(len(words))
            text = f"{sentence(rng, 5)} {' '.join(words[at : at + 40])}\n{sentence(rng, 4)}"
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
    return rows


def at_the_edges() -> list[tuple]:
    rng = random.Random(9)
    long = sentence(rng, 30_000)
    return [
        (None, "a null id with some words to it", "en", "a", 1),
        (1, None, "en", "a", 0),
        (2, "", None, None, 0),
        (3, " \t\n\r\x0b\x0c ", "en", "a", 5),
        (4, long, "en", "b", len(long)),
        (5, "é" * 300 + " ß 你好 \U0001f600 \x85\xa0  x", "fr", "b", None),
        (6, "same same same same same same same same", "de", None, 1),
        (6, "same same same same same same same same", "de", None, 1),
        (7, "1234 5678 !!", None, "c", 3),
        (8, "A\x00b \x1c nul and separators", "en", "c", 3),
    ]
