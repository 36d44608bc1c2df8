"""License scans: exact notices, and short notices with a few errors in them.

A notice with at most k errors holds at least one of its k + 1 pieces unchanged
(pigeonhole). Exact searches for the pieces give places, and only there does the
regex library's bounded-error matching look for the whole notice.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracemill.llm.common import outer_id, slices, texts

#: Exact phrases and their labels.
PHRASES = {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}
#: Notices looked for with errors, and their labels.
NOTICES = {
    b"under the mit license": "mit",
    b"permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    b"permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    b"apache license version 2": "apache-2",
    b"licensed under the apache license": "apache-2",
    b"redistribution and use in source and binary forms": "bsd",
    b"under the bsd license": "bsd",
    b"gnu general public license version 3": "gpl-3",
    b"gnu general public license version 2": "gpl-2",
    b"gnu lesser general public license": "lgpl",
    b"gnu affero general public license": "agpl",
    b"gnu free documentation license": "gfdl",
    b"mozilla public license version 2": "mpl-2",
    b"eclipse public license version 2": "epl-2",
    b"eclipse public license version 1": "epl-1",
    b"common development and distribution license": "cddl",
    b"european union public licence": "eupl",
    b"boost software license version 1": "bsl-1",
    b"artistic license 2 0": "artistic-2",
    b"academic free license version 3": "afl-3",
    b"microsoft public license": "ms-pl",
    b"python software foundation license": "psf",
    b"open software license version 3": "osl-3",
    b"sil open font license": "ofl",
    b"open data commons open database license": "odbl",
    b"do what the fuck you want to public license": "wtfpl",
    b"this is free and unencumbered software released into the public domain": "unlicense",
    b"dedicated to the public domain": "public-domain",
    b"creative commons zero": "cc0",
    b"creative commons cc0": "cc0",
    b"licensed under cc by nc": "cc-by-nc",
    b"licensed under cc by sa": "cc-by-sa",
    b"licensed under cc by nd": "cc-by-nd",
    b"creative commons attribution sharealike": "cc-by-sa",
    b"creative commons attribution noncommercial": "cc-by-nc",
    b"creative commons attribution noderivatives": "cc-by-nd",
    b"creative commons attribution 4 0": "cc-by",
    b"server side public license": "sspl",
    b"business source license": "busl",
}
NOT_WORD = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
FOLD = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))


def folded_words(text: bytes) -> list[bytes]:
    return text.lower().translate(FOLD).split()  # bytes.lower changes A-Z alone


class Notice:
    def __init__(self, phrase: bytes, label: str, per_error: int = 10):
        self.phrase, self.label = phrase, label
        self.errors = max(1, len(phrase) // per_error)
        edges = [round(i * len(phrase) / (self.errors + 1)) for i in range(self.errors + 2)]
        self.pieces = [(a, phrase[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        self.pattern = regex.compile(rb"(?e)(?:\b" + regex.escape(phrase, special_only=True) + rb"\b){e<=" + str(self.errors).encode() + rb"}")

    def places(self, line: bytes) -> list[tuple[int, int, int]]:
        """(start, end, errors) of matches near exact pieces; windows that overlap are searched once."""
        spans = []
        for offset, piece in self.pieces:
            at = line.find(piece)
            while at >= 0:
                low = max(0, at - offset - self.errors - 1)
                spans.append((low, min(len(line), at - offset + len(self.phrase) + self.errors + 1)))
                at = line.find(piece, at + 1)
        found, end = [], -1
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            for m in self.pattern.finditer(line, a, b):
                if m.start() >= end:
                    found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                    end = m.end()
        return found


def apart(matches: list[tuple]) -> list[tuple]:
    """Matches (quality, start, end, ...) that overlap none of better quality; those taken stay in order of place."""
    taken: list[tuple[int, int]] = []
    out = []
    for m in sorted(matches):
        at = bisect(taken, (m[1], m[2]))
        if (not at or taken[at - 1][1] <= m[1]) and (at == len(taken) or m[2] <= taken[at][0]):
            taken.insert(at, (m[1], m[2]))
            out.append(m)
    return out


def scan_text(text: bytes, notices: list[Notice]) -> tuple:
    words = folded_words(text)
    line = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        padded, at = b" " + phrase + b" ", -1
        while (at := line.find(padded, at + 1)) >= 0:
            starts.append(at)
            labels.add(label)
    every = set(labels)
    matches = [(errors / len(x.phrase), a, b, errors, x.label) for x in notices for a, b, errors in x.places(line)]
    edges = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if starts or matches else np.empty(0, np.int64)
    word_at = lambda k: int(np.searchsorted(edges, k, "right")) - 1
    spans = []
    for _, a, b, errors, label in apart(matches):  # where notices overlap, the one with fewer errors holds
        spans.append((label, word_at(a), int(np.searchsorted(edges, b)), errors))
        every.add(label)
    score = max([float(bool(labels)), *(1.0 - x[0] for x in matches)])
    return len(words), len(starts), word_at(min(starts)) if starts else None, word_at(max(starts)) if starts else None, ",".join(sorted(labels)), ",".join(sorted(every)), score, spans


SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int64())])


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    notices = [Notice(p, label) for p, label in NOTICES.items()]
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(SPAN)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    for batch, found in slices(batches):
        rows = [scan_text(x, notices) for x in found]
        spans = [[dict(zip(("label", "first_word", "end_word", "errors"), s, strict=True)) for s in r[-1]] for r in rows]
        columns = [*zip(*(r[:-1] for r in rows), strict=True), spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["_id", *names])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact places, labels and spans of license notices of every document.

    spans lists (label, first word, word after the last, errors) of the notices
    found with errors; where matches overlap, the one with fewer errors is kept. A null or empty text
    has no words, no labels (empty strings), null first_word and last_word, score 0.
    Rows are independent, so repeated rows and ids give repeated results.
    """
    schema = "_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,errors:long>>"
    found = texts(docs, id_col, text_col).mapInArrow(scan_batches, schema)
    return found.select(outer_id().alias("doc_id"), *found.columns[1:])
