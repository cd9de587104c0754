"""Licence scans by ordered signature rules.

A text is reduced to its words (letters a to z after lower-casing A to Z, digits, and all
characters beyond ASCII) with single spaces between them. Each rule has a keyword that
must occur before its regex is tried. Of overlapping detections the one with the higher
priority stays, then the longer, then the earlier: a detection that lies within the
interval of one that stays is suppressed. Four base phrases are counted wherever their
words stand consecutively, whatever the rules find.

Nulls: a null text is the empty text, without words, labels or score; a null or repeated
``doc_id`` is handed through, row by row. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .license_rules import rules

#: Base phrases and their labels, fixed.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: How sure one detection of each priority makes the scan.
SURE = {1: 0.3, 2: 0.7, 3: 0.9, 4: 0.98}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Detection(NamedTuple):
    label: str
    priority: int
    start: int
    end: int


def words_of(text: str) -> bytes:
    """The words with a space before, between and after them."""
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_WORDS).split()) + b" "


@lru_cache(maxsize=1)
def _by_keyword() -> list[tuple[bytes, list[tuple[str, int, re.Pattern]]]]:
    out: dict[bytes, list] = {}
    for label, priority, keyword, regex in rules():
        compiled = re.compile(rb"(?<= )(?:" + regex.encode() + rb")(?= )")
        out.setdefault(keyword.encode(), []).append((label, priority, compiled))
    return list(out.items())


@lru_cache(maxsize=1)
def _base() -> list[tuple[str, re.Pattern]]:
    return [(label, re.compile(b"(?<= )" + phrase.encode() + b"(?= )")) for phrase, label in BASE.items()]


def suppress(found: list[Detection]) -> list[Detection]:
    """The detections that stay, in text order. A Fenwick tree over the starts tells how far those that
    stay reach from a start or before it, so n detections take n log n steps."""
    kept: list[Detection] = []
    starts = sorted({d.start for d in found})
    reach = [0] * (len(starts) + 1)
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        at = k = bisect_right(starts, d.start)
        furthest = 0
        while k:
            furthest = max(furthest, reach[k])
            k &= k - 1
        if furthest >= d.end:
            continue
        kept.append(d)
        while at <= len(starts):
            reach[at] = max(reach[at], d.end)
            at += at & -at
    return sorted(kept, key=lambda d: d.start)


def detect(words: bytes) -> list[Detection]:
    found: list[Detection] = []
    for keyword, own in _by_keyword():
        if keyword in words:
            for label, priority, regex in own:
                found += [Detection(label, priority, m.start(), m.end()) for m in regex.finditer(words)]
    return suppress(found) if len(found) > 1 else found


def _scan(text: str) -> tuple:
    words = words_of(text)
    base = {}
    for label, regex in _base():
        hits = [m.start() for m in regex.finditer(words)]
        if hits:
            base[label] = hits
    stay = detect(words)
    found = sorted(h for hits in base.values() for h in hits)
    index = [words.count(b" ", 0, at) - 1 for at in (found[0], found[-1])] if found else [None, None]
    doubt = 1.0
    for priority in sorted({d.label: d.priority for d in sorted(stay, key=lambda d: d.priority)}.values()):
        doubt *= 1 - SURE[priority]
    if base and not stay:
        doubt = 1 - SURE[2]
    spans = []
    if stay:
        blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
        first, end = (np.searchsorted(blanks, [getattr(d, c) for d in stay]).tolist() for c in ("start", "end"))
        spans = [(d.label, d.priority, a - 1, b - a + 1) for d, a, b in zip(stay, first, end)]
    n_words = words.count(b" ") - 1 if len(words) > 2 else 0
    labels = sorted(set(base) | {d.label for d in stay})
    return n_words, len(found), *index, ",".join(sorted(base)), ",".join(labels), round(1 - doubt, 6), spans


_SPAN = pa.struct([("label", pa.string()), ("priority", pa.int64()), ("word", pa.int64()), ("words", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections
    (label, priority, first word, number of words of each detection that stays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            out = [_scan(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*out)) if out else [()] * 8
            spans = [[dict(zip(("label", "priority", "word", "words"), s)) for s in own] for own in columns[7]]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types)), pa.array(spans, pa.list_(_SPAN))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return texts(docs).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "detections array<struct<label string, priority long, word long, words long>>",
    )
