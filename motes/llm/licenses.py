"""Fuzzy search for short license notices: exact seeds by the pigeonhole principle, then bounded-error
matching by the ``regex`` library.

A notice that occurs with at most k edits, cut into k + 1 pieces, holds at least one piece unchanged. So
exact finds of the pieces in the normalised text (A-Z lower-cased, each run of other characters one
space) meet every candidate, and only the whole words that a match around them may reach go to the fuzzy
pattern, which reports the edits and the span. An edit is of a character, of up to four bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import LOWER, NOT_ALNUM, Words, byte_hash, slices

#: Fixed values of the base labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Notice(NamedTuple):
    label: str
    text: str
    edits: int


NOTICES = (
    Notice("gpl", "gnu general public license", 3),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("apache", "apache license", 1),
    Notice("apache-2.0", "apache license version 2 0", 3),
    Notice("mit", "mit license", 1),
    Notice("mit", "permission is hereby granted free of charge to any person", 5),
    Notice("bsd", "bsd license", 1),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl", "mozilla public license", 2),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by-sa", "licensed under cc by sa", 1),
    Notice("cc", "creative commons attribution", 3),
    Notice("public-domain", "dedicated to the public domain", 3),
    Notice("proprietary", "all rights reserved", 2),
)


def pieces(notice: Notice) -> list[tuple[int, bytes]]:
    """(place, piece): the notice cut into edits + 1 pieces of nearly equal length."""
    raw, n = notice.text.encode(), notice.edits + 1
    cuts = [len(raw) * k // n for k in range(n + 1)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


#: Searched with a space in front: the library inserts nothing at the place where a search begins, and that is no place of a word then.
_PATTERNS = {n: regex.compile(rf"(?<![^ ])(?=[^ ])(?:{regex.escape(n.text)}){{e<={n.edits}}}(?![^ ])", regex.ENHANCEMATCH) for n in NOTICES}
#: Bytes that a character of the normalised text has at most: what an edit may add to a match.
WIDEST = 4


def _finds(text: bytes, piece: bytes) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def window(text: bytes, at: int, notice: Notice, place: int) -> tuple[int, int]:
    """The whole words of a normalised text that a match of a notice may reach whose piece from ``place`` stands at ``at``."""
    slack = WIDEST * notice.edits
    a, b = max(0, at - place - slack), min(len(text), at + len(notice.text) - place + slack)
    b = text.find(b" ", b)
    return text.rfind(b" ", 0, a) + 1, len(text) if b < 0 else b


def matches(text: bytes, windows: dict[Notice, list[tuple[int, int]]]) -> list[tuple[str, int, int, int, float]]:
    """(label, first word, last word, edits, similarity) of each notice within its windows of a normalised text."""
    found = []
    for notice, spans in windows.items():
        for a, b in _merged(spans):
            part = " " + text[a:b].decode()
            before = text.count(b" ", 0, a) - 1
            for m in _PATTERNS[notice].finditer(part):
                start = before + part.count(" ", 0, m.start())
                errors = sum(m.fuzzy_counts)
                found.append((notice.label, start, start + m.group().count(" "), errors, 1 - errors / len(notice.text)))
    return sorted(set(found))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as few as can be; those that only a space parts are one."""
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SEEDS = [(n, place, piece) for n in NOTICES for place, piece in pieces(n)]


class _Slice:
    """Base places and fuzzy finds of a slice of texts."""

    def __init__(self, data: bytes, bounds: np.ndarray):
        words = Words(data.translate(LOWER), bounds, NOT_ALNUM)
        self.n_words = words.counts()
        rows = words.row_of()
        self.base: list[tuple[int, int, str]] = []
        raw = words.bytes.tobytes()
        hashes = words.hashes()
        for phrase, label in BASE.items():
            tokens = [t.encode() for t in phrase.split()]
            at = np.flatnonzero(hashes == _word_hash(tokens[0]))
            at = at[at + len(tokens) <= words.first[1:][rows[at]]]
            for k, token in enumerate(tokens):
                at = at[hashes[at + k] == _word_hash(token)]
                exact = [raw[words.start[i + k] : words.end[i + k]] == token for i in at]
                at = at[np.array(exact, bool)]
            self.base += [(int(rows[i]), int(i - words.first[rows[i]]), label) for i in at]
        keep = words.inside.copy()
        keep[1:] |= words.inside[:-1]
        flat = np.where(words.inside, words.bytes, 32).astype(np.uint8)[keep].tobytes()
        edges = np.concatenate([[0], np.cumsum(keep)])[bounds]
        found: dict[int, list[tuple[Notice, int, int]]] = {}
        for notice, place, piece in _SEEDS:
            for at in _finds(flat, piece):
                row = int(np.searchsorted(edges, at, side="right")) - 1
                if at + len(piece) <= edges[row + 1]:
                    found.setdefault(row, []).append((notice, at - int(edges[row]), place))
        self.fuzzy: dict[int, list] = {}
        for row, seeds in found.items():
            text = flat[edges[row] : edges[row + 1]].rstrip(b" ")
            cut = text[:1] == b" "
            text = text[cut:]
            windows: dict[Notice, list[tuple[int, int]]] = {}
            for notice, at, place in seeds:
                windows.setdefault(notice, []).append(window(text, at - cut, notice, place))
            if got := matches(text, windows):
                self.fuzzy[row] = got


def _word_hash(token: bytes) -> np.uint64:
    return byte_hash(np.frombuffer(token, np.uint8)).of(np.array([0]), np.array([len(token)]))[0]


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label:string,first_word:int,last_word:int,edits:int,similarity:double>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    match = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("edits", pa.int32()), ("similarity", pa.float64())]))
    for batch in batches:
        n = batch.num_rows
        n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        first: list = [None] * n
        last: list = [None] * n
        base_labels, labels = [""] * n, [""] * n
        matches: list[list] = [[] for _ in range(n)]
        for at, end, data, bounds in slices(batch):
            got = _Slice(data, bounds)
            n_words[at:end] = got.n_words
            base: dict[int, list[tuple[int, str]]] = {}
            for row, place, label in got.base:
                base.setdefault(row, []).append((place, label))
            for row in {*base, *got.fuzzy}:
                places, near = base.get(row, []), got.fuzzy.get(row, [])
                r = at + row
                own = {label for _, label in places}
                n_base[r] = len(places)
                if places:
                    first[r], last[r] = min(places)[0], max(places)[0]
                base_labels[r] = ",".join(sorted(own))
                labels[r] = ",".join(sorted(own | {m[0] for m in near}))
                score[r] = 1.0 if places else max(m[4] for m in near)
                matches[r] = [dict(zip(("label", "first_word", "last_word", "edits", "similarity"), m, strict=True)) for m in near]
        cols = [batch.column(0), n_words, n_base, pa.array(first, pa.int64()), pa.array(last, pa.int64()), base_labels, labels, score, pa.array(matches, match)]
        yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: base places, labels, score and every fuzzy match with its span and edits.

    Null and empty texts have no words and no labels; a repeated row is scanned as a row; a null doc_id is kept; an
    empty table gives an empty table; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCHEMA)
