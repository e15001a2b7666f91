"""Removal of long repeated passages over a compacted De Bruijn graph of words.

The graph's edges are the 13-word windows, joined where they overlap. It is bucketed by anchors
(``anchors``): a run of windows with one anchor is a piece of a path, compacted where it is read. An
anchor that only ever has one content is a nonbranching piece: every text that enters it walks all of it,
so it stays one row whatever its length, with the smallest document that walks it. Where an anchor has
several contents the path branches there, and only those pieces are opened into edges; a join on edges
gives each the smallest document that has it. Joined to the pieces by coordinate, neighbouring pieces
glue into the spans to remove, and each is verified against the text at its source coordinates.

A piece is named by 128 bits, its anchor and another hash of its bytes; an edge by a 128-bit hash of its bytes.
Shuffles carry these and coordinates, pre-aggregated where they count; texts move only in the joins by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import runs
from .scratch import written
from .textops import SPACE, RangeHash, Words, covered, slices

WINDOW, GRAM = 13, 6
#: An edge with more than one in so many of all rows is joined by broadcast; there are at most so many of them.
HOT_EDGES = 1000
_PIECES = "anchor long, content long, doc_id long, start int, windows int"


class Spaced:
    """The words of a slice with one space between: ``bytes(a, z)`` of words ``a`` to ``z`` (not included) of one row."""

    def __init__(self, words: Words):
        keep = words.inside.copy()
        keep[1:] |= words.inside[:-1]
        self.data = np.where(words.inside, words.bytes, 32).astype(np.uint8)[keep].tobytes()
        place = np.concatenate([[0], np.cumsum(keep)])
        self.start, self.end = place[words.start], place[words.end - 1] + 1

    def names(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """64-bit hashes of ranges of words."""
        data, name = self.data, xxhash.xxh3_64_intdigest
        bounds = zip(self.start[a].tolist(), self.end[z - 1].tolist(), strict=True)
        return np.fromiter((name(data[x:y]) for x, y in bounds), np.uint64, len(a)).view(np.int64)

    def digests(self, a: np.ndarray, z: np.ndarray) -> list[bytes]:
        """128-bit hashes of ranges of words."""
        data, name = self.data, xxhash.xxh3_128_digest
        return [name(data[x:y]) for x, y in zip(self.start[a].tolist(), self.end[z - 1].tolist(), strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, end, data, bounds in slices(batch):
            words = Words(data, bounds, SPACE)
            if len(words) < WINDOW:
                continue
            found = runs(RangeHash(words.hashes()).grams(GRAM), words.first, GRAM, WINDOW)
            begin = words.first[found.row] + found.start
            content = Spaced(words).names(begin, begin + found.windows - 1 + WINDOW)
            own = ids.slice(at, end - at).take(pa.array(found.row))
            yield pa.record_batch(
                [pa.array(found.anchor.view(np.int64)), pa.array(content), own, pa.array(found.start.astype(np.int32)), pa.array(found.windows.astype(np.int32))],
                ["anchor", "content", "doc_id", "start", "windows"],
            )


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the pieces that branch, each with its place in its piece."""
    for batch in batches:
        pieces = _column(batch, "pieces")
        for at, end, data, bounds in slices(batch):
            words = Words(data, bounds, SPACE)
            spaced = Spaced(words)
            part = pieces.slice(at, end - at)
            flat, sizes = part.flatten(), np.diff(part.offsets.to_numpy())
            row = np.repeat(np.arange(end - at), sizes)
            get = {k: flat.field(k).to_numpy() for k in ("anchor", "content", "start", "windows", "first_id")}
            begin = words.first[row] + get["start"]
            stop = begin + get["windows"] - 1 + WINDOW
            fits = stop <= words.first[row + 1]
            fits[fits] = spaced.names(begin[fits], stop[fits]) == get["content"][fits]
            n = get["windows"][fits]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            edge = np.repeat(begin[fits], n) + place
            cols = [spaced.digests(edge, edge + WINDOW), *(np.repeat(get[k][fits], n) for k in ("anchor", "content", "first_id")), place.astype(np.int32)]
            yield pa.record_batch([pa.array(cols[0], pa.binary()), *map(pa.array, cols[1:])], ["edge", "anchor", "content", "first_id", "place"])


def marked_pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, marks): each document's pieces to remove (start, windows, content, places); null ``places`` means all their windows."""
    pieces = docs.mapInArrow(_pieces, _PIECES)
    repeated = pieces.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    shared = written(pieces.join(repeated, "anchor"), "pieces")
    paths = written(
        shared.groupBy("anchor", "content").agg(F.min("doc_id").alias("first_id"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "start", "windows"))).alias("source")), "paths"
    )
    branching = paths.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    opened = paths.where("source.doc_id is not null").join(branching, "anchor")
    by_text = opened.groupBy(F.col("source.doc_id").alias("doc_id")).agg(
        F.collect_list(F.struct("anchor", "content", "source.start", "source.windows", "first_id")).alias("pieces")
    )
    edges = written(
        docs.join(by_text, "doc_id").select("text", "pieces").mapInArrow(_edges, "edge binary, anchor long, content long, first_id long, place int"), "edges"
    )
    met = edges.groupBy("edge").agg(F.min("first_id").alias("earliest"), F.max("first_id").alias("last"), F.count("*").alias("n"))
    earliest = written(met.where("earliest < last").select("edge", "earliest", (F.col("n") > 1 + edges.count() // HOT_EDGES).alias("hot")), "earliest")
    hot = F.broadcast(earliest.where("hot").select("edge", F.col("earliest").alias("known")))  # at most HOT_EDGES rows
    dealt = edges.join(hot, "edge", "left")
    later = dealt.where("known < first_id").select("anchor", "content", "place").unionByName(
        dealt.where("known is null").join(earliest.where("not hot"), "edge").where("earliest < first_id").select("anchor", "content", "place")
    )
    partly = later.groupBy("anchor", "content").agg(F.collect_set("place").alias("places"))
    firsts = paths.select("anchor", "content", "first_id").join(partly, ["anchor", "content"], "left")
    met = shared.join(firsts, ["anchor", "content"]).where("doc_id > first_id or (doc_id = first_id and places is not null)")
    marks = met.select("doc_id", F.struct("start", "windows", "content", F.expr("if(doc_id = first_id, places, null)").alias("places")).alias("mark"))
    return written(marks.groupBy("doc_id").agg(F.collect_list("mark").alias("marks")), "marks")


def _removed(words: Words, spaced: Spaced, row: int, marks: list[dict] | None) -> np.ndarray:
    """Which words of a row its marks cover; a mark whose content is not there (an id met twice) is passed by."""
    a, b = int(words.first[row]), int(words.first[row + 1])
    if not marks:
        return np.zeros(b - a, bool)
    start, n = np.array([m["start"] for m in marks]), np.array([m["windows"] for m in marks])
    content = np.array([m["content"] for m in marks])
    stop = start + n - 1 + WINDOW
    fits = stop <= b - a
    fits[fits] = spaced.names(a + start[fits], a + stop[fits]) == content[fits]
    whole = fits & np.array([m["places"] is None for m in marks])
    first = [start[whole], *(start[k] + np.array(marks[k]["places"]) for k in np.flatnonzero(fits & ~whole))]
    length = [n[whole] - 1 + WINDOW, *(np.full(len(marks[k]["places"]), WINDOW) for k in np.flatnonzero(fits & ~whole))]
    return covered(b - a, np.concatenate(first), np.concatenate(length))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = _column(batch, "marks")
        n_words, n_removed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        kept: list[bytes] = []
        for at, end, data, bounds in slices(batch):
            words = Words(data, bounds, SPACE)
            n_words[at:end] = words.counts()
            spaced = Spaced(words) if any(marks[at + r].is_valid for r in range(end - at)) else None
            for row in range(end - at):
                own = data[bounds[row] : bounds[row + 1]].split()
                if marks[at + row].is_valid:
                    gone = _removed(words, spaced, row, marks[at + row].as_py())
                    n_removed[at + row] = gone.sum()
                    own = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                kept.append(b" ".join(own))
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.record_batch(
            [_column(batch, "doc_id"), pa.array(n_words), pa.array(n_removed), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by a space) per row of ``docs``.

    A word goes if a window over it also starts in a document of smaller id. A null text has no words; a
    null id is smaller than none and has no smaller one, so such rows neither lose words nor cost others any; rows
    that repeat an id do not count against each other. An empty table gives an empty table; other columns are
    ignored. A text is never split: the longest bounds a task's memory.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(marked_pieces(own), "doc_id", "left").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from their texts (the words that stay, joined by a space) and
    n_chars made to fit; a text that keeps all its words stays as it is."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names, schema = docs.columns, docs.schema
    # the names of docs are not ours to choose: joined under numbers
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    marks = marked_pieces(own).select(F.col("doc_id").alias("marked_id"), "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(names))
            texts = batch.column(names.index("text")).to_pylist()
            chars = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for row in range(batch.num_rows):
                if found[row].is_valid and texts[row]:
                    data = texts[row].encode()
                    words = Words(data, np.array([0, len(data)]), SPACE)
                    gone = _removed(words, Spaced(words), 0, found[row].as_py())
                    if gone.any():
                        texts[row] = b" ".join(w for w, g in zip(data.split(), gone.tolist(), strict=True) if not g).decode()
                        if chars is not None:
                            chars[row] = len(texts[row])
            cols = list(batch.columns[: len(names)])
            cols[names.index("text")] = pa.array(texts, cols[names.index("text")].type)
            if chars is not None:
                cols[names.index("n_chars")] = pa.array(chars, cols[names.index("n_chars")].type)
            yield pa.record_batch(cols, names)

    joined = plain.join(marks, F.col(f"c{names.index('doc_id')}").cast("long") == F.col("marked_id"), "left").drop("marked_id")
    return joined.mapInArrow(cut, schema)


#: Fixed SQL of the contract: every window compared as text.
SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, doc_id, i, array_to_string(w[i : i + 12], ' ') as t from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
low as (select t, min(doc_id) as first_id from win group by t having min(doc_id) < max(doc_id)),
gone as (select r, p from (select distinct r, unnest(range(i, i + 13)) as p from win join low using (t) where doc_id > first_id)),
n as (select r, count(*) as n_removed, list(p) as ps from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
    sha256(case when n_removed is null then array_to_string(w, ' ') else coalesce((select string_agg(w[p], ' ' order by p)
        from (select unnest(range(1, len(w) + 1)) as p) where not list_contains(ps, p)), '') end) as kept_sha256
from d left join n using (r)
"""
