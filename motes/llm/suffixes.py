"""Exact removal of repeated 200-byte strings by interval expansion on Burrows-Wheeler transforms.

Windows of 200 bytes are met as runs with one anchor (``anchors``). Runs with the same content, told by a
128-bit digest of their bytes, are repeated throughout. What is left, the places where a repeat begins or ends, is
settled in buckets: a window around an anchor reaches at least 84 bytes to its left or to its right, so two contents
that share a window share the anchor with its left or its right neighbourhood, and are dealt by either.

A task packs buckets into blocks of bounded size. Of a block's suffix order it derives the common prefixes
by a breadth-first search over the transform: intervals of suffixes that start with the same string are extended
backward by one byte at a time, so the boundary between two neighbours gets its common prefix length the
first time an interval ends there, in increasing order. The search stops at the minimum length: boundaries
still open by then lie between suffixes that share it, and such suffixes are repeats.

A bucket beyond the block size (a template that very many texts share) is dealt again by longer neighbourhoods,
which part its contents or, at 200 bytes, are the repeated string itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import runs
from .rows import row_key
from .scratch import written
from .textops import covered, mix, slices

LENGTH, GRAM = 200, 32
#: Bytes beside an anchor of which either its left or its right side has to hold half.
SPARE = LENGTH - GRAM
#: Bytes of a block, and of contents in a bucket at most that go to one; parts that a larger bucket's spare bytes are cut into.
BLOCK, BUCKET, PARTS = 1 << 17, 1 << 18, 4
#: Bytes of contents for each task that settles buckets.
TASK_BYTES = 1 << 21
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_RUNS = "anchor long, content binary, uid binary, start int, windows int, twice boolean, keys array<long>"


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """The hash of the ``GRAM`` = 32 bytes from each place, as four words of eight bytes."""
    n = len(raw) - 7
    if n < GRAM - 7:
        return np.zeros(0, np.uint64)
    words = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        size = (len(raw) - k) // 8
        words[k::8] = raw[k : k + 8 * size].view("<u8")[: len(words[k::8])]
    m = len(raw) - GRAM + 1
    total = words[:m] * _MULTIPLIERS[0]
    for k in (1, 2, 3):
        total += words[8 * k : 8 * k + m] * _MULTIPLIERS[k]
    return mix(total)


def context_key(data: bytes, place: int, left: int, right: int) -> int:
    """A hash of an anchor's gram with ``left`` and ``right`` bytes beside it; even for more left than right."""
    h = xxhash.xxh3_64_intdigest(data[place - left : place + GRAM + right], seed=left << 8 | right)
    return (h >> 1 << 1 | (left < right)) - (1 << 63)


def contexts(left: int, right: int, parts: int) -> list[tuple[int, int]]:
    """Longer neighbourhoods of which every window has just one that has (``left``, ``right``): the windows' places are cut into ranges."""
    places = SPARE - left - right + 1
    cuts = [places * k // parts for k in range(parts + 1)]
    return [(left + a, right + places - b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _keys_at(data: bytes, places: list[int], a: int, z: int, sides: list[tuple[int, int]]) -> dict[tuple[int, int, int], list[int]]:
    """(key, left, right) -> window starts before the contexts of the anchors at ``places`` that lie within [a, z)."""
    found: dict[tuple[int, int, int], list[int]] = {}
    for p in places:
        for left, right in sides:
            if p - left >= a and p + GRAM + right <= z:
                found.setdefault((context_key(data, p, left, right), left, right), []).append(p - left)
    return found


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the anchors of runs stand in a slice: twice and more counts as two."""
    for batch in batches:
        for _, _, data, bounds in slices(batch):
            found = runs(gram_hashes(np.frombuffer(data, np.uint8)), bounds, GRAM, LENGTH, places=True)
            anchor, number = np.unique(found.anchor, return_inverse=True)
            n = np.minimum(np.bincount(number, 1 + (found.low != found.high), len(anchor)), 2)
            yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int32))], ["anchor", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = contexts(0, 0, 2)
    for batch in batches:
        ids = batch.column(0)
        for at, end, data, bounds in slices(batch):
            grams = gram_hashes(np.frombuffer(data, np.uint8))
            found = runs(grams, bounds, GRAM, LENGTH, places=True)
            begin = bounds[found.row] + found.start
            twice = found.low != found.high
            contents, keys, sizes = [], [], []
            for k, (a, n, low, high) in enumerate(zip(begin.tolist(), found.windows.tolist(), found.low.tolist(), found.high.tolist(), strict=True)):
                z = a + n - 1 + LENGTH
                contents.append(hashlib.blake2b(data[a:z], digest_size=16).digest())
                before = len(keys)
                if low == high:
                    for left, right in sides:
                        if low - left >= a and low + GRAM + right <= z:
                            keys.append(context_key(data, low, left, right))
                else:
                    places = (low + np.flatnonzero(grams[low : high + 1] == found.anchor[k])).tolist()
                    keys += [key for key, _, _ in _keys_at(data, places, a, z, sides)]
                sizes.append(len(keys) - before)
            edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array(found.anchor.view(np.int64)), pa.array(contents, pa.binary()), ids.slice(at, end - at).take(pa.array(found.row)),
                    pa.array(found.start.astype(np.int32)), pa.array(found.windows.astype(np.int32)), pa.array(twice),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(keys, pa.int64())),
                ],
                ["anchor", "content", "uid", "start", "windows", "twice", "keys"],
            )


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` (integers from 0) in order of their first ``depth`` symbols or more, by doubling
    from as many symbols as one machine word holds."""
    n = len(text)
    bits = max(1, int(text.max() + 1).bit_length())
    size = max(1, min(n, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(size):
        key <<= bits
        key[: n - k] |= text[k:] + 1
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
    while size < depth and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - size] += rank[size:] + 1
        order = np.argsort(key)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        size *= 2
    return order


def long_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, open): ``open[i]`` if suffixes i - 1 and i share ``length`` symbols or more.

    ``text`` ends with a symbol that it holds nowhere else.
    """
    n = len(text)
    order = suffix_order(text, length + 1)
    last = text[order - 1]
    # the place of each suffix extended backward by the symbol before it
    back = np.empty(n, np.int64)
    back[np.argsort(last.astype(np.uint16) if last.max() < 1 << 16 else last, kind="stable")] = np.arange(n)
    undone = np.ones(n + 1, bool)
    undone[[0, n]] = False
    low, high = np.array([0]), np.array([n])
    first_symbol, mark = text[order], np.full(n, -1)
    step = 0
    while len(low) and step < length:
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
        # members of an interval with the same symbol before them lead to neighbouring places in the same order
        to = back[at]
        if len(to) * 16 < n:
            by = np.argsort(to)
            to, owner = to[by], owner[by]
        else:
            mark[to] = owner
            to = np.flatnonzero(mark >= 0)
            owner = mark[to]
            mark[to] = -1
        symbol = first_symbol[to]
        new = np.ones(len(to), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]) | (to[1:] != to[:-1] + 1)
        first = np.flatnonzero(new)
        low, high = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        # a boundary is given its prefix length, step, by the first interval that ends there
        fresh = undone[high]
        low, high = low[fresh], high[fresh]
        undone[high] = False
        step += 1
    return order, undone[:n]


def repeats(contents: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each content the window starts whose string also starts elsewhere in them. Every window of the
    corpus is in one content at most."""
    m = len(contents)
    sizes = np.array([len(c) for c in contents])
    text = np.ones(sizes.sum() + m, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(text), bool)
    inside[ends] = False
    raw = np.frombuffer(b"".join(contents), np.uint8)
    used = np.zeros(256, np.int64)
    used[raw] = 1
    text[inside] = (np.cumsum(used) + 1)[raw]  # the bytes in use from 2 on; 1 parts contents and 0 ends the block
    text[-1] = 0
    begin = ends - sizes
    owner = np.repeat(np.arange(m), sizes + 1)
    order, shared = long_prefixes(text, length)
    several = shared.copy()
    several[:-1] |= shared[1:]
    found = np.sort(order[several])
    found = found[found + length <= ends[owner[found]]]  # strings within one content
    cut = np.searchsorted(found, np.append(begin, len(text)))
    return [found[a:b] - begin[k] for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets, sorted by key, packed into blocks."""

    def block(rows: dict[tuple[int, bytes], bytes]) -> pa.RecordBatch:
        hit = [(k, f) for k, f in zip(rows, repeats(list(rows.values())), strict=True) if len(f)]
        return pa.record_batch(
            [pa.array([k[0] for k, _ in hit], pa.int64()), pa.array([k[1] for k, _ in hit], pa.binary()), pa.array([f.astype(np.int32) for _, f in hit], pa.list_(pa.int32()))],
            ["anchor", "content", "places"],
        )

    rows: dict[tuple[int, bytes], bytes] = {}
    size, last = 0, None
    for batch in batches:
        for key, anchor, content, data in zip(*(_column(batch, k).to_pylist() for k in ("key", "anchor", "content", "data")), strict=True):
            if key != last and size > BLOCK:
                yield block(rows)
                rows, size = {}, 0
            last = key
            if (anchor, content) not in rows:
                rows[anchor, content] = data
                size += len(data)
    if rows:
        yield block(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contents of a text's runs."""
    for batch in batches:
        texts, parts = _column(batch, "text"), _column(batch, "runs").to_pylist()
        for k, own in enumerate(parts):
            raw = texts[k].as_buffer().to_pybytes()
            yield pa.record_batch(
                [pa.array([r["anchor"] for r in own], pa.int64()), pa.array([r["content"] for r in own], pa.binary()), pa.array([r["single"] for r in own], pa.bool_()),
                 pa.array([r["deal"] for r in own], pa.list_(pa.struct([("key", pa.int64()), ("large", pa.bool_())]))),
                 pa.array([raw[r["start"] : r["start"] + r["windows"] - 1 + LENGTH] for r in own], pa.binary())],
                ["anchor", "content", "single", "deal", "data"],
            )


_LEVEL = "key long, string binary, wide int, narrow int, anchor long, content binary, single boolean, places array<int>, data binary"


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents under a context dealt by longer ones: a row for each, with the places it would start windows at; a context
    that is a whole window needs no bytes, and its 128-bit digest (``string``, else empty) tells windows of one key apart."""
    names = ["key", "string", "wide", "narrow", "anchor", "content", "single", "places", "data"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for key, left, right, anchor, content, single, data in zip(*(_column(batch, k).to_pylist() for k in names if k not in ("string", "places")), strict=True):
            there = np.flatnonzero(gram_hashes(np.frombuffer(data, np.uint8)).view(np.int64) == anchor).tolist()
            places = [p for (k, _, _), at in _keys_at(data, there, 0, len(data), [(left, right)]).items() if k == key for p in at]
            for (k, a, b), at in _keys_at(data, [p + left for p in places], 0, len(data), contexts(left, right, PARTS)).items():
                if a + b < SPARE:
                    level = [(b"", at, data)]
                else:
                    windows: dict[bytes, list[int]] = {}
                    for p in at:
                        windows.setdefault(hashlib.blake2b(data[p : p + LENGTH], digest_size=16).digest(), []).append(p)
                    level = [(string, same, None) for string, same in windows.items()]
                for string, same, rest in level:
                    for column, value in zip(out, (k, string, a, b, anchor, content, single, same, rest), strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)


def _dealt_longer(large: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(small, whole): contents of large buckets in buckets of longer contexts that fit a block, and those whose context is a whole window."""
    small, whole = [], []
    for _ in range(SPARE):
        level = written(large.mapInArrow(_longer, _LEVEL), "longer")
        size = level.groupBy("key", "string").agg(F.sum(F.size("places")).alias("n"), F.max("single").alias("single"), F.sum(F.length("data")).alias("bytes"))
        size = written(size.where("single and n > 1").select("key", "string", (F.col("bytes") > BUCKET).alias("large")), "sizes")
        kept = level.join(size, ["key", "string"])
        whole.append(kept.where(f"wide + narrow = {SPARE}").select("anchor", "content", "places"))
        open_ = kept.where(f"wide + narrow < {SPARE}")
        small.append(open_.where("not large").select("key", "anchor", "content", "data"))
        large = open_.where("large")
        if not size.where("large").head(1):
            break
    return small, whole


def marked_runs(docs: DataFrame) -> DataFrame:
    """(uid, marks): each text's runs with repeats (start, windows, places); null ``places`` means all their windows."""
    counts = docs.select("text").mapInArrow(_anchor_counts, "anchor long, n int")
    repeated = counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    shared = written(docs.mapInArrow(_runs, _RUNS).join(repeated, "anchor"), "runs")
    grouped = written(
        shared.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("uid", "start", "windows", "twice", "keys")).alias("run")), "contents"
    )
    # buckets that hold a content met once, and another content or an anchor met twice in it
    keyed = grouped.select("anchor", "content", F.expr(f"run.windows - 1 + {LENGTH}").alias("bytes"), (F.col("n") == 1).alias("single"), "run.twice", F.explode("run.keys").alias("key"))
    buckets = written(
        keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("single").alias("single"), F.max("twice").alias("twice"), F.sum("bytes").alias("bytes"))
        .where("single and (n > 1 or twice)").select("key", (F.col("bytes") > BUCKET).alias("large")), "buckets",
    )
    wanted = keyed.join(buckets, "key").groupBy("anchor", "content", "bytes", "single").agg(F.collect_set(F.struct("key", "large")).alias("open"))
    # an anchor whose contents fit one bucket is one: a content then isn't met under both of its sides
    total = wanted.groupBy("anchor").agg(F.sum("bytes").alias("total"))
    deal = F.when(F.col("total") <= BUCKET, F.array(F.struct(F.col("anchor").alias("key"), F.lit(False).alias("large")))).otherwise(F.col("open"))
    by_text = (
        grouped.join(wanted.join(total, "anchor").select("anchor", "content", "single", deal.alias("deal")), ["anchor", "content"])
        .groupBy("run.uid").agg(F.collect_list(F.struct("anchor", "content", "single", "run.start", "run.windows", "deal")).alias("runs"))
    )
    cut = docs.join(by_text, "uid").select(F.col("text").cast("binary").alias("text"), "runs").mapInArrow(
        _cut, "anchor long, content binary, single boolean, deal array<struct<key:long,large:boolean>>, data binary"
    )
    dealt = written(cut.withColumn("deal", F.explode("deal")).select("anchor", "content", "single", "deal.*", "data"), "dealt")
    (_, right), (left, _) = contexts(0, 0, 2)
    large = dealt.where("large").withColumns({"wide": F.expr(f"if(key % 2 = 0, {left}, 0)"), "narrow": F.expr(f"if(key % 2 = 0, 0, {right})")})
    small, whole = [dealt.where("not large").select("key", "anchor", "content", "data")], []
    if large.head(1):
        more, whole = _dealt_longer(large)
        small += more
    small = union(small)
    tasks = 1 + int(small.agg(F.sum(F.length("data"))).first()[0] or 0) // TASK_BYTES
    settled = small.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_settle, "anchor long, content binary, places array<int>")
    partly = union([settled, *whole]).groupBy("anchor", "content").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    judged = grouped.select("anchor", "content", "n").join(partly, ["anchor", "content"], "left").where("n > 1 or places is not null")
    met = shared.join(judged, ["anchor", "content"])
    marks = met.select("uid", F.struct("start", "windows", F.expr("if(n > 1, null, places)").alias("places")).alias("mark"))
    return written(marks.groupBy("uid").agg(F.collect_set("mark").alias("marks")), "marks")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists, and where each list's begin and the last one's end; null holds none."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _kept(texts_too: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _column(batch, "text")
        marks, own = _flat(_column(batch, "marks"))
        start, windows = (marks.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "windows"))
        whole = marks.field("places").is_null().to_numpy(zero_copy_only=False)
        places, at = _flat(marks.field("places"))
        places = places.to_numpy(zero_copy_only=False) + np.repeat(start, np.diff(at))
        sizes, gone, spans, sha, kept = [], [], [], [], []
        for k in range(batch.num_rows):
            raw = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
            removed, n, a, z = None, 0, own[k], own[k + 1]
            if a < z:
                some, parts = whole[a:z], places[at[a] : at[z]]
                begin = np.concatenate([start[a:z][some], parts])
                width = np.concatenate([windows[a:z][some] - 1 + LENGTH, np.full(len(parts), LENGTH)])
                removed = covered(len(raw), begin, width)
                n = int((removed & ~np.concatenate([[False], removed[:-1]])).sum())
            rest = np.frombuffer(raw, np.uint8)[~removed].tobytes() if n else raw
            sizes.append(len(raw)), gone.append(int(removed.sum()) if n else 0), spans.append(n), sha.append(hashlib.sha256(rest).hexdigest())
            if texts_too:
                kept.append(rest)
        cols = [_column(batch, "doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(sha, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.record_batch([*cols, *[pa.array(kept, pa.binary())] * texts_too], names + ["kept"] * texts_too)


def suffix_dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept (the bytes that stay) per row of ``docs``.

    A byte goes if a 200-byte string over it also starts anywhere else. Null texts are empty; rows that
    repeat, id and all, are other places, so texts of 200 bytes in them go; null ids are documents as any; an empty
    table gives an empty table; other columns are ignored. A text is never split: the longest bounds a task's memory.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", row_key("doc_id", "text"))
    joined = own.join(marked_runs(own.select("uid", "text")), "uid", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "marks")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return joined.mapInArrow(partial(_kept, texts), schema)
