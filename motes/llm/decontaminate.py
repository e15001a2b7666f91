"""Benchmark decontamination as a prefix-filtered set join.

An item's window (13 words, or a shorter item whole) occurs in a document only if all of its word
shingles do. At containment 1 the necessary prefix of a window, its shingles ordered by rarity, is the
single rarest one: windows are joined to documents on that shingle alone. Position and length bounds
drop candidates that would start before or end after the document, and the words themselves verify the rest.

Rarity is counted over the whole corpus. The benchmark's shingles reach the documents as a broadcast set
while they are at most ``BROADCAST_SHINGLES``; beyond that the documents' shingles are shuffled to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import own_name, row_key
from .scratch import written
from .textops import LOWER, NOT_ALNUM, RangeHash, Words, mix, slices

WINDOW, SHINGLE = 13, 5
BROADCAST_SHINGLES = 2_000_000
HITS = "array<struct<shingle:long,pos:int,lead:int,context:array<string>>>"
_REACH = WINDOW - SHINGLE


def _shingles(words: Words, hashes: RangeHash, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each shingle of ``size`` words."""
    rows = words.row_of()
    at = np.arange(len(rows))
    at = at[at + size <= words.first[1:][rows]] if len(rows) else at
    return at, mix(hashes.of(at, at + size) + np.uint64(size)).view(np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {k: [] for k in ("item_id", "window", "size", "offset", "width", "shingle")}
        for at, end, data, bounds in slices(batch):
            words = Words(data.translate(LOWER), bounds, NOT_ALNUM)
            raw, hashes = words.bytes.tobytes(), RangeHash(words.hashes())
            by = {s: dict(zip(*(x.tolist() for x in _shingles(words, hashes, s)), strict=True)) for s in range(1, SHINGLE + 1)}
            for row in range(end - at):
                a, b = int(words.first[row]), int(words.first[row + 1])
                size = min(WINDOW, b - a)
                width = min(SHINGLE, size)
                for w in range(a, b - size + 1 if size else a):
                    text = " ".join(raw[words.start[k] : words.end[k]].decode() for k in range(w, w + size))
                    for k in range(size - width + 1):
                        for key, v in zip(out, (ids[at + row], text, size, k, width, by[width][w + k]), strict=True):
                            out[key].append(v)
        yield pa.record_batch([pa.array(v, pa.string() if k == "window" else pa.int64()) for k, v in out.items()], list(out))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """A row for each shingle of each window of each item."""
    schema = "item_id long, window string, size long, offset long, width long, shingle long"
    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_windows, schema)


def _hits_of(words: Words, raw: bytes, rows: np.ndarray, at: np.ndarray, shingle: np.ndarray) -> dict[int, list[dict]]:
    found: dict[int, list[dict]] = {}
    for i, s in zip(at.tolist(), shingle.tolist(), strict=True):
        row = int(rows[i])
        a, b = max(int(words.first[row]), i - _REACH), min(int(words.first[row + 1]), i + WINDOW)
        context = [raw[words.start[k] : words.end[k]].decode() for k in range(a, b)]
        found.setdefault(row, []).append({"shingle": s, "pos": i - int(words.first[row]), "lead": i - a, "context": context})
    return found


def _hit_schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, hits {HITS}"


def _broadcast_hits(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """doc_id, n_words and the hits of each row, looked up in a broadcast of the benchmark's shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("lead", pa.int32()), ("context", pa.list_(pa.string()))]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for at, end, data, bounds in slices(batch):
                words = Words(data.translate(LOWER), bounds, NOT_ALNUM)
                counts[at:end] = words.counts()
                hashes, rows, raw = RangeHash(words.hashes()), words.row_of(), None
                for size, known in shared.value.items():
                    first, values = _shingles(words, hashes, size)
                    place = np.searchsorted(known, values)
                    hit = known[np.minimum(place, len(known) - 1)] == values
                    if hit.any():
                        raw = raw or words.bytes.tobytes()
                        for row, found in _hits_of(words, raw, rows, first[hit], values[hit]).items():
                            hits[at + row] += found
            yield pa.record_batch([batch.column(0), pa.array(counts), pa.array(hits, kind)], ["doc_id", "n_words", "hits"])

    return docs.mapInArrow(look, _hit_schema(docs))


def _all_shingles(sizes: list[int]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.schema.get_field_index("key"))
            for at, _, data, bounds in slices(batch):
                words = Words(data.translate(LOWER), bounds, NOT_ALNUM)
                hashes, rows = RangeHash(words.hashes()), words.row_of()
                for size in sizes:
                    first, values = _shingles(words, hashes, size)
                    own = key.take(pa.array(rows[first] + at))
                    pos = first - words.first[rows[first]]
                    yield pa.record_batch([own, pa.array(values), pa.array(pos.astype(np.int32))], ["key", "shingle", "pos"])

    return each


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("lead", pa.int32()), ("context", pa.list_(pa.string()))]))
    for batch in batches:
        wanted = batch.column(batch.schema.get_field_index("found")).to_pylist()
        counts, hits = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
        for at, end, data, bounds in slices(batch):
            words = Words(data.translate(LOWER), bounds, NOT_ALNUM)
            counts[at:end] = words.counts()
            raw, rows = words.bytes.tobytes(), words.row_of()
            for row in range(end - at):
                if pairs := wanted[at + row]:
                    place = np.array([int(words.first[row]) + p["pos"] for p in pairs])
                    hits[at + row] = _hits_of(words, raw, rows, place, np.array([p["shingle"] for p in pairs]))[row]
        yield pa.record_batch([batch.column(0), pa.array(counts), pa.array(hits, kind)], ["doc_id", "n_words", "hits"])


def _shuffled_hits(docs: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """As ``_broadcast_hits`` for a benchmark of any size: shingles are shuffled and semi-joined, and the
    hits go back to their texts. Rows equal in doc_id and text share a key, and so their hits."""
    keyed = docs.withColumn("key", F.sha2(F.concat_ws("\x00", F.col("doc_id").cast("string"), "text"), 256))
    rows = keyed.select("key", "text").mapInArrow(_all_shingles(sizes), "key string, shingle long, pos int").join(wanted, "shingle", "left_semi")
    found = rows.distinct().groupBy("key").agg(F.collect_list(F.struct("shingle", "pos")).alias("found"))
    return keyed.join(found, "key", "left").select("doc_id", "text", "found").mapInArrow(_attach, _hit_schema(docs))


def contamination(docs: DataFrame, items: DataFrame, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256 and contaminated for every row of ``docs``.

    A null text has no words; an item without words has no window; an item whose id is null can be hit but
    is not listed; repeated rows are judged each for itself; empty tables give no rows or no hits.
    """
    return _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, broadcast_shingles)


def _judged(docs: DataFrame, items: DataFrame, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """As ``contamination`` for (doc_id, text) with ids of any type."""
    windows = written(benchmark_windows(items), "windows")
    wanted = windows.select("width", "shingle").distinct()
    n, sizes = wanted.count(), sorted(r[0] for r in wanted.select("width").distinct().collect())
    if n <= broadcast_shingles:
        table = wanted.toArrow()
        width, shingle = (table.column(k).to_numpy() for k in ("width", "shingle"))
        hits = _broadcast_hits(docs, {s: np.sort(shingle[width == s]) for s in sizes})
    else:
        hits = _shuffled_hits(docs, wanted.select("shingle"), sizes)
    judged = written(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    each = judged.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    rarity = each.groupBy("shingle").agg(F.count("*").alias("seen"))
    distinct = windows.select("window", "size", "offset", "shingle").distinct()
    # a window with a shingle that no document holds cannot occur: it stays without a prefix
    prefix = (
        distinct.join(rarity, "shingle", "left")
        .groupBy("window", "size")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "shingle", "offset")).alias("rarest"))
        .where("rarest.seen > 0")
        .select("window", "size", "rarest.shingle", "rarest.offset")
    )
    candidates = each.join(prefix, "shingle").where("lead >= offset and size(context) - lead + offset >= size")
    exact = candidates.where(F.expr("array_join(slice(context, cast(lead - offset + 1 as int), cast(size as int)), ' ') = window"))
    places = exact.select("row", (F.col("pos") - F.col("offset")).alias("start"), "size", "window")
    covered = """aggregate(array_sort(collect_set(named_struct('start', start, 'size', size))),
        named_struct('n', 0L, 'reach', 0L),
        (a, x) -> named_struct('n', a.n + greatest(0L, x.start + x.size - greatest(x.start, a.reach)), 'reach', greatest(a.reach, x.start + x.size)),
        a -> a.n)"""
    hit = places.groupBy("row").agg(F.expr(covered).alias("n_hit"))
    owners = windows.select("window", "item_id").where("item_id is not null").distinct()
    listed = places.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    none = F.array().cast("array<string>")
    return (
        judged.select("row", "doc_id", "n_words").join(hit, "row", "left").join(listed, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))
        .withColumns({
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ","), 256),
            "contaminated": F.expr("n_hit > 0 and 20 * n_hit >= n_words"),
        })
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    mine = own_name(docs, "own_uid")
    keyed = docs.withColumn(mine, row_key("doc_id", "text"))
    judged = _judged(keyed.select(F.col(mine).alias("doc_id"), "text"), items)
    bad = written(judged.where("contaminated").select(F.col("doc_id").alias(mine)).distinct(), "contaminated")
    small = bad.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    return keyed.join(F.broadcast(bad) if small else bad, mine, "left_anti").select(docs.columns)


#: Fixed SQL of the contract over the same tables: every window compared as text.
SQL = r"""
with d as (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as win
    from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select r, n, i, array_to_string(w[i : i + n - 1], ' ') as win
    from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select r, i, dw.n, item_id from dw join bw using (win)),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
    cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (r) left join items using (r)
"""
