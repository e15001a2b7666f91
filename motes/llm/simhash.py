"""SimHash near-duplicates: a segment-popcount embedding and a grid range join under Manhattan distance.

A fingerprint becomes the vector of the bit counts of its 32 two-bit segments. Two fingerprints that
differ in d bits have vectors at most d apart in Manhattan distance, so the range join over vectors
loses no link. The vector is kept as a thermometer code (a segment's count 0, 1, 2 as 00, 01, 11):
Manhattan distance is then the bit count of an exclusive or.

The grid: the segments are dealt to ``BANDS`` bands; at a distance of at most ``MAX_BITS`` at most that
many bands differ, so two linked vectors lie in the same unit cell of some choice of the other bands.
A cell of up to ``CELL_PAIRS`` fingerprints is joined pairwise and each pair verified. A denser cell emits
no pairs: members that differ in at most two bits share a fingerprint at one bit from both, so each
member is listed under itself and its 64 one-bit neighbours and linked to the smallest one listed there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .rows import own_name, row_key
from .scratch import written
from .textops import LOWER, slices

MAX_BITS = 2
SEED = 42
SHINGLE = 3
BANDS = 5
CELL_PAIRS = 48
_EVEN = 0x5555555555555555


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's word shingles (fewer words: one shingle; none: 0)."""
    words = text.translate(LOWER).split()
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 15):
        some = hashes[part : part + (1 << 15)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.empty(batch.num_rows, np.uint64)
        for at, end, data, bounds in slices(batch):
            for row in range(end - at):
                out[at + row] = fingerprint(data[bounds[row] : bounds[row + 1]])
        yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = next(_fingerprints(iter([batch])))
        yield pa.record_batch([batch.column(0), batch.column(1), prints.column(1)], ["own_uid", "id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row of ``docs`` (doc_id long, text string; null text: empty)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _code(fp: Column) -> Column:
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _band_masks() -> list[int]:
    """For each choice of bands that may stay equal, the bits of their segments as a signed long."""
    width = [[s for s in range(32) if s * BANDS // 32 == b] for b in range(BANDS)]
    masks = []
    for chosen in combinations(range(BANDS), BANDS - MAX_BITS):
        mask = sum(3 << (2 * s) for b in chosen for s in width[b])
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def near_links(prints: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints ``fp``: enough links to connect all that differ in <= 2 bits."""
    masks = _band_masks()
    cells = prints.select("fp", _code(F.col("fp")).alias("code")).select(
        "fp", "code", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell")
    )
    size = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(cells.join(size, ["grid", "cell"]), "cells")
    sparse, dense = shared.where(f"n <= {CELL_PAIRS}"), shared.where(f"n > {CELL_PAIRS}")
    a = sparse.select("grid", "cell", F.col("fp").alias("u"), F.col("code").alias("cu"))
    b = sparse.select("grid", "cell", F.col("fp").alias("v"), F.col("code").alias("cv"))
    pairs = (
        a.join(b, ["grid", "cell"])
        .where(F.bit_count(F.col("cu").bitwiseXOR(F.col("cv"))) <= MAX_BITS)
        .where("u > v")
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    )
    flips = [F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)]
    around = dense.select(
        "grid", "cell", "fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(x) for x in flips])).alias("near")
    )
    star = around.groupBy("grid", "cell", "near").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    starred = around.join(star, ["grid", "cell", "near"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return reduce(DataFrame.unionByName, [pairs.select("u", "v"), starred]).distinct()


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, root, head) of the distinct fingerprints of ``prints``: the class each is in, and the smallest ``head`` in the class."""
    distinct = prints.groupBy("fp").agg(F.min("head").alias("first"))
    roots = components(near_links(distinct))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("head"))
    return rooted.join(named, "root").select("fp", "root", "head")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: near-duplicate classes of whole texts.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows are rows of their own
    class; a null doc_id joins its class but never names it (a class of nulls alone is named null).
    An empty table gives an empty table.
    """
    prints = written(fingerprints(docs), "fingerprints")
    classes = _classes(prints.withColumn("head", F.col("doc_id")))
    return prints.join(classes, "fp").select("doc_id", "fp", F.col("head").alias("component_id"))


def near_duplicates_removed(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the smallest doc_id, null last. Of rows equal in id and text one stays."""
    uid, mine = row_key("doc_id", "text"), own_name(docs, "own_uid")
    own = docs.select(uid.alias("own_uid"), F.col("doc_id").cast("long").alias("id"), "text").dropDuplicates(["own_uid"])
    prints = written(own.mapInArrow(_keyed_fingerprints, "own_uid binary, id long, fp long"), "fingerprints")
    head = F.struct(F.col("id").isNull().alias("last"), "id", "own_uid")
    classes = _classes(prints.select("fp", head.alias("head")))
    kept = classes.select(F.col("head.own_uid").alias(mine)).distinct()
    return docs.withColumn(mine, uid).dropDuplicates([mine]).join(kept, mine, "left_semi").select(docs.columns)
