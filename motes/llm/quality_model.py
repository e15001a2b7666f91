"""A quality classifier of Naive Bayes support vectors.

Features are n-gram indicators of a document, hashed to ``BUCKETS``: words and word pairs, shapes of words
(letter case, digits, what punctuation closes them) singly, in pairs and triples, and grams of how large a share of
the text each kind of token has. Each indicator is scaled by its log-count ratio between the classes,
counted over every labelled row that may be learnt from; a linear hinge-loss model is then fitted to the scaled indicators by
dual coordinate descent on a bounded sample (``SAMPLE`` rows), and its margin calibrated on rows that the fit left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import labelled, remainder, usable_labels
from .scratch import written
from .textops import LOWER, SPACE, RangeHash, Words, mix, row_sums, slices

BUCKETS = 1 << 17
#: Labelled rows of the fit at most, taken by the hash of their ids; a fifth of them calibrate.
SAMPLE = 8_000
COST, EPOCHS, SMOOTH = 0.1, 20, 1.0
ACCEPT = 0.7
PARTS, HELD_OUT = 4, 2
#: Shares at which a kind of token moves to the next gram.
EDGES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])

_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(256) if 97 <= b <= 122 or b >= 0x80]] = 1
_KIND[range(65, 91)] = 2
_KIND[range(48, 58)] = 3
for _c in '.,;:!?"()':
    _KIND[ord(_c)] = 4
_KIND[[b for b in range(33, 127) if not _KIND[b]]] = 5


def _shapes(words: Words) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A small code for the shape of each word, and flags of the kinds whose share is counted."""
    kind = _KIND[words.bytes]
    count = {k: np.concatenate([[0], np.cumsum(kind == k)]) for k in range(1, 6)}
    n = {k: c[words.end] - c[words.start] for k, c in count.items()}
    size = words.end - words.start
    last, first = words.bytes[words.end - 1].astype(np.int64), kind[words.start].astype(np.int64)
    before = words.bytes[np.maximum(words.end - 2, words.start)].astype(np.int64)
    closed = np.where(_KIND[last] >= 4, last, 0) * 2 + ((before == last) & (_KIND[last] >= 4))
    upper = (n[2] > 1) & (n[1] == 0)
    shape = closed * 64 + first * 8 + upper * 4 + np.minimum((n[3] > 0) + 2 * (n[5] > 0), 3)
    flags = {
        "upper": upper, "symbol": n[5] > 0, "digit": n[3] > 0, "bare": n[1] + n[2] + n[3] == 0, "doubled": closed % 2 == 1,
        "long": size > 20, "short": size <= 2, "stop": n[4] > 0,
    }
    return shape, flags


def features(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row bounds, buckets): the distinct indicators of each row of a slice."""
    words = Words(data.translate(LOWER), bounds, SPACE)
    raw = Words(data, bounds, SPACE)
    rows, n = words.row_of(), words.counts()
    hashes = words.hashes()
    shape, flags = _shapes(raw)
    again = np.zeros(len(rows), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    flags["again"] = again
    distinct = np.ones(len(rows), bool)
    distinct[np.unique(mix(hashes ^ mix(rows + 1)), return_index=True)[1]] = False
    flags["seen"] = distinct
    parts: list[tuple[np.ndarray, np.ndarray]] = [(rows, mix(hashes ^ np.uint64(1)))]
    spans = RangeHash(hashes)
    shapes = RangeHash(shape.astype(np.uint64) + np.uint64(1))
    at = np.arange(len(rows))
    for size, source, salt in ((2, spans, 2), (1, shapes, 3), (2, shapes, 4), (3, shapes, 5)):
        own = at[at + size <= words.first[1:][rows]] if len(rows) else at
        parts.append((rows[own], mix(source.of(own, own + size) + np.uint64(salt))))
    every = np.arange(len(n))
    total = np.maximum(n, 1)
    for k, flag in enumerate(flags.values()):
        share = np.searchsorted(EDGES, row_sums(flag, words.first) / total, side="right")
        share[row_sums(flag, words.first) == 0] = 0
        # every step up to the share's own, so that nearby shares have most grams in common
        for step in range(len(EDGES) + 1):
            there = every[share >= step]
            parts.append((there, np.full(len(there), mix(np.array([1_000_003 * (k + 1) + step]))[0], np.uint64)))
    length = np.minimum(np.log2(total + 1).astype(np.int64), 15)
    parts.append((every, mix(length + 77_000_000)))
    row = np.concatenate([p[0] for p in parts])
    code = (np.concatenate([p[1] for p in parts]) % np.uint64(BUCKETS)).astype(np.int64)
    both = np.unique(row * BUCKETS + code)
    return np.searchsorted(both, np.arange(len(n) + 1) * BUCKETS), both % BUCKETS


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        y = batch.column(2).to_numpy()
        for at, end, data, bounds in slices(batch):
            first, found = features(data, bounds)
            own = np.repeat(y[at:end], np.diff(first))
            for c in (0, 1):
                counts[c] += np.bincount(found[own == c], minlength=BUCKETS)
                rows[c] += int((y[at:end] == c).sum())
    some = np.flatnonzero(counts.sum(0))
    if rows.sum():
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(counts[0, some], rows[0])), pa.array(np.append(counts[1, some], rows[1]))], ["bucket", "bad", "good"])


def _indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column(2)
        for at, end, data, bounds in slices(batch):
            first, found = features(data, bounds)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found.astype(np.int32)))
            yield pa.record_batch([batch.column(0).slice(at, end - at), y.slice(at, end - at), lists], ["doc_id", "y", "found"])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (bias last) of the hinge loss over scaled indicators, one dual variable a row in turn."""
    rng = np.random.default_rng(0)
    w = np.zeros(len(scale) + 1)
    alpha = np.zeros(len(rows))
    sign = np.where(y > 0, 1.0, -1.0)
    values = [np.append(scale[r], 1.0) for r in rows]
    places = [np.append(r, len(scale)) for r in rows]
    square = np.array([v @ v for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[places[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[places[i]] += (new - alpha[i]) * sign[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-5:
            break
    return w


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a * margin + b))), by Newton steps with a little ridge."""
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], 1)
    # targets drawn in from 0 and 1 as the counts allow
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta -= np.clip(step, -5, 5)
    return float(max(theta[0], 0.0)), float(theta[1])


class Model:
    """Folded weights: a document's margin is ``bias`` plus the sum of ``weight`` over its indicators."""

    def __init__(self, weight: np.ndarray, bias: float, a: float, b: float):
        self.weight, self.bias, self.a, self.b = weight, bias, a, b

    def margins(self, first: np.ndarray, found: np.ndarray) -> np.ndarray:
        # summed row by row: the same text has the same sum wherever it stands
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        return self.bias + np.bincount(row, self.weight[found], len(first) - 1)

    def scores(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from documents and (doc_id, y) labels; without both classes it scores all alike."""
    labels = written(labels, "labels")
    own = labelled(docs, labels)
    counted = own.mapInArrow(_class_counts, "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad"), F.sum("good"))
    counts, rows = np.zeros((2, BUCKETS)), np.zeros(2)
    for bucket, bad, good in counted.collect():  # at most BUCKETS + 1 rows
        if bucket < 0:
            rows[:] = bad, good
        else:
            counts[:, bucket] = bad, good
    if not rows.all():
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log((rows[1] + 1) / (rows[0] + 1))))
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[counts.sum(0) == 0] = 0.0
    picked = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows_of = labelled(docs, picked).dropDuplicates(["doc_id"]).mapInArrow(_indicators, "doc_id long, y int, found array<int>").toArrow()
    order = np.argsort(rows_of.column("doc_id").to_numpy())
    y = rows_of.column("y").to_numpy()[order]
    lists = rows_of.column("found").combine_chunks()
    found = [lists[int(k)].values.to_numpy() for k in order]
    fold = np.arange(len(found)) % 5
    share = np.where(y > 0, (y == 0).mean(), (y > 0).mean()) * 2
    norm = np.array([1 / max(np.sqrt((ratio[f] ** 2).sum()), 1e-9) for f in found])
    train, held = np.flatnonzero(fold), np.flatnonzero(fold == 0)
    if len(set(y[train])) < 2 or len(set(y[held])) < 2:
        train = held = np.arange(len(found))
    w = dual_coordinate_descent([found[k] for k in train], y[train], ratio, COST * share[train] * norm[train].mean())
    model = Model(w[:-1] * ratio, float(w[-1]), 1.0, 0.0)
    margin = np.array([model.bias + model.weight[found[k]].sum() for k in held])
    model.a, model.b = calibrate(margin, y[held])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: the probability of good quality. Null and empty texts have the same score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, end, data, bounds in slices(batch):
                out[at:end] = own.scores(own.margins(*features(data, bounds)))
            yield pa.record_batch([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Learns only from labels whose ids are not held out. Repeated rows score alike; empty tables of
    documents give no rows, of labels one score for all.
    """
    model = fit(docs, usable_labels(labels, "quality", PARTS, HELD_OUT))
    out = scored(docs, model)
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), PARTS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    model = fit(docs, usable_labels(labels, "quality", PARTS, HELD_OUT))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, place = docs.columns, docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            text = pa.record_batch([batch.column(place)], ["text"])
            kept = np.zeros(batch.num_rows, bool)
            for at, end, data, bounds in slices(text):
                kept[at:end] = own.scores(own.margins(*features(data, bounds))) >= ACCEPT
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema).select(names)
