"""Toxicity by a noisy channel: disguised words are decoded to what was meant, then the text is scored.

A character trigram model is counted over all documents. Words written with digits and signs for
letters, letter by letter with gaps, or with letters repeated become lattices: every written character
may stand for a few letters, a gap or a repetition may stand for nothing. Viterbi decoding finds the
likeliest path under the language model and the costs of the channel. Text and decoded words are scored
together by marked words and word beginnings, chosen by their association with the label.

Only distinct disguised words are decoded, once a worker, so the decoding cost follows their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import labelled, remainder, usable_labels
from .scratch import written
from .textops import LOWER, NOT_ALNUM, SPACE, RangeHash, Words, byte_table, mix, slices

PARTS, HELD_OUT = 5, 0
#: What written signs may stand for, besides themselves.
LEET = {"0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c"}
#: Costs in nats of a substituted sign, a dropped gap and a dropped repetition.
COST_SIGN, COST_GAP, COST_REPEAT = 1.0, 0.3, 0.7
#: Beginnings of words that count as features, in bytes; association (log-likelihood ratio) and log-odds that a mark
#: needs, and the share of the toxic rows that hold it (three rows at least). A toxic row holds some keys and no more,
#: so the share bounds the number of marks by that number over ``SUPPORT``, however many rows there are.
BEGINNINGS, ASSOCIATION, ODDS, SUPPORT = (4, 5, 6), 20.0, 2.5, 5e-4
#: Longest disguised span whose reading is remembered (a longer one is decoded each time, whole as well), and
#: readings of each of two generations that a worker remembers.
REMEMBERED_SPAN, REMEMBER = 40, 100_000
_GAPS = " .-_*~,/\\'"
_SIGN = byte_table("".join(LEET))
_LETTER = np.array([97 <= b <= 122 or b >= 0x80 for b in range(256)])


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in batches:
        for _, _, data, bounds in slices(batch):
            words = Words(data.translate(LOWER), bounds, NOT_ALNUM)
            # words side by side with one gap: each word as ^word$ over bytes
            b = np.where(words.inside, words.bytes, 32).astype(np.int64)
            code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            same = np.searchsorted(bounds, np.arange(len(code)), side="right") == np.searchsorted(bounds, np.arange(len(code)) + 2, side="right")
            found, n = np.unique(code[same], return_counts=True)
            for c, k in zip(found.tolist(), n.tolist(), strict=True):
                total[c] = total.get(c, 0) + k
    if total:
        yield pa.record_batch([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["code", "n"])


class Language:
    """log P(third byte | first two), interpolated with the shorter contexts' frequencies.

    ``codes`` (three bytes as one number, distinct) and their counts ``n``: at most 256^3, in UTF-8 texts far fewer.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.n = codes[order].astype(np.int32), n[order].astype(np.int64)
        self.two = np.bincount(self.codes >> 8, self.n, 1 << 16)
        self.pair = np.bincount(self.codes & 0xFFFF, self.n, 1 << 16)
        self.begin = self.pair.reshape(256, 256).sum(1)
        self.one = np.bincount(self.codes & 0xFF, self.n, 256) + 1
        self.total = float(self.one.sum())
        self.forget()

    def forget(self) -> None:
        """Empties what this worker remembers: logarithms, and readings in two generations."""
        self.known: dict[int, float] = {}
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "recent", "older")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def code_log(self, code: int) -> float:
        """The logarithm for three bytes as one number."""
        value = self.known.get(code)
        if value is None:
            at = int(np.searchsorted(self.codes, code))
            three = float(self.n[at]) if at < len(self.codes) and self.codes[at] == code else 0.0
            p1 = self.one[code & 0xFF] / self.total
            p2 = (self.pair[code & 0xFFFF] + 8 * p1) / (self.begin[(code >> 8) & 0xFF] + 8)
            value = math.log((three + 8 * p2) / (self.two[code >> 8] + 8))
            if len(self.known) >= 1 << 20:
                self.known.clear()
            self.known[code] = value
        return value

    def log(self, a: int, b: int, c: int) -> float:
        return self.code_log((a << 16) | (b << 8) | c)


_OPTIONS = [[(b if _LETTER[b] or 48 <= b <= 57 else 32, 0.0), *((ord(c), COST_SIGN) for c in LEET.get(chr(b), ""))] for b in range(256)]
_GAP = [chr(b) in _GAPS for b in range(256)]
#: Signs that may close a word and mean nothing.
_CLOSING = [chr(b) in LEET and not 48 <= b <= 57 for b in range(256)]


def lattice(span: bytes, gaps: bool = True) -> list[list[tuple[int, float]]]:
    """For each written byte what it may stand for (-1: nothing) and at what cost; without ``gaps`` every
    gap stands for nothing."""
    out, before, last = [], -1, len(span) - 1
    for k, b in enumerate(span):
        options = _OPTIONS[b]
        if _GAP[b]:
            options = [*options, (-1, COST_GAP)] if gaps else [(-1, COST_GAP)]
        elif before == b:
            options = [*options, (-1, COST_REPEAT)]
        elif k == last and k and _CLOSING[b]:
            options = [*options, (-1, COST_GAP)]
        out.append(options)
        before = b
    return out


def decode(span: bytes, model: Language, gaps: bool = True) -> bytes:
    """The likeliest reading of a disguised span: Viterbi over its lattice; a state is the last two bytes read, as one number."""
    # what is read is a chain (before, byte), so that a long span costs no copies
    known, log = model.known, model.code_log
    best: dict[int, tuple[float, tuple | None]] = {(32 << 8) | 32: (0.0, None)}
    for options in lattice(span, gaps):
        after: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, read) in best.items():
            for c, cost in options:
                if c < 0 or (c == 32 and state & 0xFF == 32):
                    new, value, text = state, score - cost, read
                else:
                    code = (state << 8) | c
                    gain = known.get(code)
                    new, value, text = code & 0xFFFF, score - cost + (log(code) if gain is None else gain), (read, c)
                old = after.get(new)
                if old is None or value > old[0]:
                    after[new] = (value, text)
        best = after
    return max((score + log((state << 8) | 32), _bytes(read)) for state, (score, read) in best.items())[1]


def _bytes(read: tuple | None) -> bytes:
    out = bytearray()
    while read is not None:
        read, c = read
        out.append(c)
    return bytes(out[::-1])


def disguised(words: Words) -> list[tuple[int, int, int]]:
    """(row, start, end) of byte spans that may hide words: signs beside a letter, letters written apart,
    or a letter twice in a row."""
    b = words.bytes
    if not len(words):
        return []
    letter = _LETTER[b]
    # both bytes of a pair are in one word; words of two rows may stand side by side
    joined = words.inside[1:] & words.inside[:-1]
    joined[words.start[words.start > 0] - 1] = False
    flag = np.zeros(len(b), bool)
    flag[1:] = joined & (_SIGN[b[1:]] & letter[:-1] | letter[1:] & (b[1:] == b[:-1]))
    flag[:-1] |= joined & _SIGN[b[:-1]] & letter[1:]
    count = np.concatenate([[0], np.cumsum(flag)])
    hit = np.flatnonzero(count[words.end] > count[words.start])
    rows = words.row_of()
    out = [(int(rows[k]), int(words.start[k]), int(words.end[k])) for k in hit]
    whole = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    single = whole[words.end] - whole[words.start] == 1
    # also letters parted by signs within one word: s-t-u-p-i-d
    parted = np.zeros(len(b), bool)
    parted[1:-1] = letter[:-2] & letter[2:] & np.isin(b[1:-1], [ord(c) for c in _GAPS if c not in " ,'"])
    parts = np.concatenate([[0], np.cumsum(parted)])
    out += [(int(rows[k]), int(words.start[k]), int(words.end[k])) for k in np.flatnonzero(parts[words.end] - parts[words.start] >= 2)]
    apart = np.where(single & (letter | _SIGN[b])[words.start], rows, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[-1], apart, [-1]])))
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        if apart[a] >= 0 and z - a >= 3:
            out.append((int(apart[a]), int(words.start[a]), int(words.end[z - 1])))
    return sorted(set(out))


def restored(span: bytes, model: Language) -> bytes:
    """The readings of a span of any length, remembered with the model: the likeliest and, if it has gaps, the likeliest as one word."""
    read = model.recent.get(span)
    if read is None:
        read = model.older.get(span)
        if read is None:
            read = decode(span, model)
            if any(_GAP[b] for b in span):
                read += b" " + decode(span, model, False)
        if len(span) <= REMEMBERED_SPAN:
            if len(model.recent) >= REMEMBER:
                model.older, model.recent = model.recent, {}
            model.recent[span] = read
    return read


def _keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of words and their beginnings."""
    rows, spans = words.row_of(), words.ranges
    keys, owners = [mix(spans.of(words.start, words.end) ^ np.uint64(1))], [rows]
    for n in BEGINNINGS:
        long = np.flatnonzero(words.end - words.start > n)
        keys.append(mix(spans.of(words.start[long], words.start[long] + n) ^ np.uint64(n)))
        owners.append(rows[long])
    return np.concatenate(owners), np.concatenate(keys)


def features(data: bytes, bounds: np.ndarray, model: Language) -> tuple[np.ndarray, np.ndarray]:
    """(row, key), distinct and sorted by row: of the text's own words and of the decoded ones."""
    low = data.translate(LOWER)
    row, key = _keys(Words(low, bounds, NOT_ALNUM))
    hidden = disguised(Words(low, bounds, SPACE))
    if hidden:
        texts: dict[int, list[bytes]] = {}
        for r, a, b in hidden:
            texts.setdefault(r, []).append(restored(low[a:b], model))
        joined = [b" ".join(texts.get(r, ())) for r in range(len(bounds) - 1)]
        more = Words(b"".join(joined), np.concatenate([[0], np.cumsum([len(t) for t in joined])]), NOT_ALNUM)
        row2, key2 = _keys(more)
        row, key = np.concatenate([row, row2]), np.concatenate([key, key2])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _class_counts(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(2).to_numpy()
            keys, labels = [], []
            for at, _, data, bounds in slices(batch):
                row, key = features(data, bounds, shared.value)
                keys.append(key)
                labels.append(y[at + row])
            if keys:
                found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                toxic = np.bincount(inverse, np.concatenate(labels), len(found)).astype(np.int64)
                every = np.bincount(inverse, minlength=len(found))
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(toxic), pa.array(every.astype(np.int64))], ["key", "toxic", "n"])

    return count


class Model:
    """Marked keys with their log-odds, and the logistic over a text's strongest mark and the sum of marks."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray, theta: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.odds, self.theta = keys[order], odds[order], theta

    def summary(self, row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        """Columns: the strongest mark, and the logarithm of one plus the sum."""
        out = np.zeros((n, 2))
        if len(self.keys) and len(key):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            value = np.where(self.keys[at] == key, self.odds[at], 0.0)
            np.maximum.at(out[:, 0], row, value)
            out[:, 1] = np.log1p(np.bincount(row, value, n))
        return out

    def scores(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.theta[:2] + self.theta[2], -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a logistic regression over weighted rows, by damped Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    theta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (n * (p - y)) + 0.1 * theta
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(theta))
        step = np.linalg.solve(curve, slope)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return theta


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Language, Model]:
    """Both models. The language model counts all of ``docs``; marks and logistic count all labelled rows."""
    spark = docs.sparkSession
    grams = docs.select("text").mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = grams.toArrow()  # at most 256^3 codes, in texts of few scripts some ten thousand
    language = Language(counted.column("code").to_numpy(), counted.column("n").to_numpy())
    shared = spark.sparkContext.broadcast(language)
    own = labelled(docs, labels)
    counts = own.mapInArrow(_class_counts(shared), "key long, toxic long, n long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    total = labels.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id").agg(F.sum("y"), F.count("*")).first()
    positive, rows = float(total[0] or 0), float(total[1])
    if not 0 < positive < rows:
        share = (positive + 0.5) / (rows + 1)
        return language, Model(np.zeros(0, np.uint64), np.zeros(0), np.array([0.0, 0.0, math.log(share / (1 - share)) if rows else -1.0]))
    cell = "{0} * ln(greatest({0}, 1e-9) * {2} / ({1} * n))"
    clean, negative = "(n - toxic)", rows - positive
    ratio = f"2 * ({cell.format('toxic', positive, rows)} + {cell.format(clean, negative, rows)})"
    odds = f"ln((toxic + 0.5) / ({positive} + 1)) - ln(({clean} + 0.5) / ({negative} + 1))"
    marked = counts.where(f"toxic >= {max(3.0, SUPPORT * positive)}").selectExpr("key", f"{ratio} as association", f"{odds} as odds").where(f"odds > {ODDS} and association >= {ASSOCIATION}")
    best = marked.select("key", "odds").toArrow()
    model = Model(best.column("key").to_numpy().view(np.uint64), best.column("odds").to_numpy(), np.zeros(3))
    bound = spark.sparkContext.broadcast(model)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in slices(batch):
                x = np.round(bound.value.summary(*features(data, bounds, shared.value), end - at), 1)
                yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(2).slice(at, end - at)], ["top", "total", "y"])

    bins = own.mapInArrow(summaries, "top double, total double, y int").groupBy("top", "total", "y").agg(F.count("*").alias("n")).collect()
    x = np.array([[r.top, r.total] for r in bins])
    model.theta = logistic(x, np.array([r.y for r in bins], float), np.array([r.n for r in bins], float))
    return language, model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Learns only from labels whose ids are not held out; null and empty texts score as texts without
    marks; repeated rows score alike; without documents no rows, without labels one score for all.
    """
    usable = written(usable_labels(labels, "toxic", PARTS, HELD_OUT), "labels")
    language, model = fit(docs, usable)
    shared = docs.sparkSession.sparkContext.broadcast((language, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_language, own = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, end, data, bounds in slices(batch):
                out[at:end] = own.scores(own.summary(*features(data, bounds, own_language), end - at))
            yield pa.record_batch([batch.column(0), pa.array(out)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), PARTS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
