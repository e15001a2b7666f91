"""Weakly supervised quality rules: each rule votes good, bad or abstains; expectation-maximisation
estimates how far each can be trusted, and the posterior probability of quality decides.

Counting runs over Arrow batches; the estimation sees only the counts of vote patterns, of which there
are at most 3 to the number of rules however many documents there are. The posterior is then a plain
Column expression, so scoring needs no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .textops import SPACE, Words, byte_table, covered, interned, paired, row_sums, run_starts, slices

SYMBOLS = byte_table("#*$%&|<>")
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_distinct", "n_letter_words",
)
_UPPER = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = np.array([bool(_UPPER[b] or 97 <= b <= 122 or b >= 0xC0) for b in range(256)])
#: Below this the votes are too few to overrule the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The posterior at which a document stays.
KEEP_AT = 0.5
#: The estimation stops once no pattern's posterior moves by more than ``SETTLED``, or after so many rounds.
ROUNDS, SETTLED, SMOOTH, START = 60, 1e-6, 1.0, 0.9


def _vote(bad: str, good: str) -> Column:
    return F.expr(f"cast(case when {bad} then -1 when {good} then 1 else 0 end as int)")


def votes() -> dict[str, Column]:
    """Rule name -> 1 (good), -1 (bad) or 0 (abstains), from the counts of a document."""
    return {
        "length": _vote(f"n_words < {MIN_WORDS}", "n_words >= 100"),
        "word_length": _vote("word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
        "symbols": _vote("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
        "lines": _vote("n_dup_lines > 0.3 * n_lines", "n_lines >= 3 and n_dup_lines = 0"),
        "repeats": _vote(f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words", "n_repeat_words <= 0.2 * n_words"),
        "capitals": _vote("n_upper > 0.4 * n_letters", "n_upper between 1 and 0.15 * n_letters"),
        "variety": _vote("n_words >= 50 and n_distinct < 0.2 * n_words", "n_distinct > 0.4 * n_words"),
        "letters": _vote("n_letter_words < 0.6 * n_words", "n_letter_words > 0.8 * n_words"),
    }


def _repeat_words(names: np.ndarray, words: Words, rows: np.ndarray) -> np.ndarray:
    """Which words lie in a 3-word window that the same row holds twice or more; ``names`` tells words apart."""
    at = run_starts(rows, words.first, 3)
    if not len(at):
        return np.zeros(len(rows), bool)
    grams = paired(paired(paired(names[at], names[at + 1]), names[at + 2]), rows[at])
    return covered(len(rows), at[np.bincount(grams)[grams] > 1], 3)


def _first_of(keys: np.ndarray) -> np.ndarray:
    """Which places hold a number for the first time."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def _counts(data: bytes, bounds: np.ndarray) -> list[np.ndarray]:
    words = Words(data, bounds, SPACE)
    raw, rows = words.bytes, words.row_of()
    names = interned(raw, words.start, words.end, words.hashes())
    n = words.counts()
    whole = (raw & 0xC0) != 0x80
    starts = np.union1d(bounds[:-1], np.flatnonzero(raw == 10) + 1)
    line_row = np.searchsorted(bounds, starts, side="right") - 1
    starts, line_row = starts[line_row < len(bounds) - 1], line_row[line_row < len(bounds) - 1]
    ends = np.minimum(np.append(starts[1:], len(raw)), bounds[line_row + 1])
    ends = ends - ((ends > starts) & (raw[np.maximum(ends - 1, 0)] == 10) if len(raw) else 0)
    inside = np.concatenate([[0], np.cumsum(words.inside)])
    full = inside[ends] > inside[starts]
    starts, ends, line_row = starts[full], ends[full], line_row[full]
    again = ~_first_of(paired(interned(raw, starts, ends, words.ranges.of(starts, ends)), line_row))
    per_line = np.searchsorted(line_row, np.arange(len(bounds)))
    upper = _UPPER[raw]
    latin = np.zeros_like(upper)
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    distinct = _first_of(paired(names, rows))
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    lettered = 2 * (letters[words.end] - letters[words.start]) >= words.end - words.start
    return [
        n, row_sums(whole & words.inside, bounds), row_sums(SYMBOLS[raw], bounds), row_sums(again, per_line),
        row_sums(_repeat_words(names, words, rows), words.first), row_sums(np.ones(len(again), bool), per_line),
        row_sums(_LETTER[raw], bounds), row_sums(upper | latin, bounds), row_sums(distinct, words.first),
        row_sums(lettered, words.first),
    ]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_counts(data, bounds) for _, _, data, bounds in slices(batch)]
        cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(COUNTS))]
        yield pa.record_batch([batch.column(0), *(pa.array(c.astype(np.int64)) for c in cols)], ["doc_id", *COUNTS])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every row of ``docs`` (null and empty texts: zeros)."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count_batches, schema)


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """(prior log-odds, each rule's log-odds by its vote) by EM over counted vote patterns.

    A rule's three outcomes are independent given the class; abstaining is an outcome too. It starts from
    documents that no rule votes against as likely good, which also fixes which class is the good one.
    """
    if not patterns:
        return 0.0, [{v: 0.0 for v in (-1, 0, 1)} for _ in range(rules)]
    votes_at = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    good = np.where((votes_at < 0).any(1), 1 - START, START)
    prior, weights = 0.0, []
    for _ in range(rounds):
        up, down = n * good, n * (1 - good)
        prior = math.log((up.sum() + SMOOTH) / (down.sum() + SMOOTH))
        weights = []
        for j in range(rules):
            at = {v: votes_at[:, j] == v for v in (-1, 0, 1)}
            w = {
                v: math.log((up[m].sum() + SMOOTH) / (up.sum() + 3 * SMOOTH)) - math.log((down[m].sum() + SMOOTH) / (down.sum() + 3 * SMOOTH))
                for v, m in at.items()
            }
            weights.append(w)
        log_odds = prior + sum(np.select([votes_at[:, j] == v for v in (-1, 0, 1)], [weights[j][v] for v in (-1, 0, 1)]) for j in range(rules))
        before, good = good, 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))
        if np.abs(good - before).max() < SETTLED:
            break
    return prior, weights


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, ``COUNTS``, a vote column for each rule, base_failed, posterior and kept, per row.

    Null and empty texts have no words, so the base rules fail them; repeated rows count as rows; an
    empty table gives an empty table.
    """
    rules = votes()
    table = written(counted(docs).withColumns({f"vote_{k}": v for k, v in rules.items()}), "votes")
    names = [f"vote_{k}" for k in rules]
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    # accuracies are judged on what the base rules leave to judge
    patterns = [(tuple(r[:-1]), r[-1]) for r in table.where(~failed).groupBy(*names).agg(F.count("*").alias("n")).collect()]
    prior, weights = fit(sorted(patterns), len(names))
    log_odds = F.lit(float(prior))
    for name, w in zip(names, weights, strict=True):
        log_odds = log_odds + F.when(F.col(name) > 0, float(w[1])).when(F.col(name) < 0, float(w[-1])).otherwise(float(w[0]))
    return table.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-log_odds))}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT)
    )
