"""Runs of windows that share an anchor: how repeats are found without listing every window.

The anchor of a window of ``length`` units is the least hash of its grams of ``gram`` units. Equal windows
have equal anchors wherever they stand, so grouping by anchor loses no pair of equal windows; and since
neighbouring windows mostly share their anchor, a run of them makes one row: some 2 / (length - gram + 2)
rows a unit. Two grams under one hash only make a group larger.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Runs(NamedTuple):
    row: np.ndarray
    #: First window's place in its row, and number of windows.
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    #: First and last place of the anchor's gram in the run, in the slice.
    low: np.ndarray
    high: np.ndarray


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _nearest(grams: np.ndarray, kept: np.ndarray, at: np.ndarray, value: np.ndarray, step: int) -> np.ndarray:
    """The places in ``kept``, from number ``at`` on by ``step``, whose gram is ``value``."""
    wrong = np.flatnonzero(grams[kept[at]] != value)
    while len(wrong):
        at[wrong] += step
        wrong = wrong[grams[kept[at[wrong]]] != value[wrong]]
    return kept[at]


def runs(grams: np.ndarray, first: np.ndarray, gram: int, length: int, places: bool = False) -> Runs:
    """The runs of a slice whose rows ``first`` bounds; ``grams`` has the hash of the gram at each place. ``places``: also find the anchors."""
    none = np.zeros(0, np.int64)
    width = length - gram + 1
    if len(grams) < width:
        return Runs(none, none, none, none.view(np.uint64), none, none)
    least = sliding_min(grams, width)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    valid = np.arange(length, len(least) + length) <= first[1:][row]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    a, z = np.flatnonzero(begins), np.flatnonzero(ends)
    low = high = none
    if places:
        # grams that are the least of some window, in order; an anchor's first and last one in a run are among its nearest
        edge = np.zeros(width - 1, np.uint64)
        kept = np.flatnonzero(grams == ~sliding_min(~np.concatenate([edge, least, edge]), width))
        low = _nearest(grams, kept, np.searchsorted(kept, a), least[a], 1)
        high = _nearest(grams, kept, np.searchsorted(kept, z + width - 1, side="right") - 1, least[z], -1)
    return Runs(row[a], a - first[row[a]], z - a + 1, least[a], low, high)
