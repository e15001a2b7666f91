"""The periodic box: wrapping, cells, images and minimum-image expressions as Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Domain:
    """An orthogonal box centred on the origin, ``[-E/2, E/2)`` on each axis."""

    extent: tuple[float, float, float]

    def __post_init__(self):
        if len(self.extent) != 3 or not all(e > 0 and math.isfinite(e) for e in self.extent):
            raise ValueError(f"three positive extents are needed, not {self.extent}")

    @property
    def volume(self) -> float:
        return math.prod(self.extent)

    def wrap(self, axis: str, value: Column | None = None) -> Column:
        """``value`` brought back into the box; an exact upper face goes to the lower one."""
        e = self.extent[AXES.index(axis)]
        return F.pmod((F.col(axis) if value is None else value) + e / 2, F.lit(float(e))) - e / 2

    def inside(self, low=None, high=None) -> Column:
        """lo <= p < hi on all axes; the whole box by default."""
        low = low or [-e / 2 for e in self.extent]
        high = high or [e / 2 for e in self.extent]
        tests = [(F.col(a) >= lo) & (F.col(a) < hi) for a, lo, hi in zip(AXES, low, high, strict=True)]
        return tests[0] & tests[1] & tests[2]

    def escape_code(self) -> Column:
        """Which of 26 directions a row left the box by: two bits an axis, 1 below, 2 above; 0 inside."""
        code = F.lit(0)
        for k, (axis, e) in enumerate(zip(AXES, self.extent, strict=True)):
            code = code + F.when(F.col(axis) < -e / 2, 1 << 2 * k).when(F.col(axis) >= e / 2, 2 << 2 * k).otherwise(0)
        return code

    def minimum_image(self, axis: str, difference: Column) -> Column:
        e = self.extent[AXES.index(axis)]
        return difference - e * F.round(difference / e)

    def cell_counts(self, width: float) -> tuple[int, int, int]:
        """Cells an axis whose edge is at least ``width``; a width beyond an extent has none and raises."""
        if not width > 0:
            raise ValueError(f"a cell width has to be positive, not {width}")
        n = tuple(int(e / width) for e in self.extent)
        if min(n) < 1:
            raise ValueError(f"the width {width} is beyond the box {self.extent}")
        return n

    def cell(self, axis: str, n: int, strict: bool = False) -> Column:
        """A row's cell on an axis; upper-face rows fall in the last one. ``strict``: a row outside the box raises."""
        e = self.extent[AXES.index(axis)]
        place = F.least(F.floor((F.col(axis) + e / 2) * n / e).cast("int"), F.lit(n - 1))
        if not strict:
            return place
        out = (F.col(axis) < -e / 2) | (F.col(axis) > e / 2)
        return F.when(out, F.raise_error(F.concat(F.lit(f"outside the box on {axis}: "), F.col(axis).cast("string"))).cast("int")).otherwise(place)

    def cell_or_none(self, axis: str, n: int) -> Column:
        """As ``cell``, with -1 for rows outside."""
        e = self.extent[AXES.index(axis)]
        return F.when((F.col(axis) >= -e / 2) & (F.col(axis) <= e / 2), self.cell(axis, n)).otherwise(-1)


def stencil(width: tuple[float, float, float], cutoff: float) -> list[tuple[int, int, int]]:
    """Cell offsets that hold any point within ``cutoff`` of any point of a cell, for cells of any size.

    An offset is kept if the gap between the two cells is at most the cutoff, on each axis by its own width.
    """
    reach = [math.ceil(cutoff / w) for w in width]
    gap = lambda o, w: max(abs(o) - 1, 0) * w
    return [
        (a, b, c)
        for a in range(-reach[0], reach[0] + 1)
        for b in range(-reach[1], reach[1] + 1)
        for c in range(-reach[2], reach[2] + 1)
        if sum(gap(o, w) ** 2 for o, w in zip((a, b, c), width, strict=True)) <= cutoff**2
    ]


def shell(width: int) -> list[tuple[int, int, int]]:
    """The outer shell of a cube of offsets."""
    r = range(-width, width + 1)
    return [(a, b, c) for a in r for b in r for c in r if max(abs(a), abs(b), abs(c)) == width]
