"""Sums over the wave vectors of a box by phase factors of each axis.

e^(i k.r) is a product of three factors, one an axis, so a batch of particles meets all wave vectors in a matrix
product of (particles x (nx, ny)) and (particles x nz), without a row for each of them and without a join. Sums are
added up in a task before they are shuffled. Wave vectors come in slabs of nx of at most ``SLAB`` places of the grid,
whose sums a task can hold, however many there are. Rows are dealt over all tasks first, the work on each being large.
Where the grid has over ``MESH`` places, that work (particles times wave vectors) and the sums that each task hands on
outgrow the input, and the sums go through ``mesh`` instead.

Rows with a null or non-finite position or charge take no part in sums and read null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import AXES
from . import mesh
from .pairs import spread

#: Places of the grid of wave vectors whose sums a task holds (16 bytes each), and factors of particles and (nx, ny) at once.
SLAB, BATCH = 1 << 22, 1 << 20
#: Places of the grid with nz >= 0 beyond which sums go through the mesh.
MESH = 1 << 18


def meshed(params) -> bool:
    mx, my, mz = params.n_max
    return (2 * mx + 1) * (2 * my + 1) * (mz + 1) > MESH


class Grid:
    """The wave vectors (nx, ny, nz) of ``params`` with nx in a slab: all, or one of each pair (k, -k)."""

    def __init__(self, params, half: bool, low: int, high: int):
        mx, my, mz = params.n_max
        self.extent = params.domain.extent
        self.ranges = np.arange(low, high + 1), np.arange(-my, my + 1), np.arange(0 if half else -mz, mz + 1)
        self.k = [2 * math.pi / e * r for e, r in zip(self.extent, self.ranges, strict=True)]
        square = self.k[0][:, None, None] ** 2 + self.k[1][:, None] ** 2 + self.k[2] ** 2
        nx, ny, nz = np.meshgrid(*self.ranges, indexing="ij")
        self.mask = (square > 0) & (square <= params.k_cut**2 * (1 + 1e-12))
        if half:
            self.mask &= (nz > 0) | (ny > 0) | ((ny == 0) & (nx > 0))
        safe = np.where(self.mask, square, 1.0)
        self.coefficient = np.where(self.mask, 4 * math.pi / params.domain.volume * np.exp(-safe / (4 * params.alpha)) / safe, 0.0)
        self.weight = 2.0 if half else 1.0

    def planes(self) -> int:
        return len(self.ranges[0]) * len(self.ranges[1])

    def factors(self, xyz: list[np.ndarray], sign: int) -> tuple[np.ndarray, np.ndarray]:
        """e^(sign i k.r) as a matrix by (nx, ny) and one by nz."""
        x, y, z = (np.exp(sign * 1j * np.outer(v, k)) for v, k in zip(xyz, self.k, strict=True))
        return (x[:, :, None] * y[:, None, :]).reshape(len(x), -1), z


def slabs(params, half: bool) -> list[Grid]:
    mx, my, mz = params.n_max
    each = max(1, SLAB // ((2 * my + 1) * (2 * mz + 1)))
    return [Grid(params, half, low, min(low + each - 1, mx)) for low in range(-mx, mx + 1, each)]


def _numbers(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]


def structure(df: DataFrame, params, half: bool) -> DataFrame:
    """(nx, ny, nz, re, im) of S(k) = sum q e^(-i k.r); no rows of an empty table."""
    rows = df.select("gid", *[F.col(c).cast("double").alias(c) for c in (*AXES, "q")])
    if meshed(params):
        return mesh.structure(rows, params, half)
    found, source = None, spread(rows).drop("gid")
    for grid in slabs(params, half):
        one = source.mapInArrow(_summed(grid), "nx long, ny long, nz long, re double, im double")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("nx", "ny", "nz").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _summed(grid: Grid):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, step = None, max(1, BATCH // grid.planes())
        for batch in batches:
            *xyz, q = _numbers(batch, (*AXES, "q"))
            good = np.isfinite(xyz[0]) & np.isfinite(xyz[1]) & np.isfinite(xyz[2]) & np.isfinite(q)
            xyz, q = [v[good] for v in xyz], q[good]
            for a in range(0, len(q), step):
                plane, z = grid.factors([v[a : a + step] for v in xyz], -1)
                part = (plane * q[a : a + step, None]).T @ z
                total = part if total is None else total + part
        if total is not None:
            at = np.nonzero(grid.mask)
            sums = total.reshape(grid.mask.shape)[at]
            columns = [pa.array(r[i]) for r, i in zip(grid.ranges, at, strict=True)] + [pa.array(sums.real.copy()), pa.array(sums.imag.copy())]
            yield from pa.Table.from_arrays(columns, ["nx", "ny", "nz", "re", "im"]).to_batches(1 << 16)

    return summed


def field(points: DataFrame, sums: DataFrame, params, half: bool) -> DataFrame:
    """(gid, potential, gx, gy, gz) at ``points`` (gid, x, y, z) of the sums of ``structure``; g is the field, the force on a unit charge.

    Without a mesh the sums of a slab are fetched when this is called, and travel with the tasks that read them.
    """
    schema = "gid long, potential double, gx double, gy double, gz double"
    rows = points.select(F.col("gid").cast("long").alias("gid"), *[F.col(a).cast("double").alias(a) for a in AXES])
    if meshed(params):
        return mesh.field(rows, sums, params, half)
    source = spread(rows)
    sums, grids, found = sums.persist(), slabs(params, half), None
    for grid in grids:
        low, high = int(grid.ranges[0][0]), int(grid.ranges[0][-1])
        rows = sums.where(F.col("nx").between(low, high)).toPandas()
        values = np.zeros(grid.mask.shape, complex)
        values[tuple(rows[c].to_numpy(np.int64) - int(r[0]) for c, r in zip(("nx", "ny", "nz"), grid.ranges, strict=True))] = rows["re"].to_numpy(float) + 1j * rows["im"].to_numpy(float)
        one = source.mapInArrow(_read(grid, values * grid.coefficient * grid.weight), schema)
        found = one if found is None else found.unionByName(one)
    sums.unpersist()
    if len(grids) == 1:
        return found
    return found.groupBy("gid").agg(*[F.sum(c).alias(c) for c in ("potential", "gx", "gy", "gz")])


def _read(grid: Grid, values: np.ndarray):
    values = values.reshape(grid.planes(), -1).T

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH // grid.planes())
        kx, ky = np.repeat(grid.k[0], len(grid.k[1])), np.tile(grid.k[1], len(grid.k[0]))
        for batch in batches:
            xyz = _numbers(batch, AXES)
            out = np.zeros((4, batch.num_rows))
            for a in range(0, batch.num_rows, step):
                plane, z = grid.factors([v[a : a + step] for v in xyz], 1)
                met = plane * (z @ values)
                along = plane * ((z * grid.k[2]) @ values)
                out[:, a : a + step] = met.real.sum(1), met.imag @ kx, met.imag @ ky, along.imag.sum(1)
            yield pa.record_batch([batch.column("gid"), *[pa.array(v, mask=~np.isfinite(v)) for v in out]], ["gid", "potential", "gx", "gy", "gz"])

    return read
