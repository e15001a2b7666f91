"""Sums over many wave vectors through a mesh: the same sums as ``waves``, by work in proportion to particles and wave vectors.

A charge is laid on the ``WIDTH`` mesh points an axis around it with a smooth weight, the mesh is transformed, and each wave
vector is divided by the weight's own transform. On a mesh twice as fine as the shortest wave asks for, what that leaves
is below 1e-13 of the sum of all charges, the rounding of plain sums of such length. Reading a field goes the same way back.

The mesh never lies in one place. Slabs of ``TILE`` planes across x are laid and transformed along y and z, each by the particles whose
weights begin in it; lines along x then meet by ny. Shuffles carry wave vectors and particles a fixed number of times, however many tasks there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import AXES

#: Mesh points an axis that a weight covers, its exponent, planes of a slab (and sides of its tiles), particles of a group at most on average.
WIDTH, BETA, TILE, GROUP = 16, 2.3 * 16, 16, 1 << 19
#: Particles of a tile at once.
BATCH = 1024
SPAN = TILE + WIDTH - 1


def mesh_points(n_max: int) -> int:
    """The least even number with no prime factor beyond 5 that is twice as fine as a wave of ``n_max`` periods asks for."""
    n = max(2 * WIDTH, 2 * (2 * n_max + 1) + 1)
    while n % 2 or 60**20 % n:
        n += 1
    return n


@lru_cache(maxsize=64)
def _transformed(points: int, n_max: int) -> np.ndarray:
    """The weight's transform at 0..n_max waves over the box, by quadrature."""
    t, weight = np.polynomial.legendre.leggauss(4 * WIDTH)
    n = np.arange(n_max + 1)
    return WIDTH / 2 * (np.cos(math.pi * WIDTH / points * np.outer(n, t)) @ (weight * np.exp(BETA * (np.sqrt(1 - t * t) - 1))))


class Mesh:
    """Mesh points an axis for the wave vectors (nx, ny, nz) of ``params``, and which of them have nz >= 0."""

    def __init__(self, params):
        self.n_max, self.extent, self.points = params.n_max, params.domain.extent, tuple(mesh_points(m) for m in params.n_max)
        self.alpha, self.volume, self.top = params.alpha, params.domain.volume, params.k_cut**2 * (1 + 1e-12)
        self.k = [2 * math.pi / e * np.arange(m + 1) for m, e in zip(self.n_max, self.extent, strict=True)]
        self.tiles = tuple(p // TILE + 1 for p in self.points)

    def reach(self, ny: int) -> int:
        """How many nz from 0 there are at this ny."""
        return int(np.count_nonzero(self.k[1][abs(ny)] ** 2 + self.k[2] ** 2 <= self.top))

    def line(self, ny: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """nx, the squares of the wave vectors by (nx, nz), and what the weights' transforms multiply them by."""
        mx, n = self.n_max[0], self.reach(ny)
        nx = np.arange(-mx, mx + 1)
        x, y, z = (_transformed(p, m) for p, m in zip(self.points, self.n_max, strict=True))
        square = self.k[0][abs(nx)][:, None] ** 2 + self.k[1][abs(ny)] ** 2 + self.k[2][:n] ** 2
        return nx, square, x[abs(nx)][:, None] * y[abs(ny)] * z[:n]

    def planes(self, slab: int) -> np.ndarray:
        """The planes across x of a slab, those that its weights reach over included."""
        return (slab * TILE + np.arange(SPAN) - WIDTH // 2) % self.points[0]

    def laid(self, axis: int, at: np.ndarray, slope: bool, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tiles, and weights of places ``at`` and their slopes over the mesh points that a tile reaches. ``begin`` is where the weights begin, half a width on."""
        points = self.points[axis]
        x = np.mod(at, self.extent[axis]) * (points / self.extent[axis])
        if begin is None:
            begin = np.ceil(x - WIDTH / 2).astype(np.int64) + WIDTH // 2
        t = (begin[:, None] - WIDTH // 2 + np.arange(WIDTH) - x[:, None]) * (2 / WIDTH)
        root = np.sqrt(np.maximum(1 - t * t, 0))
        weight = np.exp(BETA * (root - 1))
        tile = begin // TILE
        where = (begin - tile * TILE)[:, None] + np.arange(WIDTH)
        out = np.zeros((2 if slope else 1, len(at), SPAN))
        np.put_along_axis(out[0], where, weight, 1)
        if slope:  # the root is held off 0, where the weight is below rounding
            np.put_along_axis(out[1], where, weight * t / np.maximum(root, 1e-2) * (BETA * 2 / WIDTH * points / self.extent[axis]), 1)
        return tile, out[0], out[-1]

    def dealt(self, df: DataFrame) -> tuple[DataFrame, list[tuple[int, int]], int]:
        """Rows with a slab, a part of it and where their weights begin along x; the (slab, part) there are, and tasks for them. Slabs of many rows have several parts."""
        e, points = self.extent[0], self.points[0]
        begin = F.ceil(F.pmod("x", F.lit(float(e))) * (points / e) - WIDTH / 2).cast("int") + WIDTH // 2
        rows = df.withColumn("begin", begin).withColumn("slab", F.floor(F.col("begin") / TILE).cast("int"))
        parts = {r.slab: -(-r["count"] // GROUP) for r in rows.groupBy("slab").count().collect()}  # a row a slab of planes
        if max(parts.values(), default=1) > 1:
            each = F.element_at(F.array(*[F.lit(parts.get(s, 1)) for s in range(self.tiles[0] + 1)]), F.col("slab") + 1)
            rows = rows.withColumn("part", F.pmod(F.hash("gid"), each))
        else:
            rows = rows.withColumn("part", F.lit(0))
        groups = [(s, p) for s in sorted(parts) for p in range(parts[s])]
        tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * len(groups))
        return rows, groups, tasks


def finite(names: tuple[str, ...]):
    """Whether a row has all of these, as numbers."""
    test = F.lit(True)
    for n in names:
        test = test & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return test


def _by_tile(mesh: Mesh, group: pa.Table, slope: bool) -> Iterator[tuple[tuple[slice, slice], np.ndarray, list[list[np.ndarray]]]]:
    """Rows of a slab tile by tile: where the tile lies, which rows, and their weights and slopes by axis."""
    at = [group[a].to_numpy() for a in AXES]
    begin = group["begin"].to_numpy().astype(np.int64)
    y, z = (np.ceil(np.mod(at[k], mesh.extent[k]) * (mesh.points[k] / mesh.extent[k]) - WIDTH / 2).astype(np.int64) + WIDTH // 2 for k in (1, 2))
    tile = (y // TILE) * (mesh.tiles[2] + 1) + z // TILE
    order = np.argsort(tile, kind="stable")
    bounds = np.flatnonzero(np.diff(tile[order], prepend=-1))
    for low, high in zip(bounds, [*bounds[1:], len(order)], strict=True):
        for s in range(low, high, BATCH):
            rows = order[s : min(s + BATCH, high)]
            (_, *x), (ty, *wy), (tz, *wz) = (mesh.laid(k, at[k][rows], slope, b[rows]) for k, b in enumerate((begin, y, z)))
            own = tuple(slice(int(t[0]) * TILE, int(t[0]) * TILE + SPAN) for t in (ty, tz))
            yield own, rows, [x, wy, wz]


def _folded(plane: np.ndarray, points: tuple[int, int]) -> np.ndarray:
    """A plane with what lies beyond its edges brought back into the box."""
    for axis, n in enumerate(points):
        out = np.zeros([n if k == axis else s for k, s in enumerate(plane.shape)])
        for s in range(0, plane.shape[axis], n):
            piece = plane[s : s + n] if axis == 0 else plane[:, s : s + n]
            out[tuple(slice(0, k) for k in piece.shape)] += piece
        plane = np.roll(out, -(WIDTH // 2), axis)
    return plane


def structure(df: DataFrame, params, half: bool) -> DataFrame:
    """As ``waves.structure``."""
    mesh = Mesh(params)
    rows, groups, tasks = mesh.dealt(df.where(finite((*AXES, "q"))))

    def laid(group: pa.Table) -> pa.Table:
        _, py, pz = mesh.points
        _, my, mz = mesh.n_max
        slab, q = group["slab"][0].as_py(), group["q"].to_numpy()
        grid = np.zeros((SPAN, (mesh.tiles[1] + 1) * TILE + WIDTH, (mesh.tiles[2] + 1) * TILE + WIDTH))
        for (sy, sz), rows, ((x, _), (y, _), (z, _)) in _by_tile(mesh, group, False):
            xy = ((x * q[rows, None])[:, :, None] * y[:, None, :]).reshape(len(rows), -1)
            grid[:, sy, sz] += (xy.T @ z).reshape(SPAN, SPAN, SPAN)
        ny, keys, lines = np.arange(-my, my + 1), [], []
        reach = [mesh.reach(n) for n in ny]
        for plane, values in zip(mesh.planes(slab), grid, strict=True):
            waves = np.fft.fft(np.fft.rfft(_folded(values, (py, pz)), axis=1)[:, : mz + 1], axis=0)[ny % py]
            for n, line, r in zip(ny, waves, reach, strict=True):
                if r:
                    keys.append((int(n), int(plane)))
                    lines.append(line[:r].tobytes())
        found = np.array(keys, np.int32).reshape(-1, 2)
        return pa.table([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.array(lines, pa.binary())], ["ny", "plane", "line"])

    def crossed(group: pa.Table) -> pa.Table:
        ny = group["ny"][0].as_py()
        nx, square, weight = mesh.line(ny)
        lines = np.zeros((mesh.points[0], square.shape[1]), complex)
        for plane, line in zip(group["plane"].to_pylist(), group["line"], strict=True):
            lines[plane] += np.frombuffer(line.as_buffer(), complex)
        sums = np.fft.fft(lines, axis=0)[nx % mesh.points[0]] / weight
        nz = np.arange(square.shape[1])
        mask = (square > 0) & (square <= mesh.top)
        if half:
            mask &= (nz > 0) | (ny > 0) | ((ny == 0) & (nx > 0))[:, None]
        a, c = np.nonzero(mask)
        out = [nx[a], np.full(len(a), ny), c, sums[a, c].real, sums[a, c].imag]
        if not half:  # the opposite of each with nz > 0
            more = c > 0
            out = [np.concatenate([v, sign * v[more]]) for v, sign in zip(out, (-1, -1, -1, 1, -1), strict=True)]
        return pa.table([pa.array(v) for v in out], ["nx", "ny", "nz", "re", "im"])

    keyed = rows.repartition(tasks, "slab", "part").groupBy("slab", "part")
    lines = keyed.applyInArrow(laid, "ny int, plane int, line binary")
    lines = lines.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ny")
    return lines.groupBy("ny").applyInArrow(crossed, "nx long, ny long, nz long, re double, im double")


def field(points: DataFrame, sums: DataFrame, params, half: bool) -> DataFrame:
    """As ``waves.field``."""
    mesh = Mesh(params)
    schema = "gid long, potential double, gx double, gy double, gz double"
    rows, groups, tasks = mesh.dealt(points.where(finite(AXES)))

    def lined(group: pa.Table) -> pa.Table:
        """Coefficients of one ny to lines along x, under each slab that reads them."""
        ny, n = group["ny"][0].as_py(), mesh.points[0]
        _, square, weight = mesh.line(ny)
        at = group["nx"].to_numpy() + mesh.n_max[0], group["nz"].to_numpy()
        damped = 4 * math.pi / mesh.volume * np.exp(-square[at] / (4 * mesh.alpha)) / square[at] / weight[at]
        lines = np.zeros((n, square.shape[1]), complex)
        lines[group["nx"].to_numpy() % n, at[1]] = (group["re"].to_numpy() + 1j * group["im"].to_numpy()) * damped
        lines = [line.tobytes() for line in np.fft.ifft(lines, axis=0, norm="forward")]
        keys = np.array([(s, p, k) for s, p in groups for k in range(SPAN)], np.int32).reshape(-1, 3)
        own = [lines[k] for s, _ in groups for k in mesh.planes(s)]
        return pa.table([*[pa.array(keys[:, k].copy()) for k in range(3)], pa.array(np.full(len(keys), ny, np.int32)), pa.array(own, pa.binary())], ["slab", "part", "plane", "ny", "line"])

    def read(group: pa.Table, lines: pa.Table) -> pa.Table:
        _, py, pz = mesh.points
        waves = np.zeros((SPAN, py, mesh.n_max[2] + 1), complex)
        for plane, ny, line in zip(lines["plane"].to_pylist(), lines["ny"].to_pylist(), lines["line"], strict=True):
            values = np.frombuffer(line.as_buffer(), complex)
            waves[plane, ny % py, : len(values)] = values
        wy, wz = ((np.arange((t + 1) * TILE + WIDTH) - WIDTH // 2) % p for t, p in zip(mesh.tiles[1:], (py, pz), strict=True))
        grid = np.empty((SPAN, len(wy), len(wz)))
        for k in range(SPAN):
            grid[k] = np.fft.irfft(np.fft.ifft(waves[k], axis=0, norm="forward"), pz, axis=1, norm="forward")[wy[:, None], wz]
        out = np.empty((4, len(group)))
        for (sy, sz), rows, ((x, dx), (y, dy), (z, dz)) in _by_tile(mesh, group, True):
            n = len(rows)
            met = (grid[:, sy, sz].reshape(-1, SPAN) @ np.concatenate([z, dz]).T).reshape(SPAN, SPAN, 2 * n)
            plain, sloped = np.einsum("xyn,ny->xn", met[:, :, :n], y), np.einsum("xyn,ny->xn", met[:, :, n:], y)
            across = np.einsum("xyn,ny->xn", met[:, :, :n], dy)
            for k, (a, b) in enumerate(((plain, x), (plain, -dx), (across, -x), (sloped, -x))):
                out[k, rows] = np.einsum("xn,nx->n", a, b)
        return pa.table([group["gid"], *[pa.array(v) for v in out]], ["gid", "potential", "gx", "gy", "gz"])

    own = F.struct("nx", "ny", "nz", "re", "im")
    if half:  # where nz = 0 both of a pair are needed
        other = F.struct((-F.col("nx")).alias("nx"), (-F.col("ny")).alias("ny"), F.col("nz"), F.col("re"), (-F.col("im")).alias("im"))
        whole = sums.select(F.inline(F.when(F.col("nz") == 0, F.array(own, other)).otherwise(F.array(own))))
    else:
        whole = sums.where("nz >= 0").select("nx", "ny", "nz", "re", "im")
    whole = whole.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ny").groupBy("ny")
    lines = whole.applyInArrow(lined, "slab int, part int, plane int, ny int, line binary").repartition(tasks, "slab", "part")
    found = rows.repartition(tasks, "slab", "part").groupBy("slab", "part").cogroup(lines.groupBy("slab", "part")).applyInArrow(read, schema)
    none = [F.lit(None).cast("double").alias(c) for c in ("potential", "gx", "gy", "gz")]
    return found.unionByName(points.where(~finite(AXES)).select("gid", *none))
