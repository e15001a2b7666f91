"""Electrostatics: direct sums, and Ewald sums as screened pairs and two passes over the wave vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import AXES, Domain
from ..particles import ParticleSet
from . import waves
from .pairs import accumulated, pair_table

#: Fixed values of the physical constants: elementary charge (C) and vacuum permittivity (F/m).
ELEMENTARY_CHARGE, PERMITTIVITY = 1.602176634e-19, 8.8541878128e-12


def internal_to_ev() -> float:
    """The energy unit e^2 / (4 pi eps0 Angstrom) in electron volts."""
    return ELEMENTARY_CHARGE / (4 * math.pi * PERMITTIVITY * 1e-10)


#: Rows of a block at most on average, and blocks that a table of any size is dealt to where it has as many rows each: tasks then share pairs evenly.
BLOCK_ROWS, LEAST_BLOCKS, LEAST_ROWS = 1 << 15, 24, 1 << 10
#: Sides of a tile of distances, and the share of the squared size of two blocks below which squared distances are taken from differences.
TILE, NEAR = (64, 1024), 1e-3


def _along(xyz: np.ndarray) -> np.ndarray:
    """An order of places in which those of a tile lie close together, so that few tiles hold near ones."""
    size = np.maximum(np.ptp(xyz, axis=0), 1e-300)
    return np.lexsort(np.minimum((xyz - xyz.min(0)) / size * 16, 15).astype(np.int64).T)


def inverse_distances(left: np.ndarray, right: np.ndarray, q_left: np.ndarray, q_right: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """The sum of q_i q_j / r over all rows i of ``left`` and j of ``right`` (x, y, z), but those whose ids in ``same`` are equal.

    Squared distances of a tile are one matrix product about the common centre. Where they are small against the coordinates, whose
    squares cancel, they are taken again from the differences, so each keeps twelve digits or more. A distance of zero raises.
    """
    first, second = _along(left), _along(right)
    left, right, q_left, q_right = left[first], right[second], q_left[first], q_right[second]
    if same is not None:
        same = same[0][first], same[1][second]
    centre = (left.mean(0) + right.mean(0)) / 2
    a, b = left - centre, right - centre
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    near = NEAR * (a2.max() + b2.max())
    rows, cols = np.column_stack([-2 * a, a2, np.ones(len(a))]), np.ascontiguousarray(np.column_stack([b, np.ones(len(b)), b2]).T)
    total = 0.0
    for s in range(0, len(a), TILE[0]):
        for t in range(0, len(b), TILE[1]):
            i, j = slice(s, s + TILE[0]), slice(t, t + TILE[1])
            r = rows[i] @ cols[:, j]
            u = v = ()
            if not r.min() >= near:
                u, v = np.nonzero(~(r >= near))
                d = left[i][u] - right[j][v]
                r[u, v] = (d * d).sum(1)
            if same is not None:
                r[same[0][i, None] == same[1][None, j]] = np.inf
            if len(u) and not r[u, v].all():
                raise ZeroDivisionError("two charges, or a charge and an image, are at one place")
            np.sqrt(r, out=r)
            np.divide(1.0, r, out=r)
            total += float(q_left[i] @ (r @ q_right[j]))
    return total


def _direct(df: DataFrame, images: Sequence[tuple[float, float, float]], blocks: int | None) -> DataFrame:
    """(energy): the sum of q_i q_j / r over unordered pairs, plus half of each interaction, a charge's own ones included, with
    all charges shifted by each of ``images``.

    Rows are dealt to blocks, and each two blocks, or a block by itself, meet in a group of bounded size. Of a pair met once, an
    image counts as half itself and half its opposite. Rows with a null count for nothing.
    """
    rows = df.select("gid", *[F.col(c).cast("double").alias(c) for c in (*AXES, "q")]).dropna(subset=[*AXES, "q"])
    if blocks is None:
        n = rows.count()
        blocks = max(1, min(LEAST_BLOCKS, n // LEAST_ROWS), -(-n // BLOCK_ROWS))
    weights: dict[tuple[float, ...], float] = {}
    for image in images:
        for o in (tuple(map(float, image)), tuple(-float(x) for x in image)):
            o = tuple(x + 0.0 for x in o)  # -0.0 is 0.0
            weights[o] = weights.get(o, 0.0) + 0.5

    def met(group: pa.Table) -> pa.Table:
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        sides = [group.filter(pc.equal(group["block"], k)) for k in (a, b)]
        total = 0.0
        if all(map(len, sides)):
            (p, r), (q, w) = ([np.column_stack([side[c].to_numpy() for c in AXES]) for side in sides], [side["q"].to_numpy() for side in sides])
            total = inverse_distances(p, r, q, w, tuple(side["gid"].to_numpy() for side in sides) if a == b else None)
            total += sum(weight * inverse_distances(p, r + np.array(o), q, w) for o, weight in weights.items())
        return pa.table({"energy": [0.5 * total if a == b else total]})

    block = F.pmod(F.hash("gid"), F.lit(blocks))
    listed = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    listed = listed.select("*", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).drop("other")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(tasks, blocks * (blocks + 1) // 2)
    parts = listed.repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(met, "energy double")
    return parts.agg(F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy"))


def free_space(df: DataFrame, blocks: int | None = None) -> DataFrame:
    """The sum of q_i q_j / r over unordered pairs; ``gid`` is a key."""
    return _direct(df, [], blocks)


def nearest_images(particles: ParticleSet, offsets: Sequence[tuple[int, int, int]] | None = None, blocks: int | None = None) -> DataFrame:
    """``free_space`` plus half of each interaction with images under box offsets, the 26 nearest by default."""
    offsets = offsets or [o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]
    if (0, 0, 0) in map(tuple, offsets):
        raise ValueError("the box itself is no image")
    return _direct(particles.df, [tuple(k * e for k, e in zip(o, particles.domain.extent, strict=True)) for o in offsets], blocks)


def lambert_w(x: float) -> float:
    """The principal branch for x >= 0, by Newton's method."""
    w = math.log1p(x)
    for _ in range(60):
        step = (w * math.exp(w) - x) / (math.exp(w) * (1 + w))
        w -= step
        if abs(step) < 1e-15 * (1 + abs(w)):
            break
    return w


@dataclass(frozen=True)
class EwaldParameters:
    """The splitting of a periodic sum: alpha, the real cutoff, and wave vectors up to ``k_cut``."""

    domain: Domain
    alpha: float
    cutoff: float
    n_max: tuple[int, int, int]

    @classmethod
    def of(cls, domain: Domain, cutoff: float, eps: float = 1e-6, alpha: float | None = None) -> EwaldParameters:
        ss = math.sqrt(lambert_w(1 / eps))
        alpha = (ss / cutoff) ** 2 if alpha is None else alpha
        return cls(domain, alpha, cutoff, tuple(max(1, round(ss * e * math.sqrt(alpha) / math.pi)) for e in domain.extent))

    @property
    def k_cut(self) -> float:
        return min(2 * math.pi * n / e for n, e in zip(self.n_max, self.domain.extent, strict=True))

    @classmethod
    def balanced(cls, domain: Domain, particles: int, eps: float = 1e-6, pair_cost: float = 100.0) -> EwaldParameters:
        """The cutoff that gives the real and the reciprocal part of so many particles like work, ``pair_cost`` being a pair's
        against that of a particle and wave vector: both then grow by the power 3/2 of the particles, wave vectors by 1/2."""
        ss = math.sqrt(lambert_w(1 / eps))
        cutoff = ss * domain.volume ** (1 / 3) / (2 * math.pi**3 * pair_cost * max(1, particles)) ** (1 / 6)
        return cls.of(domain, min(cutoff, *domain.extent), eps)


def structure_factor(df: DataFrame, params: EwaldParameters, half: bool = False) -> DataFrame:
    """(nx, ny, nz, kx, ky, kz, coefficient, weight, re, im): S(k) = sum q e^(-i k.r), summed in a task before any shuffle.

    Of the full table all k; of the half one of each pair (k, -k), with weight 2. The coefficient is 4 pi / V e^(-k^2 / 4 alpha) / k^2.
    """
    sums = waves.structure(df, params, half)
    k = {f"k{a}": 2 * math.pi / e * F.col(f"n{a}") for a, e in zip(AXES, params.domain.extent, strict=True)}
    square = F.expr("kx * kx + ky * ky + kz * kz")
    coefficient = 4 * math.pi / params.domain.volume * F.exp(-square / (4 * params.alpha)) / square
    out = sums.withColumns(k).withColumn("coefficient", coefficient).withColumn("weight", F.lit(2.0 if half else 1.0))
    return out.select("nx", "ny", "nz", "kx", "ky", "kz", "coefficient", "weight", "re", "im")


def reciprocal_energy(df: DataFrame, params: EwaldParameters, half: bool = False) -> DataFrame:
    s = structure_factor(df, params, half)
    return s.agg(F.coalesce(F.sum(F.expr("0.5D * weight * coefficient * (re * re + im * im)")), F.lit(0.0)).alias("energy"))


def reciprocal_rows(df: DataFrame, params: EwaldParameters, half: bool = True) -> DataFrame:
    """(gid, u, potential, fx, fy, fz): each particle's half energy, potential and force of the reciprocal part; gid is a key."""
    field = waves.field(df, waves.structure(df, params, half), params, half)
    out = df.select("gid", "q").join(field, "gid")
    return out.select("gid", (0.5 * F.col("q") * F.col("potential")).alias("u"), "potential", *[(F.col("q") * F.col(f"g{a}")).alias(f"f{a}") for a in AXES])


#: How far the polynomial is fitted; beyond it erfc is next to the least double, and the exponential goes to 0.
ERFC_FIT = 26.0


@lru_cache(maxsize=1)
def _erfc_polynomial() -> list[float]:
    """Coefficients by powers of u, t = 2 / (2 + x) brought to -1..1, of log(erfc(x) / t) + x^2, which is smooth."""
    low = 2 / (2 + ERFC_FIT)

    def smooth(u: np.ndarray) -> np.ndarray:
        t = low + (u + 1) / 2 * (1 - low)
        x = 2 / t - 2
        return np.array([math.log(math.erfc(v) / w) + v * v for v, w in zip(x, t, strict=True)])

    return np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebinterpolate(smooth, 26)).tolist()


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, which Spark lacks, to twelve digits up to x = 6: a polynomial in 2 / (2 + x) under the exponential."""
    low = 2 / (2 + ERFC_FIT)
    t = 2 / (2 + x)
    u = (t - low) * (2 / (1 - low)) - 1
    value = F.lit(0.0)
    for c in reversed(_erfc_polynomial()):
        value = value * u + c
    return t * F.exp(value - x * x)


def real_rows(particles: ParticleSet, params: EwaldParameters) -> DataFrame:
    """(gid, u, potential, fx, fy, fz) of the screened pairs strictly within the cutoff."""
    root = math.sqrt(params.alpha)
    pairs = pair_table(particles, params.cutoff, ["q"]).where(F.col("r2") < params.cutoff**2)
    pairs = pairs.withColumn("r", F.sqrt("r2")).withColumn("e", erfc(root * F.col("r")))
    qq = F.col("q_i") * F.col("q_j")
    factor = -(qq / F.col("r2")) * (F.col("e") / F.col("r") + 2 * math.sqrt(params.alpha / math.pi) * F.exp(-params.alpha * F.col("r2")))
    sums = {"u": 0.5 * qq * F.col("e") / F.col("r"), "potential": F.col("q_j") * F.col("e") / F.col("r")}
    return accumulated(particles.df, pairs, sums | {f"f{a}": factor * F.col(f"d{a}") for a in AXES})


def self_energy(df: DataFrame, params: EwaldParameters) -> DataFrame:
    return df.agg((-math.sqrt(params.alpha / math.pi) * F.coalesce(F.sum(F.col("q") * F.col("q")), F.lit(0.0))).alias("energy"))


def ewald(particles: ParticleSet, params: EwaldParameters, half: bool = True) -> DataFrame:
    """(gid, u, potential, fx, fy, fz): all three parts; the sum of u is the energy of the periodic system."""
    recip, real = reciprocal_rows(particles.df, params, half), real_rows(particles, params)
    own = math.sqrt(params.alpha / math.pi)
    both = real.alias("a").join(recip.alias("b"), "gid").join(particles.df.select("gid", "q"), "gid")
    add = lambda c: F.col(f"a.{c}") + F.col(f"b.{c}")
    return both.select(
        "gid", (add("u") - own * F.col("q") * F.col("q")).alias("u"), (add("potential") - 2 * own * F.col("q")).alias("potential"), *[add(f"f{a}").alias(f"f{a}") for a in AXES]
    )


def potential_field(sources: ParticleSet, probes: DataFrame, params: EwaldParameters) -> DataFrame:
    """(gid, potential) at probe points (gid, x, y, z), from charges that are no probes; no probe may lie on a charge."""
    root = math.sqrt(params.alpha)
    probe_set = ParticleSet(probes.withColumn("q", F.lit(0.0)), sources.domain)
    pairs = pair_table(probe_set, params.cutoff, ["q"], others=sources).where(F.col("r2") < params.cutoff**2)
    near = accumulated(probes, pairs, {"near": F.col("q_j") * erfc(root * F.sqrt("r2")) / F.sqrt("r2")})
    far = waves.field(probes, waves.structure(sources.df, params, True), params, True).select("gid", F.col("potential").alias("far"))
    return near.join(far, "gid").select("gid", (F.col("near") + F.col("far")).alias("potential"))
