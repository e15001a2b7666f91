"""Forces, time steps and what is measured along a trajectory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import AXES
from ..functions.potentials import Potential
from ..functions.random import normal, uniforms
from ..particles import ParticleSet
from .pairs import accumulated, all_pairs, both_sides, pair_table


def energy_and_force(particles: ParticleSet, potential: Potential, pairs: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """gid, ``keep``, u (half of each pair's energy) and fx, fy, fz of every particle, from ordered pairs."""
    pairs = pair_table(particles, potential.cutoff) if pairs is None else pairs
    sums = {"u": potential.energy_column()} | {f"f{a}": v for a, v in potential.force_columns().items()}
    return accumulated(particles.df, pairs, sums, keep or [])


def symmetric_energy_and_force(particles: ParticleSet, potential: Potential) -> DataFrame:
    """As ``energy_and_force`` from half pairs, each written to both sides."""
    half = pair_table(particles, potential.cutoff, mode="half")
    u = potential.energy_column()
    values = {"u": (u, u)} | {f"f{a}": (v, -v) for a, v in potential.force_columns().items()}
    return accumulated(particles.df, both_sides(half, values), {k: F.col(k) for k in values})


def kick(dt: float) -> dict[str, Column]:
    return {f"v{a}": F.col(f"v{a}") + 0.5 * dt * F.col(f"f{a}") / F.col("mass") for a in AXES}


def verlet_first(df: DataFrame, dt: float) -> DataFrame:
    """Half a kick, then a drift."""
    return df.withColumns(kick(dt)).withColumns({a: F.col(a) + dt * F.col(f"v{a}") for a in AXES})


def verlet_second(df: DataFrame, dt: float) -> DataFrame:
    return df.withColumns(kick(dt))


def thermostat(df: DataFrame, dt: float, rate: float, temperature: float, seed: int = 0, step: int = 0) -> DataFrame:
    """With probability dt * rate a velocity is drawn anew from the normal distribution of variance T / m.

    Draws are keyed by seed, step and gid, so a trajectory does not depend on partitions or on retries.
    """
    drawn = uniforms(df, 7, seed, step, "draw_")
    width = F.sqrt(temperature / F.col("mass"))
    redraw = F.col("draw_0") <= dt * rate
    new = {f"v{a}": F.when(redraw, normal(F.col(f"draw_{2 * k + 1}"), F.col(f"draw_{2 * k + 2}")) * width).otherwise(F.col(f"v{a}")) for k, a in enumerate(AXES)}
    return drawn.withColumns(new).drop(*[f"draw_{k}" for k in range(7)])


def kinetic_energy(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.expr("0.5D * mass * (vx * vx + vy * vy + vz * vz)")), F.lit(0.0)).alias("kinetic"))


def max_displacement(df: DataFrame, dt: float) -> DataFrame:
    """dt times the largest velocity component: how far any particle moves in a step."""
    return df.agg((F.max(F.greatest(*[F.abs(F.col(f"v{a}")) for a in AXES])) * dt).alias("moved"))


def velocity_autocorrelation(first: DataFrame, now: DataFrame) -> DataFrame:
    """The mean over particles of v(0) . v(t)."""
    joined = first.select("gid", *[F.col(f"v{a}").alias(f"w{a}") for a in AXES]).join(now.select("gid", *[f"v{a}" for a in AXES]), "gid")
    return joined.agg(F.avg(F.expr("vx * wx + vy * wy + vz * wz")).alias("vaf"))


def radial_distribution(particles: ParticleSet, r_max: float | None = None, bins: int = 100) -> DataFrame:
    """(bin, n, r, g): minimum-image distances of unordered pairs in equal bins, and the distribution
    g = n V / (N (N - 1) 2 pi r^2 dr). Distances up to half the least extent come from the cell join; beyond that from all pairs."""
    domain = particles.domain
    half = 0.5 * min(domain.extent)
    r_max = half if r_max is None else r_max
    width = r_max / bins
    if r_max <= half:
        pairs = pair_table(particles, r_max, mode="half").where(F.col("r2") < r_max * r_max)
        r = F.sqrt("r2")
    else:
        every = all_pairs(particles.df, AXES, half=True)
        r = F.sqrt(reduce(lambda a, b: a + b, [F.pow(domain.minimum_image(a, F.col(f"{a}_j") - F.col(f"{a}_i")), F.lit(2)) for a in AXES]))
        pairs = every.where(r < r_max)
    counts = pairs.select(F.floor(r / width).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    n = particles.df.agg(F.count("*").alias("total"))
    centre = (F.col("bin") + 0.5) * width
    g = F.col("n") * domain.volume / (F.col("total") * (F.col("total") - 1) * 2 * F.pi() * centre * centre * width)
    return counts.crossJoin(F.broadcast(n)).select("bin", "n", centre.alias("r"), g.alias("g"))  # one row broadcast
