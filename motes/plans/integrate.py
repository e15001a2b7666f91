"""Time stepping as a bounded driver loop: each step is a plan over all particles.

Lineage is cut by writing the state to ``spark.checkpoint.dir`` every few steps, so that a lost executor costs a re-read.
Pair tables reach a little further than the cutoff (the skin) and are rebuilt only when the fastest particle may
have crossed half of it, or after a set number of steps.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import AXES
from ..functions.potentials import Potential
from ..operators.dynamics import energy_and_force, kinetic_energy, max_displacement, thermostat, verlet_first, verlet_second
from ..operators.pairs import pair_table
from ..particles import ParticleSet


def cut(df: DataFrame) -> DataFrame:
    """``df`` from files of the shared folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="motes-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class Schedule:
    """Callbacks every k ticks: ``items`` maps k to functions of (step, state)."""

    items: list[tuple[int, Callable]]
    step: int = 0

    def tick(self, state: ParticleSet) -> None:
        self.step += 1
        for every, act in self.items:
            if self.step % every == 0:
                act(self.step, state)


@dataclass
class RebuildPolicy:
    """Says when a pair table of a given skin no longer covers what moved: the fastest component's paths
    summed up to half the skin, or ``reuse`` steps."""

    skin: float
    reuse: int
    moved: float = 0.0
    steps: int = 0

    def stale(self, moved: float) -> bool:
        self.moved += moved
        self.steps += 1
        return self.moved >= 0.5 * self.skin or self.steps >= self.reuse

    def reset(self) -> None:
        self.moved, self.steps = 0.0, 0


@dataclass(frozen=True)
class HeatBath:
    """An Andersen thermostat: after a step a particle's velocity is drawn anew with probability ``rate`` times the step's length."""

    temperature: float
    rate: float
    seed: int = 0


@dataclass
class Trajectory:
    """Energies by step, and the last state."""

    state: ParticleSet
    energies: list[tuple[int, float, float, float]] = field(default_factory=list)

    def energy_frame(self) -> DataFrame:
        return self.state.df.sparkSession.createDataFrame(self.energies, "step int, kinetic double, potential double, total double")


def _forces(state: ParticleSet, potential: Potential, table: DataFrame) -> ParticleSet:
    """The state with fx, fy, fz and u from a table of who may meet whom, whose distances are taken anew."""
    df = state.df
    p = df.select("gid", *AXES)
    near = table.select("i", "j", "sx", "sy", "sz")
    left = p.select(F.col("gid").alias("i"), *[F.col(a).alias(f"{a}_i") for a in AXES])
    right = p.select(F.col("gid").alias("j"), *[F.col(a).alias(f"{a}_j") for a in AXES])
    pairs = near.join(left, "i").join(right, "j")
    for a, e in zip(AXES, state.domain.extent, strict=True):
        pairs = pairs.withColumn(f"d{a}", F.col(f"{a}_j") + e * F.col(f"s{a}") - F.col(f"{a}_i"))
    pairs = pairs.withColumn("r2", F.expr("dx * dx + dy * dy + dz * dz"))
    found = energy_and_force(state, potential, pairs)
    rest = df.drop("fx", "fy", "fz", "u")
    return state.with_df(rest.join(found, "gid"), moved=False)


def integrator_range(steps: int, state: ParticleSet, potential: Potential, dt: float, skin: float = 0.2, reuse: int = 10, keep: int = 5, bath: HeatBath | None = None) -> Iterator[tuple[int, ParticleSet]]:
    """Velocity Verlet, yielding (step, state) with forces and u; step 0 is the start. Positions leave the box
    between rebuilds, when they are wrapped; a wrapped position and its pairs stay the same particle by gid. With a
    ``bath``, the second half of a step ends with its redraws."""
    policy = RebuildPolicy(skin, reuse)
    state = state.wrapped()
    table = pair_table(state, potential.cutoff + skin).select("i", "j", "sx", "sy", "sz").persist()
    state = _forces(state, potential, table)
    state = state.with_df(cut(state.df), moved=False)
    yield 0, state
    for step in range(1, steps + 1):
        moved = state.with_df(verlet_first(state.df, dt))
        if policy.stale(max_displacement(moved.df, dt).first()[0] or 0.0):
            policy.reset()
            moved = moved.wrapped()
            moved = moved.with_df(cut(moved.df))
            table.unpersist()
            table = pair_table(moved, potential.cutoff + skin).select("i", "j", "sx", "sy", "sz").persist()
        state = _forces(moved, potential, table)
        state = state.with_df(verlet_second(state.df, dt), moved=False)
        if bath:
            state = state.with_df(thermostat(state.df, dt, bath.rate, bath.temperature, bath.seed, step), moved=False)
        if step % keep == 0 or step == steps:
            state = state.with_df(cut(state.df), moved=False)
        yield step, state
    table.unpersist()


def integrate(state: ParticleSet, potential: Potential, dt: float, steps: int, schedule: Schedule | None = None, every: int = 1, **options) -> Trajectory:
    """Steps through ``integrator_range`` and keeps the energies of every so many steps."""
    out = Trajectory(state)
    for step, now in integrator_range(steps, state, potential, dt, **options):
        out.state = now
        if step % every == 0:
            kinetic = kinetic_energy(now.df).first()[0]
            energy = now.df.agg(F.sum("u")).first()[0] or 0.0
            out.energies.append((step, kinetic, energy, kinetic + energy))
        if schedule and step:
            schedule.tick(now)
    return out
