"""Half lists over boxes of few cells, and velocities drawn by key."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motes.domain import AXES, Domain
from motes.functions import potentials, random
from motes.operators import dynamics
from motes.operators import pairs as P
from motes.particles import ParticleSet, from_arrays
from motes.plans.integrate import HeatBath, integrate


def cloud(spark, n, extent, seed=5, **more):
    rng = np.random.default_rng(seed)
    xyz = (rng.random((n, 3)) - 0.5) * np.array(extent)
    return from_arrays(spark, Domain(tuple(map(float, extent))), x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2], **more)


def one_way(rows):
    """Pairs turned so that i < j, or the shift of a self image is the positive one."""
    flip = lambda r: (r.j, r.i, -r.sx, -r.sy, -r.sz) if (r.i, 0, 0, 0) > (r.j, r.sx, r.sy, r.sz) else (r.i, r.j, r.sx, r.sy, r.sz)
    return sorted(flip(r) for r in rows)


@pytest.mark.parametrize("extent", [(1.0, 1.2, 1.9), (2.0, 2.5, 1.1), (3.0, 3.0, 3.9), (2.2, 1.0, 4.5)])
@pytest.mark.parametrize("sub", [1, 2])
def test_half_stencil_meets_each_pair_once(spark, extent, sub):
    s = cloud(spark, 60, extent)
    ordered = P.pair_table(s, 1.0, sub=sub).select("i", "j", "sx", "sy", "sz").collect()
    half = one_way(P.pair_table(s, 1.0, mode="half", sub=sub).select("i", "j", "sx", "sy", "sz").collect())
    assert len(set(half)) == len(half) and 2 * len(half) == len(ordered)
    assert half == sorted(set(one_way(ordered)))


def test_half_stencil_lists_fourteen_cells(spark):
    s = cloud(spark, 50, (4.0, 4.0, 4.0))
    every = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    n = s.domain.cell_counts(1.0)
    assert len(P.forward(every)) == 14
    assert 27 * P.listed(s.df, s.domain, n, P.forward(every)).count() == 14 * P.listed(s.df, s.domain, n, every).count()


def test_half_list_holds_each_pair_in_one_list(spark):
    s = cloud(spark, 80, (3.5, 3.5, 3.5))
    full = {(r.gid, j) for r in P.neighbour_list(s, 1.0).collect() for j in r.neighbours}
    half = [(r.gid, j) for r in P.half_neighbour_list(s, 1.0).collect() for j in r.neighbours]
    assert P.half_neighbour_list(s, 1.0).count() == 80
    assert sorted((min(p), max(p)) for p in half) == sorted({(min(p), max(p)) for p in full})


def test_half_pairs_refuse_sides(spark):
    s = cloud(spark, 5, (3.0, 3.0, 3.0))
    with pytest.raises(ValueError, match="half pairs"):
        P.pair_table(s, 1.0, mode="half", only=1)
    with pytest.raises(ValueError, match="half pairs"):
        P.pair_table(s, 1.0, mode="half", others=s)


def gas(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("gid"), *[F.lit(0.25).alias(a) for a in AXES], *[F.lit(9.0).alias(f"v{a}") for a in AXES], F.lit(4.0).alias("mass"))


def test_uniform_numbers(spark):
    rows = random.uniforms(gas(spark, 20000), 3, seed=11).select("gid", "u0", "u1", "u2").collect()
    u = np.array([[r.u0, r.u1, r.u2] for r in rows])
    assert (u > 0).all() and (u <= 1).all() and len(np.unique(u)) == u.size
    for k in range(3):
        counts = np.histogram(u[:, k], 50, (0, 1))[0]
        assert ((counts - 400.0) ** 2 / 400).sum() < 100  # 49 degrees of freedom
    assert np.abs(np.corrcoef(u.T) - np.eye(3)).max() < 0.03
    order = u[np.argsort([r.gid for r in rows]), 0]
    assert abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.03


def test_uniform_numbers_against_plain_integers(spark):
    gids = [0, 1, 7, 2**31, 2**32 + 5, 2**62, -1, None]
    df = spark.createDataFrame([(g,) for g in gids], "gid long")
    for r in random.uniforms(df, 2, seed=-3, step=2**33).collect():
        g = (r.gid or 0) & (1 << 64) - 1
        for k, got in enumerate((r.u0, r.u1)):
            lanes = [random.mixed(random.mixed(random.mixed(random.start(n, -3, 2**33) ^ g & random.MASK) ^ g >> 32) ^ k) for n in (0, 1)]
            assert got == ((lanes[0] << 21) + (lanes[1] >> 11) + 1) / 2**53


def test_thermostat_redraws_velocities(spark):
    out = dynamics.thermostat(gas(spark, 20000), 0.5, 0.6, 2.0, seed=1, step=3).collect()
    new = np.array([[r.vx, r.vy, r.vz] for r in out if (r.vx, r.vy, r.vz) != (9.0, 9.0, 9.0)])
    assert len(new) == pytest.approx(20000 * 0.3, rel=0.05)
    assert new.var(axis=0) == pytest.approx([0.5] * 3, rel=0.06) and np.abs(new.mean(axis=0)).max() < 0.04
    assert np.abs(np.corrcoef(new.T) - np.eye(3)).max() < 0.05


def test_draws_do_not_depend_on_partitions(spark):
    def rows(parts, step):
        return sorted(map(tuple, dynamics.thermostat(gas(spark, 500, parts), 0.5, 0.6, 2.0, seed=1, step=step).collect()))

    assert rows(1, 3) == rows(8, 3) != rows(8, 4)
    assert dynamics.thermostat(gas(spark, 0), 0.5, 0.6, 2.0).count() == 0


def test_integrator_with_a_bath(spark):
    def end(bath, parts):
        df = cloud(spark, 40, (4.0, 4.0, 4.0), mass=[1.0] * 40, vx=[0.5] * 40, vy=[0.0] * 40, vz=[0.0] * 40).df.repartition(parts)
        s = ParticleSet(df, Domain((4.0, 4.0, 4.0)))
        out = integrate(s, potentials.null(1.0), 0.01, 2, bath=bath)
        return {r.gid: (r.vx, r.vy, r.vz) for r in out.state.df.collect()}

    bath = HeatBath(temperature=1.0, rate=30.0, seed=4)
    cold, one, eight = end(None, 2), end(bath, 1), end(bath, 8)
    assert set(cold.values()) == {(0.5, 0.0, 0.0)}
    assert one == eight
    touched = sum(v != (0.5, 0.0, 0.0) for v in one.values())
    assert 10 <= touched <= 32  # 1 - 0.7^2 of 40
    assert math.isfinite(sum(map(sum, one.values())))
