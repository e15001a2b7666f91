import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motes.domain import Domain
from motes.operators import coulomb, waves
from motes.particles import ParticleSet, from_arrays

EXTENT = (4.0, 5.0, 3.0)


def random_set(spark, n, seed):
    rng = np.random.default_rng(seed)
    xyz = (rng.random((n, 3)) - 0.5) * EXTENT
    q = rng.choice([-1.0, 1.0], n)
    return from_arrays(spark, Domain(EXTENT), x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2], q=q), xyz, q


def brute(xyz, q, params):
    """(n, S(n)) of all wave vectors, and each particle's potential and field from them."""
    n = np.stack(np.meshgrid(*[np.arange(-m, m + 1) for m in params.n_max], indexing="ij"), -1).reshape(-1, 3)
    k = 2 * math.pi * n / np.array(EXTENT)
    k2 = (k**2).sum(1)
    keep = (k2 > 0) & (k2 <= params.k_cut**2 * (1 + 1e-12))
    n, k, k2 = n[keep], k[keep], k2[keep]
    wave = np.exp(-1j * xyz @ k.T)
    back = 4 * math.pi / math.prod(EXTENT) * np.exp(-k2 / (4 * params.alpha)) / k2 * (q @ wave) * wave.conj()
    return n, q @ wave, back.real.sum(1), back.imag @ k


@pytest.mark.parametrize("half", [True, False])
@pytest.mark.parametrize(("slab", "batch"), [(1 << 22, 1 << 20), (200, 300)])
def test_sums_and_field_equal_brute_force(spark, monkeypatch, half, slab, batch):
    monkeypatch.setattr(waves, "SLAB", slab)
    monkeypatch.setattr(waves, "BATCH", batch)
    s, xyz, q = random_set(spark, 70, 3)
    params = coulomb.EwaldParameters.of(s.domain, 1.6, 1e-3)
    n, sk, potential, g = brute(xyz, q, params)
    got = {(r.nx, r.ny, r.nz): complex(r.re, r.im) for r in waves.structure(s.df, params, half).collect()}
    assert len(got) == len(n) // (2 if half else 1)
    want = dict(zip(map(tuple, n.tolist()), sk, strict=True))
    assert all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    rows = coulomb.reciprocal_rows(s.df, params, half).orderBy("gid").toPandas()
    assert np.allclose(rows["potential"], potential, atol=1e-9)
    assert np.allclose(rows[["fx", "fy", "fz"]], q[:, None] * g, atol=1e-9)
    assert (len(waves.slabs(params, half)) == 1) == (slab > 200)


def test_rows_without_a_place(spark):
    s, xyz, q = random_set(spark, 20, 5)
    params = coulomb.EwaldParameters.of(s.domain, 1.5, 1e-3)
    more = s.df.unionByName(spark.sql("select 100L as gid, null as x, 0D as y, 0D as z, 1D as q union all select 101L, 0D, 0D, double('nan'), 1D union all select 102L, 0D, 0D, 0D, null"), allowMissingColumns=True)
    clean = {(r.nx, r.ny, r.nz): r.re for r in waves.structure(s.df, params, True).collect()}
    assert {(r.nx, r.ny, r.nz): r.re for r in waves.structure(more, params, True).collect()} == pytest.approx(clean)
    rows = {r.gid: r for r in coulomb.reciprocal_rows(more, params).collect()}
    assert rows[100].potential is None and rows[101].potential is None and rows[102].potential is not None and rows[102].u is None
    assert len(rows) == 23
    empty = s.df.limit(0)
    assert waves.structure(empty, params, True).count() == 0 and coulomb.reciprocal_energy(empty, params).first().energy == 0
    assert coulomb.reciprocal_rows(empty, params).count() == 0


def test_balanced_work(spark):
    def sizes(n):
        p = coulomb.EwaldParameters.balanced(Domain((n ** (1 / 3),) * 3), n, 1e-6)
        return p.cutoff**3, math.prod(p.n_max)

    (r1, k1), (r2, k2) = sizes(10**6), sizes(10**8)
    assert 9 < r2 / r1 < 11 and 8 < k2 / k1 < 12
    s, _, _ = random_set(spark, 60, 7)
    total = lambda p: coulomb.ewald(s, p).agg(F.sum("u")).first()[0]
    balanced = coulomb.EwaldParameters.balanced(s.domain, 60, 1e-8, pair_cost=1000.0)
    assert total(balanced) == pytest.approx(total(coulomb.EwaldParameters.of(s.domain, 1.4, 1e-8)), rel=1e-6)


def test_erfc(spark):
    x = [k / 50 for k in range(1500)]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", coulomb.erfc(F.col("x")).alias("e")).collect()
    assert all(abs(r.e - math.erfc(r.x)) <= 1e-12 * math.erfc(r.x) for r in got if r.x <= 6)
    assert all(abs(r.e - math.erfc(r.x)) < 1e-17 for r in got if r.x > 6)


def test_no_join_with_wave_vectors(spark):
    s, _, _ = random_set(spark, 10, 1)
    params = coulomb.EwaldParameters.of(s.domain, 1.5, 1e-3)
    probes = ParticleSet(s.df, s.domain).df.select("gid", *[(F.col(a) / 3 + 0.01).alias(a) for a in "xyz"])
    for df in (coulomb.structure_factor(s.df, params), coulomb.reciprocal_rows(s.df, params), coulomb.potential_field(s, probes, params)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("half", [True, False])
def test_mesh_equals_plain_sums(spark, monkeypatch, half):
    """Crowded slabs in parts, places beyond the box and rows without a place included."""
    s, *_ = random_set(spark, 300, 11)
    more = spark.sql("select 900L as gid, 2D as x, -2.5D as y, 7D as z, 1D as q union all select 901L, null, 0D, 0D, 1D union all select 902L, 0D, double('nan'), 0D, 1D union all select 903L, 0D, 0D, 0D, null")
    df = s.df.unionByName(more, allowMissingColumns=True)
    params = coulomb.EwaldParameters.of(s.domain, 0.9, 1e-3)
    both = []
    for most in (1 << 40, 0):
        monkeypatch.setattr(waves, "MESH", most)
        monkeypatch.setattr(waves.mesh, "GROUP", 20)
        monkeypatch.setattr(waves.mesh, "BATCH", 7)
        sums = waves.structure(df, params, half).orderBy("nx", "ny", "nz").toPandas()
        both.append((sums, waves.field(df, waves.structure(df, params, half), params, half).orderBy("gid").toPandas()))
    (sums, rows), (meshed, read) = both
    assert (sums[["nx", "ny", "nz"]] == meshed[["nx", "ny", "nz"]]).all(axis=None)
    assert np.allclose(sums[["re", "im"]], meshed[["re", "im"]], rtol=0, atol=1e-11)
    assert (rows["gid"] == read["gid"]).all() and len(read) == 304
    assert np.allclose(rows.drop(columns="gid"), read.drop(columns="gid"), rtol=0, atol=1e-10, equal_nan=True)
    empty = s.df.limit(0)
    assert waves.structure(empty, params, half).count() == 0 and coulomb.reciprocal_rows(empty, params, half).count() == 0


def test_sums_of_many_waves_do_not_multiply_by_tasks(spark):
    """Each task used to hand on all wave vectors; now slabs of the mesh are handed on, and nothing is added up by wave vector."""
    s, *_ = random_set(spark, 50, 2)
    params = coulomb.EwaldParameters.of(s.domain, 0.2, 1e-4)
    assert waves.meshed(params) and not waves.meshed(coulomb.EwaldParameters.of(s.domain, 2.0, 1e-4))
    shown = waves.structure(s.df, params, True)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in shown and "HashAggregate" not in shown
