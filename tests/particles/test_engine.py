"""Analytic goldens, seeded properties and cross-method equivalence of the particle engine."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motes import kernels as K
from motes.domain import AXES, Domain, shell, stencil
from motes.functions import harmonics, potentials
from motes.operators import coulomb, dynamics, multipole
from motes.operators import pairs as P
from motes.particles import ParticleSet, from_arrays, wrapped_by_minimum
from motes.plans.integrate import RebuildPolicy, Schedule, integrate
from motes.sources import files, lattices


def random_set(spark, n, extent, seed, neutral=True):
    rng = np.random.default_rng(seed)
    e = np.array(extent)
    xyz = (rng.random((n, 3)) - 0.5) * e
    q = rng.uniform(-1, 1, n)
    if neutral:
        q -= q.mean()
    return from_arrays(spark, Domain(tuple(map(float, extent))), x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2], q=q), xyz, q


def images(extent, reach=1):
    r = range(-reach, reach + 1)
    return np.array([(a, b, c) for a in r for b in r for c in r]) * np.array(extent)


@pytest.mark.parametrize(("scale", "count"), [(1 - 1e-9, 0), (1 + 1e-9, 6), (math.sqrt(2) - 1e-9, 6), (math.sqrt(2) + 1e-9, 18), (math.sqrt(3) - 1e-9, 18), (math.sqrt(3) + 1e-9, 26)])
def test_cubic_lattice_neighbours(spark, scale, count):
    s = ParticleSet(lattices.cubic_lattice(spark, (10, 10, 10), (8.0, 8.0, 8.0)), Domain((8.0, 8.0, 8.0)))
    rows = P.accumulated(s.df, P.pair_table(s, 0.8 * scale), {"n": F.lit(1)}).collect()
    assert len(rows) == 1000 and {r.n for r in rows} == {count}


def test_fcc_neighbours(spark):
    s = ParticleSet(lattices.fcc_lattice(spark, (10, 10, 10), (8.0, 8.0, 8.0)), Domain((8.0, 8.0, 8.0)))
    rows = P.accumulated(s.df, P.pair_table(s, 0.8 - 1e-9), {"n": F.lit(1)}).collect()
    assert len(rows) == 4000 and {r.n for r in rows} == {12}


def test_lattice_errors(spark):
    for n, e in (((0, 1, 1), (1, 1, 1)), ((1, 1), (1, 1, 1)), ((), ()), ((1,), (-1,))):
        with pytest.raises(ValueError):
            lattices.cubic_lattice(spark, n, e)


@pytest.mark.parametrize("cutoff", [1.2, 1.9, 2.6, 3.9])
def test_few_cells_see_every_image(spark, cutoff):
    s, xyz, _ = random_set(spark, 40, (4, 4, 4), 5)
    d = xyz[None, :, None] + images((4, 4, 4), 2)[None, None] - xyz[:, None, None]
    r2 = (d**2).sum(-1)
    near = (r2 <= cutoff**2) & ~((np.arange(40)[:, None, None] == np.arange(40)[None, :, None]) & (np.abs(images((4, 4, 4), 2)).sum(1) == 0))
    for options in ({}, {"salt": 3}, {"sub": 2}):
        got = P.pair_table(s, cutoff, **options).agg(F.count("*"), F.sum("r2")).first()
        assert got[0] == near.sum() and got[1] == pytest.approx(r2[near].sum())
    half = P.pair_table(s, cutoff, mode="half").count()
    assert 2 * half == near.sum()
    with pytest.raises(ValueError):
        P.pair_table(s, 4.5)


def test_single_particle_equals_bulk(spark):
    s, *_ = random_set(spark, 100, (8, 8, 8), 11111)
    bulk = {r.gid: r.n for r in P.accumulated(s.df, P.pair_table(s, 1.6), {"n": F.lit(1)}).collect()}
    for k in (0, 17, 99):
        assert P.pair_table(s, 1.6, only=k).count() == bulk[k]
    assert {r.gid: r.n for r in P.neighbour_list(s, 1.6).collect()} == bulk


def test_all_to_all(spark):
    df = spark.range(200).withColumnRenamed("id", "gid").withColumn("a", F.col("gid"))
    rows = P.accumulated(df, P.all_pairs(df, ["a"], blocks=3), {"b": F.col("a_j")}).collect()
    assert all(r.b == 199 * 100 - r.gid for r in rows)
    assert P.all_pairs(df, ["a"], half=True, blocks=5).count() == 199 * 100


def test_no_nested_loop_in_pair_plans(spark):
    s, *_ = random_set(spark, 50, (8, 8, 8), 1)
    for df in (P.pair_table(s, 1.0), P.all_pairs(s.df, ["q"])):
        assert "NestedLoop" not in df._jdf.queryExecution().toString()


def test_access_modes(spark):
    df = spark.range(10).selectExpr("id as gid", "1.0D as pr", "9.0D as pw", "5.0D as pi", "7.0D as pi0", "id * 1.0D as prw")
    kernel = K.Kernel("all modes", {"pw": "a1", "prw": "a1", "pi": "pr", "pi0": "pr"}, arguments=("a1",))
    modes = {"pw": K.WRITE, "prw": K.RW, "pi": K.INC, "pi0": K.INC_ZERO}
    for r in K.particle_loop(df, kernel, modes, a1=3.0).collect():
        assert (r.pr, r.pw, r.prw, r.pi, r.pi0) == (1, 3, 3, 6, 1)
    assert kernel.name == "all_modes"
    with pytest.raises(ValueError):
        K.particle_loop(df, kernel, modes)
    for bad in ({"pw": K.READ}, {}):
        with pytest.raises(ValueError):
            K.particle_loop(df, K.Kernel("k", {"pw": "1"}), bad)
    with pytest.raises(ValueError):
        K.check(K.Kernel("k", {"pw": "1"}), ["pw"], {"pw": K.WRITE}, pair=True)
    with pytest.raises(ValueError):
        K.reduce_loop(df, K.Kernel("k", {"s": "1"}), {"s": K.WRITE})
    assert K.reduce_loop(df.limit(0), K.Kernel("k", {"s": "1"}), {"s": K.INC}, {"s": 4}).first()[0] == 4
    assert K.Kernel("k", {"x": "a + b * c - d / e"}).operations() == {"+": 1, "-": 1, "*": 1, "/": 1}


def test_edits_follow_ids(spark):
    rng = random.Random(97531)
    s = from_arrays(spark, Domain((4.0,) * 3), x=[0.1 * k - 1 for k in range(20)], y=[0.0] * 20, z=[0.0] * 20, w=[float(k) for k in range(20)])
    expected = {k: float(k) for k in range(20)}
    for step in range(3):
        gone = rng.sample(sorted(expected), 4)
        new = [100 + 10 * step + k for k in range(3)]
        with s.modify() as edit:
            edit.add(spark.createDataFrame([(g, 0.0, 0.0, 0.0) for g in new], "gid long, x double, y double, z double"))
            edit.remove(spark.createDataFrame([(g,) for g in gone], "gid long"))
        before, s = s.version, edit.result
        assert s.version > before
        expected = {k: v for k, v in (expected | {g: 0.0 for g in new}).items() if k not in gone}
    assert {r.gid: r.w for r in s.df.collect()} == expected
    assert s.checked(len(expected)).first()[0] == len(expected)
    with pytest.raises(Exception, match="expected"):
        s.checked(3).collect()
    with pytest.raises(ValueError):
        s.inserted(spark.range(1).selectExpr("id as gid", "0.0 as x"))


def test_edits_that_cannot_be_meant_raise(spark):
    s = from_arrays(spark, Domain((4.0,) * 3), x=[0.0, 1.0, -1.0], y=[0.0] * 3, z=[0.0] * 3)
    row = lambda *gids: spark.createDataFrame([(g, 0.5, 0.0, 0.0) for g in gids], "gid long, x double, y double, z double")
    for bad in (row(2), row(7, 7), row(None)):
        with pytest.raises(Exception, match="already"):
            s.inserted(bad).df.collect()
    assert s.inserted(row(7, 8)).count() == 5
    for gone in ([1, 9], [0, 1, 2, 9]):
        with pytest.raises(Exception, match="no particle has: 1, such as 9"):
            s.removed(spark.createDataFrame([(g,) for g in gone], "gid long")).df.collect()
    assert s.removed(s.df.select("gid")).df.collect() == []
    moved = s.edited(x="x + 0.5", y=F.lit(0.25))
    assert [(r.x, r.y) for r in moved.df.orderBy("gid").collect()] == [(0.5, 0.25), (1.5, 0.25), (-0.5, 0.25)] and moved.version > s.version
    with pytest.raises(Exception, match="outside the box"):
        s.edited(x="x + 1.5").df.collect()
    with pytest.raises(ValueError):
        s.edited(w="1")


def test_pairs_of_particles_outside_the_box_raise(spark):
    s = from_arrays(spark, Domain((4.0,) * 3), x=[1.95, 2.05], y=[0.0] * 2, z=[0.0] * 2)
    with pytest.raises(Exception, match="outside the box"):
        P.pair_table(s, 1.0).collect()
    assert P.pair_table(s.wrapped(), 1.0).count() == 2


def test_planes_re_enter_at_the_opposite_face(spark):
    domain = Domain((8.0,) * 3)
    for k, axis in enumerate(AXES):
        for side in (-1, 1):
            point = dict.fromkeys(AXES, 0.25) | {axis: side * 4.1}
            s = from_arrays(spark, domain, **{a: [v] * 10 for a, v in point.items()})
            assert [r.direction for r in s.escapes().collect()] == [(1 if side < 0 else 2) << 2 * k]
            assert {round(r[axis], 9) for r in s.wrapped().df.collect()} == {round(-side * 3.9, 9)}
    with pytest.raises(Exception, match="outside"):
        s.df.select(domain.cell("z", 4, strict=True)).collect()
    folded = wrapped_by_minimum(from_arrays(spark, domain, x=[0.0, 3.0, 9.0], y=[0.0, 1.0, 2.0], z=[5.0, 5.0, 5.0]).df, domain)
    assert [(r.x, r.y, r.z) for r in folded.orderBy("gid").collect()] == [(-1.5, -1, 0), (1.5, 0, 0), (-0.5, 1, 0)]


def test_stencils():
    assert sorted(stencil((1.0, 1.0, 1.0), 1.0)) == sorted([(0, 0, 0), *shell(1)])
    assert len(shell(2)) == 125 - 27
    assert len(stencil((0.5, 0.5, 0.5), 1.0)) == 125 and len(stencil((0.5, 0.5, 0.5), 0.8)) == 125 - 8


def test_potential_force_is_the_slope_where_it_should_be(spark):
    for p, true in ((potentials.lennard_jones(1.3, 0.9), True), (potentials.buckingham_physical(5, 1.5, 0.3, 2.5), True), (potentials.buckingham(5, 1.5, 0.3, 2.5), False)):
        rows = spark.createDataFrame([(r, (r + h) ** 2) for r in (0.95, 1.2, 1.9) for h in (-1e-5, 0.0, 1e-5)], "r double, r2 double")
        got = rows.withColumns({"u": F.expr(p.energy), "f": F.expr(p.force)}).collect()
        for k in range(0, 9, 3):
            slope = (got[k + 2].u - got[k].u) / 2e-5
            # F_i = f R with R from i to j: a repelling pair has f < 0, and f r is the energy's slope
            assert (abs(got[k + 1].f * got[k + 1].r - slope) < 1e-4 * max(1, abs(slope))) == true
    edge = spark.createDataFrame([(2.5**2 - 1e-9,), (2.5**2,)], "r2 double").select(potentials.lennard_jones().energy_column().alias("u")).collect()
    assert abs(edge[0].u) < 1e-8 and edge[1].u == 0


def test_symmetric_equals_ordered(spark):
    s = ParticleSet(lattices.cubic_lattice(spark, (5, 5, 5), (6.0, 6.0, 6.0)).withColumn("x", F.col("x") + 0.2 * F.sin("gid")), Domain((6.0,) * 3)).wrapped()
    lj = potentials.lennard_jones(1.0, 1.0, 2.0)
    a = {r.gid: r for r in dynamics.energy_and_force(s, lj).collect()}
    for r in dynamics.symmetric_energy_and_force(s, lj).collect():
        assert all(r[c] == pytest.approx(a[r.gid][c], abs=1e-9) for c in ("u", "fx", "fy", "fz"))
    cache = P.PairCache()
    assert cache.get(s, 2.0) is cache.get(s, 2.0)
    assert cache.get(s.wrapped(), 2.0) is not None and len(cache.tables) == 1


def test_pair_cache_keeps_sets_apart(spark):
    box, cache = Domain((6.0,) * 3), P.PairCache()
    near = from_arrays(spark, box, x=[0.0, 0.5], y=[0.0, 0.0], z=[0.0, 0.0])
    far = from_arrays(spark, box, x=[-2.0, 1.0], y=[0.0, 0.0], z=[0.0, 0.0])
    assert [cache.get(s, 1.0).count() for s in (near, far, near)] == [2, 0, 2]
    alone = near.removed(spark.createDataFrame([(1,)], "gid long"))
    assert [cache.get(s, 1.0).count() for s in (alone, near.within((-1, -1, -1), (1, 1, 1)))] == [0, 2]


def test_two_particles_conserve_energy(spark):
    s = from_arrays(spark, Domain((6.0,) * 3), x=[-0.6, 0.6], y=[0.0, 0.1], z=[2.9, 2.95], vx=[1.0, -1.0], vy=[0.0, 0.0], vz=[0.5, 0.5], mass=[40.0, 40.0])
    ticks = []
    out = integrate(s, potentials.lennard_jones(1.0, 1.0, 2.0), 0.005, 12, Schedule([(4, lambda k, _: ticks.append(k))]), every=3)
    total = [e[3] for e in out.energies]
    assert ticks == [4, 8, 12] and len(total) == 5
    assert max(total) - min(total) < 2e-3
    assert out.energy_frame().count() == 5
    policy = RebuildPolicy(0.2, 10)
    assert [policy.stale(0.04) for _ in range(3)] == [False, False, True]


def test_rdf_of_an_ideal_gas(spark):
    s, *_ = random_set(spark, 1500, (10, 10, 10), 3)
    rows = dynamics.radial_distribution(s, 5.0, 10).where("bin >= 4").collect()
    assert all(abs(r.g - 1) < 0.08 for r in rows)
    beyond = dynamics.radial_distribution(s, 6.0, 12).where("bin < 10").agg(F.sum("n")).first()[0]
    assert beyond == dynamics.radial_distribution(s, 5.0, 10).agg(F.sum("n")).first()[0]


# --- electrostatics


def direct(xyz, q, extent=None, reach=0):
    shifts = images(extent, reach) if extent else np.zeros((1, 3))
    d = xyz[None, :, None] + shifts[None, None] - xyz[:, None, None]
    r = np.sqrt((d**2).sum(-1))
    r[r == 0] = np.inf
    return 0.5 * np.einsum("i,j,ijk->", q, q, 1 / r)


def test_direct_sums(spark):
    s, xyz, q = random_set(spark, 60, (3, 4, 5), 93573)
    assert coulomb.free_space(s.df).first()[0] == pytest.approx(direct(xyz, q), rel=1e-12)
    assert coulomb.nearest_images(s).first()[0] == pytest.approx(direct(xyz, q, (3, 4, 5), 1), rel=1e-12)


def test_ewald_does_not_depend_on_the_split(spark):
    s, xyz, q = random_set(spark, 12, (6, 6, 6), 8123)
    totals, rows = [], []
    for cutoff in (2.0, 2.9):
        params = coulomb.EwaldParameters.of(s.domain, cutoff, 1e-8)
        got = coulomb.ewald(s, params).orderBy("gid").collect()
        totals.append(sum(r.u for r in got))
        rows.append(got)
    assert totals[0] == pytest.approx(totals[1], rel=1e-5)
    assert all(a[c] == pytest.approx(b[c], abs=2e-4) for a, b in zip(*rows, strict=True) for c in ("potential", "fx", "fy", "fz"))
    full = coulomb.reciprocal_energy(s.df, params).first()[0]
    assert full == pytest.approx(coulomb.reciprocal_energy(s.df, params, half=True).first()[0], rel=1e-12)
    # the force is minus the energy's slope
    moved = s.with_df(s.df.withColumn("x", F.col("x") + F.when(F.col("gid") == 3, 1e-4).otherwise(0.0)))
    slope = (coulomb.ewald(moved, params).agg(F.sum("u")).first()[0] - totals[1]) / 1e-4
    assert -slope == pytest.approx(rows[1][3].fx, abs=2e-3)


def test_rock_salt_madelung_constant(spark):
    s = ParticleSet(lattices.cubic_lattice(spark, (4, 4, 4), (4.0, 4.0, 4.0)).withColumn("q", F.expr("if((floor(x + 2) + floor(y + 2) + floor(z + 2)) % 2 = 0, 1.0D, -1.0D)")), Domain((4.0,) * 3))
    got = coulomb.ewald(s, coulomb.EwaldParameters.of(s.domain, 1.9, 1e-8)).agg(F.sum("u")).first()[0]
    assert 2 * got / 64 == pytest.approx(-1.7475645946, abs=1e-5)
    for boundary in ("pbc",):
        fmm = multipole.fmm(s, 3, 10, boundary).agg(F.sum("u")).first()[0]
        assert 2 * fmm / 64 == pytest.approx(-1.7475645946, abs=2e-3)


def test_potential_field_matches_particles(spark):
    s, xyz, q = random_set(spark, 10, (6, 6, 6), 4)
    params = coulomb.EwaldParameters.of(s.domain, 2.9, 1e-8)
    probe = spark.createDataFrame([(7, 0.3, -1.0, 2.9)], "gid long, x double, y double, z double")
    both = s.with_df(s.df.withColumn("q", F.col("q")).unionByName(probe.selectExpr("100 as gid", "x", "y", "z", "0.0D as q")))
    expected = coulomb.ewald(both, params).where("gid = 100").first().potential
    assert coulomb.potential_field(s, probe, params).first().potential == pytest.approx(expected, abs=1e-9)


def test_lambert_and_units():
    for x in (0.0, 0.5, 10.0, 1e8):
        w = coulomb.lambert_w(x)
        assert w * math.exp(w) == pytest.approx(x, rel=1e-12, abs=1e-12)
    assert coulomb.internal_to_ev() == pytest.approx(14.3996, abs=1e-3)


def test_harmonics(spark):
    rng = np.random.default_rng(0)
    p, o = rng.normal(size=(5, 3)) * 0.3, rng.normal(size=(5, 3)) * 0.1 + np.array([3.0, -2.0, 1.0])
    r, i = harmonics.regular(14, *p.T), harmonics.irregular(14, *o.T)
    assert np.allclose((np.conj(r) * i).sum(1).real, 1 / np.linalg.norm(o - p, axis=1), rtol=1e-8)
    a, b = np.array([[0.2, -0.1, 0.3]]), np.array([[-0.5, 0.4, 0.1]])
    m = np.conj(harmonics.regular(6, *(a + b).T)[0])
    assert np.allclose(harmonics.multipole_shift(6, tuple(b[0])) @ np.conj(harmonics.regular(6, *a.T)[0]), m)
    df = spark.createDataFrame([tuple(map(float, v)) for v in p], "x double, y double, z double")
    cols = harmonics.regular_columns(4, F.col("x"), F.col("y"), F.col("z"))
    got = df.select(*[c for pair in cols.values() for c in pair]).collect()
    for row, want in zip(got, harmonics.regular(4, *p.T), strict=True):
        for k, (l, m_) in enumerate(cols):
            assert complex(row[2 * k], row[2 * k + 1]) == pytest.approx(want[harmonics.place(l, m_)], abs=1e-12)


@pytest.mark.parametrize(("extent", "local"), [((10, 10, 10), False), ((10, 10, 10), True), ((8, 6, 5), False)])
def test_multilevel_energy(spark, extent, local):
    s, xyz, q = random_set(spark, 150, extent, 3418)
    got = multipole.multilevel_energy(s, 4 if not local else 3, 8, local).first()[0]
    assert got == pytest.approx(direct(xyz, q), rel=2e-3)


@pytest.mark.parametrize("boundary", ["free", "27", "pbc"])
def test_fmm(spark, boundary):
    s, xyz, q = random_set(spark, 60, (10, 10, 10), 12)
    rows = multipole.fmm(s, 3, 10, boundary).orderBy("gid").collect()
    u = sum(r.u for r in rows)
    if boundary == "pbc":
        other = coulomb.ewald(s, coulomb.EwaldParameters.of(s.domain, 3.3, 1e-8)).orderBy("gid").collect()
        assert u == pytest.approx(sum(r.u for r in other), rel=1e-3, abs=1e-3)
        assert all(a[c] == pytest.approx(b[c], abs=5e-3) for a, b in zip(rows, other, strict=True) for c in ("fx", "fy", "fz"))
    else:
        assert u == pytest.approx(direct(xyz, q, (10, 10, 10), int(boundary == "27")), rel=1e-3, abs=1e-3)
    d = xyz[:, None] - xyz[None]
    r = np.sqrt((d**2).sum(-1))
    r[r == 0] = np.inf
    if boundary == "free":
        force = (q[:, None, None] * q[None, :, None] * d / r[..., None] ** 3).sum(1)
        assert np.allclose(force, [[v.fx, v.fy, v.fz] for v in rows], atol=2e-3)
    assert len(multipole.interaction_list((0, 0, 0))) == len(multipole.interaction_list((1, 0, 1))) == 189


def test_periodic_direct_agrees_with_ewald(spark):
    s, *_ = random_set(spark, 10, (19, 19, 19), 8123)
    ewald = coulomb.ewald(s, coulomb.EwaldParameters.of(s.domain, 9.0, 1e-8)).agg(F.sum("u")).first()[0]
    assert multipole.periodic_direct(s, 12) == pytest.approx(ewald, rel=1e-4)


def test_wigner_matrices():
    b = 0.7
    c, s = math.cos(b), math.sin(b)
    want = [[(1 + c) / 2, s / math.sqrt(2), (1 - c) / 2], [-s / math.sqrt(2), c, s / math.sqrt(2)], [(1 - c) / 2, -s / math.sqrt(2), (1 + c) / 2]]
    assert np.allclose(np.abs(harmonics.wigner_d(1, b)), np.abs(want))
    for l in (2, 7, 12):
        assert np.allclose(harmonics.wigner_d(l, 0.3) @ harmonics.wigner_d(l, 0.5), harmonics.wigner_d(l, 0.8))
        # degree l of a rotated point is a rotation matrix times that of the point
        f = harmonics.to_normalised(l + 1)[l * l :]
        p = np.array([[0.3, -0.4, 0.5]])
        turn = np.array([[math.cos(0.9), 0, math.sin(0.9)], [0, 1, 0], [-math.sin(0.9), 0, math.cos(0.9)]])
        y, z = (harmonics.regular(l + 1, *q.T)[0][l * l :] * f for q in (p, p @ turn.T))
        assert np.allclose(harmonics.wigner_d(l, 0.9) @ y, z)


def test_native_kernel(spark):
    import pyarrow as pa
    import pyarrow.compute as pc

    s, *_ = random_set(spark, 50, (6, 6, 6), 2)

    def double(batches):
        for b in batches:
            yield pa.record_batch([b.column(b.schema.get_field_index("i")), pc.multiply(b.column(b.schema.get_field_index("r2")), 2.0)], ["i", "w"])

    pairs = P.pair_table(s, 1.5)
    got = P.accumulated(s.df, P.native_kernel(pairs, double, "i long, w double"), {"w": F.col("w")}).agg(F.sum("w")).first()[0]
    assert got == pytest.approx(2 * pairs.agg(F.sum("r2")).first()[0])


# --- files


def test_xyz_round_trip(spark, tmp_path):
    rng = np.random.default_rng(9)
    s = from_arrays(spark, Domain((100.0,) * 3), **{a: rng.uniform(-50, 50, 200) for a in AXES})
    files.write_xyz(s.df, f"{tmp_path}/out", comment="a frame")
    back = files.read_xyz(spark, f"{tmp_path}/out/part-*").orderBy("idx").collect()
    want = s.df.orderBy("gid").collect()
    assert all(max(abs(a[c] - b[c]) for c in AXES) < 1e-14 for a, b in zip(back, want, strict=True))
    assert back[0].num_atoms == 200 and back[0].label == "A" and back[0].comment == "a frame"
    (tmp_path / "bare.xyz").write_text("2\n\n1.0 2.0 3.0\n\n4.0 5.0 6.0\n")
    assert [(r.label, r.x) for r in files.read_xyz(spark, f"{tmp_path}/bare.xyz").orderBy("idx").collect()] == [(None, 1.0), (None, 4.0)]
    for step in (0, 5):
        files.append_frame(s.df, f"{tmp_path}/frames", step)
        files.track(s.df, 3, ["x"], f"{tmp_path}/track", step)
    files.frame_text(spark, f"{tmp_path}/frames", f"{tmp_path}/text")
    assert spark.read.text(f"{tmp_path}/text").count() == 404
    assert spark.read.parquet(f"{tmp_path}/track").count() == 2


def test_simulation_files(spark, tmp_path):
    body = ["title", "2 1 8", "4.0 0.0 0.0", "0.0 4.0 0.0", "0.0 0.0 5.0"]
    for k in range(8):
        body += [f"Na {k + 1}", f"{k}.5 {-k}.25 0.125", "1.0 2.0 3.0", f"{k} {k + 1} {k + 2}"]
    (tmp_path / "CONFIG").write_text("\n".join(body) + "\n")
    rows = files.dlpoly_config(spark, f"{tmp_path}/CONFIG").orderBy("idx").collect()
    assert len(rows) == 8 and (rows[3].symbol, rows[3].id, rows[3].x, rows[3].vy, rows[3].fz) == ("Na", 4, 3.5, 2.0, 5.0)
    assert files.dlpoly_domain(spark, f"{tmp_path}/CONFIG").extent == (4.0, 4.0, 5.0)
    (tmp_path / "CONTROL").write_text("# c\n\nENSEMBLE NVE\nsteps 10\nequil steps 5\nFINISH\nfinish\nafter 1\n")
    control = files.dlpoly_control(spark, f"{tmp_path}/CONTROL")
    assert control.count() == 4 and files.dlmonte_control(spark, f"{tmp_path}/CONTROL").count() == 6
    assert [r.tokens for r in files.directive_values(control, "ensemble").collect()] == [["NVE"]]
    assert [r.tokens for r in files.directive_values(control, "Equil Steps").collect()] == [["5"]]
    (tmp_path / "MONTE").write_text("\n".join(["h"] * 7 + ["Na core", "0.1 0.2 0.3", "Cl core", "0.4 0.5 0.6"]) + "\n")
    assert [(r.type, r.x) for r in files.dlmonte_positions(spark, f"{tmp_path}/MONTE").orderBy("idx").collect()] == [("Na core", 0.1), ("Cl core", 0.4)]
    (tmp_path / "BAD").write_text("\n".join(["h"] * 7 + ["one"]) + "\n")
    with pytest.raises(Exception, match="unknown line"):
        files.dlmonte_positions(spark, f"{tmp_path}/BAD").collect()


def test_streamed_frames(spark, tmp_path):
    from motes.streaming.trajectory import frames, kinetic_by_step

    s = from_arrays(spark, Domain((6.0,) * 3), x=[0.0, 1.0], y=[0.0, 1.0], z=[0.0, 1.0], vx=[1.0, 2.0], vy=[0.0, 0.0], vz=[0.0, 0.0], mass=[2.0, 2.0])
    for step in (0, 1):
        files.append_frame(s.df, f"{tmp_path}/frames", step)
    stream = kinetic_by_step(frames(spark, f"{tmp_path}/frames", spark.read.parquet(f"{tmp_path}/frames").schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("kinetic").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.step, r.particles, r.kinetic) for r in spark.sql("select * from kinetic order by step").collect()] == [(0, 2, 5.0), (1, 2, 5.0)]
