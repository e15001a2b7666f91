"""What keeps queries going on large tables: plans, work that follows the input, ids beyond those of the small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motes.domain import Domain
from motes.functions.harmonics import irregular, place
from motes.operators import coulomb, multipole, waves
from motes.operators import pairs as P
from motes.operators.hierarchy import levels_for
from motes.particles import from_arrays
from motes.plans.tables import particles
from motes.queries import queries

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["salted_pairs", "half_pairs", "sub_cell_pairs"])
def test_listings_are_not_sent_to_every_task(spark, name):
    shown = plan(queries()[name](spark, SMALL))
    assert "Broadcast" not in shown and "SortMergeJoin" in shown


def test_sum_of_others_makes_no_pairs(spark):
    df = spark.range(50).selectExpr("id as gid", "id * 3 - 20 as a")
    pairs = P.accumulated(df, P.all_pairs(df, ["a"], blocks=3), {"b": F.col("a_j")})
    assert sorted(P.sum_of_others(df, F.col("a")).collect()) == sorted(pairs.collect())
    assert "HashJoin" not in plan(queries()["all_to_all_sum"](spark, SMALL))


def test_sum_of_products_makes_no_pairs(spark):
    df = spark.range(50).selectExpr("id as gid", "(id * 53 % 128 - 64) / 64D as a")
    pairs = P.all_pairs(df, ["a"], half=True).agg(F.count("*"), F.sum(F.expr("a_i * a_j")))
    assert tuple(P.sum_of_products(df, F.col("a")).first()) == tuple(pairs.first())
    assert P.sum_of_products(df.limit(0), F.col("a")).first().n == 0
    assert "HashJoin" not in plan(queries()["all_to_all_half"](spark, SMALL))


def beyond_a_million(spark, tmp_path) -> str:
    spark.sql("select * from values (1L), (2L), (5L), (9L), (1000005L), (1000009L), (1000010L) as t(p_partkey)").selectExpr(
        "p_partkey", "1 as p_size", "1D as p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_inserted_ids_may_meet_those_of_a_large_table(spark, tmp_path):
    rows = queries()["insert_missing_zero"](spark, beyond_a_million(spark, tmp_path)).collect()
    assert sorted((r.gid, r.mass > 0) for r in rows) == [
        (1, True), (2, True), (5, True), (9, True), (1000005, False), (1000005, True), (1000009, True), (1000010, True), (2000005, False), (2000010, False)]


def test_removals_leave_rows_of_the_same_transaction(spark, tmp_path):
    """1000005 is removed, and added again under the id of 5."""
    rows = queries()["modify_transaction"](spark, beyond_a_million(spark, tmp_path)).collect()
    assert sorted((r.gid, r.q) for r in rows) == [(1, -1), (2, 1), (5, -1), (1000005, -1), (1000009, -1), (1000010, 1), (2000005, -1), (2000010, 1)]


def test_levels_follow_the_particles():
    assert [levels_for(n) for n in (0, 20_000, 120_000, 1_200_000, 7_200_000)] == [3, 3, 4, 5, 6]
    assert levels_for(10**6, (1, 1, 1)) == 3


@pytest.mark.parametrize("name", ["multilevel_energy", "fast_multipole_energy"])
def test_near_particles_are_not_sent_to_every_task(spark, name):
    """Broadcasts are one row or a list of offsets: no side of a join on cells is one."""
    joins = [line for line in plan(queries()[name](spark, SMALL)).splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "cx#" in line]


def test_wave_sums_run_in_all_tasks(spark):
    """A table of one file is read by one task; the sums over wave vectors are not left to it."""
    df = particles(spark, SMALL).df
    params = coulomb.EwaldParameters(particles(spark, SMALL).domain, 0.35, 2.0, (2, 2, 2))
    assert "REPARTITION_BY_NUM" in plan(waves.structure(df, params, True))


@pytest.mark.parametrize("name", ["coulomb_free_direct", "coulomb_nearest_direct", "coulomb_images_direct", "periodic_direct_energy"])
def test_direct_sums_make_no_rows_of_pairs(spark, name):
    shown = plan(queries()[name](spark, SMALL))
    assert "Join" not in shown and "FlatMapGroupsInArrow" in shown


def drawn(n, shift=0.0, spread=1.0):
    rng = np.random.default_rng(7)
    return rng.uniform(-0.5, 0.5, (n, 3)) * spread + shift, rng.uniform(-1, 1, n)


@pytest.mark.parametrize(("shift", "spread"), [(0.0, 10.0), (1e6, 1.0), (0.0, 1e-6)])
def test_tiles_keep_their_digits(shift, spread):
    """Near and far from the origin, with a crowd of charges in a large box, and over several tiles."""
    xyz, q = drawn(1500, shift, spread)
    xyz = np.concatenate([xyz, [[shift + 40, shift, shift - 30], [shift, shift + 50, shift]]])
    q, ids = np.append(q, [1, -0.5]), np.arange(1502)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got, terms = coulomb.inverse_distances(xyz, xyz, q, q, (ids, ids)), q[:, None] * q[None] / d
    assert abs(got - terms.sum()) < 1e-12 * np.abs(terms).sum()


def test_blocks_and_offsets_of_direct_sums(spark):
    """Any blocks, offsets without their opposites, and a null charge, against a plain sum."""
    xyz, q = drawn(90, 0.0, 4.0)
    s = from_arrays(spark, Domain((4.0, 5.0, 6.0)), x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2], q=q)
    s = s.with_df(s.df.union(spark.sql("select 90L, 0D, 0D, 0D, cast(null as double)")))
    d = xyz[None] - xyz[:, None]
    own = np.sqrt((d**2).sum(-1))
    np.fill_diagonal(own, np.inf)
    want = 0.5 * (q[:, None] * q / own).sum()
    for o in ((1, 0, 0), (0, -1, 1)):
        want += 0.5 * (q[:, None] * q / np.sqrt(((d + np.array(o) * [4, 5, 6]) ** 2).sum(-1))).sum()
    for blocks in (None, 1, 5):
        assert coulomb.nearest_images(s, [(1, 0, 0), (0, -1, 1)], blocks).first().energy == pytest.approx(want, rel=1e-12)
    with pytest.raises(ValueError, match="no image"):
        coulomb.nearest_images(s, [(0, 0, 0)])


def test_charges_at_one_place_raise(spark):
    s = from_arrays(spark, Domain((4.0,) * 3), x=[1.0, 1.0, 0.0], y=[1.0, 1.0, 0.0], z=[0.5, 0.5, 0.0], q=[1.0, 1.0, -1.0])
    with pytest.raises(Exception, match="at one place"):
        coulomb.free_space(s.df).first()
    assert coulomb.free_space(s.df.limit(0)).first().energy == 0


def test_expansions_at_particles_make_no_rows(spark, monkeypatch):
    """A row a particle and listed cell was made; now cells with their lists are groups, in parts where they hold many particles."""
    got = queries()["multilevel_energy"](spark, SMALL)
    assert "Join" not in plan(got) and "FlatMapCoGroupsInArrow" in plan(got)
    monkeypatch.setattr(multipole, "GROUP", 2)
    monkeypatch.setattr(multipole, "PLACES", 100)
    assert queries()["multilevel_energy"](spark, SMALL).first().energy == pytest.approx(got.first().energy, rel=1e-12)


def test_expansions_at_places_equal_their_harmonics():
    xyz, _ = drawn(40, 0.0, 6.0)
    coefficient = np.random.default_rng(2).normal(size=(2, 5, 21))
    half = [(l, m) for l in range(6) for m in range(l + 1)]
    i = irregular(6, *xyz.T)[:, [place(l, m) for l, m in half]]
    twice = np.array([2.0 if m else 1.0 for _, m in half])
    want = (i[:, None] * (coefficient[0] + 1j * coefficient[1])).real @ twice
    got = multipole._expanded(6, [np.repeat(v[:, None], 5, 1) for v in xyz.T], *coefficient)
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12 * abs(want).max())


def test_tiles_hold_places_close_together():
    """Near distances are looked for in tiles that hold one; rows in the order of their ids gave every tile some."""
    xyz, _ = drawn(4096, 0.0, 10.0)
    tiles = xyz[coulomb._along(xyz)].reshape(64, 64, 3)
    assert np.ptp(tiles, axis=1)[:, 2].mean() < 1.5 < 8 < np.ptp(xyz.reshape(64, 64, 3), axis=1)[:, 2].mean()
