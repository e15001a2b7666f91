"""Particle sets over the given tables: ``part`` seen as charged, moving particles on a jittered lattice.

All coordinates are exact binary fractions, so distances are the same in any engine.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import Domain
from ..particles import ParticleSet

#: Cutoff of the registered pair queries, in lattice spacings.
CUTOFF = 2.0


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice")


def particles(spark: SparkSession, sf_dir: str) -> ParticleSet:
    """gid, x, y, z, vx, vy, vz, mass, q over the rows of ``part``; the box's edge is the least that holds a unit lattice."""
    df = part(spark, sf_dir)
    n = math.ceil(round((df.agg(F.max("p_partkey")).first()[0] + 1) ** (1 / 3), 9))
    k = F.col("p_partkey")
    place = {"x": k % n, "y": F.floor(k / n) % n, "z": F.floor(k / (n * n)) % n}
    jitter, speed = {"x": 37, "y": 101, "z": 29}, {"x": 53, "y": 71, "z": 89}
    cols = [(place[a] + 0.5 - n / 2 + ((k * jitter[a]) % 64 - 32) / 1024.0).alias(a) for a in "xyz"]
    cols += [(((k * speed[a]) % 128 - 64) / 64.0).alias(f"v{a}") for a in "xyz"]
    cols += [(1.0 + k % 4).alias("mass"), F.when(k % 2 == 0, 1.0).otherwise(-1.0).alias("q")]
    return ParticleSet(df.select(k.alias("gid"), *cols), Domain((float(n),) * 3))


#: The same in SQL, as a prefix of every statement: ``p`` and the box's edge ``e``.
SQL = """
with recursive b as (select ceil(round(power(max(p_partkey) + 1, 1e0 / 3), 9)) as e, cast(ceil(round(power(max(p_partkey) + 1, 1e0 / 3), 9)) as bigint) as n from part),
p as (select p_partkey as gid,
    (p_partkey % n) + 0.5e0 - n / 2e0 + ((p_partkey * 37) % 64 - 32) / 1024e0 as x,
    (cast(floor(p_partkey / cast(n as double)) as bigint) % n) + 0.5e0 - n / 2e0 + ((p_partkey * 101) % 64 - 32) / 1024e0 as y,
    (cast(floor(p_partkey / cast(n * n as double)) as bigint) % n) + 0.5e0 - n / 2e0 + ((p_partkey * 29) % 64 - 32) / 1024e0 as z,
    ((p_partkey * 53) % 128 - 64) / 64e0 as vx, ((p_partkey * 71) % 128 - 64) / 64e0 as vy, ((p_partkey * 89) % 128 - 64) / 64e0 as vz,
    1e0 + p_partkey % 4 as mass, case when p_partkey % 2 = 0 then 1e0 else -1e0 end as q, e, n from part, b),
d as (select a.gid as i, b.gid as j, a.q as q_i, b.q as q_j,
    b.x - a.x - a.e * round((b.x - a.x) / a.e) as dx, b.y - a.y - a.e * round((b.y - a.y) / a.e) as dy, b.z - a.z - a.e * round((b.z - a.z) / a.e) as dz
    from p a, p b where a.gid <> b.gid),
pairs as (select *, dx * dx + dy * dy + dz * dz as r2 from d where dx * dx + dy * dy + dz * dz <= 4e0)
"""
