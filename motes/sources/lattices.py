"""Lattices generated by Spark, cell-centred and centred on the origin."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = ("x", "y", "z")


def cubic_lattice(spark: SparkSession, n: Sequence[int], extent: Sequence[float]) -> DataFrame:
    """(gid, x, y, z): the last axis runs fastest. Beyond three dimensions columns are x0, x1 and so on."""
    if len(n) != len(extent) or not n:
        raise ValueError(f"as many counts as extents are needed, and one at least: {n}, {extent}")
    if min(n) < 1 or min(extent) < 0:
        raise ValueError(f"counts have to be positive and extents not negative: {n}, {extent}")
    names = _NAMES[: len(n)] if len(n) <= 3 else [f"x{k}" for k in range(len(n))]
    cols, below = {}, math.prod(n)
    for name, count, e in zip(names, n, extent, strict=True):
        below //= count
        place = F.floor(F.col("gid") / below) % count
        cols[name] = F.lit(-0.5 * e + 0.5 * e / count) + place * F.lit(float(e) / count)
    return spark.range(math.prod(n)).withColumnRenamed("id", "gid").withColumns(cols)


def fcc_lattice(spark: SparkSession, n: Sequence[int], extent: Sequence[float]) -> DataFrame:
    """(gid, x, y, z) of a face-centred cubic lattice: four atoms a unit cell, the first axis running fastest."""
    if len(n) != 3 or len(extent) != 3 or min(n) < 1:
        raise ValueError(f"three positive counts and three extents are needed: {n}, {extent}")
    w = [float(e) / int(k) for e, k in zip(extent, n, strict=True)]
    base = F.array(*[F.struct(*[F.lit(0.5 * f).alias(a) for f, a in zip(atom, "abc", strict=True)]) for atom in ((0, 0, 0), (1, 1, 0), (1, 0, 1), (0, 1, 1))])
    cells = spark.range(math.prod(n)).select("id", F.posexplode(base).alias("atom", "o"))
    place = [F.col("id") % n[0], F.floor(F.col("id") / n[0]) % n[1], F.floor(F.col("id") / (n[0] * n[1]))]
    cols = []
    for axis, k, o, width, e in zip(_NAMES, place, "abc", w, extent, strict=True):
        value = (k + F.col(f"o.{o}")) * width + (0.5 * width - 0.5 * e)
        cols.append(F.when(value >= 0.5 * e, F.lit(-0.5 * e)).otherwise(value).alias(axis))
    return cells.select((F.col("id") * 4 + F.col("atom")).alias("gid"), *cols)
