"""A set of particles: a DataFrame keyed by gid in a periodic box, and the edits that it takes."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .domain import AXES, Domain


_versions = count()


@dataclass(frozen=True)
class ParticleSet:
    """``df`` has gid (bigint), x, y, z (double) and any numeric columns. ``version`` names the positions: no two sets and
    no two states of one share it, so that pair tables know whether they still fit."""

    df: DataFrame
    domain: Domain
    version: int = field(default_factory=lambda: next(_versions))

    def with_df(self, df: DataFrame, moved: bool = True) -> ParticleSet:
        return replace(self, df=df, version=next(_versions) if moved else self.version)

    def count(self) -> int:
        return self.df.count()

    def wrapped(self) -> ParticleSet:
        """Periodic boundary conditions: positions brought back into the box."""
        return self.with_df(self.df.withColumns({a: self.domain.wrap(a) for a in AXES}))

    def inserted(self, rows: DataFrame, unique: bool = True) -> ParticleSet:
        """Rows added; columns they lack are 0, unknown ones raise. An id that is null, given twice or in the set already
        raises when the result is computed; with ``unique=False`` all rows are taken, ids that meet included."""
        if unknown := set(rows.columns) - set(self.df.columns):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        if missing := {"gid", *AXES} - set(rows.columns):
            raise ValueError(f"rows to insert need {sorted(missing)}")
        lacking = [c for c in self.df.columns if c not in rows.columns]
        out = self.df.unionByName(rows, allowMissingColumns=True).fillna(0, lacking)
        if not unique:
            return self.with_df(out)
        own = rows.select(F.col("gid").alias("new"), F.lit(1).alias("n"))
        held = self.df.select(F.col("gid").alias("new"), F.lit(1).alias("n")).join(own.select("new").distinct(), "new", "left_semi")
        bad = own.unionByName(held).groupBy("new").agg(F.sum("n").alias("n")).where("n > 1 or new is null")
        return self.with_df(_unless(out, bad.select("new"), "ids that are there already, given twice or null"))

    def removed(self, gids: DataFrame) -> ParticleSet:
        """Rows whose gid is in ``gids`` go; a gid that no row has raises when the result is computed."""
        gone = gids.select("gid").distinct()
        bad = gone.join(self.df.select("gid"), "gid", "left_anti").select(F.col("gid").alias("new"))
        return self.with_df(_unless(self.df.join(gone, "gid", "left_anti"), bad, "ids to remove that no particle has"))

    def edited(self, **columns: Column | str) -> ParticleSet:
        """Columns set by expressions of the old ones, all at once; positions that leave the box raise."""
        if unknown := set(columns) - set(self.df.columns):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        out = self.df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()})
        moved = bool(set(columns) & set(AXES))
        if moved:
            where = F.concat(F.lit("outside the box: "), F.concat_ws(", ", *[F.col(a).cast("string") for a in AXES]))
            out = out.where(F.when(self.domain.inside(), True).otherwise(F.raise_error(where).cast("boolean")))
        return self.with_df(out, moved)

    def within(self, low, high) -> ParticleSet:
        return self.with_df(self.df.where(self.domain.inside(low, high)))

    def escapes(self) -> DataFrame:
        """(direction, n): how many rows left the box by each direction."""
        return self.df.select(self.domain.escape_code().alias("direction")).groupBy("direction").agg(F.count("*").alias("n"))

    def checked(self, expected: int) -> DataFrame:
        """A row (n) that raises when rows got lost."""
        n = F.count("*")
        return self.df.agg(F.when(n == expected, n).otherwise(F.raise_error(F.concat(F.lit(f"{expected} particles expected, found "), n.cast("string"))).cast("long")).alias("n"))

    @contextmanager
    def modify(self):
        """Edits collected and applied together on leaving: additions first, then removals.

        The result is in ``edit.result``; an exception within leaves everything as it was.
        """
        edit = Edit(self)
        yield edit
        edit.apply()


def _unless(df: DataFrame, bad: DataFrame, what: str) -> DataFrame:
    """``df``, raising if ``bad`` (new) has rows: a branch of the plan that counts them, and has no row itself."""
    seen = bad.agg(F.count("*").alias("bad_n"), F.min("new").alias("bad_id"))
    text = F.concat(F.lit(f"{what}: "), F.col("bad_n").cast("string"), F.lit(", such as "), F.coalesce(F.col("bad_id").cast("string"), F.lit("null")))
    none = seen.where(F.when(F.col("bad_n") == 0, False).otherwise(F.raise_error(text).cast("boolean")))
    return df.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))


class Edit:
    """``unique=False``: ids of added rows may meet those of the set; removals then go by the rows that were there before."""

    def __init__(self, base: ParticleSet, unique: bool = True):
        self.base, self.unique, self.added, self.gone, self.result = base, unique, [], [], base

    def add(self, rows: DataFrame) -> None:
        self.added.append(rows)

    def remove(self, gids: DataFrame) -> None:
        self.gone.append(gids)

    def apply(self) -> None:
        steps = [lambda s, rows=rows: s.inserted(rows, self.unique) for rows in self.added]
        gone = [lambda s, gids=gids: s.removed(gids) for gids in self.gone]
        out = self.base
        for step in [*steps, *gone] if self.unique else [*gone, *steps]:
            out = step(out)
        self.result = out


def wrapped_by_minimum(df: DataFrame, domain: Domain) -> DataFrame:
    """Positions shifted by their minimum, folded into the box and centred on what they span."""
    low = df.agg(*[F.min(a).alias(f"low_{a}") for a in AXES])
    out = df.crossJoin(F.broadcast(low))  # one row
    folded = out.withColumns({a: (F.col(a) - F.col(f"low_{a}")) % e for a, e in zip(AXES, domain.extent, strict=True)})
    high = folded.agg(*[F.max(a).alias(f"high_{a}") for a in AXES])
    centred = folded.crossJoin(F.broadcast(high))  # one row
    for a in AXES:
        centred = centred.withColumn(a, F.col(a) - 0.5 * F.col(f"high_{a}"))
    return centred.select(df.columns)


def from_arrays(spark: SparkSession, domain: Domain, **columns) -> ParticleSet:
    """A set from equally long arrays; gid counts from 0 if it isn't given."""
    import pandas as pd

    frame = pd.DataFrame(columns)
    if "gid" not in frame:
        frame.insert(0, "gid", range(len(frame)))
    return ParticleSet(spark.createDataFrame(frame), domain)
