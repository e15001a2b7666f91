"""Kernels: SQL expressions over a particle's columns, with access modes that say what they may do.

A kernel names its outputs and the expression of each. The modes decide how an output meets the column
it replaces: READ may not be written; WRITE and RW replace it, and their expressions see the old value; INC
adds to it; INC_ZERO starts from zero.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Mode(Enum):
    READ = "R"
    WRITE = "W"
    RW = "RW"
    INC = "INC"
    INC_ZERO = "INC0"

    @property
    def writes(self) -> bool:
        return self is not Mode.READ

    @property
    def reads(self) -> bool:
        return self not in (Mode.WRITE, Mode.INC_ZERO)

    @property
    def increments(self) -> bool:
        return self in (Mode.INC, Mode.INC_ZERO)


READ, WRITE, RW, INC, INC_ZERO = Mode


@dataclass(frozen=True)
class Constant:
    """A name that stands for a number in a kernel's expressions."""

    name: str
    value: float

    def put(self, text: str) -> str:
        value = repr(float(self.value)) if isinstance(self.value, float) else repr(self.value)
        return re.sub(rf"\b{re.escape(self.name)}\b", f"({value}D)" if isinstance(self.value, float) else f"({value})", text)


@dataclass(frozen=True)
class Kernel:
    """``outputs``: column -> SQL expression. Constants are written in; other free names are columns or arguments."""

    name: str
    outputs: dict[str, str]
    constants: tuple[Constant, ...] = ()
    arguments: tuple[str, ...] = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "name", re.sub(r"\W", "_", self.name))

    def expressions(self, **values: float) -> dict[str, Column]:
        if set(values) != set(self.arguments):
            raise ValueError(f"{self.name} takes the arguments {self.arguments}, not {tuple(values)}")
        out = {}
        for column, text in self.outputs.items():
            for c in (*self.constants, *(Constant(k, v) for k, v in values.items())):
                text = c.put(text)
            out[column] = F.expr(text)
        return out

    def operations(self) -> dict[str, int]:
        """How often each arithmetic sign stands in the expressions."""
        text = " ".join(self.outputs.values())
        return {sign: text.count(sign) for sign in "+-*/"}


def check(kernel: Kernel, columns: list[str], modes: dict[str, Mode], pair: bool = False) -> None:
    """Raises if an output has no mode or may not be written, or a particle output of a pair loop isn't an increment."""
    for name in kernel.outputs:
        if name not in modes:
            raise ValueError(f"{kernel.name} writes {name}, for which no access mode is given")
        if not modes[name].writes:
            raise ValueError(f"{kernel.name} writes {name}, which is {modes[name].name}")
        if pair and not modes[name].increments:
            raise ValueError(f"a pair loop may only increment, and {name} is {modes[name].name}")
        if name not in columns and modes[name] in (Mode.RW, Mode.INC):
            raise ValueError(f"{name} is {modes[name].name} and is no column")


def _first(df: DataFrame, first: int | None) -> DataFrame:
    return df if first is None else df.where(F.col("gid") < first)


def particle_loop(df: DataFrame, kernel: Kernel, modes: dict[str, Mode], first: int | None = None, **arguments: float) -> DataFrame:
    """``df`` with the kernel's outputs as one projection. ``first``: only rows whose gid is smaller are changed."""
    check(kernel, df.columns, modes)
    new = {}
    for name, value in kernel.expressions(**arguments).items():
        mode = modes[name]
        result = F.col(name) + value if mode is Mode.INC else value
        if first is not None:
            old = F.col(name) if name in df.columns else F.lit(0)
            result = F.when(F.col("gid") < first, result).otherwise(F.lit(0) if mode is Mode.INC_ZERO else old)
        new[name] = result
    return df.withColumns(new)


def reduce_loop(df: DataFrame, kernel: Kernel, modes: dict[str, Mode], old: dict[str, float] | None = None, first: int | None = None, **arguments: float) -> DataFrame:
    """One row: each output summed over all particles; INC adds the old value. An empty set sums to zero."""
    for name in kernel.outputs:
        if not modes.get(name, READ).increments:
            raise ValueError(f"a global array can only be incremented, and {name} is {modes.get(name)}")
    sums = []
    for name, value in kernel.expressions(**arguments).items():
        base = (old or {}).get(name, 0) if modes[name] is Mode.INC else 0
        sums.append((F.coalesce(F.sum(value), F.lit(0)) + F.lit(base)).alias(name))
    return _first(df, first).agg(*sums)


def gather(values: list[float], index: Column) -> Column:
    """The entry of a small array at a row's index, counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def array_algebra(values: Column) -> dict[str, Column]:
    """min, max, mean and sum over an array column."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return {"min": F.array_min(values), "max": F.array_max(values), "sum": total, "mean": total / F.size(values)}


def norm_linf(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in columns]) if len(columns) > 1 else F.abs(F.col(columns[0]))).alias("norm_linf"))
