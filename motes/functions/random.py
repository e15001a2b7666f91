"""Random numbers that are functions of a key: the same under any partitioning, order, retry or engine.

A draw belongs to (seed, step, gid, number). Two lanes of 32 bits mix the key by xor-shifts and products below 2^63,
which plain bigint arithmetic states exactly, so that SQL can give the same numbers. Lanes are bijections of the low half
of a gid, so particles of a step share no state but by chance of 2^-64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shifts and odd factors of a 32-bit mixer, and what tells the two lanes apart.
SHIFTS, FACTORS, MASK = (16, 15, 15), (0x21F0AAAD, 0x735A2D97), 0xFFFFFFFF
LANES = (0x9E3779B9, 0x85EBCA6B)


def mixed(h: int) -> int:
    """The mixer on a number below 2^32."""
    for shift, factor in zip(SHIFTS, (*FACTORS, 1), strict=True):
        h = (h ^ h >> shift) * factor & MASK
    return h


def start(lane: int, seed: int, step: int) -> int:
    """A lane's state after seed and step, both of up to 64 bits."""
    h = LANES[lane]
    for part in (seed & MASK, seed >> 32 & MASK, step & MASK, step >> 32 & MASK):
        h = mixed(h ^ part)
    return h


def _xor(a: Column, b: Column | int) -> Column:
    return a.bitwiseXOR(b if isinstance(b, Column) else F.lit(b).cast("long"))


def _mix(df: DataFrame, names: list[str]) -> DataFrame:
    """The mixer on columns; a projection a step, so that no expression is written out twice."""
    for shift, factor in zip(SHIFTS, (*FACTORS, 1), strict=True):
        df = df.withColumns({c: (_xor(F.col(c), F.shiftright(c, shift)) * F.lit(factor).cast("long")).bitwiseAND(F.lit(MASK).cast("long")) for c in names})
    return df


def uniforms(df: DataFrame, count: int, seed: int, step: int = 0, prefix: str = "u") -> DataFrame:
    """``df`` with ``count`` uniform numbers of (0, 1] a row, in multiples of 2^-53, named ``prefix``0 and so on.

    A null gid draws as gid 0 does; rows of equal gid draw alike.
    """
    low = F.coalesce("gid", F.lit(0)).cast("long").bitwiseAND(F.lit(MASK).cast("long"))
    high = F.shiftrightunsigned(F.coalesce("gid", F.lit(0)).cast("long"), 32)
    lanes = [f"{prefix}_lane{k}" for k in (0, 1)]
    out = _mix(df.withColumns({c: _xor(low, start(k, seed, step)) for k, c in enumerate(lanes)}), lanes)
    out = _mix(out.withColumns({c: _xor(F.col(c), high) for c in lanes}), lanes)
    draws = {f"{c}_{k}": _xor(F.col(c), k) for c in lanes for k in range(count)}
    out = _mix(out.withColumns(draws), list(draws))
    whole = {f"{prefix}{k}": (F.col(f"{lanes[0]}_{k}") * 2097152 + F.shiftright(f"{lanes[1]}_{k}", 11) + 1) / F.lit(2.0**53) for k in range(count)}
    return out.withColumns(whole).drop(*lanes, *draws)


def normal(u: Column, v: Column) -> Column:
    """A standard normal number from two uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
