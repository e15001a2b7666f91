"""Pair potentials as SQL expressions in dx, dy, dz and r2 (R = r_j - r_i).

``energy`` is a pair's whole energy with its shift; ``force`` the factor f of F_i += f R. Both are zero
from the cutoff on (strictly inside counts). Ordered loops add half the energy a side, symmetric ones all of it and
both forces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: float) -> str:
    return f"cast({float(x)!r} as double)"


@dataclass(frozen=True)
class Potential:
    name: str
    cutoff: float
    energy: str
    force: str

    def masked(self, text: str) -> Column:
        return F.expr(f"case when r2 < {number(self.cutoff**2)} then {text} else {number(0)} end")

    def energy_column(self, half: bool = True) -> Column:
        return self.masked(f"({number(0.5 if half else 1.0)} * ({self.energy}))")

    def force_columns(self) -> dict[str, Column]:
        return {a: self.masked(f"(({self.force}) * d{a})") for a in "xyz"}

    def counted(self) -> Column:
        """1 for a pair inside the cutoff: the counting variant."""
        return F.expr(f"case when r2 < {number(self.cutoff**2)} then 1 else 0 end")


def lennard_jones(epsilon: float = 1.0, sigma: float = 1.0, cutoff: float | None = None) -> Potential:
    """4 eps ((s/r)^12 - (s/r)^6) shifted to 0 at the cutoff, 2.5 sigma by default."""
    cutoff = 2.5 * sigma if cutoff is None else cutoff
    shift = (sigma / cutoff) ** 6 - (sigma / cutoff) ** 12
    s2 = f"({number(sigma**2)} / r2)"
    s6 = f"({s2} * {s2} * {s2})"
    energy = f"{number(4 * epsilon)} * (({s6} - 1) * {s6} + {number(shift)})"
    return Potential("lennard_jones", cutoff, energy, f"{number(-48 * epsilon / sigma**2)} * ({s6} - {number(0.5)}) * {s6} * {s2}")


def lennard_jones_repulsive(epsilon: float = 1.0, sigma: float = 1.0) -> Potential:
    """The purely repulsive form: cut at the minimum, 2^(1/6) sigma, and shifted by a quarter."""
    lj = lennard_jones(epsilon, sigma, 2 ** (1 / 6) * sigma)
    return Potential("lennard_jones_repulsive", lj.cutoff, lj.energy, lj.force)


def null(cutoff: float) -> Potential:
    return Potential("null", cutoff, number(0), number(0))


def buckingham(a: float, b: float, c: float, cutoff: float) -> Potential:
    """A e^(-Br) - C/r^6 with the force and shift of the established kernel of that name: its factor is
    A B e^(-Br) - 6C/r^7, which is not -dV/dr over r (see ``buckingham_physical``), and its shift takes
    exp(-B/rc) and -C/rc^6."""
    from math import exp

    shift = -a * exp(-b / cutoff) + c / cutoff**6
    r = "sqrt(r2)"
    energy = f"{number(a)} * exp({number(-b)} * {r}) - {number(c)} / (r2 * r2 * r2) + {number(shift)}"
    return Potential("buckingham", cutoff, energy, f"{number(a * b)} * exp({number(-b)} * {r}) - {number(6 * c)} / (r2 * r2 * r2 * {r})")


def buckingham_physical(a: float, b: float, c: float, cutoff: float) -> Potential:
    """A e^(-Br) - C/r^6 shifted to 0 at the cutoff, with its true force."""
    from math import exp

    shift = -(a * exp(-b * cutoff) - c / cutoff**6)
    r = "sqrt(r2)"
    energy = f"{number(a)} * exp({number(-b)} * {r}) - {number(c)} / (r2 * r2 * r2) + {number(shift)}"
    return Potential("buckingham_physical", cutoff, energy, f"-({number(a * b)} * exp({number(-b)} * {r}) / {r} - {number(6 * c)} / (r2 * r2 * r2 * r2))")


def symbolic(cutoff: float, energy: str, force: str, spark_value: float | None = None) -> Potential:
    """Any SQL expressions in r2; F_i -= force R. ``spark_value`` is the energy at the cutoff, taken off."""
    shifted = energy if spark_value is None else f"({energy}) - {number(spark_value)}"
    return Potential("symbolic", cutoff, shifted, f"-({force})")


def polynomial(coefficients: list[float], cutoff: float) -> Potential:
    """A polynomial of the distance by Horner's rule, without a force."""
    text = number(coefficients[-1])
    for c in coefficients[-2::-1]:
        text = f"({text} * sqrt(r2) + {number(c)})"
    return Potential("polynomial", cutoff, text, number(0))
