"""Hierarchical electrostatics: charges rolled up an octree into expansions, met over interaction lists, and
brought down again. Every step is a grouping or an equi-join on cell ids; translations of expansions are
matrix products over bounded lists (eight children, 27 blocks), in numpy within a task.

Level k has 2^k cells an axis. Expansions are kept as (re, im) arrays over l and m >= 0 of the unnormalised
harmonics (``functions.harmonics``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import AXES, Domain
from ..functions.harmonics import degrees, irregular, local_shift, multipole_shift, multipole_to_local, place, regular, regular_columns, to_normalised
from ..particles import ParticleSet
from . import blocks as meet
from . import hierarchy
from .coulomb import nearest_images
from .pairs import forward, spread

CELL = ("cx", "cy", "cz")


def _half(order: int) -> list[tuple[int, int]]:
    return [(l, m) for l in range(order) for m in range(l + 1)]


def _in_cells(particles: ParticleSet, level: int) -> DataFrame:
    """Particles with their cell on a level and their place from its centre."""
    d = particles.domain
    out = particles.df.withColumns({f"c{a}": d.cell(a, 2**level) for a in AXES})
    return out.withColumns({f"d{a}": F.col(a) - ((F.col(f"c{a}") + 0.5) * (e / 2**level) - e / 2) for a, e in zip(AXES, d.extent, strict=True)})


def _expansions(df: DataFrame, keys: list[str], terms: dict[tuple[int, int], tuple[Column, Column]], sign: float) -> DataFrame:
    """Sums over q of complex terms by ``keys``, as arrays re and im; pre-aggregated in each task. ``sign`` -1 conjugates."""
    sums = {}
    for (l, m), (a, b) in terms.items():
        sums[f"re_{l}_{m}"], sums[f"im_{l}_{m}"] = F.sum(F.col("q") * a), F.sum(sign * F.col("q") * b)
    out = df.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    names = [f"{l}_{m}" for l, m in terms]
    return out.select(*keys, F.array(*[F.col(f"re_{n}") for n in names]).alias("re"), F.array(*[F.col(f"im_{n}") for n in names]).alias("im"))


def multipoles(particles: ParticleSet, level: int, order: int) -> DataFrame:
    """(cx, cy, cz, re, im): the expansion of each occupied cell about its centre, sum q conj(R_lm)."""
    terms = regular_columns(order, F.col("dx"), F.col("dy"), F.col("dz"))
    terms = {k: terms[k] for k in _half(order)}
    return _expansions(_in_cells(particles, level), list(CELL), terms, -1.0)


def moments(particles: ParticleSet, levels: int, order: int) -> DataFrame:
    """(cx, cy, cz, l, m, re, im) on the finest of ``levels``: sum q r^l Y_l^-m of each cell, m >= 0."""
    factor = to_normalised(order)
    rows = F.explode(F.array(*[
        F.struct(F.lit(l).alias("l"), F.lit(m).alias("m"), (F.col("re")[k] * float(factor[place(l, m)])).alias("re"), (F.col("im")[k] * float(factor[place(l, m)])).alias("im"))
        for k, (l, m) in enumerate(_half(order))
    ]))
    return multipoles(particles, levels - 1, order).select(*CELL, rows.alias("t")).select(*CELL, "t.*")


def charge_by_level(particles: ParticleSet, levels: int) -> DataFrame:
    """(level, cx, cy, cz, q, n): charge and count of every occupied cell of every level, rolled up from the finest."""
    finest = levels - 1
    leaf = _in_cells(particles, finest).groupBy(*CELL).agg(F.sum("q").alias("q"), F.count("*").alias("n"))
    up = leaf.select(F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("level"), *CELL, "q", "n")
    up = up.withColumns({c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(finest) - F.col("level"))).cast("int") for c in CELL})
    return up.groupBy("level", *CELL).agg(F.sum("q").alias("q"), F.sum("n").alias("n"))


def interaction_offsets() -> list[tuple[int, int, int]]:
    """Offsets that can be in an interaction list: beyond the neighbours, within the parents' neighbours."""
    return [o for o in product(range(-3, 4), repeat=3) if max(map(abs, o)) > 1]


def interaction_list(parity: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """The 189 offsets of a cell whose indices have this parity."""
    return [o for o in interaction_offsets() if all(-1 <= (p + a) // 2 <= 1 for p, a in zip(parity, o, strict=True))]


def exclusion_list() -> list[tuple[int, int, int]]:
    """The cells that are met directly."""
    return list(product((-1, 0, 1), repeat=3))


def _listed(df: DataFrame, level: int, offsets: list[tuple[int, int, int]], interacting: bool) -> DataFrame:
    """Rows under the cells at offsets from their own (tx, ty, tz), those outside the box dropped."""
    out = df.select("*", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", o, strict=True)]) for o in offsets])).alias("o"))
    out = out.withColumns({f"t{a}": F.col(f"c{a}") + F.col(f"o.{n}") for a, n in zip(AXES, "abc", strict=True)})
    for a in AXES:
        out = out.where(f"t{a} between 0 and {2**level - 1}")
        if interacting:
            out = out.where(f"floor(t{a} / 2) - floor(c{a} / 2) between -1 and 1")
    return out.drop("o")


def _from_centre(domain: Domain, level: int, prefix: str) -> dict[str, Column]:
    return {f"d{a}": F.col(a) - ((F.col(f"{prefix}{a}") + 0.5) * (e / 2**level) - e / 2) for a, e in zip(AXES, domain.extent, strict=True)}


def _product(order: int, terms: dict[tuple[int, int], tuple[Column, Column]], conjugate: bool) -> Column:
    """The real sum over l and all m of an expansion's (re, im) with terms given for m >= 0."""
    total = F.lit(0.0)
    for k, (l, m) in enumerate(_half(order)):
        a, b = terms[l, m]
        real = F.col("re")[k] * a + (F.col("im")[k] * b if conjugate else -F.col("im")[k] * b)
        total = total + (2.0 if m else 1.0) * real
    return total


def _irregular_columns(order: int) -> dict[tuple[int, int], tuple[Column, Column]]:
    r2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    out = {}
    for (l, m), (a, b) in regular_columns(order, F.col("dx"), F.col("dy"), F.col("dz")).items():
        scale = float(factorial(l - m) * factorial(l + m)) / F.pow(r2, F.lit(l + 0.5))
        out[l, m] = (a * scale, b * scale)
    return out


def near_energy(particles: ParticleSet, level: int) -> DataFrame:
    """(energy), partial sums of pairs in the same or neighbouring cells, each once, without images."""
    df = _in_cells(particles.with_df(spread(particles.df), False), level)
    return meet.near_sum(df, (2**level,) * 3, particles.domain.extent, forward(exclusion_list()), "free")


def _expanded(order: int, d: list[np.ndarray], re: np.ndarray, im: np.ndarray) -> np.ndarray:
    """Expansions re, im (of m >= 0 by rows) at places (points, expansions) from their centres, by the recursion of I_lm in l."""
    x, y, z = d
    s = 1 / (x * x + y * y + z * z)
    total, lead, a, b = 0.0, np.sqrt(s), 1.0, 0.0
    at = {lm: k for k, lm in enumerate(_half(order))}
    for m in range(order):
        if m:
            lead, a, b = lead * s * -(2 * m - 1), a * x - b * y, a * y + b * x
        before, now = 0.0, lead
        real, imaginary = re[:, at[m, m]] * now, im[:, at[m, m]] * now
        for l in range(m + 1, order):
            before, now = now, ((2 * l - 1) * z * now - ((l - 1) ** 2 - m * m) * before) * s
            real += re[:, at[l, m]] * now
            imaginary += im[:, at[l, m]] * now
        total = total + (2.0 if m else 1.0) * (real * a - imaginary * b)
    return total


#: Particles of a group on average, and places (particle, expansion) evaluated at once.
GROUP, PLACES = 1 << 16, 1 << 14


def listed_energy(particles: ParticleSet, level: int, order: int, count: int) -> DataFrame:
    """(energy), partial sums over particles of half of q times the expansions of the cells in their interaction lists."""
    cells, width = (2**level,) * 3, np.array([e / 2**level for e in particles.domain.extent])
    half, edge = np.array(particles.domain.extent) / 2, meet.edges(cells, 8)
    blocks_there = np.prod([-(-n // e) for n, e in zip(cells, edge, strict=True)])
    parts = max(1, -(-count // int(blocks_there * GROUP)))
    terms = len(_half(order))

    def met(rows: pa.Table, found: pa.Table) -> pa.Table:
        total = 0.0
        if len(rows) and len(found):
            g, xyz, q = meet.Group(found, cells, edge), np.stack([rows[a].to_numpy() for a in AXES], 1), rows["q"].to_numpy()
            re, im = (found[c].combine_chunks().flatten().to_numpy().reshape(-1, terms)[g.order] for c in ("re", "im"))
            own, where = np.unique(meet.integers(rows, CELL), axis=0, return_inverse=True)
            for k, cell in enumerate(own):
                some = np.flatnonzero(where.ravel() == k)
                steps = [tuple((cell + o).tolist()) for o in interaction_list(tuple((cell % 2).tolist()))]
                at = [g.slices[c].start for c in steps if c in g.slices]
                if at:
                    centre, each = (g.seen[at] + 0.5) * width - half, max(1, PLACES // len(at))
                    for s in range(0, len(some), each):
                        d = [xyz[some[s : s + each], a, None] - centre[:, a] for a in range(3)]
                        total += 0.5 * float(q[some[s : s + each]] @ _expanded(order, d, re[at], im[at]).sum(1))
        return pa.table({"energy": [total]})

    keys, tasks = [*meet.BLOCK, "part"], meet.tasks_for(particles.df, cells, edge, parts)
    rows = _in_cells(particles, level).select("gid", *[F.col(a).cast("double").alias(a) for a in (*AXES, "q")], *CELL).dropna(subset=[*AXES, "q"])
    rows = rows.withColumns({b: F.floor(F.col(c) / e).cast("int") for b, c, e in zip(meet.BLOCK, CELL, edge, strict=True)})
    rows = rows.withColumn("part", F.pmod(F.hash("gid"), F.lit(parts))).drop("gid").repartition(tasks, *keys)
    found = meet.blocked(hierarchy.multipoles(hierarchy.Tree(particles.domain, level + 1), particles, level, order), cells, edge, interaction_offsets(), "free", 1000)
    found = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, *keys)
    return rows.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInArrow(met, "energy double")


def multilevel_energy(particles: ParticleSet, levels: int, order: int, local: bool = False) -> DataFrame:
    """(energy) in free space: pairs of neighbouring finest cells directly, and all others through expansions of the
    level whose interaction lists they are in. ``local``: expansions are laid down in the listed cells and evaluated in the
    own one, instead of laid down in the own one and evaluated over the list."""
    total, count = near_energy(particles, levels - 1), 0 if local else particles.df.count()
    for level in range(2, levels):
        if not local:
            total = total.unionByName(listed_energy(particles, level, order, count))
            continue
        cells = _in_cells(particles.with_df(spread(particles.df), False), level).select("gid", *AXES, "q", *CELL)
        target = [F.col(f"c{a}").alias(f"t{a}") for a in AXES]
        laid = _listed(cells, level, interaction_offsets(), True).withColumns(_from_centre(particles.domain, level, "t"))
        found = _expansions(laid, ["tx", "ty", "tz"], {k: _irregular_columns(order)[k] for k in _half(order)}, 1.0)
        met = cells.select("gid", *AXES, "q", *target).join(found, ["tx", "ty", "tz"]).withColumns(_from_centre(particles.domain, level, "t"))
        value = _product(order, regular_columns(order, F.col("dx"), F.col("dy"), F.col("dz")), True)
        total = total.unionByName(met.agg(F.coalesce(F.sum(0.5 * F.col("q") * value), F.lit(0.0)).alias("energy")))
    return total.agg(F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy"))


# --- the fast multipole method


def _full(order: int, re, im) -> np.ndarray:
    """All m of an expansion from m >= 0: the coefficient of -m is (-1)^m times the conjugate."""
    out = np.zeros(order * order, complex)
    for k, (l, m) in enumerate(_half(order)):
        value = complex(re[k], im[k])
        out[place(l, m)] = value
        if m:
            out[place(l, -m)] = (-1) ** m * value.conjugate()
    return out


def _cut(order: int, full: np.ndarray) -> tuple[list[float], list[float]]:
    some = full[[place(l, m) for l, m in _half(order)]]
    return some.real.tolist(), some.imag.tolist()


_EXPANSION = "cx int, cy int, cz int, re array<double>, im array<double>"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*CELL, "re", "im"])


def blocks(cells: DataFrame) -> DataFrame:
    """(px, py, pz, children): the up to eight children of each parent."""
    parent = [F.floor(F.col(c) / 2).cast("int").alias(f"p{c[1]}") for c in CELL]
    return cells.select(*parent, F.struct(*CELL, "re", "im").alias("child")).groupBy("px", "py", "pz").agg(F.collect_list("child").alias("children"))


def _up(order: int, width: tuple[float, ...]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for px, py, pz, children in part[["px", "py", "pz", "children"]].itertuples(index=False):
                total = np.zeros(order * order, complex)
                for c in children:
                    d = tuple((c[k] % 2 - 0.5) * w for k, w in zip(CELL, width, strict=True))
                    total += multipole_shift(order, d) @ _full(order, c["re"], c["im"])
                rows.append((px, py, pz, *_cut(order, total)))
            yield _frame(rows)

    return run


def _across(order: int, width: tuple[float, ...]):
    """Multipoles of neighbouring blocks to local expansions of the block's children."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for around in part["around"]:
                own = next((b for b in around if (b["ox"], b["oy"], b["oz"]) == (0, 0, 0)), None)
                for target in own["children"] if own is not None else ():
                    total = np.zeros(order * order, complex)
                    for b in around:
                        for c in b["children"]:
                            # the child's place as seen from the target: of its block, moved by the block's offset
                            step = [2 * b[f"o{k[1]}"] + c[k] % 2 - target[k] % 2 for k in CELL]
                            if max(map(abs, step)) > 1:
                                d = tuple(-s * w for s, w in zip(step, width, strict=True))
                                total += multipole_to_local(order, d) @ _full(order, c["re"], c["im"])
                    rows.append((*(target[k] for k in CELL), *_cut(order, total)))
            yield _frame(rows)

    return run


def _down(order: int, width: tuple[float, ...]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.to_dict("records"):
                d = tuple((r[k] % 2 - 0.5) * w for k, w in zip(CELL, width, strict=True))
                total = local_shift(order, d) @ _full(order, r["pre"], r["pim"])
                if r["re"] is not None:
                    total += _full(order, r["re"], r["im"])
                rows.append((*(r[k] for k in CELL), *_cut(order, total)))
            yield _frame(rows)

    return run


@lru_cache(maxsize=16)
def lattice_sums(order: int, extent: float) -> np.ndarray:
    """Sums of I_lm over the images of a cube beyond its 26 neighbours, l < 2 * order; odd l and l = 2 vanish by
    symmetry. Shells are summed to two radii and the tail, which falls as radius^-(l - 2), is extrapolated."""
    order2 = 2 * order
    at = {}
    total = np.zeros(order2 * order2, complex)
    for n in range(2, 25):
        r = np.arange(-n, n + 1)
        grid = np.stack(np.meshgrid(r, r, r, indexing="ij"), -1).reshape(-1, 3)
        own = grid[np.abs(grid).max(1) == n] * extent
        total = total + irregular(order2, *own.T).sum(0)
        if n in (12, 24):
            at[n] = total.copy()
    out = np.zeros(order2 * order2, complex)
    for l, m in degrees(order2):
        if l >= 4 and l % 2 == 0 and m % 4 == 0:
            tail = (12.5 / 24.5) ** (l - 2)
            out[place(l, m)] = (at[24][place(l, m)] - tail * at[12][place(l, m)]) / (1 - tail)
    return out


def far_field(order: int, extent: float, whole: np.ndarray) -> np.ndarray:
    """The local expansion about the box's centre of all images beyond the nearest, from the box's multipoles."""
    s = lattice_sums(order, extent)
    out = np.zeros(order * order, complex)
    for k, n in degrees(order):
        out[place(k, n)] = (-1) ** k * sum(whole[place(l, m)] * s[place(l + k, m + n)] for l, m in degrees(order) if abs(m + n) <= l + k)
    return out


def _whole_box(level0: DataFrame, order: int) -> np.ndarray:
    """The one expansion of the whole box; zero for an empty set."""
    row = level0.first()
    return _full(order, row.re, row.im) if row else np.zeros(order * order, complex)


def _periodic_local(domain: Domain, whole: np.ndarray, order: int, tin_foil: bool) -> np.ndarray:
    """``far_field``, with the dipole's field 4 pi D / 3V taken off as a local expansion of degree 1 for ``tin_foil``."""
    far = far_field(order, domain.extent[0], whole)
    if tin_foil:
        scale = 4 * np.pi / (3 * domain.volume)
        dipole = np.array([-2 * whole[place(1, 1)].real, 2 * whole[place(1, 1)].imag, whole[place(1, 0)].real])
        far[place(1, 0)] -= scale * dipole[2]
        far[place(1, 1)] += scale * complex(dipole[0], dipole[1])
        far[place(1, -1)] -= scale * complex(dipole[0], -dipole[1])
    return far


def periodic_direct(particles: ParticleSet, order: int = 12, tin_foil: bool = True) -> float:
    """The energy of a neutral periodic cube: the direct sum over the box and its 26 nearest images, and all
    further ones through the box's multipoles."""
    if len(set(particles.domain.extent)) > 1:
        raise ValueError("the periodic far field is for cubic boxes")
    whole = _whole_box(multipoles(particles, 0, order), order)
    far = _periodic_local(particles.domain, whole, order, tin_foil)
    return nearest_images(particles).first()[0] + 0.5 * float((far * whole).sum().real)


def fmm(particles: ParticleSet, levels: int = 3, order: int = 8, boundary: str = "free", tin_foil: bool = True) -> DataFrame:
    """(gid, u, potential, fx, fy, fz) of every particle by the fast multipole method; u is half of q times the potential.

    ``boundary``: ``free``; ``27``, the box with its 26 nearest images; ``pbc``, the periodic system of a cubic box, neutral.
    There, ``tin_foil`` takes off the dipole term of the shell-wise sum, so that it agrees with Ewald's.
    """
    domain = particles.domain
    if boundary not in ("free", "27", "pbc"):
        raise ValueError(f"no such boundary: {boundary}")
    if boundary == "pbc" and len(set(domain.extent)) > 1:
        raise ValueError("the periodic far field is for cubic boxes")
    if levels < 3:
        raise ValueError("at least three levels are needed")
    periodic = boundary != "free"
    width = lambda level: tuple(e / 2**level for e in domain.extent)
    finest = levels - 1
    at_level = {finest: multipoles(particles, finest, order)}
    families = {}
    for level in range(finest, 0, -1):
        families[level] = blocks(at_level[level])
        at_level[level - 1] = families[level].mapInPandas(_up(order, width(level)), _EXPANSION)
    local = None
    lowest = 1 if periodic else 2
    if boundary == "pbc":
        far = _periodic_local(domain, _whole_box(at_level[0], order), order, tin_foil)
        local = particles.df.sparkSession.createDataFrame([(0, 0, 0, *_cut(order, far))], _EXPANSION)
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{a}") for a, v in zip(AXES, o, strict=True)]) for o in exclusion_list()]))
    for level in range(1, finest + 1):
        across = None
        if level >= lowest:
            # a block at p is seen from the block at p - o under the offset o
            listed = families[level].select("px", "py", "pz", "children", steps.alias("o"))
            n = 2 ** (level - 1)
            to = {a: F.col(f"p{a}") - F.col(f"o.o{a}") for a in AXES}
            listed = listed.select(*[(F.pmod(v, F.lit(n)) if periodic else v).alias(f"t{a}") for a, v in to.items()], F.struct("o.ox", "o.oy", "o.oz", "children").alias("block"))
            for a in AXES:
                listed = listed.where(f"t{a} between 0 and {n - 1}")
            across = listed.groupBy("tx", "ty", "tz").agg(F.collect_list("block").alias("around")).select("around").mapInPandas(_across(order, width(level)), _EXPANSION)
        if local is None:
            local = across
            continue
        parents = local.select(*[F.col(c).alias(f"p{c[1]}") for c in CELL], F.col("re").alias("pre"), F.col("im").alias("pim"))
        own = at_level[level].select(*CELL)
        if across is not None:
            own = own.join(across, list(CELL), "left")
        else:
            own = own.withColumns({c: F.lit(None).cast("array<double>") for c in ("re", "im")})
        own = own.withColumns({f"p{c[1]}": F.floor(F.col(c) / 2).cast("int") for c in CELL})
        local = own.join(parents, ["px", "py", "pz"]).mapInPandas(_down(order, width(level)), _EXPANSION)
    cells = _in_cells(particles, finest).select("gid", "q", *CELL, "dx", "dy", "dz").join(local.hint("merge"), list(CELL), "left")
    far_rows = cells.mapInPandas(_evaluate(order), "gid long, q double, fp double, ex double, ey double, ez double")
    near = _near_rows(particles, finest, periodic)
    out = far_rows.join(near, "gid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    potential = F.col("fp") + zero("np")
    return out.select("gid", (0.5 * F.col("q") * potential).alias("u"), potential.alias("potential"), *[(F.col("q") * (F.col(f"e{a}") + zero(f"n{a}"))).alias(f"f{a}") for a in AXES])


def _evaluate(order: int):
    """Local expansions at particles: potential, and field as minus its gradient."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            r = np.conj(regular(order, part["dx"], part["dy"], part["dz"]))
            none = np.zeros(order * order, complex)
            coefficient = np.array([none if a is None else _full(order, a, b) for a, b in zip(part["re"], part["im"], strict=True)]).reshape(len(part), -1)
            gradient = np.zeros((3, len(part)))
            for l, m in degrees(order):
                c = coefficient[:, place(l, m)]
                if l and abs(m) <= l - 1:
                    gradient[2] += (c * r[:, place(l - 1, m)]).real
                # of the conjugates: (dx - i dy) R*_lm = R*_(l-1, m+1), (dx + i dy) R*_lm = -R*_(l-1, m-1)
                plus = c * r[:, place(l - 1, m + 1)] if l and abs(m + 1) <= l - 1 else 0
                minus = -c * r[:, place(l - 1, m - 1)] if l and abs(m - 1) <= l - 1 else 0
                gradient[0] += np.real(plus + minus) / 2
                gradient[1] += np.real((minus - plus) / 2j) if l else 0
            yield pd.DataFrame({"gid": part["gid"], "q": part["q"], "fp": (coefficient * r).sum(1).real, "ex": -gradient[0], "ey": -gradient[1], "ez": -gradient[2]})

    return run


def _near_rows(particles: ParticleSet, level: int, periodic: bool) -> DataFrame:
    """(gid, np, nx, ny, nz): potential and field at each particle from the neighbouring finest cells."""
    d, n = particles.domain, 2**level
    df = _in_cells(particles.with_df(spread(particles.df), False), level)
    left = df.select("gid", *CELL, *[F.col(a).alias(f"{a}_i") for a in AXES])
    right = df.select(F.col("gid").alias("j"), *CELL, *AXES, "q", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abc", o, strict=True)]) for o in exclusion_list()])).alias("o"))
    seen = {f"c{a}": F.col(f"c{a}") + F.col(f"o.{k}") for a, k in zip(AXES, "abc", strict=True)}
    moved = {f"{a}_j": F.col(a) - (e * F.floor(seen[f"c{a}"] / n) if periodic else 0.0) for a, e in zip(AXES, d.extent, strict=True)}
    image = sum((F.abs(F.floor(v / n)) for v in seen.values()), F.lit(0)) > 0
    right = right.select("j", "q", *[v.alias(k) for k, v in moved.items()], image.alias("image"), *[(F.pmod(v, F.lit(n)) if periodic else v).alias(k) for k, v in seen.items()])
    pairs = left.join(right.hint("merge"), list(CELL)).where("gid <> j or image")
    pairs = pairs.withColumns({f"d{a}": F.col(f"{a}_i") - F.col(f"{a}_j") for a in AXES}).withColumn("r2", F.expr("dx * dx + dy * dy + dz * dz"))
    field = F.col("q") / (F.col("r2") * F.sqrt("r2"))
    return pairs.groupBy("gid").agg(F.sum(F.col("q") / F.sqrt("r2")).alias("np"), *[F.sum(field * F.col(f"d{a}")).alias(f"n{a}") for a in AXES])
