"""Angles and four-vectors of (pt, eta, phi, mass), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def delta_phi(a: Column, b: Column) -> Column:
    """a - b wrapped to [-pi, pi); pmod is the floored modulo."""
    return F.pmod(a - b + F.pi(), 2 * F.pi()) - F.pi()


def delta_r(eta1: Column, phi1: Column, eta2: Column, phi2: Column) -> Column:
    return F.hypot(eta1 - eta2, delta_phi(phi1, phi2))


def px(p: Column) -> Column:
    return p["pt"] * F.cos(p["phi"])


def py(p: Column) -> Column:
    return p["pt"] * F.sin(p["phi"])


def pz(p: Column) -> Column:
    return p["pt"] * F.sinh(p["eta"])


def energy(p: Column) -> Column:
    return F.sqrt(F.pow(p["pt"] * F.cosh(p["eta"]), F.lit(2.0)) + F.pow(p["mass"], F.lit(2.0)))


def add(*parts: Column) -> Column:
    """The sum of four-vectors as (x, y, z, t)."""
    s = lambda f: sum((f(p) for p in parts[1:]), f(parts[0]))
    return F.struct(s(px).alias("x"), s(py).alias("y"), s(pz).alias("z"), s(energy).alias("t"))


def vector(p: Column) -> Column:
    """One object as (x, y, z, t): do this once an object before combining many."""
    return add(p)


def total(*vectors: Column) -> Column:
    """The sum of (x, y, z, t) vectors."""
    s = lambda c: sum((v[c] for v in vectors[1:]), vectors[0][c])
    return F.struct(*[s(c).alias(c) for c in "xyzt"])


def mass_of(v: Column) -> Column:
    """Invariant mass of an (x, y, z, t) vector; a squared mass below 0 counts as 0."""
    m2 = v["t"] * v["t"] - v["x"] * v["x"] - v["y"] * v["y"] - v["z"] * v["z"]
    return F.sqrt(F.greatest(m2, F.lit(0.0)))


def pt_of(v: Column) -> Column:
    return F.hypot(v["x"], v["y"])


def pair_mass(a: Column, b: Column) -> Column:
    return mass_of(add(a, b))


def transverse_mass(pt1: Column, phi1: Column, pt2: Column, phi2: Column) -> Column:
    return F.sqrt(2 * pt1 * pt2 * (1 - F.cos(delta_phi(phi1, phi2))))


def safe_log(x: Column) -> Column:
    """Natural log with the array convention: nan below 0, -inf at 0, nan of nan."""
    return F.when(F.isnan(x) | (x < 0), F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def above(x: Column, limit) -> Column:
    """x > limit with nan comparing false; Spark alone would order nan above every number."""
    return (x > limit) & ~F.isnan(x)


def rint_to(x: Column, scale: float = 1e6) -> Column:
    """Half-even rounding to 1/scale, which keeps values off bin edges."""
    return F.rint(x * F.lit(scale)) / F.lit(scale)
