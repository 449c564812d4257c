"""Column builders over arrays of structs: the object algebra of event analyses.

Every function returns a Column made of Spark's own higher-order functions, so an event stays one
row and no shuffle happens.  Null arrays stay null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def num(arr: Column) -> Column:
    """Objects in the list (A1)."""
    return F.size(arr)


def total(arr: Column) -> Column:
    """Sum of a numeric list as a double; 0 when empty (A2)."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def product(arr: Column) -> Column:
    """Product of a numeric list as a double; 1 when empty (A3)."""
    return F.aggregate(arr, F.lit(1.0), lambda acc, x: acc * x.cast("double"))


def any_of(arr: Column, test: Callable[[Column], Column]) -> Column:
    """Whether some object passes; false when empty (A4)."""
    return F.exists(arr, test)


def all_of(arr: Column, test: Callable[[Column], Column]) -> Column:
    """Whether all objects pass; true when empty (A5)."""
    return F.forall(arr, test)


def argmin(arr: Column) -> Column:
    """0-based index of the first least value; null when empty."""
    return F.array_min(F.transform(arr, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))["i"]


def min_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """The first object with the least key; null when empty."""
    keyed = F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))
    return F.get(arr, F.array_min(keyed)["i"])


def argsort(arr: Column, ascending: bool = True) -> Column:
    """0-based positions in order of value; equal values keep their order."""
    sign = 1 if ascending else -1
    keyed = F.transform(arr, lambda v, i: F.struct((v * sign).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def sort_by(arr: Column, key: Callable[[Column], Column], descending: bool = False) -> Column:
    """Objects in order of a numeric key; equal keys keep their order."""
    sign = -1 if descending else 1
    keyed = F.transform(arr, lambda x, i: F.struct((key(x) * sign).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"])), lambda s: s["x"])


def local_index(arr: Column) -> Column:
    """0-based position of each object."""
    return F.transform(arr, lambda x, i: i)


def first(arr: Column) -> Column:
    """The first object, null when empty."""
    return F.get(arr, F.lit(0))


def nth(arr: Column, n: int, fill=None) -> Column:
    """The n-th object from 0, or ``fill``."""
    got = F.get(arr, F.lit(n))
    return got if fill is None else F.coalesce(got, F.lit(fill))


def pad(arr: Column, n: int) -> Column:
    """The list with nulls behind it up to length ``n``; longer lists stay."""
    missing = F.greatest(F.lit(0), F.lit(n) - F.size(arr))
    return F.concat(arr, F.transform(F.array_repeat(F.get(arr, F.lit(0)), missing), lambda x: F.when(F.lit(False), x)))


def pairs(arr: Column, names: Sequence[str] = ("a", "b")) -> Column:
    """All pairs of positions i < j in lexicographic order, as structs."""
    n = F.size(arr)
    inner = lambda x, i: F.transform(F.slice(arr, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.struct(x.alias(names[0]), y.alias(names[1])))
    return F.flatten(F.transform(arr, inner))


def triples(arr: Column, names: Sequence[str] = ("a", "b", "c")) -> Column:
    """All triples of positions i < j < k in lexicographic order, as structs."""
    n = F.size(arr)
    rest = lambda i: F.slice(arr, i + 2, F.greatest(n - i - 1, F.lit(0)))

    def outer(x, i):
        tail = rest(i)
        size = n - i - 1
        second = lambda y, j: F.transform(F.slice(tail, j + 2, F.greatest(size - j - 1, F.lit(0))), lambda z: F.struct(x.alias(names[0]), y.alias(names[1]), z.alias(names[2])))
        return F.flatten(F.transform(tail, second))

    return F.flatten(F.transform(arr, outer))


def cross(left: Column, right: Column, names: Sequence[str] = ("a", "b")) -> Column:
    """For each left object the list of (left, right) structs."""
    return F.transform(left, lambda x: F.transform(right, lambda y: F.struct(x.alias(names[0]), y.alias(names[1]))))


def joined(*arrs: Column) -> Column:
    """Lists of one event put behind each other."""
    return F.concat(*arrs)


def regroup(flat: Column, counts: Column) -> Column:
    """A flat list cut into consecutive lists of the given sizes: the inverse of flatten."""
    step = lambda acc, n: F.struct((acc["at"] + n.cast("int")).alias("at"), F.concat(acc["out"], F.array(F.slice(flat, acc["at"] + 1, n.cast("int")))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.filter(F.array(flat), lambda x: F.lit(False)).alias("out"))
    return F.aggregate(counts, start, step)["out"]


def full_like(arr: Column, value) -> Column:
    """A list as long as ``arr`` holding a constant: zeros_like, ones_like, full_like."""
    return F.transform(arr, lambda x: F.lit(value))


def with_field(arr: Column, name: str, value: Callable[[Column], Column]) -> Column:
    """Each struct of the list with a field added or replaced."""
    return F.transform(arr, lambda x: x.withField(name, value(x)))


def zipped(**lists: Column) -> Column:
    """One list of structs from lists of equal length."""
    return F.transform(F.arrays_zip(*[c.alias(n) for n, c in lists.items()]), lambda x: F.struct(*[x[n].alias(n) for n in lists]))


def drop_none(arr: Column) -> Column:
    """The list without nulls."""
    return F.filter(arr, lambda x: x.isNotNull())


def fill_none(arr: Column, value) -> Column:
    """Nulls of the list replaced."""
    return F.transform(arr, lambda x: F.coalesce(x, F.lit(value)))


def flags(df: DataFrame, prefix: str, how: str = "and") -> Column:
    """All boolean columns whose name starts with ``prefix``, reduced by and/or (P5)."""
    named = [F.col(c) for c, kind in df.dtypes if c.startswith(prefix) and kind == "boolean"]
    if how not in ("and", "or"):
        raise ValueError(f"how is 'and' or 'or', not {how!r}")
    if not named:
        return F.lit(how == "and")
    out = named[0]
    for c in named[1:]:
        out = out & c if how == "and" else out | c
    return out


def flattened(df: DataFrame, prefixes: dict[str, str]) -> list[Column]:
    """Fields of struct columns as flat columns, ``prefixes`` giving each struct's prefix; names sorted."""
    found = {f"{p}{f.name}": F.col(f"{c}.{f.name}") for c, p in prefixes.items() for f in df.schema[c].dataType.fields}
    return [found[n].alias(n) for n in sorted(found)]


def bit_set(word: Column, bit: int) -> Column:
    """Whether one bit of a word is set."""
    return word.bitwiseAND(F.lit(1 << bit)) != 0


def bit_field(word: Column, low: int, width: int) -> Column:
    """``width`` bits of a word from ``low`` on, as a number."""
    return F.shiftright(word.bitwiseAND(F.lit(((1 << width) - 1) << low)), low)
