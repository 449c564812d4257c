"""Systematic variations: one read, many labelled siblings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    """Alternatives of one kind: label -> values of the parameters that it changes."""

    name: str
    labels: dict[str, dict[str, float]] = field(default_factory=dict)


def vary(df: DataFrame, nominal: dict[str, float], families: Sequence[Family], label: str = "variation") -> DataFrame:
    """Each row once for ``nominal`` and once for each label, with the parameters as columns.

    Families are siblings, never combined.  What stands before this call is computed once a row; the
    copies are narrow if the selection is made to follow column pruning.
    """
    cases = [("nominal", nominal)]
    for fam in families:
        for name, changed in fam.labels.items():
            unknown = set(changed) - set(nominal)
            if unknown:
                raise ValueError(f"{fam.name}.{name} sets unknown parameters {sorted(unknown)}")
            cases.append((f"{fam.name}_{name}", {**nominal, **changed}))
    if len({c for c, _ in cases}) != len(cases):
        raise ValueError("variation labels repeat")
    grid = F.array(*[F.struct(F.lit(c).alias(label), *[F.lit(float(v)).alias(k) for k, v in sorted(values.items())]) for c, values in cases])
    return df.withColumn("__v", F.explode(grid)).select(*df.columns, "__v.*")


def matrix(df: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]], label: str = "variation") -> DataFrame:
    """Several outputs of one varied table, each (output, variation, ...), in one result."""
    out = None
    for name in sorted(outputs):
        part = outputs[name](df).withColumn("output", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no outputs")
    return out


def shifted(value: Column, by: Column | str) -> Column:
    """A value scaled by a parameter column."""
    return value * (F.col(by) if isinstance(by, str) else by)
