"""Sets of columns by name; only the schema is looked at.

A set is declared as a row of ``SETS``: its name, the kinds of columns it draws from and the
beginning or part of a name it asks for. One pass over the column names fills them all.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import CONTINUOUS, NOMINAL, ORDINAL, RAW_MEANS
from ..functions.scalars import col

#: Kind of a column -> what its name holds.
KINDS = {"continuous": CONTINUOUS, "nominal": NOMINAL, "ordinal": ORDINAL}

#: (set, kind, text in the name)
SETS = (
    ("grow", "continuous", "growth_"),
    ("vol", "continuous", "volatility"),
    ("fur", "continuous", "fur_"),
    ("score", "ordinal", "MScore"),
)

#: The set of all studied features, in this order; ``raw_mean`` is a fixed list.
STUDIED = ("grow", "raw_mean", "vol", "fur", "score")


@dataclass(frozen=True)
class ColumnSets:
    """Names per kind and per set, each in the order of the schema."""

    kinds: dict[str, tuple[str, ...]]
    sets: dict[str, tuple[str, ...]]

    def __getitem__(self, name: str) -> tuple[str, ...]:
        return self.kinds[name] if name in self.kinds else self.sets[name]


def column_sets(names: Iterable[str]) -> ColumnSets:
    kinds: dict[str, list[str]] = {k: [] for k in KINDS}
    sets: dict[str, list[str]] = {s: [] for s, _, _ in SETS}
    for name in names:
        for kind, parts in KINDS.items():
            if any(part in name for part in parts):
                kinds[kind].append(name)
                for s, of, text in SETS:
                    if of == kind and text in name:
                        sets[s].append(name)
    found = {s: tuple(v) for s, v in sets.items()} | {"raw_mean": RAW_MEANS}
    found["all"] = tuple(name for s in STUDIED for name in found[s])
    return ColumnSets({k: tuple(v) for k, v in kinds.items()}, found)


def yearly_columns(names: Iterable[str]) -> dict[str, dict[str, str]]:
    """metric -> year -> column, for names like ``EBIT.2020``; other names are left out."""
    table: dict[str, dict[str, str]] = {}
    for name in names:
        metric, dot, year = name.rpartition(".")
        if dot and year.isdigit():
            table.setdefault(metric, {})[year] = name
    return table


def metric_columns(names: Iterable[str], *metrics: str, years: Sequence[str] | None = None) -> tuple[str, ...]:
    """Yearly columns of the given metrics, in the order of the schema; all years unless some are named."""
    table = yearly_columns(names)
    return tuple(column for m in metrics for year, column in table.get(m, {}).items() if years is None or year in years)


def without(columns: Sequence[str], omit: Sequence[str]) -> tuple[str, ...]:
    """Ordered difference."""
    drop = set(omit)
    return tuple(c for c in columns if c not in drop)


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in columns])
