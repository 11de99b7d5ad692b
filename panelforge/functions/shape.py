"""Shape transforms as column builders, and their registry."""

from __future__ import annotations

from collections.abc import Callable
from types import MappingProxyType

from pyspark.sql import Column
from pyspark.sql import functions as F

POLE_EPS = 1e-8


def clipped_sqrt(x: Column) -> Column:
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


def inverse_sqrt(x: Column) -> Column:
    shifted = x + F.lit(POLE_EPS)
    return F.when(shifted > 0, F.lit(1.0) / F.sqrt(shifted))


def inverse(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), x + F.lit(POLE_EPS))


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson power with the log limits at 0 and 2."""
    up = F.log1p(F.greatest(x, F.lit(0.0)))
    down = F.log1p(F.greatest(-x, F.lit(0.0)))
    rest = F.lit(2.0) - lam
    positive = F.when(lam == 0, up).otherwise(F.try_divide(F.expm1(lam * up), lam))
    negative = F.when(rest == 0, -down).otherwise(-F.try_divide(F.expm1(rest * down), rest))
    return F.when(x >= 0, positive).when(x < 0, negative)


def box_cox(x: Column, lam: Column) -> Column:
    """Box-Cox power; NULL outside x > 0."""
    log = F.when(x > 0, F.ln(x))
    return F.when(lam == 0, log).otherwise(F.try_divide(F.expm1(lam * log), lam))


#: transforms that need no fitting; "power" is fitted (see operators.power)
PLAIN_TRANSFORMS: MappingProxyType = MappingProxyType(
    {"sqrt": clipped_sqrt, "inv_sqrt": inverse_sqrt, "inv": inverse}
)

POWER_METHODS: MappingProxyType = MappingProxyType({"yeo-johnson": yeo_johnson, "box-cox": box_cox})


class TransformRegistry:
    """Ordered name -> builder map; order decides ties when choosing a transform."""

    def __init__(self, include_power: bool = True):
        self._builders: dict[str, Callable[[Column], Column] | None] = dict(PLAIN_TRANSFORMS)
        if include_power:
            self._builders["power"] = None

    def register(self, name: str, builder: Callable[[Column], Column]) -> None:
        self._builders[name] = builder

    def names(self) -> list[str]:
        return list(self._builders)

    def needs_fit(self, name: str) -> bool:
        return self._builders[name] is None

    def build(self, name: str, x: Column, lam: Column | None = None) -> Column:
        builder = self._builders[name]
        if builder is None:
            if lam is None:
                raise ValueError(f"transform {name!r} needs a fitted lambda")
            return yeo_johnson(x, lam)
        return builder(x)

    def has_pole(self, name: str) -> bool:
        return name in ("inv_sqrt", "inv")
