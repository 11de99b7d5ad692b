"""Thresholds, column lists and category codes.

The values below are fixed values: results only agree with published runs of
the same analysis when they are the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SEED = 42
SAMPLE_FRACTION = 0.1

# --- fixed values: panel columns -------------------------------------------
METRICS = ("MScore", "TAsset", "Leverage", "EBIT", "Turnover", "ROE", "PLTax")
YEARS = ("2020", "2019", "2018", "2017", "2016", "2015")

NOMINAL = (
    "Company name",
    "Region",
    "Country",
    "NACE code",
    "Sector 1",
    "Sector 2",
    "Combined_Sector",
)

ORDINAL = ("MScore_mean", "growth_MScore_mean", "volatility_MScore")

CONTINUOUS = (
    "TAsset_mean",
    "Leverage_mean",
    "EBIT_mean",
    "Turnover_mean",
    "ROE_mean",
    "PLTax_mean",
    "growth_TAsset_mean",
    "growth_Leverage_mean",
    "growth_EBIT_mean",
    "growth_Turnover_mean",
    "growth_ROE_mean",
    "growth_PLTax_mean",
    "volatility_TAsset",
    "volatility_Leverage",
    "volatility_EBIT",
    "volatility_Turnover",
    "volatility_ROE",
    "volatility_PLTax",
    "fur_debt_to_eq",
    "fur_op_marg",
    "fur_asset_turnover",
    "fur_roa",
)

RAW_MEANS = (
    "Turnover_mean",
    "EBIT_mean",
    "PLTax_mean",
    "Leverage_mean",
    "ROE_mean",
    "TAsset_mean",
)

TRAINING_FEATURES = (
    "Leverage_mean",
    "ROE_mean",
    "PLTax_mean",
    "EBIT_mean",
    "fur_debt_to_eq",
)

TRANSFORM_ORDER = ("sqrt", "inv_sqrt", "inv", "power")

# --- fixed values: category codes ------------------------------------------
COUNTRY_CODES = {"Italy": 0, "France": 1, "Spain": 2, "Germany": 3}

RATING_CODES = {
    "AAA": 0,
    "AA": 0,
    "A": 0,
    "BBB": 1,
    "BB": 1,
    "B": 1,
    "CCC": 2,
    "CC": 2,
    "C": 2,
    "D": 3,
}

CLUSTER_TO_TARGET = {0: 1, 2: 0, 1: 2, 3: 3}

STAGES = ("raw", "outliers", "transform1", "transform2")


# --- settings, one small class per family of operators ----------------------
@dataclass(frozen=True)
class DeviationLimit:
    """Largest distance from the mean, in standard deviations."""

    limit: float = 12.0


@dataclass(frozen=True)
class QuantileFence:
    """Two quantiles and how many of their ranges a value may lie outside."""

    low: float = 0.05
    high: float = 0.95
    reach: float = 6.0


@dataclass(frozen=True)
class Forest:
    dropped: float = 0.01
    seed: int = SEED


@dataclass(frozen=True)
class LocalDensity:
    dropped: float = 0.05
    neighbours: int = 20


@dataclass(frozen=True)
class Density:
    radius: float = 0.5
    rows: int = 5


@dataclass(frozen=True)
class Partition:
    """Number of clusters of k-means and of the Ward tree; exact in rounds over cells of
    ``cell_rows`` groups, or with ``micro`` over micro-clusters."""

    clusters: int = 4
    micro: int | None = None
    cell_rows: int = 2_000
    seed: int = SEED


@dataclass(frozen=True)
class ShapeRounds:
    least: float = 0.0
    rounds: int = 2


@dataclass(frozen=True)
class StudySettings:
    """Outlier filters in their order, shape rounds and the share that is sampled."""

    filters: tuple[str, ...] = ("lof", "iqr", "zscore")
    deviation: DeviationLimit = DeviationLimit()
    fence: QuantileFence = QuantileFence()
    forest: Forest = Forest()
    local: LocalDensity = LocalDensity()
    density: Density = Density()
    shapes: ShapeRounds = ShapeRounds()
    fraction: float = SAMPLE_FRACTION


@dataclass(frozen=True)
class ModelSettings:
    """Components, the clusterings to compare, how they are scored and what their labels mean.

    ``silhouette`` is ``exact`` (all pairs of rows) or ``squared`` (linear in the rows).
    """

    features: tuple[str, ...] = TRAINING_FEATURES
    components: int = 3
    least_variance: float = 0.1
    scaled: bool = False
    methods: tuple[str, ...] = ("kmeans", "dbscan", "agglomerative")
    partition: Partition = Partition()
    density: Density = Density()
    silhouette: str = "exact"
    codes: dict = field(default_factory=lambda: dict(CLUSTER_TO_TARGET))

    def arguments(self, method: str) -> dict:
        if method == "dbscan":
            return {"eps": self.density.radius, "min_samples": self.density.rows}
        found = {"k": self.partition.clusters, "seed": self.partition.seed}
        ward = {"micro": self.partition.micro, "rounds": self.partition.micro is None, "cell_rows": self.partition.cell_rows}
        return found | ward if method == "agglomerative" else found
