"""Parameters of the engine."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and score weights; checked on construction."""

    similarity_high: float = 85.0
    similarity_alert: float = 65.0
    tie_points: float = 0.50
    weight_price: float = 0.30
    weight_similarity: float = 0.20
    weight_attributes: float = 0.20
    weight_commercial: float = 0.30

    def __post_init__(self):
        if not 0 <= self.similarity_alert <= self.similarity_high <= 100:
            raise ValueError("similarity thresholds must satisfy 0 <= alert <= high <= 100")
        if self.tie_points < 0:
            raise ValueError("tie_points must not be negative")
        weights = (self.weight_price, self.weight_similarity,
                   self.weight_attributes, self.weight_commercial)
        if min(weights) < 0 or abs(sum(weights) - 1.0) > 1e-9:
            raise ValueError("weights must be non-negative and sum to 1")


@dataclass(frozen=True)
class SkewPolicy:
    """When a group counts as hot and into how many parts it is split.

    A group is split into as many parts as it holds ``hot_rows`` rows. Up to ``hot_limit``
    hot keys are held as a list and broadcast; more of them stay a table that is joined.
    """

    hot_rows: int = 1_000_000
    hot_limit: int = 1_000


@dataclass(frozen=True)
class HeaderThresholds:
    """Confidence limits of the header classifier."""

    high: float = 92.0
    medium: float = 78.0
    low: float = 62.0

    def __post_init__(self):
        if not 0 <= self.low <= self.medium <= self.high <= 100:
            raise ValueError("thresholds must satisfy 0 <= low <= medium <= high <= 100")


@dataclass(frozen=True)
class DetectionWindow:
    """Rows of a sheet in which its header is sought, and rows that are looked at in all."""

    header_rows: int = 30
    sample_rows: int = 100

    def __post_init__(self):
        if not 0 < self.header_rows <= self.sample_rows:
            raise ValueError("the header rows must lie among the sampled rows")
