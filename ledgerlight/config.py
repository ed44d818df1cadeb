"""Roles and thresholds of the analyses, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Roles:
    """Columns of the input; a role that is None switches off what needs it."""

    account: str
    label: str
    time: str | None = None
    tie: str | None = None
    amount: str | None = None
    channel: str | None = None
    anchor: str | None = None
    dates: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    #: A score that the extracts bring; features that no screen drops; columns that are no features; new names of columns.
    score: str | None = None
    force_keep: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)


@dataclass
class Settings:
    # screening
    null_leak: float = 0.90
    auc_leak: float = 0.995
    constant_share: float = 0.9995
    most_correlation: float = 0.95
    # models
    folds: int = 3
    trees: int = 20
    depth: int = 4
    alert_rate: float = 0.01
    #: Which frauds count as missed: oof, existing_score or temporal.
    missed: str = "oof"
    # segments
    components: int = 4
    segments: int = 4
    engine: str = "gmm"
    least_rows: int = 30
    prior: float = 50.0
    # what the book holds
    n_book: int = 20_000_000
    n_fraud_book: int = 800
    goods_weight: float = 7.8
