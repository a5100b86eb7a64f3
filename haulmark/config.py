"""Thresholds of the curation and the reports; fixed values, each can be overridden."""

from __future__ import annotations

from dataclasses import dataclass

NO_BRANCH = "SEM_FILIAL"
NO_SELLER = "SEM_VENDEDOR"


@dataclass(frozen=True)
class CurationConfig:
    lead_max_days: float = 100
    weight_max_g: float = 30_000
    freight_over_goods: float = 3
    payment_tolerance: float = 1.00
    tail_days: int = 60
    no_branch: str = NO_BRANCH
    no_seller: str = NO_SELLER


@dataclass(frozen=True)
class CostConfig:
    """Defect cost: penalty as a share of the freight, and one more delivery."""

    penalty: float = 0.035
    redelivery: float = 180.0
    misrouted_per_city: int = 4


@dataclass(frozen=True)
class DelayCosts:
    false_negative: float = 45.0
    false_positive: float = 8.0
    test_days: int = 90
    cuts: tuple = (0.05, 0.08, 0.10, 0.12, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)


@dataclass(frozen=True)
class QuotingConfig:
    """Decision limits of the request waterfall."""

    confidence_to_ask: float = 0.35
    confidence_to_quote: float = 0.60
    require_weight: bool = True
    pricing: str = "tabela"
    own_address: str = "cotacao@empresa.com"
    default_mode: str = "RODOVIARIO"
