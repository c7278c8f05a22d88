"""Settings of the risk engine."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

# Merchant category risk and its default.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}
DEFAULT_RISK = 0.50
# Feature count, fixed-point scale, neighbours that vote, frauds that deny.
DIMS = 14
SCALE = 4096
NEIGHBOURS = 5
DENY_AT = 3


@dataclass(frozen=True)
class Normalization:
    """Divisors of the features (fixed values)."""

    max_amount: float = 10000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10000.0

    @classmethod
    def parse(cls, text: str) -> Normalization:
        """From a JSON object; a missing constant is an error."""
        given = json.loads(text)
        return cls(**{f.name: float(given[f.name]) for f in fields(cls)})


@dataclass(frozen=True)
class ScoringConfig:
    """Search settings. The shortcuts that may change a count are off unless asked for."""

    neighbours: int = NEIGHBOURS
    candidates: int = NEIGHBOURS + 1
    nprobe: int = 5
    nprobe_full: int = 40
    repair: bool = True
    rerank: bool = True
    profile: bool = False
    profile_min_count: int = 30
    unanimity_skip: bool = False
    deterministic_skip: bool = False
    #: Bytes of query vectors that are broadcast at a time; inverted-file search routes more of them
    #: by shuffles, exact search goes block by block.
    block_bytes: int = 32 << 20
    #: Leading dimensions that the routed search measures before it decides whether to go on.
    early_exit_dims: int = 8
    max_body: int = 4096
