"""Parameters of the pipeline; the defaults are the production constants."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    n_bins: int = 72
    min_stable: int = 5
    alpha: float = 0.01
    eps: float = 1e-8
    pcd_weight: float = 0.8
    dyad_weight: float = 0.2
    margin_strict: float = 0.003
    margin_min: float = 0.001
    min_voiced: int = 200
    min_clips: int = 5
    min_gating: float = 0.05
    window: int = 10
    drift: float = 25.0
    voiced_ratio: float = 0.6
    tonic_bins: int = 200
    tonic_peaks: int = 5
    tonic_multipliers: tuple[float, ...] = (0.5, 1.0, 2.0)
    tonic_low: float = 80.0
    tonic_high: float = 400.0
    tonic_tolerance: float = 50.0
    feature_version: str = "v1.2"

    def but(self, **changes) -> Params:
        return replace(self, **changes)


UNKNOWN = "UNKNOWN / LOW CONFIDENCE"


def require_registered(**values) -> None:
    """Refuse to run an experiment whose parameters were not all fixed beforehand."""
    missing = [k for k, v in values.items() if v is None]
    if missing:
        raise ValueError("fix these before running: " + ", ".join(sorted(missing)))
