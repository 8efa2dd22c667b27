"""Options of a scoring run: one frozen object, no module state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScoringOptions:
    """``match_policy`` exact demotes threshold matches that aren't exact; ``numeric_source`` is the key read first."""

    match_policy: str = "exact"
    numeric_source: str = "normalizedValue"
    anls_threshold: float = 0.8
    contained_recall: float = 0.9
    bootstrap_seed: int = 20260901
    bootstrap_iterations: int = 2000
    ignore_fields: tuple[str, ...] = ()
    ascii_only: bool = False
    arm_order: tuple[str, ...] = ("RAW", "RAW_POSTPROCESSED", "FINAL")

    def __post_init__(self) -> None:
        if self.match_policy not in ("exact", "threshold"):
            raise ValueError(f"unknown match_policy {self.match_policy!r}")
        if self.numeric_source not in ("normalizedValue", "originalValue"):
            raise ValueError(f"unknown numeric_source {self.numeric_source!r}")
        if not 0 < self.anls_threshold <= 1:
            raise ValueError("anls_threshold must lie in (0, 1]")
