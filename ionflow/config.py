"""Settings of a prediction, checked when made and known by a hash."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math

from ionflow.constants import ELEMENTS, LIMITS


def _whole(name: str, value, least: int) -> None:
    if type(value) is not int or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    # Names and defaults of settings.
    schema_version: int = 1
    precursor_ppm: float = 10.0
    fragment_ppm: float = 10.0
    fragment_da: float = 0.002
    intensity_floor: float = 0.001
    max_peaks: int = 128
    max_candidates: int = 10_000
    max_search_results: int = 250_000
    seed: int = 42
    element_limits: dict = dataclasses.field(default_factory=lambda: dict(LIMITS))

    def __post_init__(self):
        if self.schema_version != 1:
            raise ValueError("schema_version must be 1")
        for name in ("precursor_ppm", "fragment_ppm", "fragment_da"):
            x = getattr(self, name)
            if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x <= 0:
                raise ValueError(f"{name} must be positive and finite")
        if self.precursor_ppm >= 1e6:
            raise ValueError("precursor_ppm must be under 1e6")
        if isinstance(self.intensity_floor, bool) or not 0 <= self.intensity_floor <= 1:
            raise ValueError("intensity_floor must lie between 0 and 1")
        for name in ("max_peaks", "max_candidates", "max_search_results"):
            _whole(name, getattr(self, name), 1)
        if type(self.seed) is not int:
            raise ValueError("seed must be an integer")
        if unknown := set(self.element_limits) - set(ELEMENTS):
            raise ValueError(f"unknown elements: {sorted(unknown)}")
        for e, n in self.element_limits.items():
            _whole(f"limit of {e}", n, 0)

    @property
    def limits(self) -> list[int]:
        return [self.element_limits.get(e, 0) for e in ELEMENTS]

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @property
    def version(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:16]

    @classmethod
    def from_dict(cls, data: dict) -> EngineConfig:
        """From flat settings, or those under "formula", which win over all others."""
        data = data.get("formula", data)
        names = {f.name for f in dataclasses.fields(cls)}
        if unknown := set(data) - names:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**data)

    @classmethod
    def load(cls, path: str) -> EngineConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))
