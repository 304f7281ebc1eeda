"""Serialisable descriptions of a search and of an experiment."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from .functions import fixed_values as V


@dataclass(frozen=True)
class SearchConfig:
    """Everything that decides a ranking; recorded with every experiment."""

    lanes: dict[str, float] = field(default_factory=lambda: dict(V.LANE_WEIGHTS))
    router: str = "heuristic"
    router_folder: str | None = None  # of saved routers, for router = "learned:<version>"
    fusion: str = "weighted"
    rrf_k: int = 60
    candidates: int = 200
    rerank: bool = True
    reranker: str = "term-coverage"
    rerank_top_k: int = 30
    final_mix: dict[str, float] = field(default_factory=lambda: dict(V.FINAL_MIX))
    caption_in_rerank_passage: bool = False
    ocr_no_cue_factor: float = 1.0
    ocr_trgm_threshold: float = 0.45
    dedup_window_s: float = 12.0
    max_hits_per_video: int = 3
    span_mode: str = "segment"
    models: dict[str, str] = field(default_factory=dict)

    def with_overrides(self, overrides: dict[str, Any] | None) -> SearchConfig:
        """A copy with checked changes; mappings are merged key by key."""
        return replace(self, **{name: self._checked(name, value) for name, value in (overrides or {}).items()})

    def _checked(self, name: str, value: Any) -> Any:
        current = asdict(self).get(name)
        if current is None:
            raise KeyError(f"unknown search setting {name!r}")
        if value is None:
            raise ValueError(f"{name} cannot be null")
        if isinstance(current, dict):
            return self._merged(name, current, value)
        if isinstance(current, bool):
            if not isinstance(value, bool):
                raise TypeError(f"{name} takes true or false, not {value!r}")
            return value
        return type(current)(value)

    @staticmethod
    def _merged(name: str, current: dict, value: Any) -> dict:
        if not isinstance(value, dict):
            raise TypeError(f"{name} takes a mapping")
        unknown = set(value) - set(V.LANES) if name == "lanes" else set()
        if unknown:
            raise KeyError(f"unknown lanes {sorted(unknown)}")
        numeric = name in ("lanes", "final_mix")
        return current | {k: float(v) if numeric else v for k, v in value.items()}

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class ExperimentSpec:
    """Which queries to run, over which videos, with which changes to the search."""

    name: str
    dataset: str
    split: str = "test"
    subset: dict = field(default_factory=dict)  # {limit, seed} by video, or {ids: [...]}
    scope: str = "dataset"  # video | dataset | corpus
    limit: int = 10
    tolerance_s: float = V.TOLERANCE_S
    search: dict = field(default_factory=dict)
    group_by: str = "modality"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
