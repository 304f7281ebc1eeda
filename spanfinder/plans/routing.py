"""Lane weights per query. A router is any object with name and route(plans, base) -> plans + weights."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VISUAL_LIKE = ("visual", "caption", "temporal")


class Router(Protocol):
    name: str

    def route(self, plans: DataFrame, base: Mapping[str, float]) -> DataFrame: ...


def weight_map(weights: Mapping[str, Column]) -> Column:
    return F.create_map(*[c for lane, w in weights.items() for c in (F.lit(lane), w.cast("double"))])


class FixedRouter:
    """The configured weights, whatever the query says."""

    name = "fixed"

    def route(self, plans: DataFrame, base: Mapping[str, float]) -> DataFrame:
        return plans.withColumn("weights", weight_map({lane: F.lit(float(w)) for lane, w in base.items()}))


class HeuristicRouter:
    """Cues found in the query scale the configured weights."""

    name = "heuristic"

    def __init__(self, ocr_no_cue_factor: float = 1.0):
        self.ocr_no_cue_factor = ocr_no_cue_factor

    def route(self, plans: DataFrame, base: Mapping[str, float]) -> DataFrame:
        has = {c: F.array_contains("cues", c) for c in ("split", "speech", "visual", "ocr", "exact")}
        seen_only = ~has["split"] & has["visual"] & ~has["speech"]
        spoken_only = has["speech"] & ~has["visual"]

        def factor(when: Column, by: float, otherwise: float = 1.0) -> Column:
            return F.when(when, by).otherwise(otherwise)

        scale: dict[str, list[Column]] = {lane: [] for lane in base}
        for lane in VISUAL_LIKE:
            scale.setdefault(lane, []).extend(
                [factor(has["split"], 1.4), factor(seen_only, 1.5), factor(spoken_only, 0.6)]
            )
        scale.setdefault("text", []).append(factor(spoken_only, 1.2))
        scale.setdefault("lexical", []).extend([factor(spoken_only, 1.1), factor(has["exact"], 1.5)])
        scale.setdefault("ocr", []).extend(
            [factor(has["split"], 1.3), factor(has["ocr"], 1.6, self.ocr_no_cue_factor), factor(has["exact"], 1.3)]
        )
        weights = {}
        for lane, w in base.items():
            col = F.lit(float(w))
            for f in scale[lane]:
                col = col * f
            weights[lane] = col
        return plans.withColumn("weights", weight_map(weights))


def get_router(name: str, ocr_no_cue_factor: float = 1.0, learned=None, folder: str | None = None) -> Router:
    """`learned:<version>` is the router given, or the one of that version in the folder of saved routers."""
    if name == "fixed":
        return FixedRouter()
    if name == "heuristic":
        return HeuristicRouter(ocr_no_cue_factor)
    if name.startswith("learned:") and learned is not None:
        return learned
    if name.startswith("learned:") and folder:
        from .learned_router import load_router

        return load_router(folder, name.removeprefix("learned:"))
    raise ValueError(f"unknown router {name!r} (fixed | heuristic | learned:<version>)")


def pin_weights(plans: DataFrame, overrides: Mapping[str, float] | None) -> DataFrame:
    """Explicit lane weights win over the router; unknown lanes are ignored."""
    if not overrides:
        return plans
    pinned = F.create_map(*[c for k, v in overrides.items() if v is not None for c in (F.lit(k), F.lit(float(v)))])
    return plans.withColumn(
        "weights", F.transform_values("weights", lambda k, v: F.coalesce(F.try_element_at(pinned, k), v))
    )
