"""Settings of the engine: one frozen object, read once from the session.

A setting that is absent, unreadable or out of its range takes its default;
nothing is ever truncated into a range.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "wayfold."


def bounded_int(raw: str | None, default: int, lo: int = 0, hi: int = 10**7) -> int:
    try:
        value = int(str(raw).strip())
    except ValueError:
        return default
    return value if lo <= value <= hi else default


def bounded_float(raw: str | None, default: float, lo: float, hi: float) -> float:
    try:
        value = float(str(raw).strip())
    except ValueError:
        return default
    return value if lo <= value <= hi else default


def flag(raw: str | None, default: bool = False) -> bool:
    return default if raw is None or not str(raw).strip() else str(raw).strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    # requests
    num_vehicles: int = 2
    max_per_vehicle: int = 35
    # matrix
    matrix_max_routes: int = 3500
    matrix_max_locations: int = 0
    matrix_retries: int = 3
    null_speed_kmh: float = 30.0
    # separable splits
    separable_refine: int = 12
    separable_max_angles: int = 6000
    # neighbourhood graph
    knn_start: int = 4
    knn_max: int = 12
    road_neighbours: int = 3
    strict_knn: int = 5
    # search
    local_iterations: int = 60
    repair_iterations: int = 200
    tie_seconds: float = 30.0
    max_unique: int = 100
    target_unique: int = 60
    max_raw: int = 2000
    per_source: int = 12
    max_repairs: int = 400
    perturbations: int = 250
    chain_length: int = 4
    local_seeds: int = 6
    refine: int = 36
    finalists: int = 12
    diverse_share: float = 0.5
    legacy_slots: int = 6
    repair_slots: int = 3
    # swaps
    swap_candidates: int = 50
    swap_max_fails: int = 0
    swap_rounds: int = 5
    border_km: float = 0.5
    # hybrid
    service_s: float = 0.0
    enclave_cap: float = 0.15
    alns_iterations: int = 400
    route_first_refined: int = 6
    hybrid_solves: int = 4
    nucleus_solves: int = 1
    # joint payloads
    max_jobs: int = 200
    max_joint_vehicles: int = 4
    max_matrix_dim: int = 256
    # maps and shares
    map_routes: int = 2
    map_max_coords: int = 60
    share_chunk: int = 45000
    share_max_fragments: int = 40
    share_days: int = 30

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Defaults, overridden by ``wayfold.<name>`` of the session."""
        values = {}
        for f in fields(cls):
            raw = spark.conf.get(PREFIX + f.name, None)
            if raw is None:
                continue
            values[f.name] = bounded_int(raw, f.default) if isinstance(f.default, int) else bounded_float(raw, f.default, 0.0, 1e7)
        return cls(**values)


#: Strategy names that requests may carry.
STRATEGIES = ("kmeans", "ortools_haversine", "ortools_ors_matrix", "ortools_ors_matrix_connected", "hybrid_local_vroom_territorial")
COMPONENT_RULES = ("smallest", "farthest", "cheapest_ors")
MOVE_RULES = ("ors_delta", "connectivity", "cross", "haversine")
GROWTH_RULES = ("haversine", "ors", "continuity", "centroid")


def override_key(name: str) -> str:
    if not re.fullmatch(r"[a-z_]+", name):
        raise ValueError(f"not a setting: {name!r}")
    return PREFIX + name
