"""Matrices, geometries and orders from outside, behind one interface with retries and counters.

Nothing here reaches a network: a provider is any function from a request to a
reply.  Tests and offline runs use tables; a deployment passes its own client.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRIED = (429,)


@dataclass
class Reply:
    status: int
    body: dict | None = None
    error: str | None = None


@dataclass
class Counted:
    """A provider that counts its calls, retries what may pass, and gives up on what cannot."""

    call: Callable[[dict], Reply]
    retries: int = 3
    backoff_s: float = 2.0
    sleep: Callable[[float], None] = time.sleep
    calls: int = 0
    log: list[str] = field(default_factory=list)

    def reset(self) -> None:
        self.calls, self.log = 0, []

    def once(self, request: dict) -> Reply:
        self.calls += 1
        try:
            return self.call(request)
        except Exception as e:  # a provider may fail in any way; the failure becomes a reply
            return Reply(0, None, type(e).__name__)

    def fetch(self, request: dict) -> Reply:
        for k in range(self.retries):
            reply = self.once(request)
            if reply.status == 200:
                return reply
            self.log.append(reply.error or f"http_{reply.status}")
            if not (reply.status in RETRIED or reply.status >= 500 or reply.status == 0):
                return reply
            if k + 1 < self.retries:
                self.sleep(self.backoff_s * 2**k)
        return reply


def totals(*providers: Counted) -> int:
    return sum(p.calls for p in providers)


def joint_orders(provider: Counted, jobs: list, vehicles: list) -> tuple[dict | None, float, str | None]:
    """{vehicle: ordered job ids} and duration of one joint solve, or an error."""
    reply = provider.once({"jobs": jobs, "vehicles": vehicles})
    if reply.status != 200 or not reply.body:
        return None, 0.0, reply.error or f"http_{reply.status}"
    routes = {r["vehicle"]: [s["id"] for s in r["steps"] if s["type"] == "job"] for r in reply.body.get("routes", [])}
    return routes, float(sum(r.get("duration", 0) for r in reply.body.get("routes", []))), None


def geometry_status(reply: Reply, too_large: bool = False) -> str:
    """A closed set of codes for one directions call."""
    if too_large:
        return "response_too_large"
    if reply.status == 0:
        return "timeout" if reply.error and "timeout" in reply.error.lower() else "network_error"
    if reply.status != 200:
        return f"http_{reply.status}"
    return "ok" if reply.body else "invalid_response"


def table_matrix(cells: DataFrame, requested: DataFrame) -> DataFrame:
    """A matrix provider over a table: the cells of the requested blocks of rows."""
    blocks = requested.select("instance_id", "first_row", "last_row")
    return cells.join(blocks, "instance_id").where("i BETWEEN first_row AND last_row").select("instance_id", "i", "j", "dur_s", "dist_m")


GEOJSON = "struct<type: string, features: array<struct<geometry: struct<type: string, coordinates: array<array<double>>>>>>"


def line_of(geojson):
    """[[lon, lat], ...] of a collection's first feature; further ordinates go; null when any coordinate is malformed."""
    coords = F.try_element_at(F.from_json(geojson, GEOJSON)["features"], F.lit(1))["geometry"]["coordinates"]
    fine = F.forall(coords, lambda c: (F.size(c) >= 2) & F.get(c, F.lit(0)).isNotNull() & F.get(c, F.lit(1)).isNotNull())
    return F.when((F.size(coords) > 0) & fine, F.transform(coords, lambda c: F.slice(c, 1, 2)))


PROFILES = ("driving-car", "driving-hgv")


def map_request_error(profile, routes, most: int = 60):
    """The first thing wrong with a map request, or null: two routes, 2 to 60 coordinates each, pairs of numbers in range."""
    pair = lambda c: (F.size(c) == 2) & F.coalesce(F.get(c, F.lit(0)).between(-180, 180) & F.get(c, F.lit(1)).between(-90, 90) & ~F.isnan(F.get(c, F.lit(0))) & ~F.isnan(F.get(c, F.lit(1))), F.lit(False))
    return (
        F.when(profile.isNotNull() & ~profile.isin(*PROFILES), "profile").when(routes.isNull() | (F.size(routes) != 2), "routes")
        .when(F.exists(routes, lambda r: r.isNull() | (F.size(r) < 2)), "too few coordinates").when(F.exists(routes, lambda r: F.size(r) > most), "too many coordinates")
        .when(~F.forall(routes, lambda r: F.forall(r, pair)), "coordinates")
    )


def map_answer(status_a, status_b):
    """Status of a map request from its two calls; only complete answers may be cached."""
    ok = (status_a == "ok").cast("int") + (status_b == "ok").cast("int")
    return F.when(ok == 2, "ok").when(ok == 1, "partial").otherwise("failed")
