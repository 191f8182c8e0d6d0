"""Responses hold the plan of the solutions once, and price their routes rightly."""

import json

from wayfold.config import Settings
from wayfold.operators import matrix, search
from wayfold.plans import outputs
from wayfold.sources import world


def test_solutions_stand_in_the_plan_once(spark):
    points = world.scattered(spark, 8)
    cells = world.cells(points)
    solved = search.crow_solutions(matrix.packed(points, cells), Settings()).selectExpr("*", "'kmeans' AS strategy", "'kmeans' AS strategy_used", "CAST(NULL AS STRING) AS error")
    out = outputs.responses(solved, points, cells)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    best, cost = solved.first(), {(r.i, r.j): r for r in cells.collect()}
    tours = json.loads(out.first().response)["tours"]
    for vehicle, route, tour in zip((1, 2), (best.route_a, best.route_b), tours, strict=True):
        arcs = [cost[e] for e in zip(route[:-1], route[1:], strict=True)]
        want = {"vehicle": vehicle, "ids": [str(i) for i in route], "km": round(sum(a.dist_m for a in arcs) / 1000, 2), "min": round(sum(a.dur_s for a in arcs) / 60, 1)}
        assert abs(tour["km"] - want["km"]) < 0.011 and abs(tour["min"] - want["min"]) < 0.11 and (tour["vehicle"], tour["ids"]) == (vehicle, want["ids"])
