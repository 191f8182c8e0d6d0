"""Instances travel as rows of points: matrices are added behind the shuffle, and stops and splits are never rows."""

import pytest

from wayfold.operators import matrix
from wayfold.plans import catalog, outputs
from wayfold.schemas import SOLUTION
from wayfold.sources import world

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["map_payloads", "run_log"])
def test_solutions_come_from_one_kernel_and_no_matrix_is_shuffled(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    kernels = [k for k, line in enumerate(plan) if "MapInArrow" in line]
    assert len(kernels) == 1  # the solutions stand in the plan once
    below = [k for k, line in enumerate(plan) if "Repartition" in line]
    assert [line for line in plan if " AS dist#" in line] and all(k < below[0] for k, line in enumerate(plan) if " AS dist#" in line)


def test_matrices_of_rows_are_those_of_cells(spark):
    points = world.points(spark, "/root/testdata/sf0.01")
    columns = ["instance_id", "n", "ids", "lat", "lon", "dur", "dist"]
    dense = [df.select(*columns).orderBy("instance_id").collect() for df in (world.with_matrices(world.instances(points)), matrix.packed(points, world.cells(points)))]
    assert dense[0] == dense[1] and len(dense[0]) > 30


def test_payload_skips_points_without_coordinates(spark):
    points = spark.createDataFrame(
        [(1, 0, "d", "", 45.0, 4.0), (1, 1, "a", "", 45.1, 4.1), (1, 2, "x", "", float("nan"), 4.1), (1, 3, "b", "", 45.2, 4.2), (1, 4, "y", "", None, 4.2), (1, 5, None, "", 95.0, 4.2), (1, 6, "w", "", 95.0, 4.2)],
        "instance_id long, idx int, id string, address string, lat double, lon double",
    )
    best = spark.createDataFrame([(1, "s", "q", [1, 2, 3], [4, 5, 6], [0, 2, 1, 3, 0], [0, 6, 5, 4, 0], 1.0, 1.0, True, True, 0, (0, 0.0, 0, 0))], SOLUTION)
    [row] = outputs.map_payload(best, world.instances(points)).collect()
    a, b = row.routes
    assert [(p.pos, p.id, p.label, p.role) for p in a.points] == [(0, "d", "D", "start"), (2, "a", "1", "collection"), (3, "b", "2", "collection"), (4, "d", "A", "end")]
    assert (a.vehicle, a.skipped, b.vehicle, b.skipped) == (1, ["x"], 2, ["w", "y"])
    assert [(p.pos, p.label) for p in b.points] == [(0, "D"), (4, "A")] and row.certificate.connected
