"""Fixed schemas; no free-form maps or inferred types."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = "instance_id long, idx int, id string, address string, lat double, lon double"
CELL = "instance_id long, i int, j int, dur_s int, dist_m int"
PACKED = "instance_id long, n int, lat array<double>, lon array<double>, dur array<array<int>>, dist array<array<int>>"
EDGE = "instance_id long, u int, v int, kind string"
CANDIDATE = "instance_id long, source string, seq int, group_a array<int>, group_b array<int>"
BOUNDARY = "struct<cut_edges: int, cut_length_m: double, cross_neighbors: int, enclave_points: int>"
SOLUTION = (
    "instance_id long, source string, sequencer string, group_a array<int>, group_b array<int>, route_a array<int>, route_b array<int>,"
    f" duration_s double, distance_m double, connected boolean, cardinality_ok boolean, components_total int, boundary {BOUNDARY}"
)

REQUEST = T.StructType([
    T.StructField("points", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("address", T.StringType()),
        T.StructField("lat", T.StringType()), T.StructField("lon", T.StringType()),
    ]))),
    T.StructField("num_vehicles", T.StringType()), T.StructField("max_per_vehicle", T.StringType()),
    T.StructField("start_id", T.StringType()), T.StructField("end_id", T.StringType()),
    T.StructField("strategy", T.StringType()), T.StructField("ortools_solution_limit", T.VariantType()),
    T.StructField("max_swap_candidates", T.VariantType()), T.StructField("swap_max_consecutive_fails", T.VariantType()),
])
