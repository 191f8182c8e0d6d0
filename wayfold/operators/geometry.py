"""Linearly separable splits: angles, projections, certificates.

An instance's points are gathered into one row and a kernel does the rest, so
neither pairs of points nor points by angles are ever rows.  Points are taken
in order of idx: results are the same for any order of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import kernels as K
from wayfold.operators.search import per_row


def gathered(points: DataFrame, *columns: str) -> DataFrame:
    """One row per instance: idx and the columns as arrays, in order of idx."""
    rows = points.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("idx", *columns))).alias("p"))
    return rows.select("instance_id", *[F.col("p")[c].alias(c) for c in ("idx", *columns)])


def local_xy(points: DataFrame) -> DataFrame:
    """Metres on a plane about each instance's centroid."""

    def run(row):
        x, y = (v.tolist() for v in K.metres_about_centroid(row["lat"], row["lon"]))
        known = lambda v: None if v != v else v
        for i, a, b in zip(row["idx"], x, y, strict=True):
            yield row["instance_id"], i, known(a), known(b)

    return per_row(gathered(points, "lat", "lon"), run, "instance_id long, idx int, x double, y double")


def _angles(rows: DataFrame, function) -> DataFrame:
    run = lambda row: iter([(row["instance_id"], function(row).tolist())])
    return per_row(rows, run, "instance_id long, angles array<double>").select("instance_id", F.explode("angles").alias("angle"))


def critical_angles(xy: DataFrame, digits: int = 10) -> DataFrame:
    """Directions at which two points change their order, modulo pi; coincident points have none."""
    return _angles(gathered(xy, "x", "y"), lambda row: K.critical_angles(row["x"], row["y"], digits))


def sample_angles(critical: DataFrame, most: int = 6000) -> DataFrame:
    """One angle between each two neighbours, the last wrapping; at most ``most`` per instance, evenly spread."""
    rows = critical.groupBy("instance_id").agg(F.array_sort(F.collect_list("angle")).alias("angles"))
    return _angles(rows, lambda row: K.between(np.array(row["angles"], float), most))


def separable_partitions(points: DataFrame, most_angles: int = 6000) -> DataFrame:
    """Every distinct split of the collection points (idx > 0), with its widest margin."""

    def run(row):
        x, y = K.metres_about_centroid(row["lat"], row["lon"])
        for a, b, margin, angle in K.straight_splits(row["idx"], x, y, K.between(K.critical_angles(x, y), most_angles)):
            yield row["instance_id"], a, b, margin, angle

    return per_row(gathered(points.where("idx > 0"), "lat", "lon"), run, "instance_id long, group_a array<int>, group_b array<int>, margin double, angle double")


def certificates(xy: DataFrame, partitions: DataFrame) -> DataFrame:
    """Violations and margin of each partition, counted anew from the projections."""

    def run(row):
        x, y = (np.array(row[c], float) for c in "xy")
        for c in row["rows"]:
            yield row["instance_id"], c["group_a"], c["group_b"], c["angle"], *K.certificate(row["idx"], x, y, c["group_a"], c["group_b"], c["angle"])

    rows = partitions.groupBy("instance_id").agg(F.collect_list(F.struct("group_a", "group_b", "angle")).alias("rows")).join(gathered(xy, "x", "y"), "instance_id")
    return per_row(rows, run, "instance_id long, group_a array<int>, group_b array<int>, angle double, violations int, margin double")
