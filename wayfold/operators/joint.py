"""Payloads for joint solves, and the strict validation of what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def payload_error(jobs: DataFrame, n_matrix: int, max_jobs: int = 200, max_dim: int = 256) -> DataFrame:
    """Per instance: the first thing wrong with its jobs (idx), or null."""
    stats = jobs.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    wrong = (
        F.when(F.col("n") != F.col("d"), "duplicate job").when((F.col("lo") < 0) | (F.col("hi") >= n_matrix), "location out of range")
        .when(F.col("n") > max_jobs, "too many jobs").when(F.lit(n_matrix) > max_dim, "matrix too large")
    )
    return stats.select("instance_id", wrong.alias("error"))


def payloads(packed: DataFrame, capacity: int, vehicles: tuple[int, ...] = (1, 2), service_s: int = 0, profile: str = "car") -> DataFrame:
    """One JSON text per instance: unit jobs, capacitated vehicles from depot to depot, whole seconds."""
    job = lambda k: F.struct(k.alias("id"), k.alias("location_index"), F.array(F.lit(1)).alias("delivery"), F.lit(service_s).alias("service"))
    jobs = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1), F.col("n") - 1), job)).otherwise(F.array())
    fleet = F.array(*[F.struct(F.lit(v).alias("id"), F.lit(profile).alias("profile"), F.lit(0).alias("start_index"), F.lit(0).alias("end_index"), F.array(F.lit(capacity)).alias("capacity")) for v in vehicles])
    body = F.struct(jobs.alias("jobs"), fleet.alias("vehicles"), F.struct(F.struct(F.col("dur").alias("durations")).alias(profile)).alias("matrices"))
    return packed.select("instance_id", F.to_json(body).alias("payload"))


def pinned_skills(sides: DataFrame) -> DataFrame:
    """Skills that tie core points to their side's vehicle and leave border points free."""
    skill = F.when(~F.col("free"), F.when(F.col("side") == "a", 1).otherwise(2))
    return sides.select("instance_id", "idx", F.when(skill.isNotNull(), F.array(skill)).otherwise(F.array().cast("array<int>")).alias("skills"))


def validated(steps: DataFrame, expected: DataFrame, vehicles: tuple[int, ...] = (1, 2), cap: int | None = None) -> DataFrame:
    """Per instance: the first fault of a solution's steps (vehicle, pos, kind, idx) against the expected jobs, or null."""
    job = F.col("kind") == "job"
    routes = steps.groupBy("instance_id", "vehicle").agg(
        F.min_by("kind", "pos").alias("first"), F.max_by("kind", "pos").alias("last"), F.count_if(job).alias("jobs")
    )
    fleet = routes.groupBy("instance_id").agg(
        F.array_sort(F.collect_list("vehicle")).alias("vehicles"), F.bool_and(F.col("first") == "start").alias("starts"), F.bool_and(F.col("last") == "end").alias("ends"),
        F.min("jobs").alias("fewest"), F.max("jobs").alias("most"),
    )
    done = steps.where(job).groupBy("instance_id", "idx").agg(F.count(F.lit(1)).alias("times"))
    both = expected.select("instance_id", "idx", F.lit(1).alias("wanted")).join(done, ["instance_id", "idx"], "full")
    marks = both.groupBy("instance_id").agg(F.count_if(F.col("times") > 1).alias("twice"), F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("foreign"))
    joined = expected.select("instance_id").distinct().join(fleet, "instance_id", "left").join(marks, "instance_id", "left")
    fault = (
        F.when(F.col("vehicles").isNull() | (F.col("vehicles") != F.array(*map(F.lit, vehicles))), "vehicles").when(~F.col("starts"), "start").when(~F.col("ends"), "end")
        .when(F.col("fewest") == 0, "empty route").when(F.col("most") > (cap if cap is not None else 1 << 30), "capacity")
        .when(F.col("twice") > 0, "duplicate job").when(F.col("foreign") > 0, "foreign job").when(F.col("missing") > 0, "missing job")
    )
    return joined.select("instance_id", fault.alias("fault"))


def with_depots(sequences: DataFrame) -> DataFrame:
    """route: the depot, the sequence, the depot."""
    return sequences.withColumn("route", F.concat(F.array(F.lit(0)), "sequence", F.array(F.lit(0))))
