"""Ranking and choosing solutions: lexicographic keys, the tie window, territorial levels, arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import enclave_level
from wayfold.functions.text import one_sided_key

#: Which order of stops is preferred among equals, the rank of all others, and the reason each is reported with.
SEQUENCER_RANK = {"ortools": 0, "vroom": 1, "heuristic": 2}
OTHER_RANK = 9
SELECTION_REASONS = {"heuristic": "level1_heuristic", "ortools": "level2_ortools", "vroom": "level3_vroom"}


def selection_key() -> Column:
    """Pre-rank: connected, even, few components, short in time, then in distance, a clean border, the key."""
    return F.struct(
        (~F.col("connected")).alias("k1"), (~F.col("cardinality_ok")).alias("k2"), F.col("components_total").alias("k3"), F.col("duration_s").alias("k4"),
        F.col("distance_m").alias("k5"), (F.col("boundary.cut_edges") + F.col("boundary.enclave_points")).alias("k6"), one_sided_key(F.col("group_a"), F.col("group_b")).alias("k7"),
    )


def ranked(solutions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """0-based rank per instance by the selection key."""
    order = Window.partitionBy("instance_id", *(keys or [])).orderBy(selection_key())
    return solutions.withColumn("rank", F.row_number().over(order) - 1)


def sequencer_rank(sequencer: Column) -> Column:
    return F.coalesce(*[F.when(sequencer == s, r) for s, r in SEQUENCER_RANK.items()], F.lit(OTHER_RANK))


def tiebreak() -> Column:
    """Within the window: distance, a clean border, the partition, then who ordered the stops, and the stops."""
    zero = lambda c: F.coalesce(F.col(f"boundary.{c}"), F.lit(0))
    return F.struct(
        F.col("distance_m").alias("t1"), (zero("cut_edges") + zero("enclave_points")).alias("t2"), one_sided_key(F.col("group_a"), F.col("group_b")).alias("t3"),
        sequencer_rank(F.col("sequencer")).alias("t4"), F.coalesce("sequencer", F.lit("")).alias("t5"), F.concat("route_a", "route_b").alias("t6"),
    )


def window_pool(solutions: DataFrame, tie_seconds: float = 30.0) -> DataFrame:
    """Valid solutions (all, where none is) no more than ``tie_seconds`` above the fastest; the bound is included."""
    of = Window.partitionBy("instance_id")
    valid = F.col("connected") & F.col("cardinality_ok")
    pool = solutions.withColumn("_valid", valid).withColumn("_any", F.max("_valid").over(of)).where("_valid = _any")
    return pool.withColumn("_best", F.min("duration_s").over(of)).where(F.col("duration_s") <= F.col("_best") + tie_seconds).drop("_valid", "_any", "_best")


def select_best(solutions: DataFrame, tie_seconds: float = 30.0) -> DataFrame:
    """One solution per instance: within the window the shortest distance wins."""
    pool = window_pool(solutions, tie_seconds)
    columns = [c for c in pool.columns if c != "instance_id"]
    best = pool.groupBy("instance_id").agg(F.min_by(F.struct(*columns), tiebreak()).alias("s"))
    return best.select("instance_id", *[F.col(f"s.{c}").alias(c) for c in columns])


def selection_reason(solutions: DataFrame, tie_seconds: float = 30.0) -> DataFrame:
    """The winner, and which level of ordering it came from; an unknown sequencer stands for itself."""
    s = F.col("sequencer")
    reason = F.coalesce(*[F.when(s == k, v) for k, v in SELECTION_REASONS.items()], s)
    return select_best(solutions, tie_seconds).withColumn("reason", reason)


def select_territorial(solutions: DataFrame, tie_seconds: float = 30.0, cap: float = 0.15) -> DataFrame:
    """Among sound solutions (connected and even) the lowest level of enclaves is taken first, then the tie window decides.

    Where none is sound the window decides over all, where none reaches a level
    over the sound ones; both are marked as not admissible, without a level.
    """
    of = Window.partitionBy("instance_id")
    n = F.size("group_a") + F.size("group_b")
    sound = F.col("connected") & F.col("cardinality_ok")
    pool = solutions.withColumn("_sound", sound).withColumn("_any", F.max("_sound").over(of)).where("_sound = _any")
    enclaves = F.coalesce("boundary.enclave_points", F.lit(0))
    level = pool.withColumn("level", F.when(F.col("_any"), enclave_level(enclaves, n, cap))).withColumn("_least", F.min("level").over(of))
    at_level = level.where(F.col("_least").isNull() | (F.col("level") == F.col("_least")))
    best = select_best(at_level.withColumn("_some", F.col("_any")).drop("_sound", "_any", "_least"), tie_seconds)
    reason = F.when(F.col("level").isNotNull(), "").when(F.col("_some"), "enclave_cap_exceeded").otherwise("no_structurally_valid_solution")
    return best.select(*solutions.columns, F.col("level").alias("territorial_level"), F.col("level").isNotNull().alias("admissible"), reason.alias("fallback_reason"))


def arbitrate(before: DataFrame, after: DataFrame, tie_seconds: float = 30.0) -> DataFrame:
    """Whether the post-optimised routes replace those before: both compete by the tie window and its tiebreak.

    The later one competes under a sequencer of its own, whose rank is behind
    all known ones, so equal distances keep the earlier one.  Without a solution
    before there is nothing to compare; routes whose points changed are
    rejected; incomplete figures keep the later one.
    """
    columns = ("route_a", "route_b", "duration_s", "distance_m")
    b = before.select("instance_id", *[F.col(c).alias(f"b_{c}") for c in columns], F.coalesce(F.nullif("sequencer", F.lit("")), F.lit("heuristic")).alias("b_by"))
    a = after.select("instance_id", *[F.col(c).alias(f"a_{c}") for c in columns])
    same = lambda c: F.array_sort(F.array_distinct(f"b_{c}")) == F.array_sort(F.array_distinct(f"a_{c}"))
    nothing = F.coalesce(F.size("b_route_a") + F.size("b_route_b"), F.lit(0)) <= 0
    blank = F.col("b_duration_s").isNull() | F.col("a_duration_s").isNull() | F.col("b_distance_m").isNull() | F.col("a_distance_m").isNull()
    key = lambda s, by: F.struct(F.col(f"{s}_distance_m").alias("d"), sequencer_rank(by).alias("r"), by.alias("s"), F.concat(f"{s}_route_a", f"{s}_route_b").alias("p"))
    fastest = F.least("b_duration_s", "a_duration_s")
    in_b, in_a = F.col("b_duration_s") <= fastest + tie_seconds, F.col("a_duration_s") <= fastest + tie_seconds
    after_wins = in_a & (~in_b | (key("a", F.lit("or2opt")) < key("b", F.col("b_by"))))
    verdict = (
        F.when(nothing, "no_comparison_possible").when(~(same("route_a") & same("route_b")), "membership_changed").when(blank, "metrics_incomplete")
        .when(after_wins, "or2opt_kept").otherwise("or2opt_rejected")
    )
    out = a.join(b, "instance_id", "left").withColumn("verdict", verdict)
    return out.select("instance_id", "verdict", F.col("verdict").isin("no_comparison_possible", "metrics_incomplete", "or2opt_kept").alias("kept"), "b_duration_s", "a_duration_s", "b_distance_m", "a_distance_m")


def connectivity_penalty(best: DataFrame, reference: DataFrame) -> DataFrame:
    """What connection costs: the winner's duration and distance against the reference's, reliable where the reference is even."""
    r = reference.select("instance_id", F.col("duration_s").alias("reference_s"), F.col("distance_m").alias("reference_m"), F.col("cardinality_ok").alias("reliable"))
    share = F.when(F.col("reference_s") > 0, F.round((F.col("duration_s") / F.col("reference_s") - 1) * 100, 2))
    return best.join(r, "instance_id", "left").select(
        "instance_id", "duration_s", "reference_s", (F.col("duration_s") - F.col("reference_s")).alias("penalty_s"), (F.col("distance_m") - F.col("reference_m")).alias("penalty_m"), share.alias("penalty_pct"), F.coalesce("reliable", F.lit(False)).alias("reliable")
    )


def deduplicated(candidates: DataFrame, key: Column, order: list) -> DataFrame:
    """The first candidate of each key, by stage and place in its stage."""
    w = Window.partitionBy("instance_id", key).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def capped_per_source(candidates: DataFrame, per_source: int, order: list) -> DataFrame:
    w = Window.partitionBy("instance_id", "source").orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_source).drop("_n")


def smallest_difference(candidates: DataFrame) -> DataFrame:
    """The least number of points that any two candidates of an instance differ by; 0 below two candidates."""
    from wayfold.functions.text import canonical_key, partition_difference

    keyed = candidates.select("instance_id", canonical_key(F.col("group_a"), F.col("group_b")).alias("k"))
    a, b = keyed.withColumnRenamed("k", "p"), keyed.withColumnRenamed("k", "q")
    gaps = a.join(b, "instance_id").where("p < q").select("instance_id", partition_difference(F.col("p"), F.col("q")).alias("d"))
    counted = keyed.groupBy("instance_id").agg((F.count(F.lit(1)) > F.count_distinct("k")).alias("twice"))
    least = gaps.groupBy("instance_id").agg(F.min("d").alias("d"))
    return counted.join(least, "instance_id", "left").select("instance_id", F.when(F.col("twice"), 0).otherwise(F.coalesce("d", F.lit(0))).alias("least_difference"))


def source_counters(considered: DataFrame) -> DataFrame:
    """Counters per source of considered candidates (columns source and verdict)."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return considered.groupBy("instance_id", "source").agg(
        F.count(F.lit(1)).alias("raw"), n("duplicate").alias("duplicate"), n("invalid_size").alias("size"), n("disconnected").alias("disconnected"), n("lost_points").alias("failed"), n("ok").alias("unique")
    )


def partition_verdict(connected: Column, target: Column, indices: Column) -> Column:
    """The first fault of a partition: duplicate, lost_points, invalid_size, disconnected, or ok."""
    both = F.concat("group_a", "group_b")
    return (
        F.when(F.size(F.array_distinct(both)) != F.size(both), "duplicate")
        .when((F.size(F.array_except(indices, both)) > 0) | (F.size(F.array_except(both, indices)) > 0), "lost_points")
        .when((F.size("group_a") != target) | (F.size("group_b") != F.size(indices) - target), "invalid_size")
        .when(~connected, "disconnected").otherwise("ok")
    )
