"""The five strategies as plans over any number of instances, and the dispatch by request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.config import Settings
from wayfold.functions.text import canonical_key, matrix_content_hash, seed_of
from wayfold.operators import search, selection
from wayfold.sources.world import with_matrices


def kmeans(points: DataFrame, packed: DataFrame, settings: Settings) -> DataFrame:
    """Joint solves where they exist, else k-means partitions; the shortest in time wins."""
    joint = search.joint_orders(packed, settings).withColumn("_class", F.lit(0))
    means = search.kmeans_solutions(packed, settings).withColumn("_class", F.lit(1))
    every = joint.unionByName(means)
    columns = [c for c in every.columns if c not in ("instance_id", "_class")]
    best = every.groupBy("instance_id").agg(F.min_by(F.struct(*columns), F.struct("_class", "duration_s", "distance_m", "group_a")).alias("s"))
    return best.select("instance_id", "s.*")


def crow_capacity(points: DataFrame, packed: DataFrame, settings: Settings) -> DataFrame:
    return search.crow_solutions(packed, settings)


def separable(points: DataFrame, packed: DataFrame, settings: Settings) -> DataFrame:
    """The straight split that is shortest in time; its certificate is counted anew and must show no violation."""
    return search.separable_solutions(packed, settings).where("violations = 0 AND margin > 0").drop("violations", "margin")


def connected(points: DataFrame, packed: DataFrame, settings: Settings) -> DataFrame:
    """Candidates of every source, deduplicated and capped, estimated, the best refined, diverse finalists ordered anew; the tie window decides."""
    order = ["stage", "seq"]
    found = search.candidates(packed, settings).where("verdict = 'ok'")
    unique = selection.deduplicated(found, canonical_key(F.col("group_a"), F.col("group_b")), order)
    # the cap is for the second stage; one window, as a union of both parts would run the generators twice
    of = Window.partitionBy("instance_id", "source", F.col("stage") == 2).orderBy(*order)
    pool = unique.withColumn("_n", F.row_number().over(of)).where((F.col("stage") != 2) | (F.col("_n") <= settings.per_source)).drop("_n")
    rough = selection.ranked(search.rough_scores(pool, packed, settings))
    few = rough.where(F.col("rank") < settings.refine).drop("rank")
    return selection.select_best(search.diverse_finalists(few, packed, settings), settings.tie_seconds)


def hybrid(points: DataFrame, packed: DataFrame, settings: Settings) -> DataFrame:
    """Cut cycles, joint solves and a seeded search; the lowest level of enclaves first, then the tie window."""
    seed = seed_of(matrix_content_hash(F.col("dur"), F.col("dist")))
    seeded = with_matrices(packed).withColumn("seed", seed).select(*packed.columns, "seed")
    solved = search.hybrid_solutions(seeded, settings)
    return selection.select_territorial(solved, settings.tie_seconds, settings.enclave_cap).drop("territorial_level", "admissible", "fallback_reason")


PLANS = {
    "kmeans": kmeans,
    "ortools_haversine": crow_capacity,
    "ortools_ors_matrix": separable,
    "ortools_ors_matrix_connected": connected,
    "hybrid_local_vroom_territorial": hybrid,
}


def solve(requests: DataFrame, points: DataFrame, packed: DataFrame, settings: Settings) -> DataFrame:
    """Each request's instance solved by the strategy it asks for; requests with an error keep it and get no solution."""
    out = None
    for name, plan in PLANS.items():
        mine = requests.where((F.col("strategy") == name) & F.col("error").isNull()).select("instance_id")
        solved = plan(points.join(mine, "instance_id", "left_semi"), packed.join(mine, "instance_id", "left_semi"), settings).withColumn("strategy_used", F.lit(name))
        out = solved if out is None else out.unionByName(solved)
    return requests.select("instance_id", "strategy", "error").join(out, "instance_id", "left")
