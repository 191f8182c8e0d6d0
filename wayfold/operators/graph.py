"""Neighbourhood graphs, components, borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_km


def pair_distances(points: DataFrame) -> DataFrame:
    """All ordered pairs of different points of an instance, with kilometres."""
    a = points.select("instance_id", F.col("idx").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = points.select("instance_id", F.col("idx").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "instance_id").where("i <> j").select("instance_id", "i", "j", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))


def nearest(distances: DataFrame, k: int, cost: str = "km") -> DataFrame:
    """The k nearest of each point by (cost, j), with their rank."""
    rank = F.row_number().over(Window.partitionBy("instance_id", "i").orderBy(cost, "j"))
    return distances.where(F.col(cost).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k)


def canonical_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select("instance_id", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct()


def knn_edges(points: DataFrame, k: int) -> DataFrame:
    """Undirected edges to the k nearest by great circle."""
    return canonical_edges(nearest(pair_distances(points), k))


def strict_knn(points: DataFrame, k: int = 5) -> DataFrame:
    """The same graph with a fixed k; small instances have fewer neighbours to offer."""
    return knn_edges(points, k)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("instance_id", "u", "v").unionByName(edges.select("instance_id", F.col("v").alias("u"), F.col("u").alias("v")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label: the smallest node that each node (u) of an instance reaches over the edges between its nodes.

    An instance is bounded by its request, so its graph travels as one row and
    is settled in one pass.
    """
    from wayfold.operators.kernels import adjacency, parts
    from wayfold.operators.search import per_row

    links = edges.groupBy("instance_id").agg(F.collect_list(F.struct("u", "v")).alias("links"))
    packed = nodes.groupBy("instance_id").agg(F.collect_set("u").alias("nodes")).join(links, "instance_id", "left")

    def labels(row):
        adj = adjacency((e["u"], e["v"]) for e in row["links"] or [])
        for part in parts(row["nodes"], adj):
            for u in part:
                yield row["instance_id"], u, part[0]

    return per_row(packed, labels, "instance_id long, u int, label int")


def component_summary(labels: DataFrame) -> DataFrame:
    """count, sizes (descending), and components ordered by size and least node."""
    keys = ["instance_id"]
    each = labels.groupBy(*keys, "label").agg(F.array_sort(F.collect_list("u")).alias("nodes"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.size("nodes")).alias("s"), F.col("label").alias("l"), "nodes")))
    out = each.groupBy(*keys).agg(ordered.alias("c"))
    return out.select(*keys, F.size("c").alias("components"), F.transform("c", lambda c: -c["s"]).alias("sizes"), F.transform("c", lambda c: c["nodes"]).alias("members"), (F.size("c") <= 1).alias("connected"))


def membership(partitions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per point of a partition: side a or b."""
    sides = F.concat(F.transform("group_a", lambda x: F.struct(x.alias("idx"), F.lit("a").alias("side"))), F.transform("group_b", lambda x: F.struct(x.alias("idx"), F.lit("b").alias("side"))))
    return partitions.select("instance_id", *keys, F.inline(sides))


def sided_edges(edges: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Directed edges of both ends' sides; ends outside the partition drop out."""
    m = members.select("instance_id", *keys, "idx", "side")
    first = both_ways(edges).join(m.select("instance_id", *keys, F.col("idx").alias("u"), F.col("side").alias("su")), ["instance_id", "u"])
    return first.join(m.select("instance_id", *keys, F.col("idx").alias("v"), F.col("side").alias("sv")), ["instance_id", *keys, "v"])


def boundary_metrics(edges: DataFrame, members: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """cut_edges, their length, neighbours across (both directions), and enclaves: points most of whose neighbours are foreign."""
    place = points.select("instance_id", F.col("idx").alias("p"), "lat", "lon")
    e = sided_edges(edges, members, keys)
    e = e.join(place.select("instance_id", F.col("p").alias("u"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), ["instance_id", "u"]).join(place.select("instance_id", F.col("p").alias("v"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), ["instance_id", "v"])
    foreign = F.col("su") != F.col("sv")
    metres = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) * 1000
    node = e.groupBy("instance_id", *keys, "u").agg(
        F.sum(foreign.cast("int")).alias("foreign"), F.count(F.lit(1)).alias("degree"),
        F.sum((foreign & (F.col("su") == "a")).cast("int")).alias("cut"), F.sum(F.when(foreign & (F.col("su") == "a"), metres).otherwise(0.0)).alias("length"),
    )
    return node.groupBy("instance_id", *keys).agg(
        F.sum("cut").cast("int").alias("cut_edges"), F.round(F.sum("length"), 1).alias("cut_length_m"), F.sum("foreign").cast("int").alias("cross_neighbors"), F.count_if(F.col("foreign") * 2 > F.col("degree")).cast("int").alias("enclave_points")
    )


def border_nodes(edges: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Points with a neighbour on the other side."""
    return sided_edges(edges, members, keys).where("su <> sv").select("instance_id", *keys, F.col("u").alias("idx"), F.col("su").alias("side")).distinct()


def border_and_cores(edges: DataFrame, members: DataFrame, keys: list[str], depth: int = 1) -> DataFrame:
    """Each point with ``free``: whether it lies on the border or within depth - 1 steps of it."""
    free = border_nodes(edges, members, keys).select("instance_id", *keys, "idx")
    for _ in range(depth - 1):
        near = free.join(both_ways(edges).withColumnRenamed("u", "idx"), ["instance_id", "idx"]).select("instance_id", *keys, F.col("v").alias("idx"))
        free = free.unionByName(near.join(members.select("instance_id", *keys, "idx"), ["instance_id", *keys, "idx"], "left_semi")).distinct()
    return members.join(free.withColumn("free", F.lit(True)), ["instance_id", *keys, "idx"], "left").withColumn("free", F.coalesce("free", F.lit(False)))


def close_to_other_route(stops: DataFrame, points: DataFrame, km: float = 0.5) -> DataFrame:
    """Points of a vehicle within ``km`` of another vehicle's points, by distance."""
    s = stops.join(points.select("instance_id", "idx", "lat", "lon"), ["instance_id", "idx"])
    a = s.select("instance_id", "vehicle", "idx", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = s.select("instance_id", F.col("vehicle").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    d = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    near = a.join(b, "instance_id").where("vehicle <> other").withColumn("km", d).where(F.col("km") < km)
    return near.groupBy("instance_id", "vehicle", "idx").agg(F.min("km").alias("km"))


def farthest_pair(xy: DataFrame) -> DataFrame:
    """The two points farthest apart on the plane; ties to the smaller indices."""
    a = xy.select("instance_id", F.col("idx").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = xy.select("instance_id", F.col("idx").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    pairs = a.join(b, "instance_id").where("i < j").withColumn("d", d)
    best = F.min_by(F.struct("i", "j", "d"), F.struct(-F.col("d"), F.col("i"), F.col("j")))
    return pairs.groupBy("instance_id").agg(best.alias("p")).select("instance_id", "p.i", "p.j", "p.d")


PROJECTIONS = (30, 60, 120, 150)


def seed_pairs(points: DataFrame, xy: DataFrame, symmetric: DataFrame) -> DataFrame:
    """Contrasted pairs of points to grow regions from: farthest apart, ends of six directions, farthest by road,
    first and last index, first and middle; the first mention of a pair counts."""
    pt = points.where("idx > 0")
    of = lambda rank, a, b: (F.lit(rank).alias("rank"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    far = farthest_pair(xy).select("instance_id", *of(0, F.col("i"), F.col("j")))
    ends = lambda rank, c: xy.groupBy("instance_id").agg(F.min_by("idx", F.struct(c, "idx")).alias("a"), F.min_by("idx", F.struct(-c, F.col("idx"))).alias("b")).select("instance_id", *of(rank, F.col("a"), F.col("b")))
    pairs = far.unionByName(ends(1, F.col("y"))).unionByName(ends(2, F.col("x")))
    for k, degrees in enumerate(PROJECTIONS):
        turn = F.radians(F.lit(float(degrees)))
        pairs = pairs.unionByName(ends(3 + k, F.col("x") * F.cos(turn) + F.col("y") * F.sin(turn)))
    road = symmetric.where("i > 0").groupBy("instance_id").agg(F.min_by(F.struct("i", "j"), F.struct(-F.col("cost_s"), F.col("i"), F.col("j"))).alias("p"))
    pairs = pairs.unionByName(road.select("instance_id", *of(7, F.col("p.i"), F.col("p.j"))))
    ids = pt.groupBy("instance_id").agg(F.array_sort(F.collect_list("idx")).alias("ids"))
    pairs = pairs.unionByName(ids.select("instance_id", *of(8, F.get("ids", F.lit(0)), F.get("ids", F.size("ids") - 1))))
    pairs = pairs.unionByName(ids.select("instance_id", *of(9, F.get("ids", F.lit(0)), F.get("ids", F.floor(F.size("ids") / 2).cast("int")))))
    return pairs.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").groupBy("instance_id", "u", "v").agg(F.min("rank").alias("rank"))
