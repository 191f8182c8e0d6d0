"""Cost matrices: completion, packing, route costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_km


def block_plan(sizes: DataFrame, max_cells: int = 3500, max_locations: int = 0) -> DataFrame:
    """Row blocks of even size with rows x n <= max_cells; instances above max_locations (0: off) get an error."""
    per = F.greatest(F.lit(1), F.floor(F.lit(max_cells) / F.col("n")))
    blocks = F.ceil(F.col("n") / per).cast("int")
    error = F.when((F.lit(max_locations) > 0) & (F.col("n") > max_locations), "too many locations")
    plan = sizes.withColumn("error", error).withColumn("blocks", F.when(F.col("error").isNull() & (F.col("n") > 0), blocks).otherwise(0))
    size = F.ceil(F.col("n") / F.col("blocks")).cast("int")
    rows = plan.withColumn("size", size).withColumn("block", F.explode_outer(F.when(F.col("blocks") > 0, F.sequence(F.lit(0), F.col("blocks") - 1))))
    first = F.col("block") * F.col("size")
    return rows.select("instance_id", "n", "error", "block", first.alias("first_row"), (F.least(first + F.col("size"), F.col("n")) - 1).alias("last_row"))


def complete(points: DataFrame, raw: DataFrame, null_speed_kmh: float = 30.0) -> DataFrame:
    """All n x n cells: a missing duration is driven at ``null_speed_kmh`` as the crow flies, a missing distance is the
    crow's where the duration was missing, too, and 0 otherwise; the diagonal is zero; ``filled`` marks missing durations."""
    a = points.select("instance_id", F.col("idx").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = points.select("instance_id", F.col("idx").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    grid = a.join(b, "instance_id").select("instance_id", "i", "j", km.alias("km"))
    full = grid.join(raw, ["instance_id", "i", "j"], "left")
    own = F.col("i") == F.col("j")
    gone = F.col("dur_s").isNull() & ~own
    return full.select(
        "instance_id", "i", "j",
        F.when(own, 0).otherwise(F.rint(F.coalesce(F.col("dur_s").cast("double"), F.col("km") / null_speed_kmh * 3600))).cast("int").alias("dur_s"),
        F.when(own, 0).otherwise(F.rint(F.coalesce(F.col("dist_m").cast("double"), F.when(gone, F.col("km") * 1000).otherwise(0.0)))).cast("int").alias("dist_m"),
        gone.alias("filled"),
    )


def shape_errors(cells: DataFrame) -> DataFrame:
    """Instances whose cells aren't a full square."""
    return cells.groupBy("instance_id").agg(F.count(F.lit(1)).alias("cells"), (F.max("i") + 1).alias("n")).where("cells <> n * n")


def symmetric_costs(cells: DataFrame) -> DataFrame:
    """Mean of both directions, or the one that is known; i < j."""
    back = cells.select("instance_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("dur_s").alias("back_s"))
    both = cells.where("i < j").join(back, ["instance_id", "i", "j"])
    return both.select("instance_id", "i", "j", F.coalesce((F.col("dur_s") + F.col("back_s")) / 2.0, F.col("dur_s").cast("double"), F.col("back_s").cast("double")).alias("cost_s"))


def packed(points: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per instance with its dense matrices, as kernels take them; an instance is bounded by its request (62 nodes: 15 kB)."""
    row = lambda c: F.array_sort(F.collect_list(F.struct("j", c)))
    rows = cells.groupBy("instance_id", "i").agg(row("dur_s").alias("d"), row("dist_m").alias("m"))
    rows = rows.select("instance_id", "i", F.transform("d", lambda e: e["dur_s"]).alias("d"), F.transform("m", lambda e: e["dist_m"]).alias("m"))
    mats = rows.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("i", "d", "m"))).alias("r"))
    pts = points.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon", "id"))).alias("p"))
    return pts.join(mats, "instance_id").select(
        "instance_id", F.size("p").alias("n"), F.transform("p", lambda e: e["id"]).alias("ids"), F.transform("p", lambda e: e["lat"]).alias("lat"), F.transform("p", lambda e: e["lon"]).alias("lon"),
        F.transform("r", lambda e: e["d"]).alias("dur"), F.transform("r", lambda e: e["m"]).alias("dist"),
    )


def route_stops(routes: DataFrame, route_col: str = "route") -> DataFrame:
    """One row per stop of each route."""
    return routes.select("*", F.posexplode(route_col).alias("pos", "idx")).drop(route_col)


def route_costs(stops: DataFrame, cells: DataFrame, keys: list[str], service_s: float = 0.0) -> DataFrame:
    """Seconds, metres and stops of each route: its arcs joined to the matrix, service time per inner stop.

    Routes with fewer than two nodes cost nothing.
    """
    order = Window.partitionBy("instance_id", *keys).orderBy("pos")
    arcs = stops.withColumn("j", F.lead("idx").over(order)).withColumnRenamed("idx", "i")
    priced = arcs.join(cells.select("instance_id", "i", "j", "dur_s", "dist_m"), ["instance_id", "i", "j"], "left")
    inner = F.greatest(F.count(F.lit(1)) - 2, F.lit(0))
    return priced.groupBy("instance_id", *keys).agg(
        (F.coalesce(F.sum("dur_s"), F.lit(0)) + inner * F.lit(service_s)).cast("double").alias("duration_s"), F.coalesce(F.sum("dist_m"), F.lit(0)).cast("long").alias("distance_m"), inner.cast("int").alias("stops")
    )


def packed_route_cost(matrix, route):
    """The same cost as an expression over a packed matrix, for rows that carry both."""
    arcs = F.transform(F.sequence(F.lit(0), F.size(route) - 2), lambda k: F.get(F.get(matrix, F.get(route, k)), F.get(route, k + 1)))
    return F.when(F.size(route) < 2, F.lit(0)).otherwise(F.aggregate(arcs, F.lit(0), lambda acc, v: acc + v))


def crow_km(stops: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Great-circle kilometres along each route."""
    order = Window.partitionBy("instance_id", *keys).orderBy("pos")
    placed = stops.join(points.select("instance_id", "idx", "lat", "lon"), ["instance_id", "idx"])
    arcs = placed.withColumn("lat2", F.lead("lat").over(order)).withColumn("lon2", F.lead("lon").over(order))
    return arcs.groupBy("instance_id", *keys).agg(F.coalesce(F.sum(haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))), F.lit(0.0)).alias("km"))


def members_matrix(cells: DataFrame, members: DataFrame) -> DataFrame:
    """The cells between the nodes of a route."""
    m = members.select("instance_id", F.col("idx"))
    one = cells.join(m.withColumnRenamed("idx", "i"), ["instance_id", "i"], "left_semi")
    return one.join(m.withColumnRenamed("idx", "j"), ["instance_id", "j"], "left_semi").select("instance_id", "i", "j", "dur_s", "dist_m")
