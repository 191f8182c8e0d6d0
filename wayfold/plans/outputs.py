"""What leaves the engine: result tables, the run log, map payloads, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.text import chunks, counts_text, joined_chunks, short_key, token

MINUTES = 60.0

#: Labels of the engines and strategies in the mode text.
ENGINE_LABELS = {"vroom": "joint routing", "ortools": "capacitated routing", "kmeans": "k-means"}


def vehicle_routes(solutions: DataFrame) -> DataFrame:
    """One row per stop: vehicle 1 and 2, position, node."""
    both = F.array(F.struct(F.lit(1).alias("vehicle"), F.col("route_a").alias("route")), F.struct(F.lit(2).alias("vehicle"), F.col("route_b").alias("route")))
    return solutions.select("instance_id", F.inline(both)).select("instance_id", "vehicle", F.posexplode("route").alias("pos", "idx"))


def vehicle_totals(stops: DataFrame, cells: DataFrame) -> DataFrame:
    """Ids, kilometres and minutes of each vehicle's route."""
    from wayfold.operators.matrix import route_costs

    cost = route_costs(stops, cells, ["vehicle"])
    return cost.select("instance_id", "vehicle", F.round(F.col("distance_m") / 1000, 2).alias("km"), F.round(F.col("duration_s") / MINUTES, 1).alias("min"), "stops")


def side_by_side(stops: DataFrame, points: DataFrame) -> DataFrame:
    """Both routes on one sheet, row by row; the shorter one is padded."""
    named = stops.join(points.select("instance_id", "idx", "id", "address", "lat", "lon"), ["instance_id", "idx"], "left")
    one = lambda v: named.where(F.col("vehicle") == v).select("instance_id", "pos", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{c}_{v}") for c in ("id", "address", "lat", "lon")])
    return one(1).join(one(2), ["instance_id", "pos"], "full").na.fill("")


def responses(solved: DataFrame, points: DataFrame, cells: DataFrame) -> DataFrame:
    """One JSON text per request: status, strategy, sizes, signature, certificate, and each vehicle's ids, kilometres and minutes.

    Solutions meet their instance's packed row, so the plan that makes them stands in this one once.
    """
    from wayfold.functions.text import ids_signature
    from wayfold.operators.matrix import packed

    def cost(matrix, route):
        arcs = F.transform(F.sequence(F.lit(0), F.size(route) - 2), lambda k: F.get(F.get(matrix, F.get(route, k)), F.get(route, k + 1)))
        return F.when(F.size(route) < 2, F.lit(0).cast("long")).otherwise(F.aggregate(arcs, F.lit(0).cast("long"), lambda sum_, v: sum_ + F.coalesce(v, F.lit(0))))

    def tour(vehicle: int, route):
        ids = F.filter(F.transform(route, lambda i: F.get("ids", i)), lambda i: i.isNotNull())
        km, minutes = F.round(cost(F.col("dist"), route) / 1000, 2), F.round(cost(F.col("dur"), route).cast("double") / MINUTES, 1)
        return F.struct(F.lit(vehicle).alias("vehicle"), ids.alias("ids"), km.alias("km"), minutes.alias("min"))

    body = solved.join(packed(points, cells).select("instance_id", "ids", "dur", "dist"), "instance_id", "left")
    tours = F.when(F.col("route_a").isNotNull(), F.array(tour(1, F.col("route_a")), tour(2, F.col("route_b"))))
    body = body.withColumn("tours", tours).withColumn("points_signature", ids_signature(F.col("ids")))
    fields = [
        F.when(F.col("error").isNull(), 200).otherwise(400).alias("status"), "error", F.col("strategy").alias("strategy_requested"), "strategy_used", "sequencer", "source", "duration_s", "distance_m",
        "connected", "cardinality_ok", "components_total", "boundary", F.when(F.col("group_a").isNotNull(), F.array(F.size("group_a"), F.size("group_b"))).alias("partition_sizes"), "points_signature", "tours",
    ]
    return body.select("instance_id", F.to_json(F.struct(*fields)).alias("response"))


def mode_text(results: DataFrame) -> DataFrame:
    """How a result came about: the engine, or the strategy, then the steps; a fallback's reason only where the joint solve is known not to have run."""
    label = F.coalesce(*[F.when(F.col("engine") == k, v) for k, v in ENGINE_LABELS.items()], F.col("strategy"), F.lit("unknown"))
    reason = F.when(F.col("joint_used").eqNullSafe(F.lit(False)) & F.col("error").isNotNull(), F.concat(F.lit("("), F.col("error"), F.lit(")")))
    return results.select("instance_id", F.concat_ws(" + ", label, F.when(F.size("steps") > 0, F.array_join("steps", " + ")), reason).alias("mode"))


def map_stops(stops: DataFrame, points: DataFrame) -> DataFrame:
    """Stops with role and label: D for the start, A for the end, numbers for collections with valid coordinates; others are skipped."""
    from wayfold.functions.geo import finite_coords

    placed = stops.join(points.select("instance_id", "idx", "id", "lat", "lon"), ["instance_id", "idx"], "left")
    of = Window.partitionBy("instance_id", "vehicle")
    last = F.max("pos").over(of)
    role = F.when(F.col("pos") == 0, "start").when(F.col("pos") == last, "end").otherwise("collection")
    valid = finite_coords(F.col("lat"), F.col("lon"))
    counted = F.sum((valid & (role == "collection")).cast("int")).over(of.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = placed.withColumn("role", role).withColumn("valid", valid).withColumn("n", counted)
    label = F.when(F.col("role") == "start", "D").when(F.col("role") == "end", "A").when(F.col("valid"), F.col("n").cast("string"))
    return rows.select("instance_id", "vehicle", "pos", "id", "lat", "lon", "role", "valid", label.alias("label"))


def map_payload(solutions: DataFrame, instances: DataFrame) -> DataFrame:
    """One nested row per instance: routes with their points in order, what was skipped, and the certificate.

    Solutions meet their instance's row of points, so stops are never rows; roles and labels are those of ``map_stops``.
    """
    from wayfold.functions.geo import finite_coords

    def stops(route):
        def stop(i, pos):
            role = F.when(pos == 0, "start").when(pos == F.size(route) - 1, "end").otherwise("collection")
            lat, lon = F.get("lat", i), F.get("lon", i)
            return F.struct(pos.alias("pos"), F.get("ids", i).alias("id"), lat.alias("lat"), lon.alias("lon"), role.alias("role"), finite_coords(lat, lon).alias("valid"))

        return F.transform(route, stop)

    def tour(vehicle: int, all_):
        def point(s):
            before = F.filter(all_, lambda t: t["valid"] & (t["role"] == "collection") & (t["pos"] <= s["pos"]))
            label = F.when(s["role"] == "start", "D").when(s["role"] == "end", "A").otherwise(F.size(before).cast("string"))
            return F.struct(s["pos"].alias("pos"), s["id"].alias("id"), label.alias("label"), s["lat"].alias("lat"), s["lon"].alias("lon"), s["role"].alias("role"))

        points = F.transform(F.filter(all_, lambda s: s["valid"]), point)
        skipped = F.array_sort(F.transform(F.filter(all_, lambda s: ~s["valid"] & s["id"].isNotNull()), lambda s: s["id"]))
        return F.struct(F.lit(vehicle).alias("vehicle"), points.alias("points"), skipped.alias("skipped"))

    certificate = F.struct("connected", "cardinality_ok", "boundary", short_key(F.col("group_a"), F.col("group_b")).alias("key"))
    both = solutions.join(instances.select("instance_id", "ids", "lat", "lon"), "instance_id").withColumns({"stops_a": stops(F.col("route_a")), "stops_b": stops(F.col("route_b"))})
    return both.select("instance_id", F.array(tour(1, F.col("stops_a")), tour(2, F.col("stops_b"))).alias("routes"), certificate.alias("certificate"))


def route_coordinates(stops: DataFrame, points: DataFrame) -> DataFrame:
    """Ordered [lon, lat] of the valid stops of each route."""
    s = map_stops(stops, points).where("valid")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.array("lon", "lat").alias("c"))))
    return s.groupBy("instance_id", "vehicle").agg(F.transform(ordered, lambda e: e["c"]).alias("coordinates"))


def with_geometries(routes: DataFrame, geometries: DataFrame) -> DataFrame:
    """Routes with the road geometry where one with two coordinates or more is known."""
    g = geometries.where(F.size("geometry") >= 2).select("instance_id", "vehicle", "geometry")
    return routes.join(g, ["instance_id", "vehicle"], "left")


# --------------------------------------------------------------------- run log


def run_log(solutions: DataFrame, requests: DataFrame, signatures: DataFrame) -> DataFrame:
    """One flat row per run, fixed columns; sinks append and may only add trailing columns."""
    s = solutions.select(
        "instance_id", "source", "sequencer", F.round("duration_s", 1).alias("duration_s"), F.round("distance_m", 1).alias("distance_m"), "connected", "cardinality_ok", "components_total",
        F.col("boundary.cut_edges").alias("cut_edges"), F.col("boundary.cut_length_m").alias("cut_length_m"), F.col("boundary.enclave_points").alias("enclave_points"),
        F.size("group_a").alias("size_a"), F.size("group_b").alias("size_b"), short_key(F.col("group_a"), F.col("group_b")).alias("partition_key"),
    )
    return requests.select("instance_id", "strategy", "num_vehicles", "max_per_vehicle", "error").join(s, "instance_id", "left").join(signatures, "instance_id", "left")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("mergeSchema", "true").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All runs, columns added later being null in earlier ones."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def log_summary(log: DataFrame) -> DataFrame:
    """Runs per strategy with their counters as one text."""
    n = log.groupBy("strategy", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("strategy").agg(counts_text(F.map_from_entries(F.collect_list(F.struct(F.coalesce("source", F.lit("none")), "n")))).alias("sources"), F.sum("n").alias("runs"))


# ---------------------------------------------------------------------- shares


def new_shares(payloads: DataFrame, now, days: int = 30, size: int = 45000, most: int = 40) -> DataFrame:
    """token, created, expires, name, signature and fragments; payloads that need more fragments than allowed are refused."""
    parts = chunks(F.col("payload"), size)
    n = F.greatest(F.lit(1), F.ceil(F.length("payload") / size)).cast("int")
    return payloads.where(n <= most).select(token().alias("token"), now.alias("created"), (now + F.expr(f"INTERVAL {days} DAYS")).alias("expires"), "name", "signature", n.alias("n"), parts.alias("fragments"))


def read_share(shares: DataFrame, wanted: str, now) -> DataFrame:
    """The payload of a token, if it is known, not expired and complete."""
    fine = (F.col("token") == wanted) & (F.col("expires") >= now) & (F.size("fragments") == F.col("n"))
    return shares.where(fine).select(joined_chunks(F.col("fragments")).alias("payload"))


def revoke_shares(spark: SparkSession, path: str) -> int:
    """Delete all shares; how many there were."""
    shares = spark.read.parquet(path)
    n = shares.count()
    spark.createDataFrame([], shares.schema).write.mode("overwrite").parquet(path)
    return n
