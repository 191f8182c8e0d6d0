"""Routing instances from the driver's tables, and the synthetic generators.

Points come from an integer generator (1103515245 x + 12345 mod 2^31), so every
engine computes the same coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.geo import haversine_m, travel_seconds

NODES = 61
SPEED_KMH = 28.0
MODULUS = 2147483648
#: Customer keys that are numbered by one task, and instances that a nation may have.
RANGE = 1 << 18
NATION = 1_000_000_000


def lcg(x: Column) -> Column:
    return F.pmod(F.lit(1103515245) * x.cast("long") + 12345, F.lit(MODULUS))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation in groups of 61: a depot (idx 0) and up to 60 collection points."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", F.floor(F.col("c_custkey") / RANGE).alias("_range"))
    # numbers within a nation: those within a range of keys, behind the counts of the ranges before
    counts = customers.groupBy("c_nationkey", "_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("c_nationkey").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("c_nationkey", "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    rn = F.col("_before") + F.row_number().over(Window.partitionBy("c_nationkey", "_range").orderBy("c_custkey")) - 1
    h1 = lcg(F.col("c_custkey"))
    numbered = customers.join(counts, ["c_nationkey", "_range"]).withColumn("rn", rn).withColumn("h1", h1).withColumn("h2", lcg(F.col("h1")))
    return numbered.select(
        (F.col("c_nationkey").cast("long") * NATION + F.floor(F.col("rn") / NODES)).alias("instance_id"),
        F.pmod("rn", F.lit(NODES)).cast("int").alias("idx"),
        F.col("c_custkey").cast("string").alias("id"),
        F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("address"),
        (F.lit(45.40) + F.lit(0.09) * F.col("h1") / F.lit(2147483648.0)).alias("lat"),
        (F.lit(4.33) + F.lit(0.11) * F.col("h2") / F.lit(2147483648.0)).alias("lon"),
    )


def cells(pts: DataFrame, kmh: float = SPEED_KMH) -> DataFrame:
    """All ordered pairs of an instance with metres and seconds; the diagonal is zero."""
    a = pts.select("instance_id", F.col("idx").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = pts.select("instance_id", F.col("idx").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    metres = haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    pairs = a.join(b, "instance_id").withColumn("dist_m", F.when(F.col("i") == F.col("j"), 0).otherwise(metres))
    return pairs.select("instance_id", "i", "j", travel_seconds(F.col("dist_m"), kmh).alias("dur_s"), "dist_m")


def instances(pts: DataFrame) -> DataFrame:
    """One row per instance with its points as arrays in order of idx: n, ids, lat, lon; ``with_matrices`` adds the rest."""
    rows = pts.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("idx", "id", "lat", "lon"))).alias("p"))
    return rows.select("instance_id", F.size("p").alias("n"), F.col("p")["id"].alias("ids"), F.col("p")["lat"].alias("lat"), F.col("p")["lon"].alias("lon"))


def with_matrices(rows: DataFrame, kmh: float = SPEED_KMH) -> DataFrame:
    """Rows of ``instances`` with the matrices that ``cells`` has as rows: 15 kB where a row has 3 kB, so they are best added where they are used.

    Rows that have matrices are left alone.
    """
    if "dur" in rows.columns:
        return rows
    far = lambda i, j: F.when(i == j, 0).otherwise(haversine_m(F.get("lat", i), F.get("lon", i), F.get("lat", j), F.get("lon", j)))
    each = F.sequence(F.lit(0), F.col("n") - 1)
    placed = rows.withColumn("dist", F.transform(each, lambda i: F.transform(each, lambda j: far(i, j))))
    return placed.withColumn("dur", F.transform("dist", lambda r: F.transform(r, lambda m: travel_seconds(m, kmh))))


def raw_cells(base: DataFrame) -> DataFrame:
    """What a provider might send: asymmetric seconds, and cells that are missing."""
    i, j, inst = F.col("i"), F.col("j"), F.col("instance_id")
    gone = (F.pmod(i * 31 + j * 17 + inst, F.lit(97)) == 0) & (i != j)
    return base.select("instance_id", "i", "j", F.when(~gone, F.when(i == j, 0).otherwise(F.col("dur_s") + F.pmod(i * 7 + j * 3, F.lit(11)))).cast("int").alias("dur_s"), F.when(~(gone & (F.pmod(i, F.lit(2)) == 0)), F.col("dist_m")).alias("dist_m"))


def scattered(spark: SparkSession, n: int, seed: int = 7, instance_id: int = 0) -> DataFrame:
    """n points by successive draws of the generator."""
    x, rows = seed, []
    for k in range(n + 1):
        x = (1103515245 * x + 12345) % MODULUS
        a = x / MODULUS
        x = (1103515245 * x + 12345) % MODULUS
        rows.append((instance_id, k, str(k), None, 45.400 + 0.09 * a, 4.330 + 0.11 * (x / MODULUS)))
    return spark.createDataFrame(rows, "instance_id long, idx int, id string, address string, lat double, lon double")


def two_grids(spark: SparkSession, n: int = 60, step: float = 0.004, instance_id: int = 0) -> DataFrame:
    """A depot and two adjacent grids of six columns, one step apart."""
    k, half = F.col("k"), (n + 1) // 2
    side, at = F.when(k < half, 0).otherwise(1), F.when(k < half, k).otherwise(k - half)
    rows = spark.range(n).withColumnRenamed("id", "k")
    grid = rows.select(
        F.lit(instance_id).cast("long").alias("instance_id"), (k + 1).cast("int").alias("idx"), (k + 1).cast("string").alias("id"), F.lit(None).cast("string").alias("address"),
        (F.lit(45.40) + step * F.floor(at / 6)).alias("lat"), (F.lit(4.33) + step * (F.pmod(at, F.lit(6)) + side * 7)).alias("lon"),
    )
    depot = spark.createDataFrame([(instance_id, 0, "0", None, 45.40 + step * 2.5, 4.33 + step * 6)], grid.schema)
    return depot.unionByName(grid)


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of a point sheet: raw and displayed id, address, coordinates as typed, selection box as text."""
    p = points(spark, sf_dir)
    k = F.col("id").cast("long")
    return p.select(
        F.col("id").alias("id_raw"), F.lpad("id", 6, "0").alias("id_display"), "address",
        F.when(F.pmod(k, F.lit(23)) == 0, F.lit("")).when(F.pmod(k, F.lit(29)) == 0, F.lit("NaN")).otherwise(F.col("lat").cast("string")).alias("lat"),
        F.when(F.pmod(k, F.lit(31)) == 0, F.lit("200.5")).otherwise(F.col("lon").cast("string")).alias("lon"),
        F.when(F.pmod(k, F.lit(3)) == 0, "TRUE").when(F.pmod(k, F.lit(3)) == 1, "FALSE").otherwise("true").alias("selection"),
    )
