"""Requests as JSON texts, and the selection of points by typed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.config import STRATEGIES
from wayfold.functions.geo import finite_coords
from wayfold.functions.text import loose_int, split_ids, strict_int
from wayfold.schemas import REQUEST

#: Range and default of the whole-number overrides.
OVERRIDES = {"ortools_solution_limit": (1, 10000, 75), "max_swap_candidates": (0, 200, 50), "swap_max_consecutive_fails": (0, 200, 0)}
#: The override that is read loosely; the others must be whole numbers in the JSON.
LOOSE = ("ortools_solution_limit",)


def parse(raw: DataFrame, json_col: str = "body") -> DataFrame:
    """Typed requests with a status: 400 for no points, an unknown strategy or a bad override; else 200.  The first fault counts."""
    r = raw.withColumn("r", F.from_json(json_col, REQUEST))
    strategy = F.coalesce(F.nullif(F.lower(F.trim("r.strategy")), F.lit("")), F.lit("kmeans"))
    no_points = F.coalesce(F.size("r.points"), F.lit(0)) <= 0
    error = F.when(no_points, "no points").when(~strategy.isin(*STRATEGIES), "unknown strategy")
    columns = {}
    for name, (lo, hi, default) in OVERRIDES.items():
        value, wrong = (loose_int if name in LOOSE else strict_int)(F.col(f"r.{name}"), lo, hi, default)
        columns[name] = value
        error = error.when(wrong.isNotNull(), F.concat(F.lit(f"{name}: "), wrong))
    whole = lambda c, default: F.coalesce(F.col(f"r.{c}").try_cast("int"), F.lit(default))
    return r.select(
        "instance_id", strategy.alias("strategy"), whole("num_vehicles", 2).alias("num_vehicles"), whole("max_per_vehicle", 35).alias("max_per_vehicle"),
        F.col("r.start_id").alias("start_id"), F.coalesce("r.end_id", "r.start_id").alias("end_id"), *[v.alias(k) for k, v in columns.items()],
        F.coalesce(F.size("r.points"), F.lit(0)).alias("n_points"), error.alias("error"), F.when(error.isNull(), 200).otherwise(400).alias("status"),
    )


def exploded_points(raw: DataFrame, json_col: str = "body") -> DataFrame:
    """The points of requests with their place as idx, ids kept as text, coordinates cast where they are numbers."""
    r = raw.select("instance_id", F.from_json(json_col, REQUEST).alias("r")).select("instance_id", F.posexplode("r.points").alias("idx", "p"))
    return r.select("instance_id", "idx", F.col("p.id").alias("id"), F.col("p.address").alias("address"), F.col("p.lat").try_cast("double").alias("lat"), F.col("p.lon").try_cast("double").alias("lon"))


def depots(requests: DataFrame, points: DataFrame) -> DataFrame:
    """Nodes of both depots: the first point with the id, node 0 for an unknown one (which is flagged)."""
    first = points.groupBy("instance_id", "id").agg(F.min("idx").alias("idx"))
    r = requests.select("instance_id", "start_id", "end_id")
    for side in ("start", "end"):
        r = r.join(first.select("instance_id", F.col("id").alias(f"{side}_id"), F.col("idx").alias(f"_{side}")), ["instance_id", f"{side}_id"], "left")
    return r.select("instance_id", F.coalesce("_start", F.lit(0)).alias("start_idx"), F.coalesce("_end", F.lit(0)).alias("end_idx"), (F.col("_start").isNotNull() & F.col("_end").isNotNull()).alias("resolved"))


def invalid_points(points: DataFrame) -> DataFrame:
    """The first five ids with unusable coordinates, per instance."""
    bad = points.where(~finite_coords(F.col("lat"), F.col("lon")))
    listed = F.array_sort(F.collect_list(F.struct("idx", "id")))
    return bad.groupBy("instance_id").agg(F.count(F.lit(1)).alias("invalid"), listed.alias("l")).select("instance_id", "invalid", F.transform(F.slice("l", 1, 5), lambda e: e["id"]).alias("first_ids"))


def feasible(requests: DataFrame) -> Column:
    """Whether the vehicles can hold all collection points."""
    return F.col("num_vehicles") * F.col("max_per_vehicle") >= F.col("n_points") - 1


# ------------------------------------------------------------- selection by id


def selected_points(sheet: DataFrame) -> DataFrame:
    """Checked rows as typed points; a box may hold a boolean or the text TRUE."""
    return sheet.where(F.upper(F.trim("selection")) == "TRUE").select(F.col("id_raw").alias("id"), "address", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"))


def id_index(sheet: DataFrame) -> DataFrame:
    """Rows by id, under the raw and the displayed form."""
    keyed = sheet.select("row", "address", F.explode(F.array_distinct(F.array("id_raw", "id_display"))).alias("id")).where("id IS NOT NULL AND id <> ''")
    return keyed.groupBy("id").agg(F.array_sort(F.collect_set("row")).alias("rows"), F.min_by("address", "row").alias("address"))


def typed_ids(texts: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("selection_id",)) -> DataFrame:
    """One row per distinct typed id, in the order of its first mention."""
    each = texts.select(*keys, F.posexplode(split_ids(F.col(text_col))).alias("pos", "id"))
    return each.groupBy(*keys, "id").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("times"))


def resolved(ids: DataFrame, index: DataFrame) -> DataFrame:
    """Each id with the rows it names: found means exactly one."""
    found = ids.join(index, "id", "left")
    n = F.coalesce(F.size("rows"), F.lit(0))
    return found.withColumn("state", F.when(F.coalesce(n, F.lit(0)) <= 0, "unknown").when(n == 1, "found").otherwise("ambiguous"))


def selection_report(resolved_ids: DataFrame, depot_rows: DataFrame, keys: tuple[str, ...] = ("selection_id",)) -> DataFrame:
    """Counts of a selection, and what blocks it: no ids, a depot without exactly one row, or unknown and ambiguous ids."""
    ids = resolved_ids.groupBy(*keys).agg(
        F.sum("times").alias("typed"), F.count(F.lit(1)).alias("distinct_ids"), F.count_if(F.col("state") == "found").alias("found"),
        F.count_if(F.col("state") == "unknown").alias("unknown"), F.count_if(F.col("state") == "ambiguous").alias("ambiguous"),
    )
    all_keys = depot_rows.select(*keys, "depots_ok").join(ids, list(keys), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    block = F.when(~F.col("depots_ok"), "depot").when(zero("distinct_ids") == 0, "no ids").when(zero("unknown") + zero("ambiguous") > 0, "unresolved ids")
    return all_keys.select(*keys, *[zero(c).alias(c) for c in ("typed", "distinct_ids", "found", "unknown", "ambiguous")], block.alias("blocked"))


def applied_selection(sheet: DataFrame, chosen_rows: DataFrame) -> DataFrame:
    """The sheet with its selection column set to the chosen rows, all else untouched."""
    marks = chosen_rows.select("row").distinct().withColumn("_on", F.lit(True))
    return sheet.join(marks, "row", "left").withColumn("selection", F.coalesce("_on", F.lit(False))).drop("_on")


def reset_selection(sheet: DataFrame) -> DataFrame:
    return sheet.withColumn("selection", F.lit(False))


def parameters(raw: DataFrame) -> DataFrame:
    """One row of typed parameters; blank and zero numbers take their default, an unknown strategy raises."""
    number = lambda c, d: F.coalesce(F.nullif(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(float(d))).cast("int")
    strategy = F.coalesce(F.nullif(F.trim("strategy"), F.lit("")), F.lit("kmeans"))
    checked = F.when(strategy.isin(*STRATEGIES), strategy).otherwise(F.raise_error(F.concat(F.lit("unknown strategy: "), strategy)))
    return raw.select(number("num_vehicles", 2).alias("num_vehicles"), number("max_per_vehicle", 35).alias("max_per_vehicle"), F.trim("start_id").alias("start_id"), F.coalesce(F.nullif(F.trim("end_id"), F.lit("")), F.trim("start_id")).alias("end_id"), checked.alias("strategy"))
