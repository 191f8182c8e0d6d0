r"""Line dedup (operator 10).

A run of ``RUN`` or more lines that also starts earlier is deleted; the
earliest copy stays.

Method: suffix array over line-ID sequences by distributed prefix doubling.
Level 1 names each line; level 2h names the pair of level-h names at a place
and h lines on, so names double their reach each round.  Names are drawn from
the sorted pairs, so they keep the suffixes' order, and places with one name of
level h form the interval of suffixes with a common prefix of h lines or more.
A place whose prefix occurs once is dropped at once, as no longer prefix of it
can repeat.  ``RUN`` lines are reached exactly, by overlapping two names of the
highest power of two below; from there on the doubling goes on until no prefix
repeats.  A place's interval of the longest reach that isn't its first place
gives a repeated run; runs that lie in one that starts before them are left
out, so a copy of a long text is a few runs, not one for each line.

Lines are the parts between "\n"; null and empty texts have none.  "Earlier"
means smaller doc_id (null last), then the smaller text hash (128 bits), then
the earlier start; rows equal in id and text count as one document and get the
same result.  Blank lines are lines like any other.  Texts of any length are
split whole; an empty table gives an empty result; columns other than the id
and the text are not read.  Frequent lines are summed up before they are
shuffled, and only texts that lose lines are shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.store import discard, documents, materialise
from wayfold.llm.substrings import KEY, Marked, keyed

RUN = 3


def line_places(rows: DataFrame) -> DataFrame:
    """The document's key, pos and two hashes of each line."""
    lines = F.when(F.length("text") > 0, F.split(F.col("text").cast("string"), "\n", -1)).otherwise(F.array().cast("array<string>"))
    each = rows.select(*KEY, F.posexplode(lines).alias("pos", "line"))
    return each.select(*KEY, "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"))


def named(pairs: DataFrame, label: str) -> DataFrame:
    """Places whose pair (a, b) occurs again, with a name in the order of the pairs, and whether the name has an earlier place."""
    groups = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "pos")).alias("first")).where("n > 1")
    names = materialise(groups.orderBy("a", "b").select("a", "b", "first", F.monotonically_increasing_id().alias("name")), f"names-{label}")
    later = F.struct(*KEY, "pos") != F.col("first")
    places = materialise(pairs.join(names, ["a", "b"]).select(*KEY, "pos", "name", later.alias("later")), f"places-{label}")
    discard(names)
    return places


def doubled(level: DataFrame, step: int) -> DataFrame:
    """Pairs of the names at a place and ``step`` lines on."""
    ahead = level.select(*KEY, (F.col("pos") - step).alias("pos"), F.col("name").alias("b"))
    return level.select(*KEY, "pos", F.col("name").alias("a")).join(ahead, [*KEY, "pos"])


def repeated_runs(rows: DataFrame, run: int = RUN) -> DataFrame:
    """The key, pos and reach of runs of ``run`` lines and more that also start earlier; together they cover all such runs."""
    level, reach = named(materialise(line_places(rows), "lines"), "1"), 1
    while reach * 2 <= run:
        level, reach = named(doubled(level, reach), str(reach * 2)), reach * 2
    if reach < run:
        level = named(doubled(level, run - reach), str(run))
    reach, found = run, None
    while not level.isEmpty():
        later = level.where("later").select(*KEY, "pos", F.lit(reach).alias("reach"))
        found = later if found is None else found.unionByName(later)
        level, reach = named(doubled(level, reach), str(reach * 2)), reach * 2
    if found is None:
        return level.select(*KEY, "pos", F.lit(run).alias("reach"))
    longest = found.groupBy(*KEY, "pos").agg(F.max("reach").alias("reach"))
    before = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # within one text
    end = F.col("pos") + F.col("reach")
    return longest.withColumn("covered", F.max(end).over(before)).where(F.col("covered").isNull() | (end > F.col("covered"))).select(*KEY, "pos", "reach")


CUT = "doc_id long, n_lines long, n_deleted long, kept_sha256 string"


def kept_lines(text: bytes, runs) -> tuple[list[bytes], list[bytes]]:
    """All lines, and those that stay."""
    lines = text.split(b"\n") if text else []
    gone = bytearray(len(lines))
    for r in runs or []:
        gone[r["pos"] : r["pos"] + r["reach"]] = b"\1" * r["reach"]
    return lines, [x for x, g in zip(lines, gone, strict=True) if not g]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, texts: bool = False) -> DataFrame:
    """One row per document: counts and the hash of the lines that stay, or (``texts``) doc_id and the text that stays."""
    rows = keyed(docs, id_col, text_col)
    runs = repeated_runs(rows, run).groupBy(*KEY).agg(F.collect_list(F.struct("pos", "reach")).alias("runs"))  # within one text's size
    runs = materialise(runs, "repeated-lines")

    def cut(batches):
        for batch in batches:
            at = batch.column("runs") if "runs" in batch.schema.names else None
            out = [[], [], [], []]
            for i in range(batch.num_rows):
                lines, kept = kept_lines(batch.column("text")[i].as_py(), at[i].as_py() if at is not None else None)
                body = b"\n".join(kept)
                for to, value in zip(out, (len(lines), len(lines) - len(kept), hashlib.sha256(body).hexdigest(), body), strict=True):
                    to.append(value)
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[3], pa.binary())], names=["doc_id", "kept"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_lines", "n_deleted", "kept_sha256"])

    schema = "doc_id long, kept binary" if texts else CUT
    marked = Marked(runs)
    clean = marked.free(rows).select("doc_id", "text").mapInArrow(cut, schema)
    touched = marked.held(rows).join(runs, KEY, "left").select("doc_id", "text", "runs").mapInArrow(cut, schema)
    return clean.unionByName(touched)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text <> ''
), w AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER p AS b, lead(line, 2) OVER p AS c FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
), f AS (
  SELECT *, c IS NOT NULL AND row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) > 1 AS again FROM w
), g AS (
  SELECT doc_id, pos, line, again OR coalesce(lag(again, 1) OVER p, false) OR coalesce(lag(again, 2) OVER p, false) AS gone FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
), s AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
