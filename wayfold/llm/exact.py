"""Exact dedup (operator 4), native.

Method: a persistent index of digests, bucketed and sorted by digest.  Data is
digested once and comes to the index in batches: copies within a batch are
summed up before they are shuffled, a sort-merge anti-join with the index finds
the digests that are new, and these are appended.  Both sides of the join are
bucketed alike, so the index is never shuffled.  What stays is then read back
from the index.  ``deduplicate`` brings a table in ``BATCHES`` batches by rising
doc_id, so most of its rows meet digests of an earlier batch.

Each digest carries the name of the batch that brought it.  A batch that comes
again under its name, as after a failure, adds nothing and gets the same result.

Texts are equal when they are after every run of [\\x20\\x09-\\x0D] becomes one
space; null and empty texts count as empty, texts of any length are digested
whole.  Of equal texts the smallest doc_id stays, nulls last, and of rows
of one doc_id (or of none) one row; a text that an earlier batch brought stays
there, whatever its doc_id.  One row per input row comes back.  Only the id and
text columns are read, so other columns may have any names.  An empty table
gives an empty result and leaves the index as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.store import documents, materialise, scratch_path

SPACE = "[\\x20\\x09-\\x0D]+"
SCHEMA = "text_sha256 string, keep_id long, batch string"
#: Batches that a whole table is brought in.
BATCHES = 2


def digest(text):
    """SHA-256 of the normalised text, lowercase hex."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id and text_sha256 of each row, written once, so that rids stand."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("text_sha256")), "digests")


class DigestIndex:
    """A bucketed, sorted table of digests: text_sha256, the doc_id that stays, and the batch that brought it."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, path: str | None = None):
        """Open the table, or make it with ``buckets`` buckets (as many as shuffle partitions) below ``path`` (the warehouse, if none)."""
        self.spark, self.table = spark, table
        if not spark.catalog.tableExists(table):
            empty = spark.createDataFrame([], SCHEMA)
            self._write(empty, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), path)
        described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect()}
        self.buckets = int(described["Num Buckets"])

    def _write(self, rows: DataFrame, buckets: int, path: str | None = None) -> None:
        writer = rows.write.mode("append").bucketBy(buckets, "text_sha256").sortBy("text_sha256").format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Append what is new in a batch of ``digested`` rows; returns a row per digest of the batch.

        These are text_sha256, keep_id as the index has it, keep_rid (the row of
        this batch that stays; null where another batch brought the text) and n,
        the copies in this batch.
        """
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))
        groups = rows.groupBy("text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        groups = materialise(groups.select("text_sha256", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid"), "n"), "batch-digests")
        # dealt by the bucketing hash: the side that the anti-join shuffles, and a bucket is one file
        dealt = groups.repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256")
        fresh = dealt.hint("merge").join(self.read().hint("merge"), "text_sha256", "left_anti")
        fresh = materialise(fresh.select("text_sha256", F.col("first_id").alias("keep_id"), F.lit(batch).alias("batch")), "fresh-digests")  # as the index stands before the batch
        self._write(fresh.repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256"), self.buckets)
        known = groups.hint("merge").join(self.read().hint("merge"), "text_sha256")
        return known.select("text_sha256", "keep_id", F.when(F.col("batch") == batch, F.col("first_rid")).alias("keep_rid"), "n")

    def ingest(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch of documents; doc_id, keep_id, group_size (copies in this batch), kept and text_sha256 of each of its rows."""
        rows = digested(docs, id_col, text_col)
        return _outcome(rows, self.add(rows, batch)).drop("rid")


def _outcome(rows: DataFrame, of_digest: DataFrame) -> DataFrame:
    # copies with one digest may be a third of all rows: an ordinary join, whose large partitions Spark can split
    out = rows.join(of_digest, "text_sha256")
    return out.select("rid", "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.coalesce("keep_rid", F.lit(-1))).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring a whole table to an index of its own, batch by batch; group_size counts all its copies.

    The index lives in the shared folder and is dropped when the result has been written.
    """
    spark = docs.sparkSession
    rows = digested(docs, id_col, text_col)
    index = DigestIndex(spark, f"wayfold_digests_{uuid.uuid4().hex}", path=scratch_path(spark, "digest-index"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / BATCHES for k in range(1, BATCHES)])).first()[0] or []
    # rising doc_id, nulls last: of equal texts the first batch has the smallest id
    batch = F.when(F.col("doc_id").isNull(), BATCHES - 1).otherwise(sum((F.col("doc_id") > c).cast("int") for c in cuts) if cuts else F.lit(0))
    found = None
    for k in range(BATCHES):
        of_batch = index.add(rows.where(batch == k), str(k))
        found = of_batch if found is None else found.unionByName(of_batch)
    of_digest = found.groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.max("keep_rid").alias("keep_rid"), F.sum("n").alias("n"))  # a row per batch at most
    out = materialise(_outcome(rows, of_digest), "outcome")
    index.drop()
    return out.drop("rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns, one row for each distinct text.

    Rows travel as one struct, so their columns may have any names.
    """
    last = F.lit((1 << 63) - 1)
    kept = deduplicate(docs, id_col, text_col).where("kept").select(F.coalesce("doc_id", last).alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[id_col].cast("long"), last).alias("id"), digest(docs[text_col]).alias("sha"))
    joined = rows.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return joined.dropDuplicates(["id", "sha"]).select("row.*")
