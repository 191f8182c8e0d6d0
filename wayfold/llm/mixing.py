"""Mixing sources to target weights (operator 1).

Method: multivariate-hypergeometric splitting tree.  A source's rows are dealt
into small blocks by hash; its target becomes an exact quota of block draws.
The tree halves the output shards again and again, and each node splits its
source quotas between its halves by one multivariate-hypergeometric draw, so a
leaf knows how many blocks of each source it takes, and from which place on in
the source's permuted order.  Segments of different leaves are disjoint.  Rows
are then shuffled within their shard.

A node's random numbers depend on the seed and its shard range alone, so any
task can compute any leaf, reruns agree, and no state is shared.

Sources are compared by code point, null last; they weigh 5, 2, 1, repeating.
Together they share ``share`` of all words; a target stops at ``most`` times
its source's words and the excess is reshared by weight.  A row is drawn 0, 1
or 2 times and gives its size in words each time; within the last block, rows
are taken in hashed order while that brings the total nearer to the target.
Null and empty texts have size 0, texts of any length are counted whole.  Empty
tables give empty results.  Places are dealt and ordered by hashes of doc_id and
text, so rows of one doc_id, or of none, are drawn independently of each other;
rows equal in doc_id, text and source are interchangeable, and how many of them
are drawn doesn't depend on their order.  Extra columns pass through ``mix``,
whatever their names: rows travel as one struct.

The one table that is held whole is the table of sources (one row each, checked
against ``MAX_SOURCES``); everything else is keyed by source and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.store import documents, materialise

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
#: Rows that a block holds on average, and block places that are summed as one.
BLOCK_ROWS = 64
CHUNK = 4096
#: Words of an output shard, about.
SHARD_WORDS = 4_000_000
MAX_SOURCES = 1_000_000
#: The numpy sampler takes totals below 1e9.
MAX_QUOTA = 900_000_000
SEED = 7
#: Primes above any number of blocks; multiplying by one permutes the block numbers.
PRIMES = (2147483647, 2147483629)

WORD, SPACE = "[^\\x20\\x09-\\x0D]+", "[\\x20\\x09-\\x0D]+"


def word_count(text):
    """Number of words: each becomes one letter, spaces go, letters are counted."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), SPACE, "")).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """rank, source, source_size, rows and target of every source.

    Water filling in sorted order: with caps c and weights w sorted by c / w,
    the level is (T - caps before) / (W - weights before) at the first source
    whose c / w lies above it.  One row per source, so one task suffices.
    """
    sources = sizes.groupBy("_mix_source").agg(F.sum("_mix_size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by_name = Window.orderBy(F.col("_mix_source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("rank", F.row_number().over(by_name).cast("long") - 1)
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weigh).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.orderBy("ratio", "rank")
    ranked = (
        ranked.withColumn("wanted", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("wanted") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before")))
        .withColumn("first_level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    level = F.col("first_level.level")
    target = F.when(level.isNull() | (F.col("ratio") <= level), F.col("cap")).otherwise(level * F.col("weight"))
    return ranked.select("rank", F.col("_mix_source").alias("source"), "source_size", "rows", target.alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, lo: int, hi: int, seed: int = SEED):
    """(shard, source rank, first place, places) of the leaves in [lo, hi)."""
    total = int(quotas.sum())
    cut = lambda m: m * total // shards
    stack = [(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64))]
    while stack:
        a, b, count, first = stack.pop()
        if b <= lo or a >= hi:
            continue
        if b - a == 1:
            for s in np.flatnonzero(count):
                yield a, int(s), int(first[s]), int(count[s])
            continue
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        left = rng.multivariate_hypergeometric(count, cut(mid) - cut(a), method="marginals")
        stack += [(mid, b, count - left, first + left), (a, mid, left, first)]


def leaves(spark: SparkSession, quotas: np.ndarray, shards: int, seed: int = SEED) -> DataFrame:
    """The tree's leaves as rank, place and shard: one row per block draw."""
    shared = spark.sparkContext.broadcast(quotas)  # one number per source
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                lo, hi = part * shards // parts, (part + 1) * shards // parts
                found = list(split_quotas(shared.value, shards, lo, hi, seed))
                for at in range(0, len(found), 65536):
                    some = list(zip(*found[at : at + 65536], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in some], names=["shard", "rank", "first", "places"])

    rows = spark.range(0, parts, 1, parts).mapInArrow(run, "shard long, rank long, first long, places long")
    return rows.select("rank", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("places") - 1)).alias("place"))


class Mix:
    """The plan of a mix: target and draws of each block, computed once and kept."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shard_words: int = SHARD_WORDS):
        self.id_col, self.text_col, self.source_col, self.seed = id_col, text_col, source_col, seed
        spark = docs.sparkSession
        self.sizes = materialise(docs.select(F.col(id_col).cast("long").alias("_mix_id"), F.col(source_col).cast("string").alias("_mix_source"), word_count(F.col(text_col)).alias("_mix_size"), F.xxhash64(F.col(text_col)).alias("_mix_hash")), "mix-sizes")
        self.targets = materialise(targets(self.sizes), "mix-targets", 1)
        if self.targets.count() > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources; merge rare sources into one before mixing")
        rows = max(1, self.targets.agg(F.sum("rows")).first()[0] or 0)
        self.block_rows = max(BLOCK_ROWS, -(-2 * rows // MAX_QUOTA))
        self.blocks, self.shards = self._plan(spark, shard_words)

    def _placed(self, rows: DataFrame, columns: list) -> DataFrame:
        """Rows with the rank and block of theirs; the table of sources is joined by its size as measured."""
        t = self.targets.select("rank", F.col("source").alias("_mix_name"), F.greatest(F.lit(1), F.ceil(F.col("rows") / self.block_rows)).cast("long").alias("_mix_blocks"), "source_size", "target")
        joined = rows.join(t, rows["_mix_source"].eqNullSafe(t["_mix_name"]))
        block = F.pmod(F.xxhash64(F.col("_mix_id"), F.col("_mix_hash"), F.lit(self.seed)), F.col("_mix_blocks"))
        return joined.select(*columns, "rank", block.alias("_mix_block"), F.col("_mix_blocks"), "source_size", "target")

    def _plan(self, spark: SparkSession, shard_words: int):
        full = F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
        blocks = self._placed(self.sizes, ["_mix_size"]).groupBy("rank", "_mix_block").agg(
            F.sum("_mix_size").alias("words"), F.first("_mix_blocks").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
        )
        place = lambda k: F.pmod(F.col("_mix_block") * F.lit(PRIMES[k]) + F.lit(self.seed * (k + 1)), F.col("n"))
        blocks = blocks.select("rank", "_mix_block", "words", "n", full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("rest"), place(0).alias("place0"), place(1).alias("place1"))
        blocks = materialise(blocks.withColumn("chunk", F.floor(F.col("place1") / CHUNK)), "mix-blocks")
        chunks = blocks.groupBy("rank", "chunk").agg(F.sum("words").alias("of_chunk"))
        ahead = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        chunks = chunks.select("rank", "chunk", F.coalesce(F.sum("of_chunk").over(ahead), F.lit(0)).alias("chunk_start"))
        within = Window.partitionBy("rank", "chunk").orderBy("place1").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.join(chunks, ["rank", "chunk"]).withColumn("start", F.col("chunk_start") + F.coalesce(F.sum("words").over(within), F.lit(0)))
        # words that the last, partial pass still wants when it comes to this block
        blocks = materialise(blocks.select("rank", "_mix_block", "words", "n", "full", "rest", "place0", "place1", (F.col("rest") - F.col("start")).alias("left")), "mix-placed")
        partial = F.col("left") > 0
        quota = blocks.groupBy("rank").agg(F.max(F.col("full") * F.col("n")).alias("whole"), F.max(F.when(partial, F.col("place1") + 1).otherwise(0)).alias("more"), F.sum(F.col("words") * F.col("full") + F.when(partial, F.least(F.col("words"), F.col("left"))).otherwise(0)).alias("out"))
        got = quota.orderBy("rank").collect()  # one row per source
        quotas = np.zeros(got[-1]["rank"] + 1 if got else 0, np.int64)
        for r in got:
            quotas[r["rank"]] = r["whole"] + r["more"]
        shards = max(1, round(sum(r["out"] for r in got) / shard_words))
        draws = F.concat(
            F.when(F.col("full") == 1, F.array(F.struct(F.col("place0").alias("place"), F.lit(None).cast("double").alias("left")))).otherwise(F.array()),
            F.when(partial, F.array(F.struct((F.col("full") * F.col("n") + F.col("place1")).alias("place"), F.col("left").cast("double").alias("left")))).otherwise(F.array()),
        )
        drawn = blocks.select("rank", "_mix_block", F.explode(draws).alias("d")).select("rank", "_mix_block", "d.place", "d.left")
        placed = drawn.join(leaves(spark, quotas, shards, self.seed), ["rank", "place"])
        per_block = placed.groupBy("rank", "_mix_block").agg(F.collect_list(F.struct("place", "shard", "left")).alias("_mix_draws"))  # two at most
        return materialise(per_block, "mix-draws"), shards

    def drawn(self, rows: DataFrame, columns: list) -> DataFrame:
        """Rows (with _mix_id, _mix_source, _mix_size, _mix_hash) with the shards that draw them, as an array, possibly empty."""
        placed = self._placed(rows, [*columns, "_mix_id", "_mix_size", "_mix_hash"]).join(self.blocks, ["rank", "_mix_block"], "left")
        upto = Window.partitionBy("rank", "_mix_block").orderBy(F.xxhash64("_mix_id", "_mix_hash", F.lit(self.seed + 1)), "_mix_id", "_mix_hash", "_mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        middle = F.sum("_mix_size").over(upto) - F.col("_mix_size") / 2
        placed = placed.withColumn("_mix_middle", middle)
        keep = F.filter("_mix_draws", lambda d: d["left"].isNull() | (F.col("_mix_middle") <= d["left"]))
        return placed.select(*columns, "_mix_id", "_mix_size", "_mix_hash", "source_size", "target", F.coalesce(F.transform(keep, lambda d: d["shard"]), F.array().cast("array<long>")).alias("_mix_shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mixed rows with all columns of ``docs``, each shard whole in one partition and shuffled there."""
    plan = Mix(docs, id_col, text_col, source_col, seed, shard_words)
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_mix_row")  # so that no column name can clash
    rows = docs.select(whole, F.col(id_col).cast("long").alias("_mix_id"), F.col(source_col).cast("string").alias("_mix_source"), word_count(F.col(text_col)).alias("_mix_size"), F.xxhash64(F.col(text_col)).alias("_mix_hash"))
    dealt = plan.drawn(rows, ["_mix_row"]).select("_mix_row", "_mix_id", "_mix_hash", F.posexplode("_mix_shards").alias("_mix_copy", "_mix_shard"))
    order = F.xxhash64("_mix_shard", "_mix_id", "_mix_hash", "_mix_copy", F.lit(seed))
    return dealt.repartition(F.col("_mix_shard")).sortWithinPartitions("_mix_shard", order).select("_mix_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Mix(documents(spark, sf_dir))
    drawn = plan.drawn(plan.sizes, [])
    return drawn.select(F.col("_mix_id").alias("doc_id"), F.col("_mix_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), (F.size("_mix_shards") * F.col("_mix_size")).cast("long").alias("taken"), F.col("_mix_shards").alias("shards"))
