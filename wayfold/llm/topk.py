"""Exact top-k inner-product search (operator 2).

Method: ball-tree branch and bound per shard.  Rows are dealt to shards of
bounded size; a shard is its ball tree and a matrix in the tree's order, in the
narrowest whole numbers that hold it.  For a block of queries the nodes are
taken in order of their inner-product upper bound q.c + |q| r, a node is dropped
for every query whose current k-th score lies above the bound, and leaves are
scored by one matrix product.  The k-th score is shared: a task takes several
shards one after the other and carries what its queries have found from shard
to shard, and a first round over one task's shards per query block gives the
starting k-th score of all the others, which return only what can still enter
the answer.  Every query meets every shard, in blocks; nothing is cut.

Components become floor(64 x).  Rows whose vector is null, empty, or holds a
null or non-finite component take no part, nor do rows without an id.  Vectors
of unequal length are compared over their common components.  A row never finds
itself; other rows of the same id are found like any row.  Ties go to the
smaller id.  Components and scores beyond 64 bits are clipped to them; sums
beyond 2^53 are computed in whole numbers.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.store import materialise

SCALE = 64.0
K = 20
EVERY = 20
SHARD_ROWS = 8192
QUERY_ROWS = 512
#: Query blocks that one task holds, and shards that they meet there one by one.
BLOCKS_AT_ONCE = 16
SHARDS_AT_ONCE = 16
LEAF = 128
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """rid, vec_id and v (whole numbers as doubles) of the rows that take part."""
    x = F.col(vector_col)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
    if "double" in dict(vectors.dtypes)[vector_col]:
        whole = F.transform(x, lambda c: F.rint(F.floor(c * SCALE)).cast("double"))
    rows = materialise(vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")), "vectors")
    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v")


class BallTree:
    """Nodes as arrays; node 0 is the root; leaves are slices of the reordered rows."""

    def __init__(self, x: np.ndarray, tie: np.ndarray):
        order, nodes, stack = np.arange(len(x)), [], [(0, len(x), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][4 + side] = at
            rows = x[order[a:b]]
            centre = rows.mean(0)
            radius = float(np.sqrt(((rows - centre) ** 2).sum(1).max()))
            nodes.append([centre, radius, a, b, -1, -1])
            if b - a > LEAF and radius > 0:
                far = rows[((rows - centre) ** 2).sum(1).argmax()]
                other = rows[((rows - far) ** 2).sum(1).argmax()]
                along = rows @ (other - far)
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(along, mid)]
                stack += [(a + mid, b, at, 1), (a, a + mid, at, 0)]
            else:
                order[a:b] = order[a:b][np.argsort(tie[order[a:b]], kind="stable")]
        self.order = order
        self.centres, self.radii = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.start, self.end, self.left, self.right = np.array([n[2:] for n in nodes], np.int64).reshape(len(nodes), 4).T

    def packed(self) -> tuple[bytes, bytes]:
        return np.column_stack([self.radii, self.centres]).tobytes(), np.column_stack([self.start, self.end, self.left, self.right]).tobytes()

    @classmethod
    def unpacked(cls, balls: bytes, nodes: bytes, width: int) -> BallTree:
        tree = cls.__new__(cls)
        both = np.frombuffer(balls).reshape(-1, width + 1)
        tree.radii, tree.centres = both[:, 0], both[:, 1:]
        tree.start, tree.end, tree.left, tree.right = np.frombuffer(nodes, np.int64).reshape(-1, 4).T
        return tree


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them all."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16) if most < 1 << 15 else x.astype(np.int32) if most < 1 << 31 else x


def widened(data: bytes, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, width).astype(np.float64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= EXACT:
        big = np.array([[int(c) for c in r] for r in q], object) @ np.array([[int(c) for c in r] for r in x], object).T
        return np.clip(big, -(1 << 63), (1 << 63) - 1)
    return q @ x.T


class Best:
    """The k best of each query of a block: score descending, id ascending."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score, self.id, self.rid = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1].astype(float))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        if score.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        width = min(self.k, score.shape[1])
        first = np.argsort(-score, axis=1, kind="stable")[:, :width]  # leaf rows stand in order of id
        s = np.concatenate([self.score[rows], np.take_along_axis(score, first, 1)], 1)
        i = np.concatenate([self.id[rows], ids[first]], 1)
        r = np.concatenate([self.rid[rows], rids[first]], 1)
        by = np.lexsort((i, -s.astype(float)), axis=-1) if s.dtype != object else np.array([sorted(range(s.shape[1]), key=lambda c, a=a: (-s[a, c], i[a, c])) for a in range(len(s))])
        by = by[:, : self.k]
        self.score[rows], self.id[rows], self.rid[rows] = (np.take_along_axis(a, by, 1) for a in (s, i, r))


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, rids: np.ndarray, q: np.ndarray, q_rids: np.ndarray, best: Best) -> None:
    """Branch and bound of a block of queries over one shard, on top of what ``best`` holds; x, ids and rids in tree order."""
    length = np.sqrt((q * q).sum(1))
    bound = q @ tree.centres.T + length[:, None] * tree.radii
    bound += 1e-9 * np.abs(bound) + 1e-6
    heap = [(-bound[:, 0].max(), 0, np.arange(len(q)))] if len(q) and len(x) else []
    while heap:
        _, node, rows = heapq.heappop(heap)
        rows = rows[bound[rows, node] >= best.kth()[rows]]
        if not len(rows):
            continue
        if tree.left[node] >= 0:
            for child in (int(tree.left[node]), int(tree.right[node])):
                heapq.heappush(heap, (-bound[rows, child].max(), child, rows))
            continue
        a, b = tree.start[node], tree.end[node]
        score = products(q[rows], x[a:b])
        score = np.where(q_rids[rows][:, None] == rids[None, a:b], -np.inf, score)
        rounded = score.astype(float)  # whole numbers near 2^63 and their floats compare unequal
        hot = (rounded >= best.kth()[rows][:, None]).any(1) & (rounded > -np.inf).any(1)
        if hot.any():
            best.add(rows[hot], score[hot], ids[a:b], rids[a:b])


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, row in enumerate(column):
        v = row.values.to_numpy()[:width]
        out[i, : len(v)] = v
    return out


INDEX = "shard long, ids binary, rids binary, kind string, x binary, balls binary, nodes binary"


def build_index(rows: DataFrame, width: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """One row per shard: its ids, its matrix and its tree.  Shards are dealt by row, so equal ids or vectors don't gather."""
    shards = max(1, -(-rows.count() // shard_rows))

    def pack(table: pa.Table) -> pa.Table:
        ids, rids = table.column("vec_id").to_numpy(), table.column("rid").to_numpy()
        x = _matrix(table.column("v").combine_chunks(), width)
        tree = BallTree(x, ids)
        x, (balls, nodes) = narrow(x[tree.order]), tree.packed()
        return pa.table({"shard": table.column("shard").slice(0, 1), "ids": [ids[tree.order].tobytes()], "rids": [rids[tree.order].tobytes()], "kind": [x.dtype.str], "x": [x.tobytes()], "balls": [balls], "nodes": [nodes]})

    dealt = rows.select(F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard"), "rid", "vec_id", "v")
    return materialise(dealt.groupBy("shard").applyInArrow(pack, INDEX), "ball-trees"), shards


QUERIES = "block long, q_ids binary, q_rids binary, q_kind string, q binary"


def pack_queries(queries: DataFrame, width: int, query_rows: int = QUERY_ROWS) -> tuple[DataFrame, int]:
    """One row per block of queries."""
    blocks = max(1, -(-queries.count() // query_rows))

    def pack(table: pa.Table) -> pa.Table:
        x = narrow(_matrix(table.column("v").combine_chunks(), width))
        return pa.table({"block": table.column("block").slice(0, 1), "q_ids": [table.column("vec_id").to_numpy().tobytes()], "q_rids": [table.column("rid").to_numpy().tobytes()], "q_kind": [x.dtype.str], "q": [x.tobytes()]})

    dealt = queries.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).alias("block"), "rid", "vec_id", "v")
    return materialise(dealt.groupBy("block").applyInArrow(pack, QUERIES), "query-blocks"), blocks


HITS = "block long, q_rid long, query_id long, rid long, vec_id long, score long"


def _round(index: DataFrame, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """Search of the query blocks (with team, part and floors) in the shards of their teams."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        blocks = []
        for i in range(right.num_rows):
            q = widened(right.column("q")[i].as_py(), right.column("q_kind")[i].as_py(), width)
            q_ids, q_rids = (np.frombuffer(right.column(c)[i].as_py(), np.int64) for c in ("q_ids", "q_rids"))
            raw = right.column("floor")[i].as_py()
            floor = np.frombuffer(raw) if raw else np.full(len(q), -np.inf)
            blocks.append((right.column("block")[i].as_py(), q, q_ids, q_rids, Best(len(q), k, floor)))
        for i in range(left.num_rows if blocks else 0):
            x = widened(left.column("x")[i].as_py(), left.column("kind")[i].as_py(), width)
            ids, rids = (np.frombuffer(left.column(c)[i].as_py(), np.int64) for c in ("ids", "rids"))
            tree = BallTree.unpacked(left.column("balls")[i].as_py(), left.column("nodes")[i].as_py(), width)
            for _, q, _, q_rids, best in blocks:
                search(tree, x, ids, rids, q, q_rids, best)
        for block, _, q_ids, q_rids, best in blocks:
            row, col = np.nonzero((best.rid >= 0) & (best.score.astype(float) >= best.floor[:, None]))
            for to, value in zip(out, (np.full(len(row), block), q_rids[row], q_ids[row], best.rid[row, col], best.id[row, col], best.score[row, col]), strict=True):
                to.extend(int(v) for v in value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["block", "q_rid", "query_id", "rid", "vec_id", "score"])

    pairs = blocks.select(F.col("team").alias("in_team"), F.col("part").alias("in_part")).distinct()
    keyed = index.join(pairs, F.col("team") == F.col("in_team")).drop("team")
    return keyed.groupBy("in_team", "in_part").cogroup(blocks.groupBy("team", "part")).applyInArrow(run, HITS)


def _floors(hits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The blocks with the k-th score of each of their queries in the order of q_rids, -inf where fewer are known."""
    kth = hits.groupBy("block", "q_rid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    known = kth.groupBy("block").agg(F.collect_list(F.struct("q_rid", "least")).alias("known"))  # a block has a bounded number of queries

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                q_rids = np.frombuffer(row.column("q_rids")[0].as_py(), np.int64)
                got = {r["q_rid"]: r["least"] for r in row.column("known")[0].as_py() or []}
                floor = np.array([float(got.get(int(r), -np.inf)) for r in q_rids])
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("block", "q_ids", "q_rids", "q_kind", "q")), pa.array([floor.tobytes()])], names=["block", "q_ids", "q_rids", "q_kind", "q", "floor"])

    return blocks.join(known, "block", "left").mapInArrow(run, QUERIES + ", floor binary")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows of each row whose id is divisible by ``every``."""
    rows = quantised(vectors, id_col, vector_col)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    index, shards = build_index(rows, width, shard_rows)
    blocks, _ = pack_queries(rows.where(F.col("vec_id") % every == 0), width, query_rows)
    teams = -(-shards // SHARDS_AT_ONCE)
    index = index.withColumn("team", F.pmod("shard", F.lit(teams)))
    part = F.floor(F.col("block") / BLOCKS_AT_ONCE)
    home = F.pmod(part, F.lit(teams))
    first = materialise(_round(index, blocks.select("*", home.alias("team"), part.alias("part"), F.lit(None).cast("binary").alias("floor")), width, k), "first-hits")
    if teams > 1:
        # queries travel to every other team of shards in the shuffle; what is written is each block once, with its floors
        known = materialise(_floors(first, blocks, k), "query-floors")
        rest = known.select("*", part.alias("part"), F.explode(F.array_except(F.sequence(F.lit(0), F.lit(teams - 1)).cast("array<long>"), F.array(home))).alias("team"))
        hits = first.unionByName(_round(index, rest, width, k))
    else:
        hits = first
    rank = F.row_number().over(Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
