"""Quality classifier (operator 5).

Method: factorisation machine.  A text becomes hashed words and word shapes,
structure statistics, and metadata of the text itself (its length in
characters, words and lines).  Pairwise interactions have rank ``FACTORS`` and
are scored in linear time by the sum-of-squares identity:
sum over pairs <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

The model is fitted on at most ``max_rows`` labelled rows, those with the
smallest hash of doc_id; labels, lang, source and doc_id are never features.
Scoring reads every whole text, in any number of partitions.

Null and empty texts have only the constant features and get a score like any
other.  Rows with a null doc_id are never learned from and count as not held
out.  Labels that are null or not 0 or 1 are ignored; without both labels every
score is the share of label 1 among them (0.5 without any).  A doc_id with
several labels or several rows is learned from once for each pair of them.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.arrow import Bounded
from wayfold.llm.store import documents

BITS = 14
FACTORS = 8
#: Labelled rows that the model is fitted on at most; their features go to the driver (about 5 kB a row).
MAX_ROWS = 5000
#: Passes over the rows; more where they give fewer than STEPS batches.
EPOCHS = 6
STEPS = 250
BATCH = 128
RATE = 0.08
DECAY = 2e-6
SEED = 20240501
STATS = 20
CONSTANT = (1 << BITS) + STATS
WIDTH = CONSTANT + 1
MEMO = 200_000

_CLASSES = ("upper", "lower", "digit", "space", "stop", "bar", "bang", "mark", "other", "high")


def _class_table() -> np.ndarray:
    of = np.zeros((256, len(_CLASSES)))
    for b in range(256):
        c = chr(b)
        k = (
            "high" if b >= 128 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "space" if c.isspace()
            else "stop" if c in ".,;:" else "bar" if c in "|<>{}[]\\/" else "bang" if c in "!?" else "mark" if c in "#$%&*@^~+=_" else "other"
        )
        of[b, _CLASSES.index(k)] = 1
    return of


_OF = _class_table()
_SHAPE = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)


def word_features(word: bytes) -> tuple[int, int]:
    """The buckets of a word and of its shape, in which runs of one class stand once."""
    classes = word.translate(_SHAPE)
    shape = bytes(b for i, b in enumerate(classes) if not i or classes[i - 1] != b)[:24]
    mask = (1 << BITS) - 1
    return zlib.crc32(word.lower()) & mask, zlib.crc32(b"\0" + shape) & mask


def features(text: bytes, memo) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values of one whole text."""
    words = text.split()
    buckets = np.array([b for pair in map(memo.__getitem__, words) for b in pair], np.int64)
    ids, counts = np.unique(buckets, return_counts=True)
    value = 1 + np.log(counts)
    value /= max(1e-9, np.sqrt((value * value).sum()))
    lines = [x for x in text.split(b"\n") if x]
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256)
    share = (histogram @ _OF) / max(1, len(text))
    n = max(1, len(words))
    stats = np.array([
        *np.sqrt(share),
        np.log1p(len(text)) / 12, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 8,
        min(2.0, len(text) / n / 10), len(set(words)) / n,
        len(set(lines)) / max(1, len(lines)), np.log1p(len(text) / max(1, len(lines))) / 8,
        sum(x.endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)), float(not words),
    ])
    return np.concatenate([ids, np.arange(1 << BITS, WIDTH)]), np.concatenate([value, stats, [1.0]])


class Machine:
    """y = w.x + (|V'x|^2 - |V^2'x^2|) / 2, through the logistic function."""

    def __init__(self, w: np.ndarray, v: np.ndarray):
        self.w, self.v = w, v

    def parts(self, ids, x, starts):
        vx = self.v[ids] * x[:, None]
        s = np.add.reduceat(vx, starts)
        y = np.add.reduceat(self.w[ids] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        return vx, s, 1 / (1 + np.exp(-np.clip(y, -40, 40)))

    def score(self, ids, x, starts) -> np.ndarray:
        return self.parts(ids, x, starts)[2]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """AdaGrad over shuffled batches; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    model = Machine(np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, FACTORS)))
    positive = sum(y for *_, y in rows)
    if not 0 < positive < len(rows):
        share = positive / len(rows) if rows else 0.5
        model.v[:] = 0
        model.w[CONSTANT] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return model
    past_w, past_v = np.full(WIDTH, 1e-4), np.full((WIDTH, FACTORS), 1e-4)
    for _ in range(max(epochs, -(-STEPS * min(BATCH, len(rows)) // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = [rows[i] for i in order[at : at + BATCH]]
            sizes = [len(r[0]) for r in some]
            ids, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            starts, of = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(some)), sizes)
            vx, s, p = model.parts(ids, x, starts)
            g = (p - [r[2] for r in some]) / len(some)
            gx = g[of] * x
            grad_w = np.bincount(ids, gx, WIDTH)
            grad_v = np.stack([np.bincount(ids, gx * (s[of, k] - vx[:, k]), WIDTH) for k in range(FACTORS)], 1)
            grad_w += DECAY * model.w
            grad_v += DECAY * model.v
            past_w += grad_w**2
            past_v += grad_v**2
            model.w -= RATE * grad_w / np.sqrt(past_w)
            model.v -= RATE * grad_v / np.sqrt(past_v)
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and quality of the rows to learn from: a sample of fixed size, picked before texts are read."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id")  # at most max_rows ids


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Features are taken on the executors; the driver gets those of the bounded sample only."""

    def run(batches):
        memo = Bounded(word_features, MEMO)
        for batch in batches:
            got = [features(x.as_py() or b"", memo) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32()))],
                names=["doc_id", "quality", "ids", "x"],
            )

    found = sample(docs, labels, max_rows, id_col, text_col).mapInArrow(run, "doc_id long, quality int, ids array<int>, x array<float>").toArrow()
    rows = []
    for batch in found.to_batches():
        ids, x = batch.column("ids"), batch.column("x")
        for i, (doc_id, quality) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), strict=True)):
            a, b = ids[i].values.to_numpy(), x[i].values.to_numpy()
            rows.append(((doc_id, quality, len(a), zlib.crc32(a.tobytes())), (a, b, quality)))
    rows.sort(key=lambda r: r[0])
    return fit([r for _, r in rows])


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.w, model.v))  # WIDTH * (1 + FACTORS) numbers, 1.2 MB

    def run(batches):
        machine, memo = Machine(*shared.value), Bounded(word_features, MEMO)
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 64):
                got = [features(x.as_py() or b"", memo) for x in batch.column(1).slice(at, 64)]
                starts = np.cumsum([0, *(len(i) for i, _ in got[:-1])])
                scores.append(machine.score(np.concatenate([i for i, _ in got]), np.concatenate([x for _, x in got]), starts))
            done = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.w, model.v))

    @F.pandas_udf("double")
    def scored(text):
        machine, memo = Machine(*shared.value), Bounded(word_features, MEMO)
        out = np.zeros(len(text))
        for i, x in enumerate(text):
            ids, value = features(bytes(x) if x is not None else b"", memo)
            out[i] = machine.score(ids, value, np.zeros(1, np.int64))[0]
        import pandas as pd

        return pd.Series(out)

    return docs.where(scored(F.col(text_col).cast("binary")) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
