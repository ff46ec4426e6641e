"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Every token (a run of letters of one case, digits or punctuation) is hashed to one of ``VOCAB`` buckets, and each
bucket has a fixed sparse index vector of +1 and -1.  A token's word vector is the sum of the index vectors of its neighbours
over the whole corpus; the sums are integers, so they don't depend on the order of tasks.  A document is the mean of
its tokens' (normalised) word vectors, and the share of tokens that say the one before again.  The network is trained on a bounded sample of labelled rows, and a temperature, fitted
on a part held out of that sample, calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_np as bn
from .shared import crc_mod, label_sample, labelled_texts, table

VOCAB, DIM, NONZERO, WINDOW = 1 << 13, 32, 2, 2
#: Labelled rows that are learned from, at most.
SAMPLE = 6_000
HIDDEN, STEPS, RATE, DECAY = 16, 400, 0.02, 1e-4
#: Buckets in one row of partial sums, and partial tables that are summed side by side before the last sum.
SLICE, SALTS = 512, 32
FOLDS, HELD_OUT = 3, 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs, VOCAB x NONZERO, of the index vectors."""
    h = bn.mix(np.arange(1, VOCAB * NONZERO + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(VOCAB, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _blocks(column: pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in bn.text_blocks(column):
        starts, ends, rows = bn.token_spans(data, offsets, words=False)
        yield a, b, (bn.Hasher(data)(starts, ends) % np.uint64(VOCAB)).astype(np.int64), rows


def word_sums(docs: DataFrame, text: str = "text") -> np.ndarray:
    """VOCAB x DIM sums of the neighbours' index vectors over all texts; its size doesn't depend on the corpus."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        sums = np.zeros(VOCAB * DIM)
        for batch in batches:
            for _, _, ids, rows in _blocks(batch.column(0)):
                row = bn.row_of(rows)
                for gap in range(1, WINDOW + 1):
                    near = np.flatnonzero(row[gap:] == row[:-gap]) if len(row) > gap else np.zeros(0, np.int64)
                    a, b = ids[near], ids[near + gap]
                    for one, other in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            sums += np.bincount(one * DIM + place[other, k], weights=sign[other, k], minlength=VOCAB * DIM)
        yield _pack(sums.reshape(VOCAB, DIM).astype(np.int64))

    def _pack(sums: np.ndarray, only: list[int] | None = None) -> pa.RecordBatch:
        at = [i for i in (range(VOCAB // SLICE) if only is None else only) if sums[i * SLICE : (i + 1) * SLICE].any()]
        return pa.RecordBatch.from_pydict({"slice": pa.array(at, pa.int32()), "sums": pa.array([sums[i * SLICE : (i + 1) * SLICE].tobytes() for i in at], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((VOCAB, DIM), np.int64)
        for batch in batches:
            for i, x in zip(batch.column("slice").to_pylist(), batch.column("sums")):
                sums[i * SLICE : (i + 1) * SLICE] += np.frombuffer(x.as_buffer(), np.int64).reshape(SLICE, DIM)
        yield _pack(sums)

    kind = "slice int, sums binary"
    parts = docs.select(text).mapInArrow(partial, kind).withColumn("salt", F.spark_partition_id() % SALTS)
    once = parts.repartition(SALTS, "slice", "salt").select("slice", "sums").mapInArrow(add, kind)
    total = np.zeros((VOCAB, DIM), np.int64)
    for i, x in once.repartition(VOCAB // SLICE, "slice").mapInArrow(add, kind).collect():  # the fixed table, at most once
        total[i * SLICE : (i + 1) * SLICE] += np.frombuffer(x, np.int64).reshape(SLICE, DIM)
    return total


def word_vectors(sums: np.ndarray) -> np.ndarray:
    length = np.sqrt((sums.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (sums / np.maximum(length, 1.0)).astype(np.float32)


def pooled(column: pa.ChunkedArray, vectors: np.ndarray) -> np.ndarray:
    """The mean word vector of each text, then the share of its tokens that repeat the one before; zeros without tokens."""
    out = np.zeros((len(column), DIM + 1))
    for a, b, ids, rows in _blocks(column):
        full = np.flatnonzero(np.diff(rows))
        if len(full):
            same = np.r_[False, ids[1:] == ids[:-1]]
            same[rows[:-1][full]] = False
            out[a + full, :DIM] = np.add.reduceat(vectors[ids], rows[:-1][full], axis=0, dtype=np.float64)
            out[a + full, DIM] = np.add.reduceat(same, rows[:-1][full], dtype=np.float64)
            out[a + full] /= np.diff(rows)[full, None]
    return out


class Network:
    """Two layers and a temperature; ``prior`` alone if there was nothing to learn from."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.prior = None
        if len(set(y.tolist())) < 2 or len(y) < 20:
            self.prior = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(7)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[used].mean(0), x[used].std(0) + 1e-6
        self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        z, t = (x[used] - self.mean) / self.scale, y[used].astype(float)
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for step in range(1, STEPS + 1):
            a = np.tanh(z @ self.p[0] + self.p[1])
            e = (_sigmoid(a @ self.p[2] + self.p[3]) - t) / len(t)
            back = np.outer(e, self.p[2]) * (1 - a * a)
            grads = [z.T @ back + DECAY * self.p[0], back.sum(0), a.T @ e + DECAY * self.p[2], np.array([e.sum()])]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        margin, truth = self.logit(x[held]), y[held]
        loss = lambda s: np.logaddexp(0, np.where(truth == 1, -1, 1) * margin / s).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -20, 20)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.prior is not None else _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> tuple[np.ndarray, Network]:
    """Word vectors from every text of ``docs``, and a network from the whole texts of at most ``sample`` labelled ids, one text an id."""
    vectors = word_vectors(word_sums(docs))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    chosen = label_sample(labels, label, sample, folds, held_out)
    rows = labelled_texts(docs, chosen).select("y", "text").mapInArrow(features, "y int, x array<double>").collect()  # at most ``sample`` rows of fixed size
    rows = sorted((r[0], r[1]) for r in rows)
    return vectors, Network(np.array([r[1] for r in rows]).reshape(len(rows), DIM + 1), np.array([r[0] for r in rows], int))


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """(doc_id, score) of every row of ``docs``.

    Null and empty texts are scored as a document without words.  Repeated rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.score(pooled(batch.column(1), v)), pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
