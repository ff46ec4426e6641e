"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Tokens (runs of letters or of digits, A-Z lower-cased) have embeddings in three hashed tables, by the whole token and by
its first six and four bytes, so that two words rarely share all and words of one stem share some.  Filters one, two and three tokens wide run over a whole text, each keeps its largest value, and a logistic layer
weighs them.  All parameters start from small random values and are trained by Adagrad through the windows that won.
Languages aren't given: texts of the sample are grouped by the frequent tokens that they use (k-means), which tells languages
apart, and each group has a threshold, fitted on rows held out of the sample, that the score puts at one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytes_np as bn
from .shared import crc_mod, label_sample, labelled_texts, table, trim_driver, trimmed

BITS, HALF, FILTERS, WIDTHS = 15, 8, 8, (1, 2, 3)
STEMS = (None, 6, 4)
TABLES = len(STEMS)
BUCKETS, DIM, PAD = 1 << BITS, TABLES * HALF, 1 << BITS
#: Labelled rows that are learned from, at most.
SAMPLE = 4_000
#: Bytes of their texts, at most.
MOST_BYTES = 64 << 20
EPOCHS, BATCH, RATE, START = 12, 32, 0.05, 0.05
FOLDS, HELD_OUT = 5, 0
#: Held-out texts of one group that a threshold of its own needs, and those of each class.
ENOUGH, ENOUGH_EACH = 60, 10
#: Groups of texts, and the frequent tokens that tell them apart.
GROUPS, FREQUENT = 6, 256


def _counts(ids: np.ndarray, starts: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """How often each text has each frequent token, as square roots of shares."""
    row = bn.row_of(starts)
    at = column[ids]
    fine = at >= 0
    n = np.bincount(row[fine] * width + at[fine], minlength=(len(starts) - 1) * width).reshape(-1, width)
    return np.sqrt(n / np.maximum(n.sum(1, keepdims=True), 1))


def encode(column: pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, TABLES x n buckets, row offsets): each text as one PAD, its tokens and two PADs."""
    for a, b, data, offsets in bn.text_blocks(column):
        data = bn.FOLD[data]
        begin, end, rows = bn.token_spans(data, offsets, words=False, punct=False)
        hasher = bn.Hasher(data)
        at = np.arange(len(begin)) + 3 * bn.row_of(rows) + 1
        starts = rows + 3 * np.arange(len(rows))
        ids = np.full((TABLES, starts[-1]), PAD, np.int64)
        for t, stem in enumerate(STEMS):
            ids[t, at] = hasher(begin, end if stem is None else np.minimum(end, begin + stem)) >> np.uint64(20 * t) & np.uint64(BUCKETS - 1)
        yield a, b, ids, starts


class Model:
    """Parameters; ``prior`` alone if there was nothing to learn from."""

    def __init__(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        self.prior = None
        if len(y) < 20 or len(set(y.tolist())) < 2:
            self.prior = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(11)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 4], order[len(y) // 4 :]
        self.e = [rng.normal(0, START, (BUCKETS + 1, HALF)) for _ in range(TABLES)]
        for e in self.e:
            e[PAD] = 0
        self.w = [rng.normal(0, (width * DIM) ** -0.5, (width, DIM, FILTERS)) for width in WIDTHS]
        self.v, self.c = rng.normal(0, 0.3, len(WIDTHS) * FILTERS), np.zeros(1)
        self._train([docs[i] for i in used], y[used].astype(float), rng)
        self._group([docs[i][0] for i in used], rng)
        self.thresholds = np.zeros(GROUPS + 1)
        self._calibrate([docs[i] for i in held], y[held])

    def _group(self, docs: list[np.ndarray], rng: np.random.Generator) -> None:
        """Centres of the groups, over the tokens that most texts of the sample use."""
        used = np.zeros(BUCKETS + 1, np.int64)
        for d in docs:
            used[np.unique(d)] += 1
        used[PAD] = 0
        often = np.argsort(-used, kind="stable")[:FREQUENT]
        self.column = np.full(BUCKETS + 1, -1, np.int64)
        self.column[often] = np.arange(FREQUENT)
        x = _counts(np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])], self.column, FREQUENT)
        x = x[x.any(1)]
        c = x[:1] if len(x) else np.zeros((1, FREQUENT))
        while len(c) < GROUPS and len(x):  # the next centre is the text that is least like those there are
            c = np.concatenate([c, x[(x @ c.T).max(1).argmin()][None]])
        for _ in range(10):
            near = (x @ c.T).argmax(1)
            c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-9)
        self.centres = c

    def _maxima(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest filter values of each text, where they stand, and the joined buckets."""
        ids = np.concatenate(docs, 1)
        starts = np.r_[0, np.cumsum([d.shape[1] for d in docs])]
        x = np.concatenate([e[i] for e, i in zip(self.e, ids)], 1)
        n = ids.shape[1] - 2
        y = np.concatenate([sum(x[k : k + n] @ w[k] for k in range(len(w))) for w in self.w], 1)
        where = np.array([a + y[a : b - 2].argmax(0) for a, b in zip(starts[:-1], starts[1:])])
        return y[where, np.arange(y.shape[1])], where, ids

    def _train(self, docs: list, y: np.ndarray, rng: np.random.Generator) -> None:
        seen_e, seen_w = [np.full(e.shape, 1e-6) for e in self.e], [np.full(w.shape, 1e-6) for w in self.w]
        seen_v, seen_c = np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                mine = order[k : k + BATCH]
                top, where, ids = self._maxima([docs[i] for i in mine])
                f = np.maximum(top, 0)
                error = (1 / (1 + np.exp(-np.clip(f @ self.v + self.c, -30, 30))) - y[mine]) / len(mine)
                back = np.outer(error, self.v) * (top > 0)
                g = f.T @ error
                seen_v += g * g
                self.v -= RATE * g / np.sqrt(seen_v)
                seen_c += error.sum() ** 2
                self.c -= RATE * error.sum() / np.sqrt(seen_c)
                rows, grads = [[] for _ in self.e], [[] for _ in self.e]
                for j, w in enumerate(self.w):
                    cols = slice(j * FILTERS, (j + 1) * FILTERS)
                    b, at = back[:, cols], where[:, cols]
                    gw = np.zeros(w.shape)
                    for tap in range(len(w)):
                        here = ids[:, at + tap]  # tables x texts x filters
                        x = np.concatenate([e[i] for e, i in zip(self.e, here)], 2)
                        gw[tap] = np.einsum("bfd,bf->df", x, b)
                        gx = b[:, :, None] * w[tap].T[None]
                        for t, i in enumerate(here):
                            rows[t].append(i.ravel())
                            grads[t].append(gx[:, :, t * HALF : (t + 1) * HALF].reshape(-1, HALF))
                    seen_w[j] += gw * gw
                    self.w[j] = w - RATE * gw / np.sqrt(seen_w[j])
                for t in range(TABLES):
                    r, back_to = np.unique(np.concatenate(rows[t]), return_inverse=True)
                    ge = np.zeros((len(r), HALF))
                    np.add.at(ge, back_to, np.concatenate(grads[t]))
                    ge[r == PAD] = 0
                    seen_e[t][r] += ge * ge
                    self.e[t][r] -= RATE * ge / np.sqrt(seen_e[t][r])

    def _calibrate(self, docs: list, y: np.ndarray) -> None:
        z = np.concatenate([np.maximum(self._maxima([d])[0], 0) @ self.v + self.c for d in docs])
        lang = np.array([self.group(d[0], np.array([0, d.shape[1]]))[0] for d in docs])

        def cut(z: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(z, kind="stable")
            z, y = z[order], y[order]
            wrong = np.r_[0, np.cumsum(y == 1)] + np.r_[np.cumsum((y == 0)[::-1])[::-1], 0]  # toxic below, others above
            best = np.flatnonzero(wrong == wrong.min())
            k = best[len(best) // 2]
            return float((z[max(k - 1, 0)] + z[min(k, len(z) - 1)]) / 2)

        self.thresholds[:] = cut(z, y)
        for k in range(1, len(self.thresholds)):
            mine = lang == k
            if mine.sum() >= ENOUGH and min((y[mine] == 1).sum(), (y[mine] == 0).sum()) >= ENOUGH_EACH:
                self.thresholds[k] = cut(z[mine], y[mine])

    def group(self, one: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The group of each text, from 1; 0 without any frequent token."""
        x = _counts(one, starts, self.column, FREQUENT)
        return np.where(x.any(1), (x @ self.centres.T).argmax(1) + 1, 0)

    def ready(self) -> Model:
        """With each bucket's part of every filter worked out, for scoring."""
        if self.prior is None and not hasattr(self, "parts"):
            flat = np.concatenate([w[k] for w in self.w for k in range(len(w))], 1)  # DIM x (taps * FILTERS)
            self.parts = [(e @ flat[t * HALF : (t + 1) * HALF]).astype(np.float32) for t, e in enumerate(self.e)]
            del self.e
        return self

    def score(self, column: pa.ChunkedArray) -> np.ndarray:
        out = np.full(len(column), self.prior if self.prior is not None else 0.0)
        if self.prior is not None:
            return out
        for a, b, ids, starts in encode(column):
            top = np.full((b - a, len(WIDTHS) * FILTERS), -np.inf, np.float32)
            for c, d in _runs(starts):
                x = self.parts[0][ids[0, starts[c] : starts[d]]]
                for t in range(1, TABLES):
                    x += self.parts[t][ids[t, starts[c] : starts[d]]]
                n, tap = len(x) - 2, 0
                for j, width in enumerate(WIDTHS):
                    y = x[:n, tap * FILTERS : (tap + 1) * FILTERS].copy()
                    for k in range(1, width):
                        y += x[k : k + n, (tap + k) * FILTERS : (tap + k + 1) * FILTERS]
                    tap += width
                    last = (starts[c + 1 : d + 1] - starts[c])[:, None] - np.array([2, 1])
                    y[last[last < n]] = -np.inf
                    top[c:d, j * FILTERS : (j + 1) * FILTERS] = np.maximum.reduceat(y, starts[c:d] - starts[c], axis=0)
            z = np.maximum(top, 0) @ self.v + self.c - self.thresholds[self.group(ids[0], starts)]
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        return out


def _runs(starts: np.ndarray, most: int = 100_000) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` tokens."""
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, "right")) - 1)
        yield a, b
        a = b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT, most_bytes: int = MOST_BYTES) -> Model:
    """A model from the whole texts of at most ``sample`` labelled ids outside the held-out fold, one text an id, as many as
    ``most_bytes`` hold (in order of a hash of the id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, ids, starts in encode(batch.column(1)):
                found += [ids[:, i:j].astype(np.uint16).tobytes() for i, j in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["y", "ids"])

    texts = labelled_texts(docs, label_sample(labels, label, sample, folds, held_out)).withColumn("upto", F.sum(F.octet_length("text")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id")))
    rows = texts.where(F.col("upto") <= most_bytes).select("y", "text").mapInArrow(run, "y int, ids binary").collect()
    rows = sorted((r[0], bytes(r[1])) for r in rows)
    model = Model([np.frombuffer(x, np.uint16).reshape(TABLES, -1) for _, x in rows], np.array([r[0] for r in rows], int))
    del rows
    trim_driver(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``toxicity`` (a column so named is replaced), 0 to 1.

    Null and empty texts are scored as texts without words; repeated rows each get their score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.ready())
    docs = docs.drop("toxicity")
    kind = docs.withColumn("toxicity", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "toxicity"])

    return docs.mapInArrow(trimmed(run), kind)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
