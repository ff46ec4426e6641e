"""Approximate nearest neighbours by cosine: probed lists, and a scan that gives candidates up early.

Vectors are scaled to length one and rotated by a fixed random orthogonal matrix, so that any leading columns are a fair
sample of a distance.  Each vector belongs to the list of its nearest centroid (k-means on a bounded sample).  How many lists
a query probes is fitted too: on the sample, brute force tells the true neighbours, and as many lists are probed as find
``TARGET`` of them there.  Where vectors have structure that is few lists; where they have none, most.

A query's distances to the sample, whose vectors in its lists are candidates themselves, bound its k-th best distance from the start.
It then scans its lists column block by column block: from the partial squared distance over d of D columns a
hypothesis test decides whether a candidate can still be within the bound, and gives it up if not.  Those that stay are
measured exactly on the original vectors in double precision.

Equal vectors are one candidate with the smallest ids that a result can need, so a vector that a third of all rows share
is scanned once.  A list is cut into blocks of bounded size, as many as it needs; queries come to a block in packs of bounded size,
one after the other, so a task holds one block and one pack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import discard, materialise, table

#: Vectors that centroids, probes and bounds are fitted on, at most; and those of them that are asked to fit the probes.
SAMPLE, ASKED = 20_000, 400
#: Vectors a list has on average, and lists at most.
PER_LIST, MAX_LISTS = 400, 4096
#: The share of true neighbours in the sample that the probed lists must hold, and the least number of them.
TARGET, MIN_PROBES = 0.96, 4
BLOCK_ROWS, COLUMNS = 8192, 16
#: Bytes of vectors in one pack of queries.
PACK = 1 << 15
#: The test gives a candidate up if its partial distance, scaled up, is over the limit by the factor (1 + EPSILON / sqrt(d))**2.
EPSILON = 2.1
#: Below this share of pairs still in the race, only theirs are computed; above it, whole column blocks are.
FEW = 0.2


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector isn't null or zero and has finite components only."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of length one."""
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row by a power of two, which is exact, so that its largest component is about one."""
    _, e = np.frexp(np.abs(x).max(1, keepdims=True))
    return np.ldexp(x, -e)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``x`` with that of ``y``, both :func:`scaled`."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places of the pairs of ``q`` and ``x`` that the tests leave within each query's ``limit`` of squared distance."""
    dim = q.shape[1]
    part, pairs, alive = np.zeros((len(q), len(x)), np.float32), None, None
    for a in range(0, dim, COLUMNS):
        b = min(a + COLUMNS, dim)
        qa, xa = q[:, a:b], x[:, a:b]
        if pairs is None:
            part += (qa * qa).sum(1)[:, None] + (xa * xa).sum(1)[None] - 2 * (qa @ xa.T)
        else:
            d = qa[pairs[0]] - xa[pairs[1]]
            alive += np.einsum("ij,ij->i", d, d)
        allowed = limit * ((1 + EPSILON / np.sqrt(b)) ** 2 * b / dim if b < dim else 1) * (1 + 1e-4) + 1e-5
        if pairs is not None:
            stay = alive <= allowed[pairs[0]]
            pairs, alive = (pairs[0][stay], pairs[1][stay]), alive[stay]
        else:
            inside = part <= allowed[:, None]
            if b == dim or np.count_nonzero(inside) < FEW * inside.size:
                pairs = np.nonzero(inside)
                alive = part[pairs]
            else:
                part[~inside] = np.inf
    return pairs


def fitted(seen: np.ndarray, lists: int, k: int) -> tuple[np.ndarray, int]:
    """Centroids of the sample, and how many of them must be probed to find TARGET of the true neighbours within it."""
    centres = kmeans(seen, lists)
    some = seen[:: max(1, len(seen) // ASKED)][:ASKED]
    near = np.argsort(-(some @ seen.T), axis=1)[:, 1 : k + 1]
    if not near.size:
        return centres, lists
    of = (seen @ centres.T).argmax(1)
    like = some @ centres.T
    place = np.argsort(np.argsort(-like, axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, of[near], 1).ravel())
    return centres, int(min(lists, max(MIN_PROBES, ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))) - 1)] + 1)))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vec: str = "embedding", sample: int = SAMPLE,
    probes: int | None = None, per_list: int = PER_LIST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries``, which are rows of ``vectors``, its ``k`` nearest others.

    Score is the cosine of the original vectors in double precision; ties go to the smaller id.  Rows whose vector is
    null, zero or not finite take no part, nor do those with another number of components than most rows have (of
    equal numbers the smaller).  Of several rows with one id the one with the smallest hash of its vector takes part.
    Fewer candidates than ``k`` are all returned, if a list that is probed has them: with few vectors all lists are.  Other columns are ignored.
    With no usable rows the result is empty.  ``probes`` overrules the number of lists that the sample says.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = usable(vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("v")), "v").where("id is not null")
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]
    one = lambda d: d.where(F.size("v") == dim).groupBy("id").agg(F.min(F.struct(F.xxhash64("v").alias("key"), "v")).alias("m")).select("id", "m.key", "m.v")
    v = one(v)
    kind = dict(v.dtypes)["v"]
    # one row for each vector, with the k + 1 smallest ids that have it: a query's own id may be among them
    first = F.row_number().over(W.partitionBy("key", "v").orderBy("id"))
    same = v.select("key", "v", "id").withColumn("r", first).where(F.col("r") <= k + 1)
    same = materialise(same.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    turn = rotation(dim)
    taken = same.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow().column(0)
    seen = (unit(_matrix(taken.combine_chunks())) @ turn).astype(np.float32)
    lists = int(min(MAX_LISTS, max(1, n // per_list), max(1, len(seen) // 4)))
    centres, enough = fitted(seen, lists, k)
    probes = lists if len(seen) < 4 * k * max(1, lists) else min(lists, probes or enough)
    shared = spark.sparkContext.broadcast((turn, centres, seen, (seen @ centres.T).argmax(1)))  # bounded by SAMPLE and MAX_LISTS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres, _, _ = shared.value
        for batch in batches:
            x = unit(_matrix(batch.column("v"))) @ turn if len(batch) else np.zeros((0, dim))
            near = (x @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["key", "v", "ids", "list"])

    placed = materialise(same.mapInArrow(place, f"key long, v {kind}, ids array<long>, list int"))
    blocks = F.broadcast(placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")))  # at most MAX_LISTS rows
    candidates = placed.join(blocks, "list").select(
        "list", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(0).cast("byte").alias("side"),
        "v", "ids", F.lit(None).cast("binary").alias("q"), F.lit(None).cast("binary").alias("bound"),
    )
    asked = one(usable(queries.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("v")), "v").where("id is not null"))
    # equal queries are searched once
    distinct = materialise(asked.select("key", "v").distinct().withColumn("qid", F.monotonically_increasing_id()))
    per_pack = max(1, PACK // (8 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(list, ids, q, bound): the queries that probe a list, in packs, with a bound of each one's (k + 1)-th distance."""
        turn, centres, seen, of = shared.value
        for batch in batches:
            raw, qid = _matrix(batch.column("v")) if len(batch) else np.zeros((0, dim)), batch.column("qid").to_numpy()
            for a in range(0, len(raw), 1024):
                x = (unit(raw[a : a + 1024]) @ turn).astype(np.float32)
                near = np.argpartition(-(x @ centres.T), probes - 1, axis=1)[:, :probes]
                bound = np.full(len(x), np.float32(8))
                if len(seen) > k:  # of the sample's vectors in the lists that are probed
                    mine = np.zeros((len(x), len(centres)), bool)
                    np.put_along_axis(mine, near, True, 1)
                    like = np.where(mine[:, of], x @ seen.T, np.float32(-3))
                    bound = (2 - 2 * np.partition(like, len(seen) - k - 1, axis=1)[:, len(seen) - k - 1]).astype(np.float32)
                order = np.argsort(near.ravel(), kind="stable")
                who, where = order // probes, near.ravel()[order]
                cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
                rows = [(where[i], who[c : min(c + per_pack, j)]) for i, j in zip(cut[:-1], cut[1:]) for c in range(i, j, per_pack)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()), pa.array([qid[a + r[1]] for r in rows], pa.list_(pa.int64())),
                        pa.array([raw[a + r[1]].tobytes() for r in rows], pa.binary()), pa.array([bound[r[1]].tobytes() for r in rows], pa.binary()),
                    ], ["list", "ids", "q", "bound"],
                )

    packs = distinct.select("qid", "v").mapInArrow(pack, "list int, ids array<long>, q binary, bound binary")
    packs = packs.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).cast("byte").alias("side"), F.lit(None).cast(kind).alias("v"), "ids", "q", "bound")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks, each followed by the packs that probe it."""
        turn = shared.value[0]
        at: tuple | None = None
        parts: list[pa.RecordBatch] = []
        x = raw = ids = None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("list", "block", "side")], 1) if len(batch) else np.zeros((0, 3), int)
            cut = np.flatnonzero(np.r_[True, np.any(where[1:] != where[:-1], axis=1), True]) if len(batch) else np.zeros(1, int)
            for i, j in zip(cut[:-1], cut[1:]):
                group, side, rows = tuple(where[i, :2]), where[i, 2], batch.slice(i, j - i)
                if group != at:
                    at, parts, x = group, [], None
                if not side:
                    parts.append(rows)
                    continue
                if not parts:
                    continue
                if x is None:
                    t = pa.Table.from_batches(parts).combine_chunks()
                    raw = scaled(_matrix(t.column("v").chunk(0)))
                    x, ids = (unit(raw) @ turn).astype(np.float32), t.column("ids")
                out: list[tuple] = []
                for qid, q, bound in zip(rows.column("ids").to_pylist(), rows.column("q").to_pylist(), rows.column("bound").to_pylist()):
                    own = scaled(np.frombuffer(q, np.float64).reshape(-1, dim))
                    who, what = scan((unit(own) @ turn).astype(np.float32), x, np.frombuffer(bound, np.float32))
                    cos = cosines(raw[what], own[who])
                    order = np.lexsort((-cos, who))
                    who, what, cos = who[order], what[order], cos[order]
                    begin = np.searchsorted(who, who)
                    last = cos[np.minimum(begin + k, np.searchsorted(who, who, "right") - 1)]
                    stay = cos >= last  # the best k + 1, and all that tie with the last of them
                    out.append((np.asarray(qid)[who[stay]], what[stay], cos[stay]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o[0] for o in out])), ids.take(pa.array(np.concatenate([o[1] for o in out]))).combine_chunks(), pa.array(np.concatenate([o[2] for o in out]))], ["qid", "ids", "score"],
                )

    key = ["list", "block"]
    scanned = candidates.union(packs).repartition(*key).sortWithinPartitions(*key, "side")
    found = scanned.mapInArrow(meet, "qid long, ids array<long>, score double")
    # per query vector the k + 1 best ids, its own still among them
    order = [F.desc("score"), F.col("vec_id")]
    best = found.select("qid", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("r") <= k + 1)
    best = materialise(best.drop("r"))
    each = asked.join(distinct, ["key", "v"]).select(F.col("id").alias("query_id"), "qid").join(best, "qid").where("query_id <> vec_id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    discard(placed, same)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
