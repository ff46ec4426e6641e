"""Near-duplicate documents by b-bit MinHash signatures and a multi-index Hamming join, confirmed on full shingle sets.

Documents with the same words in the same order (by a 128-bit BLAKE2 digest) are one class, so copies cost nothing further.  A class's signature has ``SYMBOLS`` minima,
cut to 16 bits, in ``CHUNKS`` chunks, and ``MORE`` minima cut to 8 bits that only sharpen estimates.  If two signatures
differ in at most ``2 * CHUNKS - 1`` of the ``SYMBOLS`` places, some chunk has at most one error (pigeonhole), so each chunk
is entered under each of the keys that leave one of its symbols out, and every such pair meets.  At a similarity of
0.8 a pair misses all chunks with probability 0.18 ** CHUNKS, about 6e-6.

What meets under a key is not expanded into all pairs.  First, members of a key are dealt into blocks of at most ``BLOCK``, large
keys twice, differently; within a block, estimates from the signatures join strongly similar members by two
spanning forests, and probable links by a third.  These pairs are confirmed on both whole texts.  The keys are then
gone through again with the components that these links make.  Only members outside a key's largest component can add
a link there that matters, so these few are compared with all members, block by block: from the lowest estimate that a link
can have on, both whole texts meet under the key, and a forest of the confirmed links is put out.  A link is confirmed by
hashes of the shingles and then by the shingles themselves.  Components of confirmed links are found by alternating large and
small stars.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytes_np as bn
from .shared import discard, materialise, table, trimmed

CHUNKS, WIDE = 7, 4
SYMBOLS, MORE = CHUNKS * WIDE, 100
K = SYMBOLS + MORE
STRONG = 0.9
#: Standard deviations of an estimate that a link may lie below the threshold.
SIGMAS = 4.5
#: Members of a key in one block.
BLOCK = 2048
#: Shingles in all of such members.
BLOCK_SHINGLES = 4_000_000
U = np.uint64
_SEEDS = bn.mix(np.arange(1, K + 1, dtype=U) * U(0xD6E8FEB86659FD93))


def shingles(column: pa.Array | pa.ChunkedArray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased); a text of fewer words is one shingle, without words none."""
    for a, b, data, offsets in bn.text_blocks(column):
        data = bn.FOLD[data]
        starts, ends, rows = bn.token_spans(data, offsets)
        words = bn.Hasher(data)(starts, ends)
        n = max(0, len(words) - width + 1)
        h = np.zeros(n, U)
        for k in range(width):
            h = bn.mix(h * U(0x9E3779B97F4A7C15) + words[k : k + n])
        for i, j in zip(rows[:-1], rows[1:]):
            if j - i >= width:
                yield np.unique(h[i : j - width + 1])
            elif j > i:
                x = np.zeros(1, U)
                for w in words[i:j]:
                    x = bn.mix(x * U(0x9E3779B97F4A7C15) + w)
                yield bn.mix(x + U(j - i))
            else:
                yield np.zeros(0, U)


def signature(s: np.ndarray) -> np.ndarray:
    """The K minima of a set."""
    out = np.full(K, np.iinfo(U).max, U)
    for a in range(0, len(s), 2048):
        x = (s[a : a + 2048, None] ^ _SEEDS[None]) * U(0x9E3779B97F4A7C15)
        x ^= x >> U(32)
        x *= bn._M1
        out = np.minimum(out, x.min(0))
    return out


def word_digests(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """A 128-bit digest of each text's words (A-Z lower-cased), one space between them."""
    for a, b, data, offsets in bn.text_blocks(column):
        data = bn.FOLD[data]
        space = bn.CLASS[data] == bn.SPACE
        after = np.r_[True, space[:-1]] if len(data) else space
        keep = ~(space & after)  # the first white byte behind each word stays
        ends = np.r_[0, np.cumsum(keep)]
        kept = np.where(space, np.uint8(32), data)[keep].tobytes()
        for i, j in zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist()):
            yield hashlib.blake2b(kept[i:j].strip(b" "), digest_size=16).digest()


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, tx, n, d1, d2, sig): hash of the row's text, set size, digest of the words, packed signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig = [], []
            for s in shingles(batch.column(1), width):
                n.append(len(s))
                m = signature(s) >> U(40)
                sig.append(m[:SYMBOLS].astype(np.uint16).tobytes() + m[SYMBOLS:].astype(np.uint8).tobytes())
            d = np.frombuffer(b"".join(word_digests(batch.column(1))), np.int64).reshape(-1, 2)
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tx", "n", "d1", "d2", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tx"))
    return rows.mapInArrow(trimmed(run), "doc_id long, tx long, n long, d1 long, d2 long, sig binary")


def _unpack(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * SYMBOLS + MORE)
    return raw[:, : 2 * SYMBOLS].copy().view(np.uint16), raw[:, 2 * SYMBOLS :]


def keys(classes: DataFrame) -> DataFrame:
    """(key, slot, id): each class under its CHUNKS * WIDE keys; slot tells the chunk and the symbol left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            wide, _ = _unpack(batch.column(1))
            s = wide.astype(U).reshape(len(wide), CHUNKS, WIDE)
            out = np.zeros((len(wide), CHUNKS, WIDE), U)
            for c in range(CHUNKS):
                for d in range(WIDE):
                    h = np.full(len(wide), c * WIDE + d + 1, U)
                    for k in range(WIDE):
                        if k != d:
                            h = bn.mix(h * U(0x9E3779B97F4A7C15) + s[:, c, k])
                    out[:, c, d] = h
            n = CHUNKS * WIDE
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(n, dtype=np.int8), len(ids))), pa.array(np.repeat(ids, n))], ["key", "slot", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, slot byte, id long")


def _first_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first slot under which each pair of wide signatures meets."""
    same = (a == b).reshape(len(a), CHUNKS, WIDE)
    meet = same.sum(2) >= WIDE - 1
    c = meet.argmax(1)
    gap = ~same[np.arange(len(a)), c]
    return c * WIDE + np.where(gap.any(1), gap.argmax(1), 0)


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tree of each, parent of each or -1): breadth first from the first members, so that other groups of the same members find the same edges."""
    n = len(near)
    tree, parent = np.full(n, -1), np.full(n, -1)
    for root in range(n):
        if tree[root] >= 0:
            continue
        tree[root], front = root, np.array([root])
        while len(front):
            new = np.flatnonzero((tree < 0) & near[front].any(0))
            parent[new] = front[near[np.ix_(front, new)].argmax(0)]
            tree[new] = root
            front = new
    return tree, parent


def likely_pairs(wide: np.ndarray, more: np.ndarray, slot: int, lowest: float, threshold: float) -> np.ndarray:
    """Rows (place, place) of the spanning pairs of one group; two members alone are a pair from the lowest estimate on."""
    n = len(wide)
    if n == 2:
        share = ((wide[0] == wide[1]).sum() + (more[0] == more[1]).sum()) / K
        return np.array([[0, 1]]) if share >= lowest and _first_slot(wide[:1], wide[1:])[0] == slot else np.zeros((0, 2), int)
    share = _shares(wide, more, np.arange(n), np.arange(n))
    np.fill_diagonal(share, 0)
    strong = share >= STRONG
    out = []
    for _ in range(2):
        _, parent = _forest(strong)
        child = np.flatnonzero(parent >= 0)
        out.append(np.stack([child, parent[child]], 1))
        strong[child, parent[child]] = strong[parent[child], child] = False
    _, parent = _forest(share >= threshold)
    child = np.flatnonzero(parent >= 0)
    out.append(np.stack([child, parent[child]], 1))
    return np.concatenate(out)


def open_pairs(wide: np.ndarray, more: np.ndarray, ids: np.ndarray, few: np.ndarray, outer: np.ndarray, component: np.ndarray, slot: int, lowest: float) -> np.ndarray:
    """Rows (place, place) of the pairs of one group from the lowest estimate on whose ends lie in different components.

    ``few`` rows are compared with the others; ``outer`` tells members outside the key's largest component, which have rows of
    both kinds: of two of them one row pair is enough.
    """
    mine, others = np.flatnonzero(few), np.flatnonzero(~few)
    if not len(mine) or not len(others):
        return np.zeros((0, 2), int)
    a, b = np.nonzero(_shares(wide, more, mine, others) >= lowest)
    a, b = mine[a], others[b]
    stay = (component[a] != component[b]) & (~outer[b] | (ids[a] < ids[b]))
    a, b = a[stay], b[stay]
    if not len(a):
        return np.zeros((0, 2), int)
    first = _first_slot(wide[a], wide[b]) == slot
    return np.stack([a[first], b[first]], 1)


def _shares(wide: np.ndarray, more: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The share of equal places of each of ``rows`` with each of ``others``."""
    share = np.zeros((len(rows), len(others)), np.float32)
    w, m = wide[others], more[others]
    for a in range(0, len(rows), 32):
        at = rows[a : a + 32]
        share[a : a + 32] = (wide[at, None] == w[None]).sum(2) + (more[at, None] == m[None]).sum(2)
    return share / K


GROUP = ["key", "slot", "i", "j"]


def _blocks(members: str, shingles_: str) -> Column:
    return F.greatest(F.ceil(F.col(members) / BLOCK), F.ceil(F.col(shingles_) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _place(salt: int, blocks: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(blocks)).cast("int")


def members(classes: DataFrame) -> DataFrame:
    """(key, slot, i, j, id, sig): the members of each key with several, in blocks j; a key of several blocks is dealt twice (i)."""
    k = keys(classes)
    size = k.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "slot", _blocks("m", "m").alias("nb"))
    k = k.join(size.hint("merge"), ["key", "slot"])  # the same plan at every size
    k = k.withColumn("i", F.explode(F.when(F.col("nb") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    k = k.withColumn("j", F.pmod(F.xxhash64("id", "i"), F.col("nb")).cast("int"))
    return k.select(*GROUP, "id").join(classes.select("id", "sig"), "id").select(*GROUP, "id", "sig")


def open_members(classes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, slot, i, j, id, few, outer, sig, component) of each key whose members lie in several of the components ``found``, and
    the table that it reads.

    Group (i, j) has block j of all members and, as ``few``, block i of those outside the key's largest component.
    """
    of = found.select(F.col("id").alias("of"), "component")
    signed = materialise(classes.join(of, F.col("id") == F.col("of"), "left").select("id", "sig", "n", F.coalesce("component", "id").alias("component")))
    k = keys(classes).join(signed.select("id", "n", "component").hint("merge"), "id")
    each = k.groupBy("key", "slot", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    largest = F.max(F.struct("c", "component", "s")).alias("big")
    size = each.groupBy("key", "slot").agg(F.sum("c").alias("m"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("k"), largest).where("k > 1")
    size = size.withColumns({"m2": F.col("m") - F.col("big.c"), "s2": F.col("s") - F.col("big.s")})
    size = size.select("key", "slot", F.col("big.component").alias("big"), _blocks("m", "s").alias("nb"), _blocks("m2", "s2").alias("nq"))
    k = k.select("key", "slot", "id", "component").join(size.hint("merge"), ["key", "slot"]).withColumn("outer", F.col("component") != F.col("big"))
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = k.select("key", "slot", steps("nq").alias("i"), _place(5, "nb").alias("j"), "id", F.lit(False).alias("few"), "outer")
    few = k.where("outer").select("key", "slot", _place(6, "nq").alias("i"), steps("nb").alias("j"), "id", F.lit(True).alias("few"), "outer")
    return every.union(few).join(signed.drop("n"), "id").select(*GROUP, "id", "few", "outer", "sig", "component"), signed


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "id")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where the groups begin and end."""

    def cut(t: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.r_[True, np.any([(x := t.column(c).to_numpy())[1:] != x[:-1] for c in GROUP], axis=0), True])

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not len(t):
            continue
        at = cut(t)
        held = t.slice(int(at[-2]))
        if len(at) > 2:
            yield t.slice(0, int(at[-2])), at[:-1]
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def lowest_share(threshold: float) -> float:
    """The lowest estimate that a link can have."""
    return threshold - SIGMAS * float(np.sqrt(threshold * (1 - threshold) / K))


def spanning(classes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of class ids that are likely to be links and span what is alike."""
    lowest = lowest_share(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _groups(batches):
            ids, slot = t.column("id").to_numpy(), t.column("slot").to_numpy()
            wide, more = _unpack(t.column("sig").combine_chunks())
            pairs = [np.zeros((0, 2), np.int64)]
            for a, b in zip(cut[:-1], cut[1:]):
                if b - a > 1:
                    pairs.append(np.sort(ids[a + likely_pairs(wide[a:b], more[a:b], slot[a], lowest, threshold)], 1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(2)], ["a", "b"])

    return _grouped(members(classes)).mapInArrow(trimmed(run), "a long, b long").where("a <> b").distinct()


def class_texts(docs: DataFrame, classes: DataFrame, need: DataFrame) -> DataFrame:
    """(id, text): one text of each class in ``need`` (id); rows repeat as often as they like."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64("text").alias("tx"))
    wanted = classes.join(need.hint("merge"), "id").select("id", F.col("row.doc_id").alias("first"), F.col("row.tx").alias("first_tx"))
    met = rows.join(wanted.hint("merge"), (F.col("doc") == F.col("first")) & (F.col("tx") == F.col("first_tx")))  # the same plan at every size
    return met.groupBy("id").agg(F.first("text").alias("text"))


def open_links(classes: DataFrame, found: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components ``found`` wherever any link does.

    A first pass over the signatures keeps the members of each group that have an open pair there; their whole texts go to
    the group, which confirms the open pairs on full sets and puts out a spanning forest of the links: no row per pair.
    """
    lowest = lowest_share(percent / 100)
    names = [*GROUP, "id", "few", "outer", "sig", "component"]

    def pairs_of(t: pa.Table) -> np.ndarray:
        wide, more = _unpack(t.column("sig").combine_chunks())
        ids, few, outer, component = (t.column(c).to_numpy() for c in ("id", "few", "outer", "component"))
        return open_pairs(wide, more, ids, few, outer, component, t.column("slot")[0].as_py(), lowest)

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _groups(batches):
            stay = np.zeros(len(t), bool)
            for a, b in zip(cut[:-1], cut[1:]):
                if b - a > 1:
                    stay[a + pairs_of(t.slice(int(a), int(b - a))).reshape(-1)] = True
            yield from t.filter(pa.array(stay)).to_batches()

    rows, signed = open_members(classes, found)
    rows = _grouped(rows)
    rows = materialise(rows.mapInArrow(trimmed(involved), rows.schema))
    texts = class_texts(docs, classes, rows.select("id").distinct())

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _groups(batches):
            for a, b in zip(cut[:-1], cut[1:]):
                g = t.slice(int(a), int(b - a))
                pairs = pairs_of(g)
                if not len(pairs):
                    continue
                ids, component = g.column("id").to_numpy(), g.column("component").to_numpy()
                one, place = np.unique(ids, return_index=True)
                at = np.searchsorted(one, ids)
                links = group_links(g.column("text").take(pa.array(place)), at[pairs], component[place], width, percent)
                if len(links):
                    links = np.sort(one[links], 1)
                    yield pa.RecordBatch.from_arrays([pa.array(links[:, k]) for k in range(2)], ["a", "b"])

    out = materialise(_grouped(rows.join(texts, "id").select(*names, "text")).mapInArrow(trimmed(confirmed), "a long, b long").where("a <> b").distinct())
    discard(rows, signed)
    return out


_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def real_shingles(text: str, width: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = _WORDS.findall(text.encode().lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def real_link(a: str, b: str, width: int, percent: int) -> bool:
    x, y = real_shingles(a, width), real_shingles(b, width)
    common = len(x & y)
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def group_links(texts: pa.ChunkedArray, pairs: np.ndarray, component: np.ndarray, width: int, percent: int) -> np.ndarray:
    """A spanning forest, over components, of the ``pairs`` of one group that full sets confirm, by hash and then in earnest."""
    sets = list(shingles(texts, width))
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    flat = np.split(flat, np.cumsum(size)[:-1])
    tree = np.unique(component, return_inverse=True)[1]
    has = np.zeros(len(values), bool)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    at = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0], True])
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        x, others = pairs[lo, 0], pairs[lo:hi, 1]
        others = others[(tree[others] != tree[x]) & (100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])) & (size[others] > 0)]
        if not len(others) or not size[x]:
            continue
        has[flat[x]] = True
        for k in range(0, len(others), 256):
            some = others[k : k + 256]
            common = np.add.reduceat(has[np.concatenate([flat[y] for y in some])], np.r_[0, np.cumsum(size[some])[:-1]], dtype=np.int64)
            for y in some[(common > 0) & (100 * common >= percent * (size[x] + size[some] - common))]:
                if tree[x] != tree[y] and real_link(texts[int(x)].as_py(), texts[int(y)].as_py(), width, percent):
                    out.append((x, y))
                    tree[tree == tree[y]] = tree[x]
        has[flat[x]] = False
    return np.array(out, int).reshape(-1, 2)


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of classes whose full sets have 100 * intersection >= percent * union."""
    texts = materialise(class_texts(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for k, (x, y) in enumerate(zip(shingles(batch.column(2), width), shingles(batch.column(3), width))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                stay.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common) and real_link(batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), width, percent))
            mask = pa.array(stay, pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(0), mask), pc.filter(batch.column(1), mask)], ["a", "b"])

    out = materialise(both.select("a", "b", "ta", "tb").mapInArrow(trimmed(run), "a long, b long").distinct())
    discard(texts)
    return out


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id in ``edges`` (a, b) reaches."""
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node whose neighbours are all larger gives them itself; nodes without larger neighbours keep their smallest edge
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, e = e, materialise(small.where("u <> v").distinct())
        discard(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
    raise RuntimeError(f"components don't settle in {most} rounds")


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``, from whole texts.

    Texts are linked with 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles.  Null,
    empty and blank texts have no shingles and are linked with nothing.  Rows that share a doc_id count as linked; a null
    doc_id is linked with nothing, has no component and is kept.  Other columns don't matter; an empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    base = materialise(profiles(docs, width))
    named = base.where("n > 0 and doc_id is not null")
    same = named.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "tx")).alias("row"), F.min("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialise(same.select(F.monotonically_increasing_id().alias("id"), "*"))
    likely = materialise(spanning(classes, percent / 100))
    edges = confirm(likely, classes, docs, width, percent)
    # rows that share a doc_id and differ
    ids = named.select("doc_id", "d1", "d2").distinct()
    repeated = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    own = ids.join(repeated, "doc_id").join(classes.select("id", "d1", "d2"), ["d1", "d2"])
    own = own.select(F.col("id").alias("a"), F.min("id").over(W.partitionBy("doc_id")).alias("b")).where("a <> b")
    first = components(edges.union(own))
    more = open_links(classes, first, docs, width, percent)
    found = components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    label = F.coalesce("component", "c.id").alias("label")
    of_class = classes.alias("c").join(found.alias("f"), F.col("c.id") == F.col("f.id"), "left").select("d1", "d2", "row.doc_id", label)
    least = of_class.groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("component_id"))
    of_class = materialise(of_class.join(least, F.col("label") == F.col("of")).select("d1", "d2", "component_id"))
    discard(classes, likely, edges, first, more, found)
    out = base.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), width=2)
