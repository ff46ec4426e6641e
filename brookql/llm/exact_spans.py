"""Removal of byte strings that occur more than once, by suffix arrays.

Every window of ``size`` bytes has an anchor: the place of the smallest hash among its ``GRAM``-byte strings.  Equal windows have
equal anchors at equal offsets, so they meet under the anchor's hash, wherever they stand; consecutive windows with one
anchor form a run.  Hashes only route: a run whose anchor no other run has can't repeat.  Runs of equal bytes (by a 128-bit BLAKE2 digest of
them) repeat as a whole and are settled at once, first within a task and then across tasks; so copies cost little.  What is left are
runs that share an anchor and differ: the surroundings of a passage.  Their bytes are put into shards by anchor; each shard
gets a suffix array and common prefixes, which tell the windows that occur twice.  An anchor with more bytes than a shard is dealt into
several; each two of them meet in a group of their own, where binary search in the arrays merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytes_np as bn
from .shared import materialise, table, trimmed
from .suffix_array import common_prefixes, find, suffix_array

SIZE, GRAM = 200, 32
#: Bytes of one shard.
SHARD = 1 << 20
PLACE_BITS = 28
U = np.uint64


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with d1 and d2, 128 bits of hash of id and text: rows equal in both have equal results."""
    return docs.withColumns({"d1": F.xxhash64(F.lit(1), doc_id, text), "d2": F.xxhash64(text, F.lit(2), doc_id)})


def runs(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """(row, start, end, anchor hash) of a block's runs: its windows begin at start to end - 1, places in the block."""
    n = len(data)
    wide = size - GRAM + 1
    if n < size:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, U),)
    hasher = bn.Hasher(data)
    grams = n - GRAM + 1
    place = np.arange(grams)
    h = hasher(place, place + GRAM)
    m = (h >> U(PLACE_BITS) << U(PLACE_BITS)) | place.astype(U)
    width = 1
    while width * 2 <= wide:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: n - size + 1], m[wide - width : wide - width + n - size + 1])
    anchor = (m & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n - size + 1), "right") - 1
    whole = np.arange(n - size + 1) + size <= offsets[row + 1]
    at = np.flatnonzero(whole)
    cut = np.flatnonzero(np.r_[True, (anchor[at[1:]] != anchor[at[:-1]]) | (row[at[1:]] != row[at[:-1]]), True]) if len(at) else np.zeros(1, np.int64)
    start, end = at[cut[:-1]], at[cut[1:] - 1] + 1
    return row[start], start, end, h[anchor[start]]


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2 of each span, as two numbers."""
    raw = memoryview(np.ascontiguousarray(data))
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)


R = "h long, c1 long, c2 long, n int, d1 long, d2 long, l int, r int"
_NAMES = ["h", "c1", "c2", "n", "d1", "d2", "l", "r"]
#: n of a row: SETTLED is a run known to repeat, ONCE and TWICE stand for one run or more of equal bytes.
SETTLED, ONCE, TWICE = 0, 1, 2


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"n": np.int32, "l": np.int32, "r": np.int32}
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(kinds.get(k, np.int64)) if k != "b" else c) for k, c in zip(names, columns)], names)


def _alike(h: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by h and c, first of each set of equal ones, how often it comes)."""
    order = np.lexsort((c2, c1, h))
    if not len(h):
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(len(h) - 1, bool)
    for x in (h, c1, c2):
        new |= x[order][1:] != x[order][:-1]
    first = np.flatnonzero(np.r_[True, new])
    return order, first, np.diff(np.r_[first, len(h)])


def find_runs(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, starts, ends, hs, cs = [], [], [], [], []
            for a, _, data, offsets in bn.text_blocks(batch.column(2)):
                row, start, end, h = runs(data, offsets, size)
                rows.append(a + row)
                starts.append(start - offsets[row])
                ends.append(end - offsets[row])
                hs.append(h.view(np.int64))
                cs.append(digests(data, start, end - 1 + size))
            if not rows:
                continue
            row, start, end, h, c = (np.concatenate(x) for x in (rows, starts, ends, hs, cs))
            order, first, times = _alike(h, c[:, 0], c[:, 1])
            settled, send = order[np.repeat(times, times) > 1], order[first]
            yield _batch(_NAMES, h[send], c[send, 0], c[send, 1], np.where(times > 1, TWICE, ONCE), d1[row[send]], d2[row[send]], start[send], end[send])
            # what is settled here needs no partner: any partition may take it
            spread = bn.mix(d1[row[settled]].view(U)).view(np.int64)
            yield _batch(_NAMES, spread, c[settled, 0], c[settled, 1], np.full(len(settled), SETTLED), d1[row[settled]], d2[row[settled]], start[settled], end[settled])

    return docs.select("d1", "d2", "text").mapInArrow(trimmed(run), R)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...] = ("h",)) -> Iterator[pa.Table]:
    """Tables of whole groups of equal ``keys``, from batches in their order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        for k in keys:
            x = batch.column(k).to_numpy()
            new |= np.r_[bool(held) and held[-1].column(k)[-1].as_py() != x[0], x[1:] != x[:-1]]
        at = np.flatnonzero(new)
        if not len(at):
            held.append(batch)
            continue
        last = int(at[-1])
        done = [*held, *([batch.slice(0, last)] if last else [])]
        if done:
            yield pa.Table.from_batches(done)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def meet(found: DataFrame) -> DataFrame:
    """Rows of :func:`find_runs` by anchor: SETTLED runs, and one row for each of the runs that share an anchor and differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            h, c1, c2, n, d1, d2, l, r = (t.column(k).to_numpy() for k in _NAMES)

            def rows(i: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
                return _batch(_NAMES, h[i], c1[i], c2[i], kind, d1[i], d2[i], l[i], r[i])

            done = n == SETTLED
            yield rows(np.flatnonzero(done), n[done])
            i = np.flatnonzero(~done)
            if not len(i):
                continue
            order, first, times = _alike(h[i], c1[i], c2[i])
            order = i[order]
            twice = np.add.reduceat(n[order], first) > 1
            settled = order[np.repeat(twice, times)]
            yield rows(settled, np.full(len(settled), SETTLED))
            one = order[first]
            kinds = np.flatnonzero(np.r_[True, h[one][1:] != h[one][:-1], True])
            several = np.repeat(np.diff(kinds) > 1, np.diff(kinds))
            one, twice = one[several], twice[several]
            yield rows(one, np.where(twice, TWICE, ONCE))

    return found.repartition("h").sortWithinPartitions("h").mapInArrow(trimmed(run), R)


GROUP = ("h", "i", "j")


def dealt(met: DataFrame, size: int) -> DataFrame:
    """(h, i, j, block, n, d1, d2, l, r) of the runs that share an anchor and differ: the blocks i and j of an anchor meet in group (i, j)."""
    asked = met.where(F.col("n") != SETTLED).drop("c1", "c2")
    blocks = F.ceil(F.sum(F.col("r") - F.col("l") - 1 + size) / SHARD).cast("int")
    asked = asked.join(asked.groupBy("h").agg(blocks.alias("nb")), "h")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("d1", "d2", "l"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return asked.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "d1", "d2", "l", "r")


_CUT = [("h", "long"), ("i", "int"), ("j", "int"), ("block", "int"), ("n", "int"), ("d1", "long"), ("d2", "long"), ("l", "int"), ("r", "int"), ("b", "binary")]


def _cut(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """The asked runs with their bytes b, taken from their documents."""
    per = asked.groupBy("d1", "d2").agg(F.collect_list(F.struct("h", "i", "j", "block", "n", "l", "r")).alias("runs"))
    texts = docs.select("d1", "d2", "text")
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k, _ in _CUT}
            for d1, d2, text, runs_ in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = text.encode()
                for x in runs_:
                    for k, v in x.items():
                        out[k].append(v)
                    out["d1"].append(d1)
                    out["d2"].append(d2)
                    out["b"].append(raw[x["l"] : x["r"] - 1 + size])
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kinds[t]) for k, t in _CUT], [k for k, _ in _CUT])

    return texts.join(per, ["d1", "d2"]).select("d1", "d2", "text", "runs").mapInArrow(trimmed(run), ", ".join(f"{k} {t}" for k, t in _CUT))


def repeated_windows(texts: list[bytes], size: int, shard: int = SHARD, split: int | None = None) -> list[np.ndarray]:
    """For each text, which of its windows of ``size`` bytes occur again anywhere in ``texts``; given ``split``, which of those before
    that place occur behind it, and the other way round."""
    shards, at = [], 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= shard) and not (at < end == split):
            held += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b"\xff".join(texts[at:end]) + b"\xff", np.uint8)
        begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts[at:end]])][:-1]
        counts = np.array([len(t) - size + 1 for t in texts[at:end]])
        windows = np.repeat(begin - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        sa = suffix_array(data)
        flag = np.zeros(len(data), bool)
        if split is None:
            same = common_prefixes(data, sa) >= size
            flag[sa] = same | np.r_[same[1:], False]
        shards.append((data, sa, windows, flag, counts, split is not None and at >= split))
        at = end
    for i, (data, sa, _, flag, _, side) in enumerate(shards):  # each two shards, by binary search
        for other, _, windows, found, _, theirs in shards[i + 1 :]:
            if split is not None and side == theirs:
                continue
            low, high = find(data, sa, other, windows, size)
            hit = high > low
            found[windows[hit]] = True
            cover = np.zeros(len(data) + 1, np.int64)
            np.add.at(cover, low[hit], 1)
            np.add.at(cover, high[hit], -1)
            flag[sa[np.cumsum(cover)[:-1] > 0]] = True
    out = []
    for _, _, windows, flag, counts, _ in shards:
        out += np.split(flag[windows], np.cumsum(counts)[:-1])
    return out


def settle(asked: DataFrame, size: int) -> DataFrame:
    """(d1, d2, l, r) of the windows, l to r - 1, that occur again, of runs that share an anchor and differ."""

    def work(t: pa.Table, split: int | None = None) -> pa.RecordBatch:
        n, d1, d2, l = (t.column(k).to_numpy() for k in ("n", "d1", "d2", "l"))
        flags = repeated_windows(t.column("b").to_pylist(), size, split=split)
        out = [np.zeros((4, 0), np.int64)]
        for i in np.flatnonzero((n == ONCE) & np.array([f.any() for f in flags])):
            edge = np.flatnonzero(np.diff(np.r_[0, flags[i].astype(np.int8), 0]))
            a, b = edge[::2], edge[1::2]
            out.append(np.stack([np.full(len(a), d1[i]), np.full(len(a), d2[i]), l[i] + a, l[i] + b]))
        return _batch(["d1", "d2", "l", "r"], *np.concatenate(out, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_ = [], 0
        for t in _groups(batches, GROUP):
            where = np.stack([t.column(k).to_numpy() for k in GROUP], 1)
            cut = np.flatnonzero(np.r_[True, np.any(where[1:] != where[:-1], axis=1), True])
            sizes = pc.binary_length(t.column("b")).to_numpy()
            for a, b in zip(cut[:-1], cut[1:]):
                one = t.slice(a, b - a)
                if where[a, 1] < where[a, 2]:  # two blocks of one anchor
                    yield work(one, int((one.column("block").to_numpy() == where[a, 1]).sum()))
                    continue
                if held and bytes_ + sizes[a:b].sum() > SHARD:
                    yield work(pa.concat_tables(held))
                    held, bytes_ = [], 0
                held.append(one)
                bytes_ += int(sizes[a:b].sum())
        if held:
            yield work(pa.concat_tables(held))

    return asked.repartition(*GROUP).sortWithinPartitions(*GROUP, "block").mapInArrow(trimmed(run), "d1 long, d2 long, l int, r int")


def spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(d1, d2, spans): the windows to be removed of each of the :func:`keyed` documents that has any."""
    met = materialise(meet(find_runs(docs, size)))
    more = settle(_cut(docs, dealt(met, size), size), size)
    all_ = met.where(F.col("n") == SETTLED).select("d1", "d2", "l", "r").union(more)
    return all_.groupBy("d1", "d2").agg(F.collect_set(F.struct("l", "r")).alias("spans"))


def _kept(raw: bytes, found: list[dict] | None, size: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    if not found:
        return raw, 0, 0
    at = np.array(sorted((x["l"], x["r"] - 1 + size) for x in found))
    ends = np.maximum.accumulate(at[:, 1])
    new = np.r_[True, at[1:, 0] > ends[:-1]]
    starts, ends = at[new, 0], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
    pieces, last = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        pieces.append(raw[last:a])
        last = b
    return b"".join([*pieces, raw[last:]]), int((ends - starts).sum()), len(starts)


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` replaced by what is left, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    Texts are UTF-8 bytes, a null text is empty (and stays null).  A byte goes if a string of ``size`` bytes that covers it also starts
    anywhere else, in the same document or another; repeated rows count as other documents.  ``text`` leaves out the rest of a
    character of which a part was removed; the digest has all bytes left.  Columns named like the new ones, d1, d2 or
    spans are replaced or dropped.  An empty table stays empty.
    """
    docs = keyed(docs.drop("d1", "d2", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    joined = docs.join(spans(docs, size), ["d1", "d2"], "left").select(*docs.columns, "spans")
    names = [c for c in docs.columns if c not in ("d1", "d2")]
    schema = docs.select(*names).withColumns({"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, gone, many, sha = [], [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = (text or "").encode()
                left, removed, k = _kept(raw, found, size)
                texts.append(text if not removed else left.decode(errors="ignore"))
                n.append(len(raw))
                gone.append(removed)
                many.append(k)
                sha.append(hashlib.sha256(left).hexdigest())
            own = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(sha, pa.string())], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(trimmed(run), schema)


def op3_exact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
