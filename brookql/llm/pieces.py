"""SentencePiece encoding and decoding with a published byte-pair vocabulary, by suffix-array matching.

A text becomes one mark, then itself with its spaces as marks.  No piece holds a mark behind another character, so a text
falls into units (marks and what follows) that are encoded alone.  The distinct units of a batch that aren't known yet
are joined into one text with a suffix array; every piece finds its range of occurrences by binary search, the
occurrences are edges, and the edges, sorted by position, are relaxed from left to right.  A byte-pair encoding is the only
path whose neighbouring pieces would not have been merged across their border, so a place is reached by the one edge that
is compatible with the piece before it; characters without a piece fall back to their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, trimmed
from .suffix_array import suffix_array

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Units, and pairs of pieces, that are remembered; beyond, the memory is emptied.
KNOWN = 400_000
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Parts of a unit: where each piece lies inside one part, a merge never crosses two of them.
_FINE = regex.compile(rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}0-9{MARK}]+|{MARK}+|[0-9]")
#: Stands for a mark of the text itself; no unit has a space.
OWN_MARK = " "
#: In place of a piece that ends somewhere: nothing yet, the beginning, bytes of a character without a piece.
NOWHERE, BEGIN, BYTES = -3, -1, -2
#: Places of all units that are relaxed together.
STEPS = 64
#: Bytes of texts that are encoded at once.
SLICE = 2 << 20
#: Units that are joined and learned at once.
LEARN = 50_000


class Vocabulary:
    """Pieces, merge ranks (the higher score merges first) and byte pieces of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.control = {i for i in range(n) if m.is_control(i) or m.is_unknown(i)}
        plain = [i for i in range(n) if not m.is_byte(i) and i not in self.control]
        if any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in plain):
            raise ValueError("a piece has a mark behind another character")
        order = sorted(plain, key=lambda i: (-m.get_score(i), i))
        self.rank = {i: k for k, i in enumerate(order)}
        self.id = {self.pieces[i]: i for i in order}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.known: dict[str, bytes] = {}
        self.fine: dict[str, bytes] = {}
        self.pairs, self.pair_fits = np.array([np.iinfo(np.int64).max]), np.zeros(1, bool)
        self.plain = sorted(order, key=lambda i: self.pieces[i].encode())
        text = [self.pieces[i].encode() for i in self.plain]
        self.length = np.array([len(t) for t in text])
        self.table = np.zeros((len(text), int(self.length.max())), np.uint8)
        for k, t in enumerate(text):
            self.table[k, : len(t)] = np.frombuffer(t, np.uint8)
        of_byte = {i: b for b, i in self.bytes.items()}
        self.byte_table = np.array([self.bytes[b] for b in range(256)], np.int32)
        self.raw = [bytes([of_byte[i]]) if i in of_byte else b"" if i in self.control else self.pieces[i].replace(MARK, " ").encode() for i in range(n)]
        self.splits_finer = all(_FINE.fullmatch(p) for p in self.id)

    def forget(self) -> None:
        """Empty the memory of units; that of pairs, which is small, stays."""
        self.known.clear()
        self.fine.clear()

    # --- merges ---------------------------------------------------------------------------------------------------
    def split(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes a piece, None for one character."""
        if piece not in self.splits:
            parts = [self.id.get(c, -1) for c in self.pieces[piece]]
            while len(parts) > 2:
                best = min(((self.rank[j], k, j) for k in range(len(parts) - 1) if (j := self.merged(parts[k], parts[k + 1])) is not None and j != piece), default=None)
                if best is None:
                    break
                _, k, j = best
                parts[k : k + 2] = [j]
            self.splits[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.splits[piece]

    def merged(self, a: int, b: int) -> int | None:
        return self.id.get(self.pieces[a] + self.pieces[b]) if a >= 0 and b >= 0 else None

    def fits(self, keys: np.ndarray) -> np.ndarray:
        """``compatible`` of each pair ``a << 20 | b``; remembered in arrays, which leave no holes among the short-lived strings."""
        place = np.searchsorted(self.pairs, keys)
        new = np.flatnonzero(self.pairs[np.minimum(place, len(self.pairs) - 1)] != keys)
        if len(new):
            if len(self.pairs) > 1 and len(self.pairs) + len(new) > KNOWN:
                self.pairs, self.pair_fits = self.pairs[-1:], self.pair_fits[-1:]
                return self.fits(keys)
            found = [self._compatible(k >> 20, k & 0xFFFFF) for k in keys[new].tolist()]
            self.pairs = np.insert(self.pairs, place[new], keys[new])
            self.pair_fits = np.insert(self.pair_fits, place[new], found)
            place = np.searchsorted(self.pairs, keys)
        return self.pair_fits[place]

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stand side by side in the encoding of their joined text."""
        return bool(self.fits(np.array([a << 20 | b]))[0])

    def _compatible(self, a: int, b: int) -> bool:
        limit = len(self.rank)  # ranks of merges that come before either side is undone
        while True:
            j = self.merged(a, b)
            if j is not None and self.rank[j] < limit:
                return False
            # undo the later of the two last merges: before it, the border had that side's inner part
            sa, sb = self.split(a), self.split(b)
            ra, rb = self.rank[a] if sa else -1, self.rank[b] if sb else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, sa[1]
            else:
                limit, b = rb + 1, sb[0]

    # --- matching -------------------------------------------------------------------------------------------------
    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece."""
        width = self.table.shape[1]
        sa = suffix_array(data, width)
        n = len(sa)
        low, high = np.zeros(len(self.plain), np.int64), np.full(len(self.plain), n, np.int64)
        live = np.arange(len(self.plain))
        for k in range(width):
            live = live[(self.length[live] > k) & (low[live] < high[live])]
            if not len(live):
                break
            want = self.table[live, k]
            ends = []
            for or_equal in (False, True):
                a, b = low[live].copy(), high[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) // 2
                    at = sa[np.minimum(mid, n - 1)] + k
                    here = np.where(at < n, data[np.minimum(at, n - 1)], 0)
                    go = open_ & ((here <= want) if or_equal else (here < want))
                    a, b = np.where(go, mid + 1, a), np.where(open_ & ~go, mid, b)
                ends.append(a)
            low[live], high[live] = ends
        count = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        at = np.repeat((low - np.r_[0, np.cumsum(count)[:-1]]).astype(np.int32), count)
        at += np.arange(len(at), dtype=np.int32)
        return sa.astype(np.int32)[at], piece

    def learn(self, units: list[str]) -> None:
        """Encode units and remember them: all are relaxed at once, place by place; long ones, which would take many steps, follow."""
        raw = [u.encode() for u in units]
        data = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
        size = np.array([len(r) for r in raw])
        begin = np.r_[0, np.cumsum(size + 1)][:-1]
        start, piece = self.edges(data)
        off = np.minimum(start - np.repeat(begin, size + 1).astype(np.int32)[start], STEPS).astype(np.uint8)
        order = np.argsort(off, kind="stable")
        cut = np.searchsorted(off[order], np.arange(STEPS + 1))
        start, piece = start[order], piece[order]
        del off, order
        ids, end = np.array(self.plain, np.int32)[piece], start + self.length.astype(np.int32)[piece]
        alone = 1 + (data >= 0xC0) + (data >= 0xE0) + (data >= 0xF0).astype(np.int64)
        single = np.zeros(len(data), bool)
        single[start[end - start == alone[start]]] = True
        last = np.full(len(data), NOWHERE)  # the piece that ends at a place; a unit's own end is the separator behind it
        came = np.zeros(len(data), np.int64)
        last[begin] = BEGIN
        steps = int(min(STEPS, size.max(initial=0)))
        unit = np.flatnonzero(size)
        for k in range(steps):
            e = slice(cut[k], cut[k + 1])
            self._relax(start[e], ids[e], end[e], last, came)
            unit = unit[size[unit] > k]
            at = begin[unit] + k
            self._fall_back(at[(last[at] != NOWHERE) & ~single[at]], alone, last, came)
        rest = np.arange(cut[STEPS], len(start))
        rest = rest[np.argsort(start[rest], kind="stable")]
        edge, ends = 0, (start[rest].tolist(), ids[rest].tolist(), end[rest].tolist())
        for u in np.flatnonzero(size > STEPS).tolist():
            for at in range(begin[u] + STEPS, begin[u] + size[u]):
                here = int(last[at])
                while edge < len(rest) and ends[0][edge] == at:
                    i, to = ends[1][edge], ends[2][edge]
                    if here != NOWHERE and last[to] == NOWHERE and (here < 0 or self.compatible(here, i)):
                        last[to], came[to] = i, at
                    edge += 1
                if here != NOWHERE and not single[at] and last[at + alone[at]] == NOWHERE:
                    last[at + alone[at]], came[at + alone[at]] = BYTES, at
        # back from the ends, along the one path of each unit
        on, at = np.zeros(len(data), bool), (begin + size)[size > 0]
        while len(at):
            on[at] = True
            at = came[at]
            at = at[last[at] != BEGIN]
        at = np.flatnonzero(on)
        count = np.where(last[at] == BYTES, at - came[at], 1)
        out = np.repeat(last[at], count).astype(np.int32)
        of = np.repeat(came[at] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(len(out))
        out = np.where(out == BYTES, self.byte_table[data[np.minimum(of, len(data) - 1)]], out)
        places = np.searchsorted(np.repeat(at, count), np.r_[begin, len(data)]).tolist()
        packed = out.astype(np.int32).tobytes()
        for u, a, b in zip(units, places[:-1], places[1:]):
            self.fine[u] = packed[4 * a : 4 * b]

    def _relax(self, start: np.ndarray, ids: np.ndarray, end: np.ndarray, last: np.ndarray, came: np.ndarray) -> None:
        """Follow edges with different ends, where they fit the piece before them."""
        go = np.flatnonzero((last[start] != NOWHERE) & (last[end] == NOWHERE))
        here = last[start[go]]
        inner = here >= 0
        keys, place = np.unique(here[inner] << 20 | ids[go[inner]], return_inverse=True)
        fits = ~inner
        fits[inner] = self.fits(keys)[place]
        go = go[fits]
        last[end[go]], came[end[go]] = ids[go], start[go]

    @staticmethod
    def _fall_back(at: np.ndarray, alone: np.ndarray, last: np.ndarray, came: np.ndarray) -> None:
        """Pass a character without a piece as bytes."""
        to = at + alone[at]
        new = last[to] == NOWHERE
        last[to[new]], came[to[new]] = BYTES, at[new]

    # --- texts ----------------------------------------------------------------------------------------------------
    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.  A mark that the text itself holds is given as bytes, so decoding restores it."""
        parts = []
        for t in texts:
            if MARK in t:
                runs = []
                for k, piece in enumerate(t.split(MARK)):
                    if k:
                        runs.append(OWN_MARK)
                    if piece or not k:
                        runs += _UNIT.findall((MARK if not k else "") + piece.replace(" ", MARK))
                parts.append(runs)
            else:
                parts.append(_UNIT.findall(MARK + t.replace(" ", MARK)) if t else [])
        if len(self.known) > KNOWN:
            self.known.clear()
        if len(self.fine) > KNOWN:
            self.fine.clear()
        self.known[OWN_MARK] = self.byte_table[list(MARK.encode())].tobytes()
        new = set()
        for p in parts:
            new.update(p)
        new -= self.known.keys()
        pieces = {u: _FINE.findall(u) if self.splits_finer else [u] for u in new}
        fine = list({f for p in pieces.values() for f in p}.difference(self.fine))
        for k in range(0, len(fine), LEARN):
            self.learn(fine[k : k + LEARN])
        for u, p in pieces.items():
            self.known[u] = b"".join([self.fine[f] for f in p])
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, p)), np.int32) for p in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; broken bytes become U+FFFD."""
        of = self.raw.__getitem__
        raw = b"".join(map(of, ids))
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


_held: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a process."""
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with about SLICE bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SLICE, "right")))
        yield a, b
        a = b


def encode(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``ids``, ``n_ids`` and ``round_trip`` (decoding gives the text back).

    Null and empty texts have no ids and come back empty.  Repeated rows are encoded each; columns named like the new ones are
    replaced.  ``model``: path of the model file, the same on every machine, or a name that was added with ``addFile``.
    """
    docs = docs.drop("ids", "n_ids", "round_trip")
    names = [c for c in docs.columns if c != text]
    schema = docs.select(*names).withColumns({"ids": F.array().cast("array<int>"), "n_ids": F.lit(0).cast("long"), "round_trip": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model if "/" in model else SparkFiles.get(model))
        try:
            for batch in batches:
                for a, b in _slices(batch.column(text)):
                    part = batch.slice(a, b - a)
                    texts = [t or "" for t in part.column(text).to_pylist()]
                    ids = v.encode(texts)
                    same = [v.decode(i.tolist()) == t for i, t in zip(ids, texts)]
                    n = np.array([len(i) for i in ids], np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists, pa.array(n), pa.array(same, pa.bool_())], [*names, "ids", "n_ids", "round_trip"])
        finally:  # the process lives on and runs other stages
            v.forget()

    return docs.mapInArrow(trimmed(run), schema)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of ``rows`` but the ids, with ``text`` decoded from them; null ids give an empty text."""
    names = [c for c in rows.columns if c not in (ids, text)]
    schema = rows.select(*names).withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model if "/" in model else SparkFiles.get(model))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([v.decode(i or []) for i in batch.column(ids).to_pylist()], pa.string())], [*names, text])

    return rows.mapInArrow(run, schema)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
