"""Token hashes of Arrow text columns, in numpy over the UTF-8 bytes themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Hashes are polynomials modulo a prime, at two places; modulo a power of two, words with much symmetry would collide at any place.
PRIME = U((1 << 31) - 1)
_AT = (1_220_703_125, 630_360_016)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes that are worked on at once; one longer text makes a larger block.
BLOCK = 1 << 20

SPACE, DIGIT, UPPER, LOWER, PUNCT = 0, 1, 2, 3, 4
#: Class of each byte; all bytes of characters beyond ASCII count as lower-case letters.
CLASS = np.full(256, PUNCT, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[ord("A") : ord("Z") + 1] = UPPER
CLASS[ord("a") : ord("z") + 1] = LOWER
CLASS[128:] = LOWER
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

_powers: list[list[np.ndarray]] = [[np.ones(1, U)] * 2 for _ in _AT]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME, up to one PRIME more."""
    x = (x & PRIME) + (x >> U(31))
    return (x & PRIME) + (x >> U(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    done, step = 1, base
    while done < n:  # the second half is the first times a power
        k = min(done, n - done)
        out[done : done + k] = out[:k] * U(step) % PRIME
        step, done = step * step % int(PRIME), done + k
    return out


def _upto(n: int) -> list[list[np.ndarray]]:
    """Powers of each place and of its inverse, n of them at least."""
    if len(_powers[0][0]) < n:
        n = max(n, BLOCK + 1)
        _powers[:] = [[_powers_of(base, n), _powers_of(pow(base, -1, int(PRIME)), n)] for base in _AT]
    return _powers


class Hasher:
    """62-bit hashes, spread over 64, of any spans of ``data``; equal bytes have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        self.parts = []
        one = data.astype(U) + U(1)
        for up, down in _upto(len(data) + 1):
            v = one * up[: len(data)]  # below 2**39: the sums of a block fit
            if len(data) > 1 << 24:
                v = _folded(v)
            sums = np.zeros(len(data) + 1, U)
            np.cumsum(v, out=sums[1:])
            self.parts.append((sums, down))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a, b = (_folded(_folded(sums[ends] - sums[starts]) % PRIME * down[starts]) % PRIME for sums, down in self.parts)
        return mix((a << U(31) | b) + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def text_blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about BLOCK bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def token_spans(data: np.ndarray, offsets: np.ndarray, words: bool = True, punct: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets) of the tokens of a block; they never cross rows.

    ``words``: runs without white space; else runs of bytes of one class (digits, capitals, other letters,
    punctuation, which ``punct=False`` leaves out).
    """
    kind = CLASS[data]
    if words:
        kind = (kind != SPACE).astype(np.uint8)
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] != SPACE
    if not punct:
        real &= kind[starts] != PUNCT
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(starts, offsets)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each item, from row offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
