"""Word hashing over Arrow text columns, a whole batch at a time in numpy.

Words are hashed to 64 bits with a polynomial over byte values, taken from
prefix sums, so the cost per byte is a few vector operations and no Python
string is made. Work arrays cover about 256 KB of text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
#: Bytes of a column that batch_parts() puts into a part.
PART = 4 << 20
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (the splitmix64 constants)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values for a seed."""
    with np.errstate(over="ignore"):
        return mix(U(seed) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


STEP = 0x9E3779B97F4A7C15 | 5
BYTE = stream(11, 256)
_powers = {"n": 0, "up": np.zeros(0, U), "down": np.zeros(0, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and its inverses modulo 2**64."""
    if _powers["n"] < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", STEP), ("down", pow(STEP, -1, 1 << 64))):
                factors = np.full(n, U(base), U)
                factors[0] = 1
                _powers[name] = np.multiply.accumulate(factors)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
SPACE = np.isin(_codes, [0x20, 9, 10, 11, 12, 13])
_alnum = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
BREAK = {"space": SPACE, "alnum": ~_alnum}


def text_bytes(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if fold:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_slices(offsets: np.ndarray, size: int):
    """Ranges of rows of about `size` bytes, one row at least."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end
        at = end


def batch_parts(batch: pa.RecordBatch, name: str, size: int = PART):
    """A batch in parts of about `size` bytes of a text or binary column, one row at least: what a task holds and hands on then follows the part, since Spark's batches have up to 64 MB."""
    lengths = pc.binary_length(batch.column(name)).fill_null(0)
    for a, b in row_slices(np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64)))), size):
        yield batch.slice(a, b - a)


def _slices(data: np.ndarray, starts: np.ndarray, breaks: np.ndarray):
    """Ranges of about SLICE bytes that cut no word."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE)
        while end < n:
            k = np.searchsorted(starts, end, "right") - 1
            if starts[k] > at:
                end = int(starts[k])
                break
            cut = np.flatnonzero(breaks[data[at + 1 : end]])
            if len(cut):
                end = at + 1 + int(cut[-1])
                break
            end = min(n, end + SLICE)
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, how: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words begin (rows + 1 entries).

    how: "space" lower-cases A-Z and breaks at ASCII white space; "alnum" also
    breaks at every ASCII character that is neither letter nor digit.
    """
    breaks = BREAK[how]
    hashes, begins = [], []
    with np.errstate(over="ignore"):
        for a, b in _slices(data, offsets[:-1], breaks):
            part = LOWER[data[a:b]]
            inside = ~breaks[part]
            edge = np.zeros(b - a + 1, bool)
            edge[[0, -1]] = True
            lo, hi = np.searchsorted(offsets, [a, b])
            edge[offsets[lo : hi + 1][offsets[lo : hi + 1] <= b] - a] = True
            first = inside.copy()
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | edge[1:-1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            up, down = powers(SLICE if b - a <= SLICE else b - a)
            sums = np.zeros(b - a + 1, U)
            np.cumsum(BYTE[part] * up[: b - a], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U)))
            begins.append(s + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    at = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return h, np.searchsorted(at, offsets)


def shingles(h: np.ndarray, bounds: np.ndarray, width: int):
    """For each row, the sorted distinct hashes of its word windows; a shorter row is one window."""
    keys = stream(100 + width, width)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - width + 1)
        all_windows = np.zeros(n, U)
        for i in range(width):
            all_windows += mix(h[i : i + n] + keys[i])  * keys[width - 1 - i]
        all_windows = mix(all_windows)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                own = np.sort(all_windows[a : b - width + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
            elif b > a:
                tail = U(b - a)
                for x in h[a:b]:
                    tail = mix(np.array([tail * U(31) + x], U))[0]
                yield np.array([tail], U)
            else:
                yield np.zeros(0, U)
