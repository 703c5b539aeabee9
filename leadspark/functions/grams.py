"""Keys under which a text and every string that it holds meet, so that containment begins as an equi-join.

A string's key is a hash of its first bytes, as many as the largest of SIZES that it
has; a text has the hash of every window of the same size, and so has the key of each
string in it. A filter of the strings' keys, made first, holds back the other keys of
the texts, so a text is handed on under few keys beside those of strings that begin as
one of its windows does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a window, each for strings of at least so many; longest first. Long strings may begin alike, so the steps are small there.
SIZES = (256, 128, 64, 56, 48, 32, 16, 8, 4, 2, 1)
#: Bytes keyed at a time (a longer text goes alone), few enough for a core's cache.
STEP = 1 << 17
#: Of the filter of the strings' keys: bits for each key, most bits (as a power of two, 32 MB), marks for each key.
KEY_BITS, MOST_BITS, MARKS = 32, 28, 6
U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


FACTORS = _mix(np.arange(1, MARKS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def size_of(length: int) -> int:
    """The place in SIZES for a string of so many bytes; len(SIZES) for the empty one."""
    return next((i for i, k in enumerate(SIZES) if length >= k), len(SIZES))


def window_hashes(data: np.ndarray, sizes: list[int]):
    """(size, hashes): for each of these sizes the hashes of all windows of data, shorter windows first."""
    h, span, factor = None, 1, 0x9E3779B97F4A7C15
    for size in sorted(sizes, reverse=True):
        k = SIZES[size]
        if len(data) < k:
            return
        h = _mix(data.astype(U) + U(1)) if h is None else h
        while 2 * span <= k:
            h, span, factor = h[:-span] * U(factor) + h[span:], span * 2, factor * factor % (1 << 64)
        yield size, h if span == k else h[: span - k] * U(factor) + h[k - span :]  # else two windows that overlap


def window_keys(data: np.ndarray, bounds: np.ndarray, sizes: list[int], seeds: np.ndarray, passes) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct window keys of each row of data that pass, each row's mixed with its seed."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    if len(SIZES) in sizes:  # the empty string is in all
        live = passes(seeds)
        rows.append(live)
        keys.append(seeds[live])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    seed = seeds[row]
    for size, h in window_hashes(data, [s for s in sizes if s < len(SIZES)]):
        key = h ^ seed[: len(h)]
        live = passes(key)
        live = live[live + SIZES[size] <= bounds[1:][row[live]]]
        rows.append(row[live])
        keys.append(key[live])
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[new], key[new].view(np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mark(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of keys in a filter of 2 ** bits bits."""
    return ((keys * FACTORS[k]) >> U(64 - bits)).view(np.int64)


def marked(bits: int):
    """For mapInArrow over (key): the words of a filter of 2 ** bits bits that these keys set, as (word, value)."""

    def run(batches):
        for batch in batches:
            own = np.asarray(batch.column("key")).view(U)
            at = np.unique(np.concatenate([mark(own, k, bits) for k in range(MARKS)]))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), first) if len(at) else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    return run


def passing(keys: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Which keys pass the filter: all that were marked, and few others."""
    live = np.arange(len(keys))
    for k in range(MARKS):
        at = mark(keys if k == 0 else keys[live], k, bits)
        live = live[(bitmap[at >> 6] >> (at & 63).view(U)) & U(1) == 1]
    return live


def _seeds(batch: pa.RecordBatch) -> np.ndarray:
    return _mix(np.asarray(batch.column("seed")).view(U))


def keyed_texts(sizes: list[int], shared, bits: int):
    """For mapInArrow over (..., text, seed): the rows of which a key in these sizes passes the filter, with keys, the list of those.

    A key is mixed with the row's seed, so rows of different seeds do not meet.
    """

    def run(batches):
        bitmap = np.frombuffer(shared.value, U)
        for batch in batches:
            batch = batch.filter(batch.column("text").is_valid())  # here and not in the plan, which would make the text twice
            (data, offsets), seeds = _bytes(batch.column("text")), _seeds(batch)
            names, at = [x for x in batch.schema.names if x != "seed"], 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, "right")) - 1)
                row, key = window_keys(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], sizes, seeds[at:end], lambda key: passing(key, bitmap, bits))
                rows, first = np.unique(row, return_index=True)
                if len(rows):
                    keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(key))
                    taken = pa.array(rows + at, pa.int64())
                    yield pa.RecordBatch.from_arrays([*[batch.column(x).take(taken) for x in names], keys], [*names, "keys"])
                at = end

    return run


def keyed_strings(batches):
    """For mapInArrow over (..., needle, seed): all columns but the seed, size and key, one row for each string."""
    for batch in batches:
        data, offsets = _bytes(batch.column("needle"))
        size = np.array([size_of(int(x)) for x in np.diff(offsets)], np.int32)
        key = np.zeros(len(size), U)
        for s, k in enumerate(SIZES):
            own = np.flatnonzero(size == s)
            if len(own):
                firsts = data[(offsets[own][:, None] + np.arange(k)).ravel()]
                key[own] = next(window_hashes(firsts, [s]))[1][::k]
        names = [x for x in batch.schema.names if x != "seed"]
        yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(size), pa.array((key ^ _seeds(batch)).view(np.int64))], [*names, "size", "key"])
