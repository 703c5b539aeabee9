"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some token positions and ignore the others, so a seed still
matches when an ignored token was substituted. Test-set seeds are joined with the
seeds of all document positions; each hit names a diagonal, on which the whole item
is compared with the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, row_key, small_batches, without_rows
from .tokens import batch_parts, mix, stream, text_bytes, words

#: A passage counts when SPAN tokens in a row hold at most SUBSTITUTIONS mismatches.
SPAN, SUBSTITUTIONS = 13, 2
#: Positions that each mask compares; for every placing of two mismatches in SPAN tokens, one of them fits between (tests check this).
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 2, 5, 7, 8))
#: Size of the filter that documents' seeds pass before the join, and its greatest number of bits as a power of 2 (32 MB).
BITS_PER_SEED, HASHES, MOST_BITS = 32, 6, 28
#: Bytes of text worked on at a time.
SLICE_BYTES = 4 << 20


def seeds(h: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Seed hashes at every position where the mask fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    keys = stream(1000 + number, len(mask))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for key, o in zip(keys, mask, strict=True):
            out = (out ^ h[o : o + n]) * (key | np.uint64(1))
        return mix(out)


def _positions(h: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed) of all seeds that lie inside one row of at least `least` words."""
    ends = np.repeat(np.where(np.diff(bounds) >= least, bounds[1:], bounds[:-1]), np.diff(bounds))
    at, found = [], []
    for m, mask in enumerate(MASKS):
        s = seeds(h, mask, m)
        inside = np.flatnonzero(np.arange(len(s)) + mask[-1] < ends[: len(s)])
        at.append(inside)
        found.append(s[inside])
    return np.concatenate(at), np.concatenate(found)


def _tokens(batch) -> tuple[np.ndarray, np.ndarray]:
    return words(*text_bytes(batch.column("text"), fold=True), "alnum")


def _cells(h: np.ndarray, bounds: np.ndarray, rows: list[int]) -> pa.Array:
    """The tokens of rows, 8 bytes each."""
    return pa.array([h[bounds[r] : bounds[r + 1]].tobytes() for r in rows], pa.large_binary()).cast(pa.binary())


def _numbers(n: int, at: int) -> np.ndarray:
    """Numbers of a task's rows: unique in the table, and kept by writing it."""
    return (TaskContext.get().partitionId() << 40) + np.arange(at, at + n)


def _items(batches):
    """(iid, item_id, words, tokens, seeds array<struct<seed, place>>) of items that are long enough."""
    at = 0
    for batch in batches:
        h, bounds = _tokens(batch)
        rows = np.flatnonzero(np.diff(bounds) >= SPAN)
        place, seed = _positions(h, bounds, SPAN)
        row = np.searchsorted(bounds, place, "right") - 1
        order = np.argsort(row, kind="stable")
        place, seed, row = place[order], seed[order], row[order]
        cuts = np.append(np.searchsorted(row, rows), len(row)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array((place - bounds[row]).astype(np.int32))], ["seed", "place"])
        columns = [pa.array(_numbers(len(rows), at)), batch.column("item_id").take(pa.array(rows)), pa.array(np.diff(bounds)[rows].astype(np.int32)), _cells(h, bounds, rows.tolist()), pa.ListArray.from_arrays(pa.array(cuts), pairs)]
        at += len(rows)
        yield pa.RecordBatch.from_arrays(columns, ["iid", "item_id", "words", "tokens", "seeds"])


def mark(s: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of seeds in a filter of 2 ** bits bits."""
    with np.errstate(over="ignore"):
        return (mix(s + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def _marked(bits: int):
    def run(batches):
        for batch in batches:
            own = np.asarray(batch.column("seed")).view(np.uint64)
            at = np.unique(np.concatenate([mark(own, k, bits) for k in range(HASHES)]))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    return run


def seed_filter(index: DataFrame) -> tuple[int, bytes]:
    """(bits, content) of a Bloom filter of all seeds; its size follows their number, up to 2 ** MOST_BITS bits."""
    bits = min(MOST_BITS, max(16, (BITS_PER_SEED * index.count()).bit_length()))
    rows = index.select("seed").mapInArrow(_marked(bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    content = np.zeros(1 << (bits - 6), np.uint64)
    content[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return bits, content.tobytes()


def passing(s: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Which seeds pass the filter: all of the index, and few others."""
    live = np.arange(len(s))
    for k in range(HASHES):
        at = mark(s[live], k, bits)
        live = live[(bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return live


def _suspects(shared, bits: int):
    """(uid, doc_id, words, tokens, hits array<struct<seed, position>>) of rows that have a seed which passes the filter."""

    def run(batches):
        bitmap, count = np.frombuffer(shared.value["content"], np.uint64), 0
        for batch in batches:
            for part in batch_parts(batch, "text", SLICE_BYTES):
                h, bounds = _tokens(part)
                at, seed = _positions(h, bounds, SPAN)
                live = passing(seed, bitmap, bits)
                at, seed = at[live], seed[live]
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                row = np.searchsorted(bounds, at, "right") - 1
                rows = np.unique(row)
                cuts = np.append(np.searchsorted(row, rows), len(row)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array((at - bounds[row]).astype(np.int32))], ["seed", "position"])
                columns = [pa.array(_numbers(len(rows), count)), part.column("doc_id").take(pa.array(rows)), pa.array(np.diff(bounds)[rows].astype(np.int32)), _cells(h, bounds, rows.tolist()), pa.ListArray.from_arrays(pa.array(cuts), pairs)]
                count += len(rows)
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "words", "tokens", "hits"])

    return run


def overlap(same: np.ndarray) -> tuple[int, int]:
    """Of equality along one diagonal: (item tokens inside spans that count, matches among them)."""
    if len(same) < SPAN:
        return 0, 0
    sums = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(sums[SPAN:] - sums[:-SPAN] >= SPAN - SUBSTITUTIONS)
    edge = np.zeros(len(same) + 1, np.int64)
    np.add.at(edge, good, 1)
    np.add.at(edge, good + SPAN, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return int(covered.sum()), int((covered & same).sum())


def _verify(batches):
    for batch in (part for batch in batches for part in batch_parts(batch, "mine", SLICE_BYTES)):
        pairs = zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist(), strict=True)
        got = [overlap(np.frombuffer(x, np.uint64) == np.frombuffer(y, np.uint64)) for x, y in pairs]
        keep = pa.array([i for i, x in enumerate(got) if x[0]], pa.int64())
        columns = [batch.column(x).take(keep) for x in ("uid", "iid", "doc_id", "item_id")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in got if x], pa.int64()), pa.array([y for x, y in got if x], pa.int64())], ["uid", "iid", "doc_id", "item_id", "n_covered", "n_matched"])


def contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_covered, n_matched): pairs of a document and a test item that it holds a passage of.

    Words are runs of letters, digits and non-ASCII characters in lower case. A
    passage is SPAN words of the item that stand in the document in the same order
    and distance with at most SUBSTITUTIONS other words between; the masks miss
    none. n_covered counts the item's words inside such passages on the best
    diagonal, n_matched the equal ones. Items of fewer than SPAN words, null and
    empty texts match nothing. Rows that repeat an id or a text report each, and so
    do items; further columns are not read; empty tables give an empty result.

    Documents are read once, whatever the size of the test set: a Bloom filter of
    its seeds picks the rows that go into the join, and only they move. All tables
    that are joined are written, so Spark broadcasts one only where its true size is
    below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "leaks")
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()
    own = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    test = tests.select("item_id", F.col("text").cast("string").alias("text"))
    items = work.table(test.mapInArrow(_items, f"iid long, item_id {item_type}, words int, tokens binary, seeds array<struct<seed: long, place: int>>"), "items")
    index = work.table(items.select("iid", F.col("words").alias("m"), F.inline("seeds")), "index")
    bits, content = seed_filter(index)
    shared = spark.sparkContext.broadcast({"content": content})
    suspects = own.mapInArrow(_suspects(shared, bits), f"uid long, doc_id {id_type}, words int, tokens binary, hits array<struct<seed: long, position: int>>")
    suspects = work.table(suspects, "suspects")
    hits = work.table(suspects.select("uid", F.col("words").alias("n"), F.inline("hits")), "hits")

    # A hit names a diagonal; on it, words a to b of the item meet words a + shift to b + shift of the document.
    lines = hits.join(index, "seed").select("uid", "iid", "n", "m", (F.col("position") - F.col("place")).alias("shift")).distinct()
    lines = lines.select("uid", "iid", F.greatest(F.lit(0), -F.col("shift")).alias("a"), F.least("m", F.col("n") - F.col("shift")).alias("b"), "shift")
    lines = work.table(lines.where(F.col("b") - F.col("a") >= SPAN), "diagonals")
    cut = lambda start: F.substring("tokens", 8 * start + 1, 8 * (F.col("b") - F.col("a")))
    mine = lines.join(suspects.select("uid", "doc_id", "tokens"), "uid").select("uid", "doc_id", "iid", "a", "b", cut(F.col("a") + F.col("shift")).alias("mine"))
    both = work.table(mine, "windows").join(items.select("iid", "item_id", "tokens"), "iid").select("uid", "iid", "doc_id", "item_id", "mine", cut(F.col("a")).alias("theirs"))
    found = both.mapInArrow(_verify, f"uid long, iid long, doc_id {id_type}, item_id {item_type}, n_covered long, n_matched long")
    best = found.groupBy("uid", "iid").agg(F.max_by(F.struct("doc_id", "item_id", "n_covered", "n_matched"), F.struct("n_covered", "n_matched")).alias("best"))
    return best.select("best.*")


def drop_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no passage of any test item; columns unchanged.

    Rows are told apart by id and text, so a clean row stays where another of its id
    goes, and rows alike in both stay or go together. Null and empty texts stay.
    Column names are free; empty tables drop nothing.
    """
    rows = docs.select(row_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    return without_rows(docs, contaminated(rows, tests).select("doc_id"), id_col, text_col)
