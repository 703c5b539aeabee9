"""Training-order materialisation: token sequences in fixed-stride shards, in a keyed random order.

Every sequence gets a global number (documents in the order of a hash of their ids,
counted over hash buckets), a keyed Feistel permutation with cycle-walking turns
numbers into slots, and the shard and byte offset of a slot follow by division.
Readers start at any slot and go on from where they stopped.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, kept
from .tokens import mix, text_bytes
from .warc import place

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
STRIDE = 128
PER_SHARD = 65_536
ROUNDS = 6
#: Bytes of text worked on at a time (a longer part goes alone), and the longest parts that are compared.
STEP, LONG = 8 << 20, 4096
#: Buckets of id hashes that are counted to number documents.
BUCKETS = 4096
#: Shards that one task writes at most, and tasks below which it writes fewer.
SHARDS_PER_TASK, TASKS = 8, 512
#: Spaces that may belong to a longer run of white space; such texts are not cut at spaces.
RUNS = re.compile(r"\s \s|\s \Z")
ASCII_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
#: The first n bytes of a little-endian word.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
STEP_KEY = 0x9E3779B97F4A7C15


class Encoder:
    """Token ids of whole batches of texts. Parts start at spaces; of equal parts of a step one is encoded, all in one call."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
        self.width = np.zeros(max(pairs.values()) + 1, np.int64)
        self.width[list(pairs.values())] = [len(x) for x in pairs]

    def _plain(self, part: np.ndarray) -> np.ndarray:
        return self.bpe.encode_to_numpy(part.tobytes().decode(), disallowed_special=()).astype(np.uint16)

    def kinds(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts, and where each part's ids begin and how many it has."""
        # A part that begins with one space and then something else is cut off from any part before it.
        joins = (e - s > 1) & (data[s] == 32) & ~space_at(data, np.minimum(s + 1, len(data) - 1))
        cells, size = [np.zeros(0, np.uint16)], np.zeros(len(s), np.int64)
        if joins.any():
            n = (e - s)[joins]
            joined, ends = data[np.repeat(s[joins], n) + _within(n)], np.cumsum(n)
            cells[0] = self._plain(joined)
            reached = np.cumsum(self.width[cells[0]])
            last = np.searchsorted(reached, ends)
            if np.array_equal(reached[np.minimum(last, len(reached) - 1)], ends):
                size[joins] = np.diff(last + 1, prepend=0)
            else:
                cells, joins = [np.zeros(0, np.uint16)], np.zeros(len(s), bool)
        alone = np.flatnonzero(~joins)
        cells += [self._plain(data[s[i] : e[i]]) for i in alone.tolist()]
        size[alone] = [len(x) for x in cells[1:]]
        order = np.concatenate((np.flatnonzero(joins), alone))
        begin = np.empty(len(s), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(cells), begin, size

    def steps(self, data: np.ndarray, offsets: np.ndarray, wanted: bool = True):
        """(starts of parts, number of tokens of each, their ids where wanted) for the bytes of all rows, a step at a time."""
        starts = part_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        at = 0
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP, "right")))
            a, b = starts[at], ends[end - 1]
            own, s, e = data[a:b], starts[at:end] - a, ends[at:end] - a
            which, first = same_parts(own, s, e)
            ids, begin, size = self.kinds(own, s[first], e[first])
            counts = size[which]
            if wanted:
                ids = ids[np.repeat(begin[which], counts) + _within(counts)]
            yield s + a, counts, ids
            at = end

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and where each row's ids begin (rows + 1 entries)."""
        starts, counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
        for s, n, x in self.steps(data, offsets):
            starts.append(s)
            counts.append(n)
            ids.append(x)
        begin = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        return np.concatenate(ids), begin[np.searchsorted(np.concatenate(starts), offsets)]

    def sizes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each row."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for s, n, _ in self.steps(data, offsets, wanted=False):
            out += np.bincount(np.searchsorted(offsets, s, "right") - 1, n, len(out)).astype(np.int64)
        return out


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def space_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space may begin at these bytes (true for every white space, and for a few other characters)."""
    a, b = data[at], data[np.minimum(at + 1, len(data) - 1)]
    return ASCII_SPACE[a] | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts begin: at rows and at spaces, except inside rows with runs of white space that the pattern takes together."""
    if not len(data):
        return np.zeros(0, np.int64)
    first = data == 32
    blank = np.flatnonzero(first)
    before = data[np.maximum(blank - 1, 0)]
    doubtful = ASCII_SPACE[before]
    wide = np.flatnonzero(before >= 128)
    doubtful[wide] = space_at(data, np.maximum(blank[wide] - 2, 0)) | space_at(data, np.maximum(blank[wide] - 3, 0))
    blank = blank[doubtful]
    row = np.searchsorted(offsets, blank, "right") - 1
    last = blank + 1 >= offsets[row + 1]
    for r in np.unique(row[last | space_at(data, np.minimum(blank + 1, len(data) - 1))]).tolist():
        a, b = offsets[r], offsets[r + 1]
        if RUNS.search(data[a:b].tobytes().decode()):
            first[a:b] = False
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


def _chunks(padded: bytes, s: np.ndarray, e: np.ndarray):
    """(parts, 8 bytes of each) from the front on, until no part is left; bytes beyond a part's end are 0."""
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    live = np.arange(len(s))
    while len(live):
        left = e[live] - s[live]
        yield live, words[s[live]] & MASKS[np.minimum(left, 8)]
        live = live[left > 8]
        s = s + 8


def same_parts(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the number of its kind, and for each kind its first part; equality is of bytes. Parts above LONG bytes are their own kind."""
    each = np.arange(len(s))
    padded = data.tobytes() + b"\0" * 8
    short = e - s <= LONG
    ends = np.where(short, e, s)
    keys = (e - s).astype(np.uint64) + np.where(short, 0, (each + 1) << 32).astype(np.uint64)
    rounds = list(_chunks(padded, s, ends))
    with np.errstate(over="ignore"):
        for live, word in rounds:
            keys[live] = mix(keys[live] * np.uint64(STEP_KEY) + word)
    # Sorted by their high bits with the part's number in the low ones, which is fast; kinds that share the bits are told apart below.
    low = np.uint64((1 << len(s).bit_length()) - 1)
    for known in (_kinds((keys & ~low) | each.astype(np.uint64), low), None):
        if known is None:
            _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        else:
            which, first = known
        one = first[which]
        if np.array_equal((ends - s)[one], ends - s) and all(_agree(live, word, one) for live, word in rounds):
            return which, first
    return each, each


def _agree(live: np.ndarray, word: np.ndarray, one: np.ndarray) -> bool:
    """Whether all live parts have the bytes of their kind's first part, which is as long and so live too."""
    all_words = np.empty(len(one), np.uint64)
    all_words[live] = word
    return np.array_equal(all_words[one[live]], word)


def _kinds(packed: np.ndarray, low: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """For numbers whose high bits say the kind and low bits the part: each part's kind, and each kind's first part."""
    packed = np.sort(packed)
    part, high = (packed & low).astype(np.int64), packed & ~low
    new = np.ones(len(packed), bool)
    new[1:] = high[1:] != high[:-1]
    which = np.empty(len(packed), np.int64)
    which[part] = np.cumsum(new) - 1
    return which, part[new]


def feistel(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1, applied to numbers: keyed rounds over the next even power of two, walked until inside."""
    half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)

    def once(x):
        left, right = x >> half, x & low
        with np.errstate(over="ignore"):
            for r in range(ROUNDS):
                left, right = right, left ^ (mix(right + np.uint64((key * ROUNDS + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & low)
        return (left << half) | right

    out = once(numbers.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _closed(ids: np.ndarray, begin: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids with END_OF_TEXT after every row that has text."""
    return np.insert(ids, begin[1:][full], END_OF_TEXT), begin + np.concatenate(([0], np.cumsum(full)))


def _sums(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Checksums of all rows."""
    return [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _count(ranks, stride: int):
    def run(batches):
        part, at, encoder = TaskContext.get().partitionId(), 0, kept(ranks, "encoder", Encoder)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            n = -(-(encoder.sizes(data, offsets) + (np.diff(offsets) > 0)) // stride)
            rows = np.arange(at, at + len(n))
            at += len(n)
            columns = [pa.array(np.full(len(n), part, np.int32)), pa.array(rows), batch.column("doc_id"), pa.array(n), pa.array(_sums(data, offsets), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "row", "doc_id", "n", "crc"])

    return run


def _numbered(counts: DataFrame) -> tuple[DataFrame, int]:
    """counts(part, row, doc_id, n, crc) with the number of each row's first sequence, and the number of all.

    Numbers follow a hash of the ids, then the ids and the texts' checksums, so they
    do not depend on partitions; rows alike in all of these have the same text.
    """
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = counts.withColumn("h", order).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    sizes = own.groupBy("bucket").agg(F.sum("n").alias("size")).collect()  # BUCKETS rows at most
    starts, total = [], 0
    for bucket, size in sorted(sizes):
        starts.append((bucket, total))
        total += size
    before = F.broadcast(counts.sparkSession.createDataFrame(starts, "bucket int, start long"))
    inside = Window.partitionBy("bucket").orderBy("h", "doc_id", "crc", "part", "row").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return own.join(before, "bucket").select("part", "row", "n", "crc", number.alias("number")), total


SEQUENCES = "doc_id {}, seq_no int, n_tokens int, slot long, shard int, tokens binary"


def _emit(ranks, stride: int, per_shard: int, starts: str, n: int, key: int):
    def run(batches):
        part, at, width = TaskContext.get().partitionId(), 0, 2 * stride
        store, folder = place(f"{starts}/part={part}")
        files = [x.path for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.path.endswith(".parquet")]
        own = pa.concat_tables([pq.ParquetFile(store.open_input_file(x)).read() for x in files]).sort_by("row") if files else None
        encoder = kept(ranks, "encoder", Encoder)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            crc = _sums(data, offsets)
            rows = np.arange(at, at + batch.num_rows)
            mine = own.slice(at, batch.num_rows) if own else None
            at += batch.num_rows
            if batch.num_rows and (mine is None or mine.num_rows < len(rows) or not np.array_equal(mine["row"], rows) or mine["crc"].to_pylist() != crc):
                raise RuntimeError(f"partition {part} has other rows than when sequences were counted")
            if not batch.num_rows:
                continue
            ids, begin = _closed(*encoder.encode(data, offsets), np.diff(offsets) > 0)
            size = np.diff(begin)
            count = -(-size // stride)
            total = int(count.sum())
            row = np.repeat(np.arange(len(count)), count)
            seq = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            n_tokens = np.minimum(stride, size[row] - seq * stride)
            cells = np.zeros((total, stride), "<u2")
            cells[np.arange(stride) < n_tokens[:, None]] = ids
            slots = feistel(np.asarray(mine["number"])[row] + seq, n, key) if total else np.zeros(0, np.int64)
            packed = pa.Array.from_buffers(pa.binary(width), total, [None, pa.py_buffer(cells)]).cast(pa.binary())
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(seq.astype(np.int32)), pa.array(n_tokens.astype(np.int32)), pa.array(slots), pa.array((slots // per_shard).astype(np.int32)), packed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "seq_no", "n_tokens", "slot", "shard", "tokens"])
        if own is not None and own.num_rows != at:
            raise RuntimeError(f"partition {part} has other rows than when sequences were counted")

    return run


def _pinned(df: DataFrame) -> DataFrame:
    """df over partitions that are laid out once, so that plans made from it later have the same, whatever executors there are by then."""
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), df.sparkSession)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _write(folder: str, stride: int, per_shard: int):
    def run(batches):
        store, path = place(folder)
        store.create_dir(path)
        shard, out, part = None, None, None

        def close():
            if out is not None:
                out.close()
                store.move(part, f"{path}/{shard_name(shard)}")

        for batch in batches:
            shards, slots = np.asarray(batch.column("shard")), np.asarray(batch.column("slot"))
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            cells = batch.column("tokens").to_pylist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    close()
                    shard = int(shards[a])
                    # A repeated task writes the same bytes under another name and moves them into place.
                    part = f"{path}/.{shard_name(shard)}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(part, compression=None)
                out.write(b"".join(cells[a:b]))
            sums = pa.array([zlib.crc32(x) for x in cells], pa.int64())
            offsets = pa.array((slots % per_shard) * 2 * stride, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in ("slot", "doc_id", "seq_no", "n_tokens", "shard")], offsets, sums], ["slot", "doc_id", "seq_no", "n_tokens", "shard", "byte_offset", "tokens_crc32"])
        close()

    return run


def materialise(docs: DataFrame, folder: str, key: int = 1, stride: int = STRIDE, per_shard: int = PER_SHARD, ranks_path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards below folder and returns (slot, doc_id, seq_no, n_tokens, shard, byte_offset, tokens_crc32) per sequence.

    Texts are encoded whole, closed by END_OF_TEXT, and cut every `stride` tokens;
    the last sequence of a text is filled with zeros. Tokens are 16-bit little
    endian. Numbers follow a hash of the ids, so slots depend on ids, texts and key
    alone, whatever files, partitions and executors there are; they run from 0
    without gaps. Texts are encoded twice, once to count and once to write, which
    spares a stored copy. Partitions are laid out once for both readings, and a
    partition whose rows differ between the two fails: docs should be a table on
    disk. Null and empty texts give no sequence; rows that repeat an id or a text
    have sequences of their own; a null id counts as the empty key; further columns
    are not read; an empty table writes nothing.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "token-rows")
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast({"content": f.read()})
    id_type = docs.schema[id_col].dataType.simpleString()
    own = _pinned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    counts = work.table(own.mapInArrow(_count(ranks, stride), f"part int, row long, doc_id {id_type}, n long, crc long"), "counts")
    numbered, n = _numbered(counts)
    starts = work.path("starts")
    # A file for each partition of docs: its task reads what it needs and nothing else.
    numbered.repartition("part").write.partitionBy("part").parquet(starts)
    shards = max(1, -(-n // per_shard))
    rows = own.mapInArrow(_emit(ranks, stride, per_shard, starts, n, key), SEQUENCES.format(id_type))
    # Ranges of slots are known, so rows go straight to the task that writes their shard.
    each = min(SHARDS_PER_TASK, max(1, shards // TASKS))
    rows = rows.repartitionById(-(-shards // each), (F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
    out = rows.mapInArrow(_write(folder, stride, per_shard), f"slot long, doc_id {id_type}, seq_no int, n_tokens int, shard int, byte_offset long, tokens_crc32 long")
    written = work.table(out, "rows")
    if (found := written.count()) != n:
        raise RuntimeError(f"{found} sequences were written, {n} were counted")
    return written


def read_from(folder: str, slot: int, stride: int = STRIDE, per_shard: int = PER_SHARD):
    """Token arrays from a slot on, in slot order, one shard file after another."""
    store, path = place(folder)
    shard, inside = divmod(slot, per_shard)
    while store.get_file_info(f"{path}/{shard_name(shard)}").type.name == "File":
        with store.open_input_file(f"{path}/{shard_name(shard)}") as f:
            f.seek(inside * 2 * stride)
            while cell := f.read(2 * stride):
                yield np.frombuffer(cell, "<u2")
        shard, inside = shard + 1, 0


def token_shards(docs: DataFrame) -> DataFrame:
    """materialise() into a new folder of the shared checkpoint folder."""
    return materialise(docs, Scratch(docs.sparkSession, "tokens").path("shards"))
