"""Fill-in-the-middle: documents cut at line ends, which summaries of content-defined chunks locate.

A rolling hash cuts every text into chunks whose borders depend on nearby bytes
alone, so texts that share a passage share its chunks. A chunk is summed up once
(line ends, code points, marks, border bytes) and remembered; when a chunk of the
same checksum and content comes again, its summary is taken from memory. Sums over
the summaries of a document give its number of lines and the one chunk that holds
a cut; only that chunk is looked into.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import OrderedDict
from itertools import accumulate, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import stream, text_bytes

#: What marks the parts of an output; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes that the rolling hash looks back on: those that fit its 32 bits.
WINDOW = 32
#: A border falls where this many upper bits of the hash are 0: chunks of 2 KB on average.
ZEROS = 11
#: Bytes of a chunk at least (but for a text's last) and at most.
LEAST, MOST = 256, 16_384
#: Bytes of chunks that a task remembers; the least recently met go first.
REMEMBERED = 32 << 20
#: Bytes hashed at a time, and bytes of output in one batch.
STEP_BYTES, OUT_BYTES = 1 << 20, 64 << 20
GEAR = (stream(23, 256) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last WINDOW bytes at every byte, by doubling: a hash of 2m bytes is two of m, one of them shifted."""
    h, m = GEAR[data], 1
    while m < WINDOW:
        h[m:] += h[:-m] << np.uint32(m)
        m *= 2
    return h


def candidates(data: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: places behind bytes where the hash has ZEROS leading zeros."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(data), STEP_BYTES):
        back = min(at, WINDOW - 1)
        h = rolling(data[at - back : at + STEP_BYTES])[back:]
        found.append(np.flatnonzero(h >> np.uint32(32 - ZEROS) == 0) + at + 1)
    return np.concatenate(found)


def borders(ends: np.ndarray, start: int, stop: int) -> list[int]:
    """Chunk ends of the text at start..stop: candidates at least LEAST bytes apart, further ones where a chunk would exceed MOST.

    The first candidate lies at least LEAST >= WINDOW bytes behind the start, so
    bytes before the text have no say in its chunks.
    """
    out, last = [], start
    while stop - last > LEAST:
        i = int(np.searchsorted(ends, last + LEAST))
        end = int(ends[i]) if i < len(ends) else stop
        last = min(end, last + MOST, stop)
        out.append(last)
    if last < stop:
        out.append(stop)
    return out


class Summary(NamedTuple):
    """Line ends, code points begun, whether a mark is inside, and the bytes at both borders, where a mark may be cut in two."""

    lines: int
    points: int
    marked: bool
    head: bytes
    tail: bytes


def points(chunk: bytes) -> int:
    """Code points that begin in a piece of UTF-8, which may be cut anywhere."""
    return len(chunk) if chunk.isascii() else int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80))


def summary(chunk: bytes) -> Summary:
    return Summary(chunk.count(b"\n"), points(chunk), any(m in chunk for m in MARKS), chunk[:2], chunk[-2:])


class Memory:
    """Summaries of chunks already met, each beside its content: a checksum finds, the content decides."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.size, self.shared = most, 0, 0
        self.known: OrderedDict[tuple[int, int], tuple[bytes, Summary]] = OrderedDict()

    def of(self, chunk: bytes) -> Summary:
        key = zlib.crc32(chunk), len(chunk)
        held = self.known.get(key)
        if held is not None:
            if held[0] == chunk:
                self.shared += 1
                self.known.move_to_end(key)
                return held[1]
            return summary(chunk)  # a collision: the first comer keeps the place
        made = summary(chunk)
        self.known[key] = chunk, made
        self.size += len(chunk)
        while self.size > self.most:
            self.size -= len(self.known.popitem(last=False)[1][0])
        return made


class Text:
    """One text as chunks and running sums of their summaries."""

    def __init__(self, text: bytes, ends: list[int], memory: Memory):
        self.text, self.ends = text, ends
        parts = [memory.of(text[a:b]) for a, b in pairwise([0, *ends])]
        self.lines = [0, *accumulate(p.lines for p in parts)]
        self.points = [0, *accumulate(p.points for p in parts)]
        self.marked = any(p.marked for p in parts) or any(m in a.tail + b.head for a, b in pairwise(parts) for m in MARKS)
        self.n = self.lines[-1] + (not text.endswith(b"\n") if text else 0)

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first `units` lines."""
        if units == 0:
            return 0, 0
        if units > self.lines[-1]:  # the last line has no end of its own
            return len(self.text), self.points[-1]
        k = bisect_left(self.lines, units) - 1
        start = self.ends[k - 1] if k else 0
        chunk = self.text[start : self.ends[k]]
        at = int(np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10)[units - self.lines[k] - 1]) + 1
        return start + at, self.points[k] + points(chunk[:at])


def _cut(rate: int, spm: int):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def batch_of(rows):
        ids, n, form, before, middle, out = zip(*rows, strict=True)
        columns = [pa.concat_arrays(ids), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        memory = Memory()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            found = candidates(data)
            ids, marks = batch.column("doc_id"), [batch.column(f"h{i}").to_pylist() for i in range(1, 5)]
            rows, held = [], 0
            for i, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = found[np.searchsorted(found, start) : np.searchsorted(found, stop, "right")]
                text = data[start:stop].tobytes()
                doc = Text(text, [e - start for e in borders(own, start, stop)], memory)
                h1, h2, h3, h4 = (m[i] for m in marks)
                if not text or doc.marked or h3 % 100 >= rate:
                    row = ("plain", None, None, text)
                else:
                    low, high = sorted((h1 % (doc.n + 1), h2 % (doc.n + 1)))
                    (a, chars), (b, upto) = doc.cut(low), doc.cut(high)
                    if h4 % 100 < spm:
                        form, parts = "spm", (SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])
                    else:
                        form, parts = "psm", (PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])
                    row = (form, chars, upto - chars, b"".join(parts))
                rows.append((ids.slice(i, 1), doc.n, *row))
                held += len(row[-1])
                if held > OUT_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per row of docs: (doc_id, n, form, prefix_chars, middle_chars, output).

    n counts the lines of the text, each with its end (a last one may have none).
    Prefix and middle end after numbers of lines drawn from a SHA-256 of the seed
    and the id, so the result does not depend on partitions. `rate` percent of the
    rows are cut, `spm` percent of these put the suffix first. Texts that are empty
    or hold a mark stay plain, with null lengths. A null text counts as empty, a null
    id as the empty id; rows that repeat an id and text come out alike, each of them;
    a text without line ends is one line. Further columns are not read; an empty
    table gives an empty result. A task holds one Arrow batch and REMEMBERED bytes
    of chunks; which chunks it remembers never changes a result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = own.withColumn("digest", digest)
    numbers = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    schema = f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    return drawn.select("doc_id", "text", *numbers).mapInArrow(_cut(rate, spm), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts, found by their marks, in their first order."""
    parts = F.split(output, "|".join(m.decode() for m in MARKS), -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
