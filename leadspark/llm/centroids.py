"""Centroid clustering in exact integers, by dictionaries of distinct subvectors.

Vectors are cut into blocks of a few dimensions. Once, each segment of vectors is
encoded: per block a dictionary of the distinct subvectors and per vector a code.
In a round, only the entries of the dictionaries are compared with the centroids;
the distance of a vector is the sum of what its codes stand for. Segments are rows
of a written table, as long as one task can hold, so nothing that grows with the
data is broadcast or gathered; only the centroids are, whose number is a parameter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Dimensions of a block.
BLOCK = 2
#: Vectors of a segment at most; codes have 16 bits.
SEGMENT = 32_768
#: Components reach this far at most, so that squared distances of 64 dimensions stay below 2**63.
LIMIT = 1 << 27


def encode(vectors: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, list[np.ndarray]]:
    """(codes, dictionaries): for each block of columns its distinct subvectors and, a column of codes each, which of them a vector has."""
    codes, words = [], []
    for at in range(0, vectors.shape[1], block):
        part = vectors[:, at : at + block]
        # Dimension by dimension, pairs of what was distinct so far and the next value are numbered anew.
        code = np.zeros(len(part), np.int64)
        for column in part.T:
            values, number = np.unique(column, return_inverse=True)
            _, first, code = np.unique(code * len(values) + number, return_index=True, return_inverse=True)
        words.append(part[first])
        codes.append(code.astype(np.uint16))
    return np.stack(codes), words


def distances(codes: np.ndarray, words: list[np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids: each dictionary is compared once, then partial distances are summed by code."""
    total, at = np.zeros((codes.shape[1], len(centroids)), np.int64), 0
    for code, part in zip(codes, words, strict=True):
        own = centroids[:, at : at + part.shape[1]]
        partial = np.zeros((len(part), len(centroids)), np.int64)
        for d in range(part.shape[1]):
            partial += (part[:, d, None] - own[None, :, d]) ** 2
        total += partial[code]
        at += part.shape[1]
    return total


def decode(codes: np.ndarray, words: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The vectors of some rows, as they were."""
    return np.concatenate([part[code[rows]] for code, part in zip(codes, words, strict=True)], axis=1)


SEGMENTS = "ids array<{id}>, codes binary, sizes array<int>, words binary"


def _encode(block: int, segment: int):
    def pack(ids, vectors):
        codes, words = encode(vectors, block)
        columns = [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([codes.tobytes()], pa.binary()),
            pa.array([[len(w) for w in words]], pa.list_(pa.int32())),
            pa.array([b"".join(np.ascontiguousarray(w, np.int32).tobytes() for w in words)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["ids", "codes", "sizes", "words"])

    def run(batches):
        ids, vectors, held = [], [], 0
        for batch in batches:
            own = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            at = 0
            while at < batch.num_rows:
                n = min(segment - held, batch.num_rows - at)
                ids.append(batch.column("vec_id").slice(at, n))
                vectors.append(own[at : at + n])
                held, at = held + n, at + n
                if held == segment:
                    yield pack(pa.concat_arrays(ids), np.concatenate(vectors))
                    ids, vectors, held = [], [], 0
        if held:
            yield pack(pa.concat_arrays(ids), np.concatenate(vectors))

    return run


def _segments(batch, block: int, dims: int):
    """(ids, codes, dictionaries) of each segment of a batch."""
    for i in range(batch.num_rows):
        sizes, buffer, words, at = batch.column("sizes")[i].as_py(), batch.column("words")[i].as_buffer(), [], 0
        for k, n in enumerate(sizes):
            width = min(block, dims - k * block)
            words.append(np.frombuffer(buffer, np.int32, n * width, at).reshape(n, width).astype(np.int64))
            at += 4 * n * width
        codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint16).reshape(len(sizes), -1)
        yield batch.column("ids")[i].values, codes, words


def _sums(centroids: list[list[int]], block: int):
    """Per segment and cluster: the number of its vectors (dim -1) and the sum of each component."""
    dims = len(centroids[0])

    def run(batches):
        at = np.array(centroids, np.int64)
        for batch in batches:
            for _, codes, words in _segments(batch, block, dims):
                best = distances(codes, words, at).argmin(1)
                order = np.argsort(best, kind="stable")
                present, starts, n = np.unique(best[order], return_index=True, return_counts=True)
                sums = np.concatenate([np.add.reduceat(part[code[order]], starts, axis=0) for code, part in zip(codes, words, strict=True)], axis=1)
                rows = np.concatenate([n[:, None], sums], axis=1)
                columns = [pa.array(np.repeat(present, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dims, dtype=np.int32), len(present))), pa.array(rows.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["cluster", "dim", "total"])

    return run


def _nearest(centroids: list[list[int]], block: int):
    dims = len(centroids[0])

    def run(batches):
        at = np.array(centroids, np.int64)
        for batch in batches:
            for ids, codes, words in _segments(batch, block, dims):
                far = distances(codes, words, at)
                best = far.argmin(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(far[np.arange(len(best)), best])], ["vec_id", "cluster", "distance"])

    return run


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of exactly `dims` components, none null or not finite, as integers floor(scale * x)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = own.where((F.size("v") == dims) & F.forall("v", finite))

    def whole(x: Column) -> Column:
        n = F.floor(x * scale)
        far = F.raise_error(F.lit(f"a component times {scale} exceeds {LIMIT}: squared distances would not fit 64 bits"))
        return F.when(F.abs(x * scale) <= LIMIT, n).otherwise(far.cast("long"))

    return kept.select("vec_id", F.transform("v", whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of seed and id, in that order; ids that repeat follow their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r.v for r in vectors.select(key.alias("o"), "v").orderBy("o", "v").limit(k).collect()]


def centroid_clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """One row per whole vector: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors of another length, and those with null or non-finite components, have no
    row. Components become floor(scale * x). Centroids start as the k vectors whose
    ids hash lowest (all, if there are fewer); in each round every vector goes to the
    nearest one (ties: the smaller number), and each centroid that has vectors moves
    to the floor of their exact mean. Distances are squared, exact and of 64 bits; a
    component beyond LIMIT raises. Null ids hash as the empty id; rows that repeat are
    vectors of their own; further columns are not read; an empty table gives none.

    The driver holds k centroids and gathers (dims + 1) sums for each.
    """
    work = Scratch(table.sparkSession, "centroids")
    vectors = whole_vectors(table, id_col, vector_col, dims, scale)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        empty = vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.select("*", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    segments = work.table(vectors.mapInArrow(_encode(block, min(segment, 1 << 16)), SEGMENTS.format(id=id_type)), "segments")
    for _ in range(rounds):
        sums = segments.mapInArrow(_sums(centroids, block), "cluster int, dim int, total long")
        totals = {(r.cluster, r.dim): int(r.total) for r in sums.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
        centroids = [[totals[c, d] // totals[c, -1] for d in range(dims)] if (c, -1) in totals else old for c, old in enumerate(centroids)]
    nearest = work.table(segments.mapInArrow(_nearest(centroids, block), f"vec_id {id_type}, cluster int, distance long"), "nearest")
    inertia = {r.cluster: r.far for r in nearest.groupBy("cluster").agg(F.sum("distance").alias("far")).collect()}
    work.done(segments)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    # One row for each centroid, so the broadcast is of at most k rows.
    known = table.sparkSession.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), h) for c, h in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return nearest.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
