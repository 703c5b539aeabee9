"""SentencePiece segmentation sampled from the piece lattice, and its lossless inverse.

A word's lattice has a node per byte boundary and an edge per piece of a public
vocabulary. Forward filtering sums the weight of all segmentations up to each
node; backward sampling draws the last piece, then the one before, and so on, each
in proportion to the weight that leads there. A piece that holds a space is a run of
spaces or begins with its only space, and none holds a newline, so lattices end
before every run of spaces and around newlines, and whole batches of words are
filtered and sampled together in numpy. A word of more than LONGEST bytes (text
without spaces) also ends where two characters meet that meet in no piece: every
segmentation has an end there, so its parts can be drawn apart. What is longer even
so is filtered and sampled alone, block by block, over its whole length. Draws come
from a hash of the row's key, the word's number and the step, so a row is segmented
alike wherever it runs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept, small_batches
from .tokens import BYTE, batch_parts, mix, powers, text_bytes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Weight of a piece is exp(SHARPNESS * score); scores of this vocabulary are negated merge ranks.
SHARPNESS = 1 / 1500
#: Scores from here down say that a piece has no rank.
UNRANKED = -1e8
#: Log-weight of a byte that no piece need cover.
BYTE_WEIGHT = -40.0
#: Words longer than this many bytes are parted where no piece crosses; parts longer than it are sampled one at a time, BLOCK positions at a time.
LONGEST = 128
BLOCK = 1 << 16
#: Bytes of text worked on at a time.
SLICE = 4 << 20


class Vocabulary:
    """Pieces as bytes, with a space for the word mark."""

    def __init__(self, content: bytes, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = model.get_piece_size()
        self.pieces = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        names, ids, weights = [], [], []
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value] = i
                self.pieces[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[i] = model.id_to_piece(i).replace("▁", " ").encode()
                # What lattices begin at must cut no piece.
                if b"\n" in self.pieces[i] or (self.pieces[i].strip(b" ") and b" " in self.pieces[i][1:]):
                    raise ValueError(f"piece {i} holds a space or newline inside")
                names.append(self.pieces[i])
                ids.append(i)
                weights.append(model.get_score(i))
        # Runs of spaces have no rank of their own (UNRANKED); scores fall by 1 from piece to piece, and so do theirs.
        ranked = [(i, w) for i, w in zip(ids, weights, strict=True) if w > UNRANKED]
        top = max((i + w for i, w in ranked), default=0)
        weights = [sharpness * (w if w > UNRANKED else top - i) for i, w in zip(ids, weights, strict=True)]
        keys = np.concatenate([span_hash(np.frombuffer(x, np.uint8)[None, :]) for x in names])
        order = np.argsort(keys)
        self.keys, self.ids, self.weights = keys[order], np.append(np.array(ids, np.int32)[order], 0), np.append(np.array(weights, np.float32)[order], np.float32(-np.inf))
        self.may = np.zeros(1 << 20, bool)
        self.may[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.meets = np.zeros(1 << 20, bool)
        for name in names:
            self.meets[pair_places(name.decode())] = True
        self.longest = max(map(len, names))
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in self.pieces])))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys in self.keys, -1 where they are no piece."""
        out = np.full(len(keys), -1, np.int32)
        some = np.flatnonzero(self.may[(keys >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        hit = self.keys[at] == keys[some]
        out[some[hit]] = at[hit]
        return out


def pair_places(text: str) -> np.ndarray:
    """Places in a table of 2**20 for each two neighbouring characters of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (mix((points[:-1] << np.uint64(32)) + points[1:]) >> np.uint64(44)).astype(np.int64)


def parts(word: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Where a word's parts begin, but for the first: between characters that no piece holds side by side. Bytes that are no UTF-8 are left whole."""
    try:
        text = word.tobytes().decode()
    except UnicodeDecodeError:
        return np.zeros(0, np.int64)
    begins = np.flatnonzero((word & 0xC0) != 0x80)[1:]
    return begins[~v.meets[pair_places(text)]]


def scaled(cells: np.ndarray) -> np.ndarray:
    """Byte values times the power of their column."""
    with np.errstate(over="ignore"):
        return BYTE[cells] * powers(LONGEST + 64)[0][: cells.shape[1]]


def span_hash(cells: np.ndarray) -> np.ndarray:
    """Hashes of byte rows of one length."""
    with np.errstate(over="ignore"):
        return mix(scaled(cells).sum(1, dtype=np.uint64) + np.uint64(cells.shape[1]))


def vocabulary(sharpness: float):
    """For kept(): the vocabulary of a model file's content."""
    return lambda content: Vocabulary(content, sharpness)


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where lattices begin: rows, runs of spaces, and around newlines."""
    first = data == 32
    first[1:] &= data[:-1] != 32
    first |= data == 10
    first[1:] |= data[:-1] == 10
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.flatnonzero(first)


def _edges(word: np.ndarray, a: int, b: int, v: Vocabulary):
    """(end, length, weight, id) of all edges of a word that end after positions a..b-1, by end and length."""
    begin = max(0, a + 1 - v.longest)
    own = np.zeros(b - begin + 1, np.uint64)
    np.cumsum(BYTE[word[begin:b]] * powers(BLOCK + v.longest + 64)[0][: b - begin], out=own[1:])
    back = powers(BLOCK + v.longest + 64)[1]
    ends, lengths, places = [], [], []
    with np.errstate(over="ignore"):
        for m in range(1, min(v.longest, b) + 1):
            e = np.arange(max(a + 1, m), b + 1) - begin
            at = v.find(mix((own[e] - own[e - m]) * back[e - m] + np.uint64(m)))
            hit = np.flatnonzero(at >= 0) if m > 1 else np.arange(len(e))
            ends.append(e[hit] + begin)
            lengths.append(np.full(len(hit), m))
            places.append(at[hit])
    end, length, at = np.concatenate(ends), np.concatenate(lengths), np.concatenate(places)
    order = np.lexsort((length, end))
    end, length, at = end[order], length[order], at[order]
    weight = np.where(at >= 0, v.weights[at].astype(np.float64), BYTE_WEIGHT)
    return end, length, weight, np.where(at >= 0, v.ids[at], v.byte_id[word[end - 1]])


def _sums(alpha: list, at: list, length: list, weight: list) -> list:
    """Log-weights of the positions that follow those in alpha, from each one's edges at[i]:at[i + 1]; logarithms are added up one by one."""
    exp, log, out = math.exp, math.log, alpha[:]
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        e = len(out)
        logs = [weight[k] + out[e - length[k]] for k in range(lo, hi)]
        top = max(logs)
        out.append(top + log(sum([exp(x - top) for x in logs])))
    return out[len(alpha) :]


def _fast_sums(alpha: list, at: list, length: list, weight: list) -> list | None:
    """_sums() over plain weights, scaled anew where they get small or large; None where their range is beyond that of a number."""
    log, shift, reach = math.log, alpha[-1], max(length)
    factors = np.exp(weight).tolist()
    with np.errstate(over="ignore"):
        near = np.exp(np.array(alpha) - shift).tolist()
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        e, x = len(near), 0.0
        for k in range(lo, hi):
            x += factors[k] * near[e - length[k]]
        if not 0.0 < x < math.inf:
            return None
        out.append(log(x) + shift)
        near.append(x)
        if not 1e-200 < x < 1e200:
            near[-reach:] = [y / x for y in near[-reach:]]
            shift = out[-1]
    return out


def sample_long(word: np.ndarray, seed: np.uint64, v: Vocabulary) -> np.ndarray:
    """Ids of one word, sampled as by lattice(): a last piece is drawn for every position, block by block, and those that lead to the end stay."""
    n = len(word)
    alpha, back, last = [0.0], np.empty(n + 1, np.int32), np.empty(n + 1, np.int32)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        end, length, weight, ids = _edges(word, a, b, v)
        at = np.searchsorted(end, np.arange(a + 1, b + 2))
        plain = at.tolist(), length.tolist(), weight.tolist()
        got = _fast_sums(alpha, *plain) or _sums(alpha, *plain)
        known = np.array(alpha + got)  # begins at position a + 1 - len(alpha)
        logs = weight + known[end - length - (a + 1 - len(alpha))]
        count = np.diff(at)
        share = np.cumsum(np.exp(logs - np.repeat(np.maximum.reduceat(logs, at[:-1]), count)))
        before = np.concatenate(([0.0], share))[at[:-1]]
        with np.errstate(over="ignore"):
            draw = (mix(seed + np.arange(a + 1, b + 1).astype(np.uint64)) >> np.uint64(40)).astype(np.float64) / (1 << 24)
        goal = before + draw * (share[at[1:] - 1] - before)
        pick = at[:-1] + np.minimum(np.add.reduceat((share <= np.repeat(goal, count)).astype(np.int64), at[:-1]), count - 1)
        back[a + 1 : b + 1], last[a + 1 : b + 1] = length[pick], ids[pick]
        alpha = known[-v.longest :].tolist()
    ends, e = [], n
    while e > 0:
        ends.append(e)
        e -= int(back[e])
    return last[np.array(ends[::-1])]


def lattice(cells: np.ndarray, v: Vocabulary):
    """For byte rows (words) of one length: chances (words, end, length) of the last piece given an end, cumulated, and piece ids."""
    k, n = cells.shape
    longest = min(n, v.longest)
    alpha = np.zeros((k, n + 1), np.float32)
    chance = np.zeros((k, n + 1, longest), np.float32)
    ids = np.zeros((k, n + 1, longest), np.int32)
    own = np.zeros((k, n + 1), np.uint64)
    np.cumsum(scaled(cells), 1, out=own[:, 1:])
    scale = powers(LONGEST + 64)[1]
    for e in range(1, n + 1):
        m = min(e, longest)
        begin = slice(e - m, e)
        with np.errstate(over="ignore"):
            keys = mix((own[:, e, None] - own[:, begin]) * scale[begin] + np.arange(m, 0, -1).astype(np.uint64))
        at = v.find(keys[:, ::-1].ravel()).reshape(k, m)
        weight = v.weights[at]  # the last entry stands for no piece
        ids[:, e, :m] = v.ids[at]
        alone = at[:, 0] < 0
        if alone.any():
            weight[alone, 0] = BYTE_WEIGHT
            ids[alone, e, 0] = v.byte_id[cells[alone, e - 1]]
        weight += alpha[:, begin][:, ::-1]
        top = weight.max(1)
        weight -= top[:, None]
        share = np.cumsum(np.exp(weight, out=weight), 1)
        total = share[:, -1]
        alpha[:, e] = top + np.log(total)
        chance[:, e, :m] = share / total[:, None]
        chance[:, e, m - 1 :] = 1.1
    return chance, ids


def sample(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows in order, and where each row's ids begin. keys: a 64-bit seed for each row."""
    s = word_starts(data, bounds)
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    n = np.diff(np.append(s, len(data)))
    long = np.flatnonzero(n > LONGEST)
    if len(long):
        s = np.sort(np.concatenate([s, *[s[w] + parts(data[s[w] : s[w] + n[w]], v) for w in long]]))
        n = np.diff(np.append(s, len(data)))
    row = np.searchsorted(bounds, s, "right") - 1
    number = np.arange(len(s)) - np.searchsorted(s, bounds[row])
    with np.errstate(over="ignore"):
        seeds = mix(keys[row] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    found_word, found_step, found_id = [], [], []
    for w in np.flatnonzero(n > LONGEST):
        got = sample_long(data[s[w] : s[w] + n[w]], seeds[w], v)[::-1]
        found_word.append(np.full(len(got), w))
        found_step.append(np.arange(len(got)))
        found_id.append(got)
    for length in np.unique(n[n <= LONGEST]):
        here = np.flatnonzero(n == length)
        cells = data[s[here][:, None] + np.arange(length)]
        _, first, which = np.unique(span_hash(cells), return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], np.arange(len(first) + 1))
        chunk = max(1, 2_000_000 // (int(length) * min(int(length), v.longest)))
        for c in range(0, len(first), chunk):
            chance, ids = lattice(cells[first[c : c + chunk]], v)
            mine = order[ends[c] : ends[min(c + chunk, len(first))]]
            word, u = here[mine], which[mine] - c
            e = np.full(len(word), length)
            step = 0
            while len(word):
                with np.errstate(over="ignore"):
                    draw = (mix(seeds[word] + np.uint64(step)) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
                pick = (chance[u, e] <= draw[:, None]).sum(1)
                found_word.append(word)
                found_step.append(np.full(len(word), step))
                found_id.append(ids[u, e, pick])
                e = e - pick - 1
                left = e > 0
                word, u, e, step = word[left], u[left], e[left], step + 1
    word, step, got = np.concatenate(found_word), np.concatenate(found_step), np.concatenate(found_id)
    count = np.bincount(word, minlength=len(s))
    begin = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(len(got), np.int32)
    out[begin[word] + count[word] - 1 - step] = got
    return out, begin[np.searchsorted(s, bounds)]


def decode(ids: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and where each row's bytes begin."""
    lengths = (v.at[1:] - v.at[:-1])[ids]
    begin = np.concatenate(([0], np.cumsum(lengths)))
    where = np.arange(begin[-1]) + np.repeat(v.at[ids] - begin[:-1], lengths)
    return v.flat[where], begin[bounds]


def _marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before every row that has bytes, as the vocabulary's own encoder puts it."""
    some = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][some], 32), offsets + np.concatenate(([0], np.cumsum(some)))


def _segment(content, sharpness: float, digest: bool):
    def run(batches):
        v = kept(content, f"vocabulary {sharpness}", vocabulary(sharpness))
        for batch in (part for batch in batches for part in batch_parts(batch, "text", SLICE)):
            with_marks, marked_at = _marked(*text_bytes(batch.column("text")))
            ids, begin = sample(with_marks, marked_at, np.asarray(batch.column("key")).view(np.uint64), v)
            first = [batch.column("doc_id"), pa.array(np.diff(begin), pa.int64())]
            if digest:
                shas, same = [], []
                back, back_at = decode(ids, begin, v)
                for k in range(len(batch)):
                    shas.append(hashlib.sha256(ids[begin[k] : begin[k + 1]].astype("<u4").tobytes()).hexdigest())
                    same.append(np.array_equal(back[back_at[k] : back_at[k + 1]], with_marks[marked_at[k] : marked_at[k + 1]]))
                yield pa.RecordBatch.from_arrays([*first, pa.array(shas, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_sha256", "lossless"])
            else:
                yield pa.RecordBatch.from_arrays([*first, pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))], ["doc_id", "n_pieces", "ids"])

    return run


def sampled_pieces(docs: DataFrame, digest: bool = False, seed: int = 1, sharpness: float = SHARPNESS, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_pieces, ids), or with digest (doc_id, n_pieces, ids_sha256, lossless).

    ids is a segmentation of the whole text drawn from the piece lattice, seeded by
    the id and `seed`: the same id, text and seed give the same ids on any cluster.
    ids_sha256 is taken of the ids as little-endian 32-bit numbers; lossless says
    whether decoding gave the text back, byte for byte. Characters outside the
    vocabulary, and the vocabulary's own space mark, go by bytes. Null and empty
    texts have no pieces. Every piece of the vocabulary can be drawn, in words of any
    length.
    Rows that repeat an id and a text are segmented alike; a null id counts as the
    empty key; further columns are not read; an empty table gives an empty result.
    """
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast({"content": f.read()})
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed))
    own = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("key"))
    id_type = docs.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, lossless boolean" if digest else "ids array<int>"
    return own.mapInArrow(_segment(content, sharpness, digest), f"doc_id {id_type}, n_pieces long, {rest}")


def _texts(content, sharpness: float):
    def run(batches):
        v = kept(content, f"vocabulary {sharpness}", vocabulary(sharpness))
        for batch in batches:
            column = batch.column("ids")
            ids = np.asarray(column.flatten()).astype(np.int64)
            lengths = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            back, at = decode(ids, np.concatenate(([0], np.cumsum(lengths))), v)
            texts = [back[a + 1 : b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decoded_texts(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows(doc_id, ids): the inverse of sampled_pieces.

    Null and empty ids give an empty text. Rows that repeat an id are decoded each;
    further columns are not read; an empty table gives an empty result.
    """
    with open(path, "rb") as f:
        content = rows.sparkSession.sparkContext.broadcast({"content": f.read()})
    return small_batches(rows).select("doc_id", "ids").mapInArrow(_texts(content, SHARPNESS), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
