"""N-gram Jaccard join: T-occurrence search over shingle sets with DivideSkip.

Rows with the same shingle set collapse to one class first, so copies never
meet each other again. A class can only have a partner if enough of its smallest
shingle hashes occur elsewhere; the rest leaves early. Survivors that share a
token of their prefixes (rare tokens first) form candidate groups by way of
star edges, which are linear in the tokens. A group too large for one task is
searched token list by token list, or in pairs of blocks, whichever moves less.
Within a search group an inverted index is searched by DivideSkip: short lists
are merged, long ones are probed by binary search, and documents that reach the
required overlap are linked.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .components import components
from .scratch import Scratch, row_key, small_batches, without_rows
from .tokens import batch_parts, mix, shingles, text_bytes, words

#: Tokens are ordered by the number of classes that have them; beyond this number by its power of two.
COMMON = 128
#: Documents in one search group; larger candidate groups are searched by token lists or in pairs of blocks.
BLOCK = 1024
#: Shingles of a block, and of the groups packed together, on average.
BLOCK_SHINGLES = 1 << 20
#: Looking up a token of a set in a long list costs as much as counting so many entries of the list.
PROBE = 100
#: Documents that are packed into one search group when candidate groups are small.
PACK = 1024


def least_overlap(n: int, percent: int) -> int:
    """Shared tokens that a set of n needs with any partner."""
    return -(-percent * n // 100)


def head_length(n: int, percent: int) -> int:
    """Smallest hashes that are kept of a set of n: half as many again as its prefix."""
    return min(n, (n - least_overlap(n, percent) + 1) * 3 // 2 + 8)


def _signatures(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that name a set."""
    return mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def _longs(values: list) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sketches(width: int, percent: int):
    def run(batches):
        for batch in (part for batch in batches for part in batch_parts(batch, "text")):
            h, bounds = words(*text_bytes(batch.column("text")))
            ns, names, heads = [], [], []
            with np.errstate(over="ignore"):
                for s in shingles(h, bounds, width):
                    ns.append(len(s))
                    names.append(_signatures(s))
                    heads.append(s[: head_length(len(s), percent)])
            flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            at = np.concatenate(([0], np.cumsum([len(x) for x in heads]))).astype(np.int32)
            columns = [batch.column("doc_id"), pa.array(ns, pa.int64()), _longs([x for x, _ in names]), _longs([y for _, y in names])]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], ["doc_id", "n", "s1", "s2", "head"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in (part for batch in batches for part in batch_parts(batch, "text")):
            h, bounds = words(*text_bytes(batch.column("text")))
            with np.errstate(over="ignore"):
                own = [(*_signatures(s), len(s), s.tobytes()) for s in shingles(h, bounds, width)]
            yield pa.RecordBatch.from_arrays([_longs([x[0] for x in own]), _longs([x[1] for x in own]), pa.array([x[2] for x in own], pa.int64()), pa.array([x[3] for x in own], pa.binary())], ["s1", "s2", "n", "tokens"])

    return run


def _explode_tokens(batches):
    for batch in (part for batch in batches for part in batch_parts(batch, "tokens")):
        counts = np.asarray(batch.column("n"))
        flat = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("c")), counts)), pa.array(np.repeat(counts, counts)), pa.array(flat)], ["c", "n", "h"])


def _merge(lists: list[np.ndarray], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur in at least `least` of the sorted lists, with their counts."""
    if sum(map(len, lists)) <= 512:
        found = [(x, c) for x, c in ((x, sum(1 for _ in g)) for x, g in groupby(heapq.merge(*(x.tolist() for x in lists)))) if c >= least]
        return np.array([x for x, _ in found], np.int64), np.array([c for _, c in found], np.int64)
    counts = np.bincount(np.concatenate(lists), minlength=k)  # the same merge, by counting
    ids = np.flatnonzero(counts >= max(1, least))
    return ids, counts[ids]


def link_group(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the index of another (or itself) so that the components of these links are those of all pairs that reach the similarity.
    """
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    root = np.arange(k)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    flat = np.concatenate([sets[i] for i in order]) if k else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(k), sizes[order])  # rank in the order of size
    _, token = np.unique(flat, return_inverse=True)
    by = np.argsort(token, kind="stable")  # lists one after another, each in the order of size
    posting, list_of = owner[by], token[by]
    lists_at = np.concatenate(([0], np.cumsum(np.bincount(token)))) if len(token) else np.zeros(1, np.int64)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by)) - lists_at[list_of]
    keys = list_of.astype(np.int64) * k + posting
    rows_at = np.concatenate(([0], np.cumsum(sizes[order])))
    ranked = sizes[order]
    for x in range(1, k):
        own, before = token[rows_at[x] : rows_at[x + 1]], rank[rows_at[x] : rows_at[x + 1]]
        own, before = own[before > 0], before[before > 0]
        n = int(ranked[x])
        need = least_overlap(n, percent)
        if len(own) < need:
            continue
        by_length = np.argsort(before, kind="stable")
        own, before = own[by_length], before[by_length]
        longest = int(before[-1])
        aside = min(need - 1, int(need / (0.0085 * math.log2(longest + 1) + 1)))
        cut = len(own) - aside
        candidates, counts = _merge([posting[lists_at[t] : lists_at[t] + c] for t, c in zip(own[:cut], before[:cut], strict=True)], k, need - aside)
        fits = ranked[candidates] * 100 >= percent * n
        candidates, counts = candidates[fits], counts[fits]
        best = np.argsort(-counts, kind="stable")
        candidates, counts = candidates[best], counts[best]
        at, step = 0, 4
        mine = find(order[x])
        far = None  # how many of the long lists each set is in
        while at < len(candidates):
            some, have = candidates[at : at + step], counts[at : at + step]
            at, step = at + step, min(step * 4, max(4, 1_000_000 // (aside + 1)))
            other = np.array([find(order[c]) != mine for c in some])
            some, have = some[other], have[other]
            if not len(some):
                continue
            if aside and far is None and len(some) * aside * PROBE > before[cut:].sum():
                far = np.bincount(np.concatenate([posting[lists_at[t] : lists_at[t] + c] for t, c in zip(own[cut:], before[cut:], strict=True)]), minlength=k)
            if far is not None:
                have = have + far[some]
            elif aside:
                probe = (own[cut:, None].astype(np.int64) * k + some[None, :]).ravel()
                hit = keys[np.minimum(np.searchsorted(keys, probe), len(keys) - 1)] == probe
                have = have + hit.reshape(aside, len(some)).sum(0)
            for c in some[(100 + percent) * have >= percent * (n + ranked[some])]:
                a, mine = find(order[c]), find(order[x])
                if a != mine:
                    root[max(a, mine)] = min(a, mine)
                    mine = min(a, mine)
    return np.array([find(i) for i in range(k)], np.int64)


def _search(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["c"].to_numpy()
        to = link_group([np.frombuffer(x, np.uint64) for x in pdf["tokens"]], percent)
        return pd.DataFrame({"a": names, "b": names[to]})[lambda x: x.a != x.b]

    return run


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id).

    Texts are lower-cased (A-Z), split at ASCII white space, and turned into sets
    of distinct `width`-word shingles; a text with fewer words is one shingle.
    Two rows link when 100 * intersection >= percent * union. component_id is the
    smallest id reachable by links, a row's own id included. Null, empty and blank
    texts have no shingles and no links. Rows that repeat an id or a text are all
    kept and belong together when their texts link. Ids may be of any type that has
    an order. Rows with a null id link only through an equal text. Further columns are not read. An empty table gives an
    empty result.
    """
    work = Scratch(docs.sparkSession, "ngram")
    id_type = docs.schema[id_col].dataType.simpleString()
    own = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = work.table(own.mapInArrow(_sketches(width, percent), f"doc_id {id_type}, n long, s1 long, s2 long, head array<long>"), "sketches")
    # One class per set (128 bits and a size); c numbers it from here on, as written.
    name = ["s1", "s2", "n"]
    classes = rows.where("n > 0").groupBy(name).agg(F.min("doc_id").alias("rid"), F.first("head").alias("head"))
    classes = work.table(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    # Of the smaller head of two partners, at most (size - least overlap) tokens lack in the other.
    least = lambda n: f"(({percent} * {n} + 99) div 100)"
    posts = classes.select("c", F.expr(least("n")).alias("t"), F.explode("head").alias("h"))
    shared = work.table(posts.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    need = F.expr(f"least({least('t')}, (t - {least('t')} + 1) div 2 + 9)")
    alive = posts.join(shared.select("h").hint("merge"), "h", "left_semi").groupBy("c", "t").agg(F.count("*").alias("m")).where(F.col("m") >= need)
    alive = work.table(classes.join(alive.select("c").hint("merge"), "c", "left_semi").select("rid", "c", *name), "survivors")
    texts = own.join(alive.select(F.col("rid").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(width), "s1 long, s2 long, n long, tokens binary").groupBy(name).agg(F.first("tokens").alias("tokens"))
    sets = work.table(sets.join(alive.hint("merge"), name).select("c", "n", "tokens"), "sets")

    # Prefixes: the rarest tokens of all survivors first, so that strangers, who share common ones, seldom meet. A token
    # of one class meets nobody and goes before the shuffle; counted from the common end, the ranks of the others stay.
    tokens = sets.mapInArrow(_explode_tokens, "c long, n long, h long")
    counts = work.table(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    work.done(shared)
    rarity = F.when(F.col("df") <= COMMON, F.col("df")).otherwise(COMMON + F.floor(F.log2("df")))
    common_first = Window.partitionBy("c").orderBy(rarity.desc(), F.desc("h"))
    prefix = tokens.join(counts.hint("merge"), "h").withColumn("k", F.row_number().over(common_first)).where(F.expr(f"k >= {least('n')}"))
    # Sizes of partners differ by less than one band, so they share one of two. A set stands in each band as a
    # node of its own, which keeps candidate groups from growing along chains of sizes.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / (percent - 1))).cast("int")
    node = F.xxhash64("c", "band")
    banded = lambda x, *also: x.select("c", "n", *also, band.alias("own"), F.explode(F.array(band, band + 1)).alias("band"))
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    prefix = work.table(banded(prefix, "h"), "prefixes")
    # One list of sets per token and band. Tokens of near copies have the same list, which counts once.
    marks = [F.bit_xor(F.xxhash64(node, F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    # Two sets of one band meet in it; in the next one only sets of both bands have to.
    lists = prefix.groupBy("h", "band").agg(F.min(node).alias("star"), F.count("*").alias("k"), size.alias("m"), F.sum("n").alias("load"), F.max("own").alias("own"), *marks)
    lists = lists.where("k > 1 and own = band").groupBy("star", "k", "x1", "x2").agg(F.min_by(F.struct("h", "band", "m", "load"), "h").alias("l"))
    lists = work.table(lists.select("l.*", "star"), "lists")
    edges = prefix.join(lists.hint("merge"), ["h", "band"]).select(node.alias("a"), F.col("star").alias("b"))
    groups = components(edges, work)

    # Search groups: small candidate groups packed together; of large ones pairs of blocks, or list by list
    # (a long list as pairs of blocks) where that moves fewer shingles, as in chains of strangers.
    sized = banded(sets).withColumn("node", node)
    grouped = work.table(groups.join(sized.hint("merge"), "node"), "grouped")
    n_sets, n_shingles = grouped.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    packs = max(1, n_sets // PACK, n_shingles // BLOCK_SHINGLES)
    blocks = grouped.groupBy("root").agg(size.alias("m"), F.sum("n").alias("load"))
    rooted = lists.join(groups.select(F.col("node").alias("star"), "root").hint("merge"), "star")
    by_list = rooted.groupBy("root").agg(F.sum(F.col("load") * F.col("m")).alias("moved"))
    blocks = blocks.join(by_list.hint("merge"), "root").withColumn("apart", (F.col("m") > 1) & (F.col("moved") < F.col("load") * F.col("m")))
    blocks = work.table(blocks.select("root", "m", "apart"), "blocks")
    whole = grouped.select("root", "node", "c").join(blocks.where("not apart").hint("merge"), "root")
    pack = F.when(F.col("m") > 1, F.xxhash64("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(packs)))
    whole = whole.select("c", "node", "m", pack.alias("g"))
    split = rooted.join(blocks.where("apart").select("root").hint("merge"), "root", "left_semi").select("h", "band", "m")
    split = prefix.join(split.hint("merge"), ["h", "band"]).select("c", node.alias("node"), "m", F.xxhash64("h", "band", F.lit(1)).alias("g"))
    part = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda j: (j != F.col("part")) | (F.col("m") == 1))  # a pair searches both blocks within, too
    pairs = F.transform(others, lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    member = whole.unionByName(split).withColumn("part", part)
    member = work.table(member.select("c", "g", F.explode(pairs).alias("p")).select("c", "g", "p.i", "p.j"), "members")
    work.done(counts, prefix, lists, blocks, grouped)
    found = member.join(sets.select("c", "tokens").hint("merge"), "c").groupBy("g", "i", "j").applyInPandas(_search(percent), "a long, b long")
    links = work.table(found, "links")
    work.done(member, sets, alive)
    linked = components(links, work)

    named = work.table(classes.select("c", *name, "rid").join(linked.withColumnRenamed("node", "c").hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c")), "named")
    smallest = named.groupBy("root").agg(F.min("rid").alias("component_id"))
    named = work.table(named.join(smallest.hint("merge"), "root").select(*name, "component_id"), "names")
    out = rows.select("doc_id", "n", "s1", "s2").join(named.hint("merge"), name, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that come first in their near-duplicate group, by id and then by a checksum of the text; columns unchanged.

    Groups are those of ngram_components over rows, so an unrelated row that repeats
    an id stays. Rows alike in id and text stay or go together. A null id comes
    first. Null, empty and blank texts are in no group and stay. Column names are
    free; an empty table stays empty.
    """
    rows = docs.select(row_key(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    groups = ngram_components(rows, width=width, percent=percent)
    return without_rows(docs, groups.where("doc_id <> component_id"), id_col, text_col)
