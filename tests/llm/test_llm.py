"""Operators of the llm package against brute force, round trips and edge cases."""

import hashlib
import itertools
import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadspark.llm import decontaminate, exact_dedup, licenses, line_dedup, ngram_join, pieces, queries, sharding, token_shards, tokens, toxicity, warc
from leadspark.llm.components import components
from leadspark.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (6, "long " * 30_000), (None, "no id at all here"), (7, "é ü\n梦 \U0001F600 ▁"), (8, "the same old line of text is here\n" * 3)]


def edge_docs(spark, n=None):
    rows = [(i, t, "en", "s", -1, 0, 0, "x") for i, t in EDGES][:n]
    # Columns with names that operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h long, n long, score string")


def test_words_agree_with_a_plain_split():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB \t\n\r\x0b\x0céZ.") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "x" * 3_000_000 + " y z"]
    h, at = tokens.words(*tokens.text_bytes(pa.array(texts, pa.string())))
    seen = {}
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        plain = (text or "").encode().lower().split()
        assert len(plain) == b - a
        for w, x in zip(plain, h[a:b], strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_a_task_works_on_parts_of_a_batch():
    """Spark hands over up to 64 MB at a time; what tasks hold and hand on follows 4 MB, with the same rows."""
    rng = random.Random(4)
    lines = [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(40_000)]
    texts = ["\n".join(lines[i * 7000 : i * 7000 + 40_000]) for i in range(5)] + [None, ""]
    n = [100_000 * i for i in range(1, 6)]
    ids, hashes = pa.array(range(len(texts)), pa.int64()), [np.arange(x, dtype=np.int64).tobytes() for x in n]
    docs = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array([None] * len(texts), pa.list_(pa.binary()))], ["doc_id", "text", "gone"])
    sets = pa.RecordBatch.from_arrays([ids[:5], pa.array(n, pa.int64()), pa.array(hashes, pa.binary())], ["c", "n", "tokens"])
    work = [(ngram_join._sketches(5, 80), docs), (ngram_join._sets(5), docs), (ngram_join._explode_tokens, sets), (line_dedup._keys(20), docs), (line_dedup._rebuild("text", 20, "gone", ["doc_id", "text"], False), docs)]
    for run, batch in work:
        got, single = list(run(iter([batch]))), list(run(batch.slice(i, 1) for i in range(len(batch))))
        assert len(got) > 1
        assert pa.Table.from_batches(got).combine_chunks() == pa.Table.from_batches(single).combine_chunks()
        assert max(x.nbytes for x in got) < 16 << 20


def test_words_need_little_beside_their_hashes():
    """What a worker holds while it hashes is a small multiple of a slice, whatever the text has."""
    data, offsets = tokens.text_bytes(pa.array([" ".join(["w" * 60] * 65_000)], pa.string()))
    tokens.words(data[:100], np.array([0, 100]))
    tracemalloc.start()
    tokens.words(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20


def test_spark_hands_small_batches_to_tasks(spark, monkeypatch):
    """Whole partitions of text would stand outside the heap and in the worker at once; a bound of the session's own stays."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"

    def watched(make):
        def made(*a):
            run = make(*a)

            def small(batches):
                for batch in batches:
                    if batch.nbytes > 4 << 20:
                        raise ValueError(f"a batch of {batch.nbytes} bytes")
                    yield batch

            return lambda batches: run(small(batches))

        return made

    for module, names in ((toxicity, ("_score", "_keep")), (line_dedup, ("_keys", "_rebuild")), (ngram_join, ("_sketches",)), (decontaminate, ("_suspects",)), (pieces, ("_segment",))):
        for name in names:
            monkeypatch.setattr(module, name, watched(getattr(module, name)))
    docs = spark.range(0, 250, 1, 1).selectExpr("id as doc_id", "repeat(concat('some words ', id, ' '), 1500) as text", "'en' as lang")
    tests = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    model = toxicity.train(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0))
    model.thresholds = {None: 2.0}
    jobs = [lambda: toxicity.toxicity_scores(docs, model), lambda: toxicity.drop_toxic(docs, model), lambda: line_dedup.dedup_lines(docs), lambda: ngram_join.keep_one_per_group(docs, width=5, percent=80), lambda: decontaminate.drop_contaminated(docs, tests), lambda: pieces.sampled_pieces(docs)]
    try:
        for job in jobs:
            spark.conf.unset(bound)
            assert job().count() > 0
        spark.conf.set(bound, "1m")
        pieces.sampled_pieces(docs)
        assert spark.conf.get(bound) == "1m"
    finally:
        spark.conf.unset(bound)


def near_texts(rng, groups=12, size=6):
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        for k in range(size):
            own = list(base)
            for _ in range(rng.randrange(k + 1)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return [*out, *out[:5], "", None, "a", "a"]


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "percent", "block", "common"), [(4, 85, 2048, 128), (5, 80, 2048, 128), (4, 85, 4, 2), (1, 60, 3, 1)])
def test_ngram_components_equal_brute_force(spark, monkeypatch, width, percent, block, common):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    texts = near_texts(random.Random(width * percent))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, width=width, percent=percent).collect()}
    assert got == brute_components(texts, width, percent)


def test_chains_of_strangers_are_searched_list_by_list(spark, monkeypatch):
    """Each text shares words with its neighbours only: what is moved grows with the texts, not with their square."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    moved = {}
    plain = ngram_join.Scratch.table

    def spy(self, df, name):
        out = plain(self, df, name)
        if name in ("blocks", "members"):
            moved[name] = out.collect()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "table", spy)
    rng = random.Random(3)
    texts = [" ".join(f"w{j}" for j in range(4 * i, 4 * i + 9)) for i in range(150)]
    texts += [" ".join([*rng.choice(texts[:150]).split()[:8], f"x{i}"]) for i in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, width=1, percent=70).collect()}
    want = brute_components(texts, 1, 70)
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts)
    assert any(r.apart for r in moved["blocks"])
    assert len(moved["members"]) < 12 * len(texts)


def test_group_search_equals_brute_force_on_dense_groups():
    rng = random.Random(5)
    base = list(range(1, 90))
    sets = [np.array(sorted({x if rng.random() > 0.06 else rng.randrange(100, 10**6) for x in base}), np.uint64) for _ in range(250)]
    to = ngram_join.link_group(sets, 85)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert len({(to[i], find(i)) for i in range(len(sets))}) == len({find(i) for i in range(len(sets))}) == len(set(to))


def test_strangers_with_common_words_are_no_candidates(spark, monkeypatch):
    """A text's own words come first, so what is searched are near copies alone, each in one band and a block with itself in no pair of its own."""
    searched = {}
    plain = ngram_join.Scratch.table

    def spy(self, df, name):
        out = plain(self, df, name)
        if name in ("survivors", "members"):
            searched[name] = out.collect()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "table", spy)
    rng = random.Random(7)
    texts = [" ".join([f"own{i}x{j}" for j in range(55)] + rng.sample([f"all{j}" for j in range(900)], 45)) for i in range(120)]
    texts += [" ".join([*t.split()[:-2], f"y{i}", f"z{i}"]) for i, t in enumerate(texts[:6])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, width=1, percent=85).collect()}
    assert got == brute_components(texts, 1, 85)
    assert [got[120 + i][1] for i in range(6)] == list(range(6))
    assert len(searched["survivors"]) > 60
    assert len(searched["members"]) == 12


@pytest.mark.parametrize("probe", [0, 100, 10**9])
def test_long_lists_are_looked_up_or_counted_alike(monkeypatch, probe):
    monkeypatch.setattr(ngram_join, "PROBE", probe)
    rng = random.Random(11)
    sets = [np.array(sorted({x if rng.random() > 0.075 else rng.randrange(1000, 10**6) for x in range(1, 300)}), np.uint64) for _ in range(120)]
    to = ngram_join.link_group(sets, 85)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert 1 < len({find(i) for i in range(len(sets))}) < len(sets)
    assert list(to) == [find(i) for i in range(len(sets))]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges, Scratch(spark, "test")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100}
    assert components(edges.limit(0), Scratch(spark, "test")).count() == 0


def test_keep_one_per_group_keeps_columns(spark):
    texts = near_texts(random.Random(1))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    kept = ngram_join.keep_one_per_group(docs, width=5, percent=80)
    want = {c for _, c in brute_components(texts, 5, 80).values()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("n", [None, 0])
def test_edge_rows_pass_through_every_operator(spark, n, tmp_path):
    docs = edge_docs(spark, n)
    count = docs.count()
    model = toxicity.train(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0))
    tests = spark.createDataFrame([(1, None), (2, ""), (3, "one two three")], "item_id long, text string")
    frames = [
        ngram_join.ngram_components(docs),
        exact_dedup.exact_groups(docs),
        sharding.assign_shards(docs, [1.0, 2.0], 1.0),
        line_dedup.dedup_lines(docs),
        toxicity.toxicity_scores(docs, model),
        toxicity.drop_toxic(docs, model),
        pieces.sampled_pieces(docs),
        licenses.scan_licenses(docs.withColumn("path", F.lit("a/b"))),
        decontaminate.drop_contaminated(docs, tests),
    ]
    assert [f.count() for f in frames] == [count] * len(frames)
    assert decontaminate.contaminated(docs, tests).count() == 0
    assert decontaminate.contaminated(docs, tests.limit(0)).count() == 0
    shards = token_shards.materialise(docs, f"file://{tmp_path}/t")
    assert sorted(r.slot for r in shards.collect()) == list(range(shards.count()))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), F.lit(1).alias("first"))
    assert warc.round_trip(pages).count() == count


def test_fit_without_labels(spark):
    docs = edge_docs(spark)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(docs, model).collect())


def test_exact_groups_split_collisions(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, keep="max").collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True), 4: (5, 2, False), 5: (5, 2, True)}
    assert exact_dedup.exact_groups(docs, keep="min").where("kept").count() == 3


def test_sharding_law(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("té"), F.col("id")).alias("text"))
    rows = sharding.assign_shards(docs, [1.0] * 8, 1.0).collect()
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - 2500) < 300
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {8} and abs(len(moved) - 20_000 / 9) < 300
    assert {r.doc_id: r.shard for r in sharding.assign_shards(docs, [1.0] * 9).collect()} == {r.doc_id: r.grown_shard for r in rows}
    r = rows[5]
    assert (r.size, r.text_crc32) == (len(f"té{r.doc_id}".encode()) + 1, zlib.crc32(f"té{r.doc_id}".encode()))
    heavy = sharding.assign_shards(docs, [1.0, 3.0]).where("shard = 1").count()
    assert abs(heavy - 15_000) < 400


def test_shards_and_slots_equal_a_plain_count(spark):
    import math

    import xxhash

    rng = random.Random(12)
    rows = [(rng.randrange(700) if rng.random() > 0.02 else None, rng.choice([None, "", "é", "text " * rng.randrange(9)])) for _ in range(900)]
    weights, grown, buckets = [1.0, 2.5, 1.0], 1.5, 16

    def score(key, shard, weight):
        digest = hashlib.md5(f"{key}:{shard}".encode()).hexdigest()
        return -weight / math.log((int(digest[:13], 16) + 0.5) / 2**52)

    want, by_shard = [], {}
    for i, text in rows:
        key, data = "" if i is None else str(i), (text or "").encode()
        scores = [score(key, k, w) for k, w in enumerate(weights)]
        shard = scores.index(max(scores))
        more = len(weights) if score(key, len(weights), grown) > max(scores) else shard
        # xxhash64 of a null is its seed.
        h = 42 if i is None else xxhash.xxh64(key.encode(), seed=42).intdigest()
        row = (h % buckets, i is not None, i or 0, zlib.crc32(data), len(data) + 1, i, more)
        by_shard.setdefault(shard, []).append(row)
    for shard, own in by_shard.items():
        want += [(r[5], r[4], r[3], "key", shard, slot, r[6]) for slot, r in enumerate(sorted(own, key=lambda r: r[:5]))]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), weights, grown, buckets=buckets).collect()
    plain = lambda r: tuple((x is not None, x) if x is None or isinstance(x, int) else x for x in r)
    assert sorted(map(tuple, got), key=lambda r: str(plain(r))) == sorted(want, key=lambda r: str(plain(r)))


def test_line_keys_and_ties(spark):
    line = "A line that is long enough"
    docs = spark.createDataFrame([(1, f"{line}\nown"), (2, f"  {line.upper()} \nown"), (3, f"{line}\n{line}"), (3, f"x\n{line}"), (4, "short\nshort"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).where("doc_id < 5").collect())
    assert got == [(1, 2, 1, "own"), (2, 2, 1, "own"), (3, 2, 0, f"{line}\n{line}"), (3, 2, 0, f"x\n{line}"), (4, 2, 0, "short\nshort")]
    null = line_dedup.dedup_lines(docs).where("doc_id = 5").first()
    assert (null.text, null.n_lines, null.n_dropped) == (None, 1, 0)
    assert line_dedup.line_key(("é" * 19).encode(), 20) is None and line_dedup.line_key(("é" * 20).encode(), 20)


def test_masks_miss_no_two_substitutions():
    places = [frozenset(s + o for o in m) for m in decontaminate.MASKS for s in range(decontaminate.SPAN - m[-1])]
    for bad in itertools.combinations(range(decontaminate.SPAN), decontaminate.SUBSTITUTIONS):
        assert any(not p & set(bad) for p in places)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(rng.randrange(10, 40))] for _ in range(15)]
    docs = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        if i % 2:
            item = rng.choice(items)
            a = rng.randrange(len(item))
            piece = list(item[a : a + rng.randrange(8, 30)])
            for _ in range(rng.randrange(4)):
                piece[rng.randrange(len(piece))] = "zz"
            at = rng.randrange(len(own))
            own[at:at] = piece
        docs.append(", ".join(own).upper())
    want = set()
    for d, i in itertools.product(range(len(docs)), range(len(items))):
        dw = docs[d].lower().replace(",", "").split()
        for a, b in itertools.product(range(len(dw) - 12), range(len(items[i]) - 12)):
            if sum(x == y for x, y in zip(dw[a : a + 13], items[i][b : b + 13], strict=True)) >= 11:
                want.add((d, i))
                break
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, tests).collect()} == want and want
    assert {r.doc_id for r in decontaminate.drop_contaminated(frame, tests).collect()} == set(range(60)) - {d for d, _ in want}


def test_filter_size_and_kind_of_join_change_no_row(spark, monkeypatch):
    docs, tests = queries.table(spark, SF, "documents"), queries.table(spark, SF, "benchmark")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, tests).collect()))
    monkeypatch.setattr(decontaminate, "MOST_BITS", 10)  # nearly all seeds pass
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, decontaminate.contaminated(docs, tests).collect())) == whole and whole
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_ids_lose_only_their_own_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    leak = " ".join(f"t{i}" for i in range(30))
    rows = [(1, base), (5, base + " more"), (5, "an unrelated text with the same id " * 3), (7, leak), (7, "a clean text of id seven"), (7, leak)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, gone long, __gone long, __id long")
    kept = ngram_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(r for k, r in enumerate(rows) if k != 1)
    tests = spark.createDataFrame([("a", leak)], "item_id string, text string")
    clean = decontaminate.drop_contaminated(docs, tests)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == sorted(r for r in rows if r[1] != leak)
    line = "a line that is long enough to count"
    three = spark.createDataFrame([(1, line, 0), (1, line, 0), (2, line, 0)], "doc_id long, text string, __gone long")
    assert [r.n_dropped for r in line_dedup.dedup_lines(three).collect()] == [0, 0, 0]
    four = three.union(spark.createDataFrame([(None, line, 0), (3, line, 0)], three.schema))
    assert sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(four).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 0)]


def test_ids_of_any_type_link(spark):
    texts = near_texts(random.Random(7), groups=4)
    docs = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got == {f"d{i:03d}": (n, f"d{c:03d}") for i, (n, c) in brute_components(texts, 4, 85).items()}


def test_classes_that_share_half_a_name_stay_apart(spark, monkeypatch):
    texts = near_texts(random.Random(11), groups=6)
    plain = ngram_join._signatures
    monkeypatch.setattr(ngram_join, "_signatures", lambda s: (np.uint64(7), plain(s)[1]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got == brute_components(texts, 4, 85)


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.VOCABULARY, "rb") as f:
        return pieces.Vocabulary(f.read(), pieces.SHARPNESS)


def segmentations(v, word):
    """All segmentations of a short word with their weights, by plain recursion over the vocabulary."""
    weight = {v.pieces[i]: float(w) for i, w in zip(v.ids[:-1], v.weights[:-1], strict=True)}

    def rest(at):
        if at == len(word):
            yield (), 0.0
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in weight:
                for tail, w in rest(end):
                    yield (word[at:end], *tail), w + weight[word[at:end]]

    return dict(rest(0))


def test_samples_follow_the_lattice(vocabulary):
    word, n = b" thing", 40_000
    exact = segmentations(vocabulary, word)
    total = np.logaddexp.reduce(list(exact.values()))
    data = np.frombuffer(word * n, np.uint8)
    ids, at = pieces.sample(data, np.arange(n + 1) * len(word), tokens.stream(9, n), vocabulary)
    seen = {}
    for a, b in zip(at[:-1], at[1:], strict=True):
        key = tuple(vocabulary.pieces[i] for i in ids[a:b])
        seen[key] = seen.get(key, 0) + 1
    assert set(seen) <= set(exact)
    for key, w in exact.items():
        p = np.exp(w - total)
        assert abs(seen.get(key, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_long_words_are_sampled_as_short_ones(vocabulary):
    word, n = b" thing", 20_000
    exact = segmentations(vocabulary, word)
    total = np.logaddexp.reduce(list(exact.values()))
    data, seeds, seen = np.frombuffer(word, np.uint8), tokens.stream(9, n), {}
    for seed in seeds:
        key = tuple(vocabulary.pieces[i] for i in pieces.sample_long(data, seed, vocabulary))
        seen[key] = seen.get(key, 0) + 1
    assert set(seen) <= set(exact)
    for key, w in exact.items():
        p = np.exp(w - total)
        assert abs(seen.get(key, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def spaceless(n):
    rng = random.Random(4)
    some = lambda letters: "".join(rng.choice(letters) for _ in range(n))
    return ["a" * n, some("acgt"), some("abcdefghijklmnopqrstuvwxyz"), some("的一是在不了有和人这中大为上个国我日本"), some("0123456789abcdef"), some("éßज़😀a-")]


def test_no_piece_crosses_a_part(vocabulary):
    inside = [(x, len(x)) for x in vocabulary.pieces if len(x) > 1]
    for text in spaceless(300):
        data = text.encode()
        begins = pieces.parts(np.frombuffer(data, np.uint8), vocabulary)
        crossed = set()
        for x, n in inside:
            at = data.find(x)
            while at >= 0:
                crossed.update(range(at + 1, at + n))
                at = data.find(x, at + 1)
        assert not crossed & set(begins.tolist())
    assert len(pieces.parts(np.frombuffer(b"\xff\xfe" * 99, np.uint8), vocabulary)) == 0


def test_sums_of_plain_weights_equal_those_of_logarithms(vocabulary):
    for text in spaceless(3000):
        word = np.frombuffer(text.encode(), np.uint8)
        end, length, weight, _ = pieces._edges(word, 0, len(word), vocabulary)
        at = np.searchsorted(end, np.arange(1, len(word) + 2)).tolist()
        slow, fast = pieces._sums([0.0], at, length.tolist(), weight.tolist()), pieces._fast_sums([0.0], at, length.tolist(), weight.tolist())
        assert np.allclose(slow, fast, rtol=1e-12, atol=1e-9)
    # A range that no number holds: the slow way is taken.
    assert pieces._fast_sums([0.0], [0, 1, 2], [1, 2], [-900.0, -1.0]) is None


def test_spaceless_texts_keep_all_bytes(vocabulary):
    for text in spaceless(pieces.BLOCK + 5000):
        data = np.frombuffer((" " + text + " " + text[:200]).encode(), np.uint8)
        ids, at = pieces.sample(data, np.array([0, len(data)]), tokens.stream(9, 1), vocabulary)
        assert pieces.decode(ids, at, vocabulary)[0].tobytes() == data.tobytes()


def test_pieces_are_lossless_and_reproducible(spark):
    docs = edge_docs(spark).where("doc_id is not null")
    first = pieces.sampled_pieces(docs)
    again = pieces.sampled_pieces(docs.repartition(5))
    key = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(first) == key(again) and key(first) != key(pieces.sampled_pieces(docs, seed=2))
    want = sorted((i, t or "") for i, t in EDGES if i is not None)
    assert sorted((r.doc_id, r.text) for r in pieces.decoded_texts(first).collect()) == want
    assert all(r.lossless for r in pieces.sampled_pieces(queries.table(spark, SF, "documents"), digest=True).collect())


def test_feistel_is_a_permutation_that_depends_on_the_key():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(token_shards.feistel(np.arange(n), n, 1)) == list(range(n))
    assert list(token_shards.feistel(np.arange(1000), 1000, 1)) != list(token_shards.feistel(np.arange(1000), 1000, 2))


@pytest.fixture(scope="module")
def encoder():
    with open(token_shards.RANKS, "rb") as f:
        return token_shards.Encoder(f.read())


@pytest.mark.parametrize("step", [1, 50, 1 << 20])
def test_batches_encode_as_each_text(encoder, monkeypatch, step):
    monkeypatch.setattr(token_shards, "STEP", step)
    rng = random.Random(step)
    texts = ["".join(rng.choice("ab1 .,  \n\t é'\u3000\xa0à") for _ in range(rng.randrange(60))) for _ in range(800)] + [None, "", "x" * 9000, " " * 50, " y" * 3000]
    for column in (pa.array(texts, pa.string()), pa.array([], pa.string())):
        data, offsets = tokens.text_bytes(column)
        ids, begin = encoder.encode(data, offsets)
        want = [encoder.bpe.encode_ordinary(t or "") for t in column.to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == want
        assert encoder.sizes(data, offsets).tolist() == list(map(len, want))


def plain_feistel(x, n, key):
    """The permutation of one number, step by step in plain integers."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    low, whole = (1 << half) - 1, (1 << 64) - 1

    def mixed(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & whole
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & whole
        return h ^ (h >> 31)

    while True:
        left, right = x >> half, x & low
        for r in range(token_shards.ROUNDS):
            left, right = right, left ^ (mixed(right + (key * token_shards.ROUNDS + r + 1) * 0x9E3779B97F4A7C15 & whole) & low)
        x = left << half | right
        if x < n:
            return x


def test_slots_equal_a_plain_numbering_on_any_partitions(spark, tmp_path, encoder):
    rng = random.Random(8)
    rows = [(rng.randrange(60), " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(200)))) for _ in range(150)] + [(None, "no id " * 40), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).collect()
    place = lambda r: (r.h % token_shards.BUCKETS, r.h, (r.doc_id is not None, r.doc_id or 0), zlib.crc32((r.text or "").encode()))
    sequences = []
    for r in sorted(keyed, key=place):
        ids = encoder.bpe.encode_ordinary(r.text or "") + [token_shards.END_OF_TEXT] * bool(r.text)
        sequences += [(r.doc_id, k, ids[a : a + 16]) for k, a in enumerate(range(0, len(ids), 16))]
    n = len(sequences)
    want = sorted((plain_feistel(i, n, 5), d, k, len(x), zlib.crc32(np.array(x + [0] * (16 - len(x)), "<u2").tobytes())) for i, (d, k, x) in enumerate(sequences))
    for parts in (1, 3, 17):
        got = token_shards.materialise(docs.repartition(parts, "text"), f"file://{tmp_path}/{parts}", key=5, stride=16, per_shard=50).collect()
        assert sorted((r.slot, r.doc_id, r.seq_no, r.n_tokens, r.tokens_crc32) for r in got) == want


def test_shards_read_back_in_slot_order(spark, tmp_path, encoder):
    docs, folder = queries.table(spark, SF, "documents"), f"file://{tmp_path}/tokens"
    rows = sorted(token_shards.materialise(docs, folder, stride=32, per_shard=100).collect())
    cells = list(token_shards.read_from(folder, 0, 32, 100))
    assert [r.slot for r in rows] == list(range(len(rows))) and len(cells) == len(rows)
    assert [zlib.crc32(c.tobytes()) for c in cells] == [r.tokens_crc32 for r in rows]
    assert [c.tobytes() for c in token_shards.read_from(folder, 250, 32, 100)] == [c.tobytes() for c in cells[250:]]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.seq_no, cells[r.slot][: r.n_tokens]))
    for d in docs.where("doc_id < 20").collect():
        got = np.concatenate([c for _, c in sorted(by_doc[d.doc_id], key=lambda x: x[0])])
        assert encoder.bpe.decode(got[:-1].tolist()) == d.text and got[-1] == token_shards.END_OF_TEXT


def test_slots_do_not_depend_on_splits_between_the_passes(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    ids = list(range(400))
    pq.write_table(pa.table({"doc_id": ids, "text": [f"some words {i} " * 20 for i in ids]}), f"{tmp_path}/docs.parquet", row_group_size=20)
    docs, emit, sizes = spark.read.parquet(f"{tmp_path}/docs.parquet"), token_shards._emit, ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]

    def smaller(*a):
        for x in sizes:
            spark.conf.set(x, "1000")
        return emit(*a)

    monkeypatch.setattr(token_shards, "_emit", smaller)
    try:
        rows = token_shards.materialise(docs, f"file://{tmp_path}/t", stride=32, per_shard=100).collect()
    finally:
        for x in sizes:
            spark.conf.unset(x)
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert len(list(token_shards.read_from(f"file://{tmp_path}/t", 0, 32, 100))) == len(rows)
    monkeypatch.setattr(token_shards, "_emit", lambda ranks, stride, per_shard, starts, n, key: emit(ranks, stride, per_shard, starts + "-none", n, key))
    with pytest.raises(Exception, match="has other rows"):
        token_shards.materialise(docs, f"file://{tmp_path}/u", stride=32, per_shard=100)


def test_warc_round_trip(spark):
    big, small = "x" * 150, "y" * 50
    rows = [(3, "http://a/ b\r\n", big), (1, None, big), (2, "http://c", small), (4, "http://d", small), (5, "http://e", None), (6, "http://f", "é\r\n\r\nWARC/1.1\r\n" * 9), (7, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for i, _, html in rows:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len((html or "").encode()), sha(html))
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 1)}
    assert got[3].uri == "http://a/%20b%20%20"


def hashed(texts):
    return tokens.words(*tokens.text_bytes(pa.array(texts, pa.string()), fold=True), "alnum")


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    ones = labels.sum()
    return (rank[labels == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(labels) - ones))


def test_filters_learn_the_order_of_words():
    rng = random.Random(6)

    def task(n):
        texts, labels = [], []
        for _ in range(n):
            own, label = [f"w{rng.randrange(400)}" for _ in range(20)], rng.random() < 0.5
            at = rng.randrange(20)
            own[at:at] = ["alpha", "beta"] if label else ["beta", "alpha"]
            texts.append(" ".join(own))
            labels.append(float(label))
        return texts, np.array(labels)

    texts, labels = task(2000)
    model = toxicity.train(*hashed(texts), labels)
    texts, labels = task(500)
    assert ((model.score(*hashed(texts)) >= 0.5) == labels).mean() >= 0.9


def test_convolution_equals_a_plain_loop():
    texts = ["one two three four", "five", "", "one two " * 50, "six seven"]
    h, bounds = hashed(texts)
    model = toxicity.train(h, bounds, np.array([1.0, 0, 0, 1, 0]))
    a, b = toxicity.rows_of(h)
    got = model.features(h, bounds)
    for r in range(len(texts)):
        vectors = [model.table[a[i]] + model.table[b[i]] for i in range(bounds[r], bounds[r + 1])]
        for k, w in enumerate(model.filters):
            for f in range(toxicity.FILTERS):
                sums = [sum(float(vectors[i + o] @ w[o][:, f]) for o in range(len(w)) if i + o < len(vectors)) for i in range(len(vectors))]
                want = max(0.0, max(sums) + float(model.bias[k * toxicity.FILTERS + f])) if sums else 0.0
                assert abs(got[r, k * toxicity.FILTERS + f] - want) < 1e-4


@pytest.mark.parametrize("label", [0.0, 1.0])
def test_one_class_alone_gives_its_share(label):
    h, bounds = hashed(["one two", "three four", "five"] * 30)
    scores = toxicity.train(h, bounds, np.full(90, label)).score(h, bounds)
    assert ((scores > 0.9) == bool(label)).all()


def test_toxicity_holds_out_and_finds(spark):
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents")
    labels = queries.table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    rows = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    truth, said = np.array([r.toxic for r in held]), np.array([r.predicted for r in held])
    # Always answering 0 has an F1 of 0 and an area of one half.
    assert 2 * (truth & said).sum() / (truth.sum() + said.sum()) >= 0.85
    assert auc(np.array([r.score for r in held]), truth) >= 0.95
    again = toxicity.fit(docs, labels)
    assert np.array_equal(again.table, model.table) and again.cuts == model.cuts


def test_thresholds_hold_at_the_mix_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 150)
    rng = random.Random(9)
    rows = []
    for i in range(6000):
        toxic = int(i % 20 == 0)
        # A word that every toxic row has, and one clean row in fifty: enough in a sample of equal classes, not among all rows.
        told = ["idiot"] if toxic or rng.random() < 0.02 else []
        told += ["moron"] if toxic and i % 40 == 0 else []
        rows.append((i, " ".join([rng.choice("abcdefgh") * 3 for _ in range(12)] + told), "en", toxic))
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    docs, labels = own.drop("toxic"), own.select("doc_id", "toxic")
    model = toxicity.calibrate(toxicity.fit(docs, labels, aside=True), docs, labels)
    # Scored once or twice, the result is the same.
    assert sorted(map(tuple, toxicity.learned_scores(docs, labels).collect())) == sorted(map(tuple, toxicity.toxicity_scores(docs, model).collect()))
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    dropped = [r[3] for r in rows if r[0] not in kept]
    assert sum(x == 0 for x in dropped) <= 0.03 * len(dropped)
    # The column says what the filter drops, by the threshold of the row's language, else by that of all.
    for limits in (model.thresholds, {"de": 0.0, None: float("inf")}, {"en": 0.0, None: float("inf")}):
        model.thresholds = limits
        told = {r.doc_id for r in toxicity.toxicity_scores(docs, model).collect() if not r.rejected}
        assert told == {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert not told and {r.rejected for r in toxicity.toxicity_scores(docs.drop("lang"), model).collect()} == {None}


def test_long_labelled_rows_do_not_train_and_all_others_train_whole(spark, monkeypatch):
    """The last word of a text counts; a text beyond the bound adds nothing."""
    monkeypatch.setattr(toxicity, "DOC_WORDS", 50)
    rows = [(i, "calm words " * 20 + ("idiot" if i % 2 else "fine"), "en", i % 2) for i in range(200)]
    long = [(1000 + i, "moron fine " * 40, "en", 1) for i in range(100)]
    fitted = []
    for own in (rows, rows + long):
        df = spark.createDataFrame(own, "doc_id long, text string, lang string, toxic int")
        fitted.append(toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic")))
    assert np.array_equal(fitted[0].table, fitted[1].table)
    h, bounds = hashed(["calm words " * 20 + "idiot", "calm words " * 20 + "fine"])
    assert (fitted[0].score(h, bounds) >= 0.5).tolist() == [True, False]


def test_sample_does_not_depend_on_partitions_or_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 2000)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(40 if i else 30_000)) + " idiot" * (i % 3 == 0), "en", int(i % 3 == 0)) for i in range(300)]
    models = []
    for n in ("1", "7"):
        monkeypatch.setattr(toxicity, "DOC_WORDS", 200)
        spark.conf.set("spark.sql.shuffle.partitions", n)
        own = spark.createDataFrame(rows[:: 1 if n == "1" else -1], "doc_id long, text string, lang string, toxic int")
        models.append(toxicity.fit(own.drop("toxic"), own.select("doc_id", "toxic")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.array_equal(models[0].table, models[1].table) and models[0].cuts == models[1].cuts and set(models[0].cuts) == {0, 1}


def test_thresholds_reject_nothing_without_evidence():
    counts = np.zeros((2, toxicity.TOP + 2))
    counts[:, 400] = 10, 10
    assert toxicity._threshold(counts, 0.98) is None
    counts[1, 600] = 500
    assert 0.5 < toxicity._threshold(counts, 0.98) < 1


def test_licenses_inherit_from_the_nearest_directory(spark):
    mit, gpl = "x\nReleased under the MIT License.\ny", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/f.txt", "plain"), (3, "a/b/LICENSE.md", gpl), (4, "a/x.txt", None), (5, "z/y.txt", ""), (6, "a/b/own.txt", mit), (7, None, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "MIT", None),
        2: (None, "GPL-3.0", "a/b"),
        3: ("GPL-3.0", "GPL-3.0", None),
        4: (None, "MIT", "a"),
        5: (None, None, None),
        6: ("MIT", "MIT", None),
        7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
    }


def test_licences_that_are_edited_partial_or_identifiers(spark):
    texts = dict(licenses.TEMPLATES)
    mit = next(b for a, b in licenses.TEMPLATES if a == "MIT" and "sublicense" in b)
    bsd = next(b for a, b in licenses.TEMPLATES if a == "BSD-3-Clause" and "PROCUREMENT" in b)
    prose = "The river ran past the old mill and the road went on to the town where people met.\n" * 5
    wrapped = "\n".join("# " + " ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    gpl = "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License, version 3,\n * as published by the Free Software Foundation, or any later version.\n * It is distributed in the hope that it will be useful, WITHOUT ANY WARRANTY. */"
    rows = [
        ("a.py", f"{wrapped}\n\nimport os\n{prose}", "MIT"),
        ("b.py", "Copyright (c) 2019 Some Person\n\n" + mit[: len(mit) // 2] + "\n\n" + prose, "MIT"),
        ("LICENSE", "Copyright 2020, Somebody. All their own words here.\n\n" + bsd.replace("copyright holder", "university"), "BSD-3-Clause"),
        ("c.c", "// SPDX-License-Identifier: GPL-3.0-or-later\nint main() {}\n", "GPL-3.0"),
        ("d.c", "// SPDX-License-Identifier: Apache-2.0\nint main() {}\n", "Apache-2.0"),
        ("e.c", f"{gpl}\n\nint x;\n{prose}", "GPL-3.0"),
        ("f.txt", prose, None),
        ("g.txt", "We asked for a permit to use the mill, and without any warranty it was given, free of charge.\n" + prose, None),
    ]
    docs = spark.createDataFrame([(i, f"dir{i}/{p}", t) for i, (p, t, _) in enumerate(rows)] + [(100 + i, None, prose + f" word{i}") for i in range(60)], "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [x for _, _, x in rows] and len(texts) > 10
    assert all(got[100 + i] is None for i in range(60))


def test_light_terms_alone_never_reach_the_cosine():
    rng = random.Random(1)
    vectors = [(t, f"w{k}", rng.random() * 5) for t in range(5) for k in rng.sample(range(40), 12)]
    heavy = set(licenses.heavy_terms(vectors))
    for t in range(5):
        own = {k: w for i, k, w in vectors if i == t}
        light = sum(w * w for k, w in own.items() if k not in heavy) ** 0.5 / sum(w * w for w in own.values()) ** 0.5
        assert light < licenses.LEAST_COSINE


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    plain = lambda row: str([f"{x:.6f}" if isinstance(x, float) else x for x in row])
    want = sorted(plain(r) for r in con.sql(f"SELECT {columns} FROM ({queries.SQL[name]})").fetchall())
    assert sorted(plain(r) for r in df.select(*sorted(df.columns)).collect()) == want


def test_pipeline_stages_take_edge_rows(spark):
    import corpus_pipeline

    for n in (None, 0):
        docs = edge_docs(spark, n).withColumnRenamed("h", "gone").withColumnRenamed("n", "n_lines").withColumn("__id", F.lit(1))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            kept = out.count()
            # Ids 4, 5 and 5 hold one text: the stage of near duplicates keeps one of these rows.
            assert kept == (docs.count() - (2 if name == "ngram_jaccard_join" and n is None else 0)), name
            assert name == "sentencepiece" or out.columns == docs.columns, name


FOREIGN = """
import sys
sys.path.insert(0, {repo!r})
import os
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config(map={{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": {folder!r}, "spark.executorEnv.PYTHONPATH": "", "spark.executorEnv.PYTHONSAFEPATH": "1"}}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def seen(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({{"x": [importlib.util.find_spec("leadspark") is None]}})
alone = spark.range(1).mapInArrow(seen, "x boolean").first().x
for name, q in entry.queries().items():
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        print("RAN", name, q(spark, {sf!r}).count(), alone, flush=True)
spark.stop()
"""


def spark_home(tmp_path):
    """A Spark home of links, whose folder for the workers of a local cluster is a plain folder that can be written."""
    from pathlib import Path

    import pyspark

    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    return str(home)


def test_executors_need_no_copy_of_the_package(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    repo = str(Path(line_dedup.__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_DIST_CLASSPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"SPARK_HOME": spark_home(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", FOREIGN.format(repo=repo, folder=f"file://{tmp_path}/shared", sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    ran = [x.split() for x in run.stdout.splitlines() if x.startswith("RAN")]
    assert len(ran) == 14 and all(x[3] == "True" for x in ran), run.stdout[-2000:] + run.stderr[:3000] + run.stderr[-3000:]


def test_pipeline_stages_keep_their_word(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    work, seen = Scratch(spark, "test"), {}
    own = docs
    for name, stage in corpus_pipeline.STAGES:
        before, own = own, work.table(stage(spark, own, SF), name)
        seen[name] = (before, own)
    for name, (before, after) in list(seen.items())[:-1]:
        assert after.columns == before.columns, name
    before, after = seen["ngram_jaccard_join"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    groups = brute_components([t for _, t in rows], 5, 80)
    assert {r.doc_id for r in after.collect()} == {rows[c][0] for _, c in groups.values()}
    assert seen["line_dedup"][0].count() == seen["line_dedup"][1].count()
    leaks = decontaminate.contaminated(seen["benchmark_decontamination"][0], queries.table(spark, SF, "benchmark"))
    assert seen["benchmark_decontamination"][1].join(leaks, "doc_id", "left_semi").count() == 0
    assert own.columns == ["doc_id", "n_pieces", "ids"] and own.count() == seen["sentencepiece"][0].count()
