"""Fill-in-the-middle, chat formatting and centroid clustering against plain Python, SQL and edge cases."""

import hashlib
import json
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.llm import centroids, chat, fim, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_chat_formatting", "op13_centroid_clustering"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = sorted(con.sql(f"SELECT {columns} FROM ({queries.SQL[name]})").fetchall(), key=str)
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str) == want and want


def plain_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rng = random.Random(5)
    alphabet = "abc é梦\U0001f600<>P|\n\n\r"
    shared = "".join(rng.choice(alphabet) for _ in range(9_000))
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 300, 3_000]))) for _ in range(60)]
    texts += [shared[k:] + "x" * k for k in range(0, 400, 20)] + [f"{i}\n" + shared + "\nend" for i in range(20)]
    texts += [None, "", "\n", "\n\n\n", "no line end", "a\nb", "a" * 100_000, "a\n" * 60_000, "é" * 50_000 + "\n", "x<P>y\n", "x" * 5_000 + "<S>", ("line of text\n" * 30 + "<M>") * 3, "x" * 700_000 + "\n" + "y" * 2_000_000]
    return texts


def test_fim_equals_plain_python_and_restores(spark):
    rows = [(i, t, "z", 1, 2) for i, t in enumerate(fim_texts())] + [(None, "one\ntwo\n", "z", 1, 2), (7, "twice\n", "z", 1, 2), (7, "twice\n", "z", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int, h1 int").repartition(3)
    made = fim.fill_in_middle(docs)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((d, *plain_fim(d, t), t or "") for d, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    some = {(r.doc_id, r.form) for r in fim.fill_in_middle(docs, rate=40, spm=0).collect()}
    assert some == {(d, plain_fim(d, t, 40, 0)[1]) for d, t, *_ in rows} and {f for _, f in some} == {"plain", "psm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_chunks_depend_on_content_and_cover_the_text():
    rng = np.random.default_rng(1)
    body = rng.integers(32, 127, 200_000).astype(np.uint8)
    plain = fim.borders(fim.candidates(body), 0, len(body))
    moved = np.concatenate([rng.integers(32, 127, 777).astype(np.uint8), body])
    after = fim.borders(fim.candidates(moved), 0, len(moved))
    assert len({x + 777 for x in plain} & set(after)) > 0.9 * len(plain)
    for data in (body, body[:100], body[:0], np.zeros(50_000, np.uint8)):
        ends = fim.borders(fim.candidates(data), 0, len(data))
        sizes = np.diff([0, *ends])
        assert (ends[-1] if ends else 0) == len(data) and (sizes <= fim.MOST).all() and (sizes[:-1] >= fim.LEAST).all()
    # A hash in steps equals the plain sum over the last WINDOW bytes.
    i = 5_000
    want = sum(int(fim.GEAR[body[i - j]]) << j for j in range(fim.WINDOW)) % 2**32
    assert int(fim.rolling(body)[i]) == want


def test_chunks_are_shared_by_content_not_by_checksum(monkeypatch):
    memory = fim.Memory(most=3_000)
    texts = [("word %d\n" % (i % 3)).encode() * 100 for i in range(9)]
    for t in texts:
        assert memory.of(t) == fim.summary(t)
    assert memory.shared == 6 and memory.size <= 3_000
    for i in range(50):
        memory.of(b"%d\n" % i * 200)
    assert memory.size <= 3_000 + 1_000
    monkeypatch.setattr(fim.zlib, "crc32", lambda x: 1)
    clash = fim.Memory()
    for t in (b"ab\nc", b"\n\n\n\n", b"ab\nc", b"\n\n\n\n"):
        assert clash.of(t) == fim.summary(t)
    assert clash.shared == 1


RECORDS = [
    ('{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', "messages", [("user", "a"), ("assistant", "b")]),
    ('{"messages":[]}', "messages", []),
    ('{"messages":[{"role":null,"content":null}],"id":7}', "messages", [("", "")]),
    ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r"},{"from":"tool","value":"s"}]}', "conversations", [("user", "q"), ("assistant", "r"), ("tool", "s")]),
    ('{"data":{"dialogue":[{"speaker":"bot","utterance":"hi"}]}}', "dialogue", [("assistant", "hi")]),
    ('{"response":"r","prompt":"p"}', "prompt", [("user", "p"), ("assistant", "r")]),
    ('{"response":"r","prompt":"p","system":"s","id":"x"}', "prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ('{"prompt":"p","completion":5}', "completion", [("user", "p"), ("assistant", "5")]),
    ('{"instruction":"i","input":"","output":"o"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"instruction":"i","input":"more","output":"o"}', "instruction", [("user", "i\n\nmore"), ("assistant", "o")]),
    ('{"history":[["q1","a1"],["q2",null]],"instruction":"i","output":"o"}', "history", [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", ""), ("user", "i"), ("assistant", "o")]),
    ('{"prompt":"p"}', None, None),
    ('{"messages":[{"role":"user","content":["parts"]}]}', None, None),
    ("[1,2]", None, None),
    ("{}", None, None),
    (None, None, None),
]


def plain_paths(value, at="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            name = k if re.fullmatch(r"[A-Za-z0-9_]+", k) else "`" + k.replace("`", "``") + "`"
            yield f"{at}.{name}"
            yield from plain_paths(v, f"{at}.{name}")
    elif isinstance(value, list):
        yield f"{at}[*]"
        for v in value:
            yield from plain_paths(v, f"{at}[*]")


def test_field_paths_and_layouts(spark):
    odd = ['{"we ird: <x>,`q`":{"ARRAY<y>":2,"OBJECT":{"z":[{"k":[[1]]},{"m":null}]}}}', '{"a":{"b":{"c":{}}},"d":[[{"e":1}]]}', "3", '{"a":[],"b":[[],[]]}']
    rows = [(i, r, "x") for i, (r, _, _) in enumerate(RECORDS)] + [(100 + i, r, "x") for i, r in enumerate(odd)]
    df = spark.createDataFrame(rows, "id long, j string, turns string").withColumn("record", F.parse_json("j"))
    for r in df.select("j", chat.field_paths(F.col("record")).alias("p")).where("j is not null").collect():
        assert r.p == sorted(set(plain_paths(json.loads(r.j)))), r.j
    got = {r.id: r for r in chat.canonical_turns(df).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout == layout and (got[i].turns if turns is None else [tuple(t) for t in got[i].turns]) == turns, i
    assert got[0].fingerprint != got[3].fingerprint and got[len(RECORDS) - 1].fingerprint is None
    with pytest.raises(ValueError, match="share"):
        chat.canonical_turns(df, layouts=(chat.LAYOUTS[0], chat.Layout("again", turns="$.messages")))
    none = chat.format_chats(df.limit(0))
    assert none.count() == 0 and chat.read_chats(none).count() == 0


def test_chats_are_read_back(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "\n", "assistant", "é\U0001f600", " ", "%0A", "%"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])
    chats = [[(rng.choice(["user", "assistant", "", None, "a<|im_end|>\nb%", "%3C"]), text()) for _ in range(rng.randrange(7))] for _ in range(300)]
    chats += [[("assistant", "x" * 300_000 + "<|im_end|>\n")], [("user", "k")] * 500]
    rows = [(i, [{"role": r, "content": t} for r, t in c], 1) for i, c in enumerate(chats)] + [(0, [{"role": r, "content": t} for r, t in chats[0]], 1)]
    df = spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>, formatted int")
    made = chat.format_chats(df.select("id", F.to_variant_object(F.struct("messages")).alias("record"), "formatted"))
    formatted = {r.id: r.formatted for r in made.collect()}
    got = chat.read_chats(made).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [(a or "", b or "") for a, b in chats[r.id]]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss_texts == [t for a, t in want if a == "assistant"]
        assert formatted[r.id].count(chat.START) == formatted[r.id].count(chat.END) == len(want)
    assert "PythonUDF" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()


def plain_clusters(rows, dims, k, rounds, seed, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    at = [v for _, v in sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        best = nearest()
        for c in range(len(at)):
            own = [v for (_, v), (_, n) in zip(kept, best, strict=True) if n == c]
            if own:
                at[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    best = nearest()
    total = sum(d for d, _ in best)
    by = {c: sum(d for d, n in best if n == c) for c in range(len(at))}
    return sorted(((i, n, d, by[n], total, hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, best, strict=True)), key=str)


@pytest.mark.parametrize(("dims", "k", "block", "segment"), [(5, 4, 2, 16), (5, 3, 1, 1000), (4, 200, 4, 7), (3, 2, 8, 2)])
def test_centroids_equal_plain_python(spark, dims, k, block, segment):
    rng = random.Random(dims * k)
    rows = [(i, [rng.choice([-1.5, 0.25, 0.5, 3.0, rng.uniform(-2, 2)]) for _ in range(dims)]) for i in range(120)]
    rows += [(200 + i, list(rows[0][1])) for i in range(60)] + [rows[5], rows[5], (None, [0.0] * dims)]
    rows += [(300, None), (301, []), (302, [1.0] * (dims + 1)), (303, [None] + [1.0] * (dims - 1)), (304, [float("nan")] * dims), (305, [float("inf")] * dims)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int").repartition(3)
    got = centroids.centroid_clusters(df, dims=dims, k=k, rounds=3, seed=2, scale=16, block=block, segment=segment)
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, dims, k, 3, 2, 16)
    assert centroids.centroid_clusters(df.limit(0), dims=dims).count() == 0
    assert centroids.centroid_clusters(df.limit(0), dims=dims).columns == got.columns


def test_dictionaries_are_lossless_and_small(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (2_000, 7))
    codes, words = centroids.encode(vectors, 2)
    assert (centroids.decode(codes, words, np.arange(2_000)) == vectors).all()
    assert [len(w) for w in words] == [49, 49, 49, 7]
    at = rng.integers(-9, 9, (5, 7))
    assert (centroids.distances(codes, words, at) == ((vectors[:, None] - at[None]) ** 2).sum(2)).all()
    far = spark.createDataFrame([(1, [1e9, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds"):
        centroids.centroid_clusters(far, dims=2).collect()
