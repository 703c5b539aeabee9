"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .centroids import centroid_clusters
from .chat import END, START, format_chats, read_chats
from .decontaminate import contaminated
from .exact_dedup import exact_groups
from .fim import fill_in_middle, restored
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .ngram_join import ngram_components
from .pieces import sampled_pieces
from .sharding import assign_shards
from .token_shards import token_shards
from .toxicity import learned_scores
from .warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), weights=[1.0] * 8, grown=1.0)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def document_paths(docs: DataFrame) -> DataFrame:
    """documents with a path: they carry none, so source and id lay out directories of a hundred, whose first document is the licence file."""
    number = F.col("doc_id")
    name = F.when(number % 100 == 0, "LICENSE").otherwise(F.concat(number.cast("string"), F.lit(".txt")))
    return docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("none")), (number / 1000).cast("long").cast("string"), (number / 100).cast("long").cast("string"), name))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(document_paths(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces(table(spark, sf_dir, "documents"), digest=True)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"), least_chars=20, least_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def conversation_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation as a VARIANT, in the layout that its shape suggests.

    The table has one layout only. A user turn and an answer become a prompt record
    (with a system turn before them too), longer conversations of known roles go into
    a list of `from` and `value`, all others into a list of messages.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "text")
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles, text = F.transform("t", lambda x: x["role"]), lambda i: F.get("t", F.lit(i))["text"]
    shape = F.concat_ws(",", F.slice(roles, 1, 4))
    as_shared = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    as_messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    record = (
        F.when(shape == "user,assistant", F.to_variant_object(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(shape == "system,user,assistant", F.to_variant_object(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(F.forall(roles, lambda r: r.isin("system", "user", "assistant")), F.to_variant_object(F.struct(as_shared.alias("conversations"))))
        .otherwise(F.to_variant_object(F.struct(as_messages.alias("messages"))))
    )
    return listed.select("conv_id", record.alias("record"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(f"{END}{START}assistant ok")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = read_chats(format_chats(conversation_records(turns), id_col="conv_id"), id_col="conv_id")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    seen = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), F.array_join("loss_texts", "").alias("loss"), "formatted")
    loss = [F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256")]
    return seen.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), *loss, F.length("formatted").cast("long").alias("formatted_chars"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), dims=64, k=40, rounds=5, seed=2, scale=256)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_sharding": op2_sharding,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_license_scans": op4_license_scans,
    "op5_toxicity": op5_toxicity,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_output": op10_token_output,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_centroid_clustering": op13_centroid_clustering,
}

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lloyd(rounds: int) -> str:
    """CTEs m0 (centroids at the start) to m{rounds}, and a{rounds}, the last assignment."""
    parts = []
    for r in range(rounds + 1):
        # As many rows as vectors times centroids: the vectors are the query set here.
        parts.append(f"a{r} AS (SELECT vec_id, v, list_min(list(struct_pack(far := far, c := c))) AS best FROM (SELECT vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS far FROM k, m{r}) GROUP BY vec_id, v)")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT c, list(x ORDER BY i) AS new FROM (SELECT best.c AS c, i, floor_div(sum(v[i]), count(*)) AS x FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY c),
m{r + 1} AS (SELECT c, coalesce(new, m) AS m FROM m{r} LEFT JOIN s{r} USING (c))""")
    return ",\n".join(parts).replace("floor_div(sum(v[i]), count(*))", "((sum(v[i])::BIGINT - ((sum(v[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*))")


_TEMPLATES = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(licenses.TEMPLATES))

SQL: dict[str, str] = {
    "op4_license_scans": rf"""
WITH d AS (SELECT doc_id, coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' || CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path, text FROM documents),
t(tid, license, unit) AS (VALUES {_TEMPLATES}),
u AS (SELECT DISTINCT doc_id, path, unit FROM (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS unit FROM d UNION ALL SELECT doc_id, path, unnest(string_split_regex(text, '{licenses.GAP}')) FROM d
  UNION ALL SELECT doc_id, path, text FROM d WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENSE_FILE}'))),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{licenses.TERM}'))) AS term FROM d UNION ALL SELECT unnest(list_distinct(regexp_extract_all(lower(unit), '{licenses.TERM}'))) FROM t) GROUP BY 1),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM d) + (SELECT count(*) FROM t)) / df::DOUBLE) AS idf FROM df),
tf AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '{licenses.TERM}')) AS term FROM (SELECT DISTINCT unit FROM u)) GROUP BY ALL),
tt AS (SELECT tid, license, term, count(*) AS tf FROM (SELECT tid, license, unnest(regexp_extract_all(lower(unit), '{licenses.TERM}')) AS term FROM t) GROUP BY ALL),
w AS (SELECT unit, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), v AS (SELECT tid, license, term, (1 + ln(tf)) * idf AS w FROM tt JOIN idf USING (term)),
wn AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), vn AS (SELECT tid, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1),
c AS (SELECT w.unit, v.license, round(sum(w.w * v.w) / (any_value(wn.norm) * any_value(vn.norm)), 6) AS cosine FROM w JOIN v USING (term) JOIN wn ON wn.unit = w.unit JOIN vn ON vn.tid = v.tid GROUP BY w.unit, v.tid, v.license),
o AS (SELECT * FROM (SELECT doc_id, license AS own_license, cosine, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) AS k FROM u JOIN c USING (unit) WHERE cosine >= {licenses.LEAST_COSINE}) WHERE k = 1),
f AS (SELECT d.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, cosine FROM d LEFT JOIN o ON o.doc_id = d.doc_id),
h AS (SELECT dir AS above, arg_min(own_license, path) AS dir_license FROM f WHERE own_license IS NOT NULL AND regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENSE_FILE}') GROUP BY 1),
r AS (SELECT * FROM (SELECT dir, above, dir_license, row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) AS k FROM (SELECT DISTINCT dir FROM f) JOIN h ON above = dir OR above = '' OR starts_with(dir, above || '/')) WHERE k = 1)
SELECT doc_id, path, own_license, cosine, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL AND dir_license IS NOT NULL THEN above END AS inherited_from FROM f LEFT JOIN r USING (dir)""",
    "op8_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id <> f.last, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op9_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, string_split(t, chr(10)) AS lines, len(string_split(t, chr(10))) - CASE WHEN t = '' OR t LIKE '%' || chr(10) THEN 1 ELSE 0 END AS n FROM d),
u AS (SELECT *, ('0x' || h[1:8])::UBIGINT % (n + 1) AS a, ('0x' || h[9:16])::UBIGINT % (n + 1) AS b, ('0x' || h[25:32])::UBIGINT % 100 AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' END AS plain FROM l),
w AS (SELECT *, least(a, b) AS low, greatest(a, b) AS high FROM u),
c AS (SELECT doc_id, n::BIGINT AS n, t, coalesce(plain, CASE WHEN s < 50 THEN 'spm' ELSE 'psm' END) AS form,
  CASE WHEN low = 0 THEN 0 WHEN low = len(lines) THEN length(t) ELSE length(array_to_string(lines[1:low], chr(10))) + 1 END AS p,
  CASE WHEN high = 0 THEN 0 WHEN high = len(lines) THEN length(t) ELSE length(array_to_string(lines[1:high], chr(10))) + 1 END AS q FROM w)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (q - p)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
    ELSE '<S>' || substr(t, q + 1) || '<P>' || left(t, p) || '<M>' || substr(t, p + 1, q - p) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c""",
    "op12_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|>' || '<|im_end|>') + 2 AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op13_centroid_clustering": f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS m FROM k QUALIFY c < 40),
{_lloyd(5)}
SELECT vec_id, c::INT AS cluster, best.far AS distance, (sum(best.far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(best.far) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM (SELECT *, best.c AS c FROM a5) JOIN m5 USING (c)""",
}
