"""The corpus pipeline: documents through five filters and encoders, each stage a written table.

Every stage takes empty tables, null ids and texts, repeated rows and further columns
of any name; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm.decontaminate import drop_contaminated
from leadspark.llm.line_dedup import dedup_lines
from leadspark.llm.ngram_join import keep_one_per_group
from leadspark.llm.pieces import sampled_pieces
from leadspark.llm.scratch import Scratch
from leadspark.llm.toxicity import calibrate, drop_toxic, fit


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches their language's threshold. Null and empty texts stay, unless the model rejects what has no words; rows that repeat an id or text are judged each."""
    every, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return drop_toxic(docs, calibrate(fit(every, labels, aside=True), every, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that at least three documents hold from all but one; n_chars follows the text. No row goes; null texts stay null, and rows that repeat an id count as one document."""
    out = dedup_lines(docs, counts=False)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by five-word shingles at a similarity of 0.8. Texts without words are in no group; of rows that repeat an id only those in another's group go, and rows alike in id and text stay or go together."""
    return keep_one_per_group(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Null and empty texts stay; rows that repeat an id are judged each."""
    return drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids): a seeded segmentation of every document that is left; null and empty texts have no pieces."""
    return sampled_pieces(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", pieces),
]

#: SQL can express neither the classifier nor the sampler; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next stage's docs."""
    work = Scratch(spark, "pipeline")
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
