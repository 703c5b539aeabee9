"""Line deduplication: lines that many documents hold are dropped from all but one."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, fresh, small_batches
from .tokens import batch_parts

BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """Hash of a line's key (stripped, A-Z in lower case), or None below `least` code points."""
    key = line.strip(BLANK)
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return hashlib.md5(key.lower(), usedforsecurity=False).digest()


def _keys(least: int):
    def run(batches):
        for batch in (part for batch in batches for part in batch_parts(batch, "text")):
            rows, keys = [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                own = {line_key(x, least) for x in (text or b"").split(b"\n")} - {None}
                rows += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary())], ["doc_id", "k"])

    return run


def _rebuild(text_col: str, least: int, gone_col: str, names: list[str], counts: bool):
    def run(batches):
        for batch in (part for batch in batches for part in batch_parts(batch, text_col)):
            texts, lines, dropped = [], [], []
            at = batch.schema.get_field_index(text_col)
            for text, gone in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(gone_col).to_pylist(), strict=True):
                own = (text or b"").split(b"\n")
                kept = own
                if gone:
                    gone = set(gone)
                    kept = [x for x in own if line_key(x, least) not in gone]
                texts.append(text if len(kept) == len(own) else b"\n".join(kept))
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
            columns = {name: batch.column(name) for name in names}
            columns[text_col] = pa.array(texts, pa.binary()).cast(pa.string())
            if counts:
                columns |= {"n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, counts: bool = True) -> DataFrame:
    """docs with repeated lines dropped from the text and, with counts, n_lines and n_dropped appended.

    Texts are split at newlines. A line's key is the line without ASCII white space
    at its ends, with A-Z in lower case. Keys of at least `least_chars` code points
    that at least `least_docs` ids hold lose all their lines except in rows of the
    largest id that holds them; lines repeated inside those stay. Other lines
    stay in place. A null text stays null and counts as one empty line. Rows that
    repeat an id count as one document and are treated alike; rows without an id do
    not count and keep their lines. With counts, columns named n_lines and n_dropped
    are replaced; all others pass through. An empty table stays empty.
    """
    work = Scratch(docs.sparkSession, "lines")
    id_type = docs.schema[id_col].dataType.simpleString()
    own = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = work.table(own.mapInArrow(_keys(least_chars), f"doc_id {id_type}, k binary"), "keys")
    often = keys.where("doc_id is not null").distinct().groupBy("k").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_docs)
    often = work.table(often.select("k", "last"), "often")
    gone = keys.join(often.hint("merge"), "k").where("doc_id <> last").groupBy("doc_id").agg(F.collect_set("k").alias("gone"))
    gone = work.table(gone, "gone")
    id_name, gone_name = fresh(docs, "gone_id"), fresh(docs, "gone_keys")
    gone = gone.select(F.col("doc_id").alias(id_name), F.col("gone").alias(gone_name))
    more = [T.StructField(x, T.LongType()) for x in ("n_lines", "n_dropped") if counts]
    fields = [f for f in docs.schema.fields if f.name.lower() not in {x.name for x in more}]
    schema = T.StructType([*fields, *more])
    rows = docs.join(gone.hint("merge"), docs[id_col] == F.col(id_name), "left").drop(id_name)
    return rows.mapInArrow(_rebuild(text_col, least_chars, gone_name, [f.name for f in fields], counts), schema)
