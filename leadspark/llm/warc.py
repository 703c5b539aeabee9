"""WARC archives: writing, normalising a monolithic gzip, and reading by offset index.

A monolithic archive is one gzip stream over a whole file, which cannot be entered
in the middle. The normaliser inflates that stream once, rewrites every record as
a gzip member of its own, and writes a sidecar index of member offsets beside it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

END = "\r\n\r\n"
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Records in one archive at most: keeps a file well below what one task can hold.
RECORDS_PER_FILE = 20_000
CHUNK = 1 << 20

INDEX = "file string, offset long, length long, record_id string, record_type string, refers_to string, uri string, payload_bytes long, payload_digest string"


def choose_revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, those with the
    smallest page_id are responses and the others revisits of it. Null html counts
    as empty; rows that repeat payload and smallest page_id are all responses; a null
    page_id is never the smallest while there is another. An empty table stays empty.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    first = own.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("payload_bytes").alias("payload_bytes"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    # Joined on one column more than the grouping, so both sides have exchanges that can be split.
    out = own.join(first.hint("merge"), ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record_text(date: str):
    """A WARC record as a column: headers, HTTP headers, and the payload of a response."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    uri = F.regexp_replace("url", r"[\s\x00-\x1F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", uri)),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
        http,
        body,
    )


def write_monolithic(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row; every file is one gzip stream. Column html is the payload; null counts as empty."""
    records = choose_revisits(pages).select(record_text(date).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(stream: io.BufferedIOBase):
    """(bytes of the record, headers, HTTP headers, payload) of every record of an inflated archive."""
    while True:
        lines = []
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        while line not in (b"\r\n", b"\n", b""):
            lines.append(line)
            line = stream.readline()
        head = dict(x.decode("utf-8", "replace").rstrip("\r\n").split(": ", 1) for x in lines[1:] if b": " in x)
        block = stream.read(int(head.get("Content-Length", 0)))
        http, _, payload = block.partition(b"\r\n\r\n")
        yield b"".join(lines) + b"\r\n" + block + END.encode(), head, http, payload


def _urn(value: str | None) -> str | None:
    return value[len("<urn:page:") : -1] if value else None


def _describe(head: dict, http: bytes) -> dict:
    length = re.search(rb"(?i)content-length: *(\d+)", http)
    return {
        "record_id": _urn(head.get("WARC-Record-ID")),
        "record_type": head.get("WARC-Type"),
        "refers_to": _urn(head.get("WARC-Refers-To")),
        "uri": head.get("WARC-Target-URI"),
        "payload_bytes": int(length[1]) if length else 0,
        "payload_digest": head.get("WARC-Payload-Digest", "").removeprefix("sha256:"),
    }


def place(target: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", target))


def _normalise(target: str, level: int):
    def run(batches):
        store, folder = place(target)
        store.create_dir(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = hashlib.sha256(path.encode()).hexdigest()[:20]
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                index, offset = [], 0
                origin, name_there = place(path)
                with origin.open_input_stream(name_there, compression=None, buffer_size=CHUNK) as archive, store.open_output_stream(f"{part}.gz", compression=None) as out:
                    for record, head, http, _ in parse(io.BufferedReader(gzip.GzipFile(fileobj=archive), CHUNK)):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = squeeze.compress(record) + squeeze.flush()
                        out.write(member)
                        index.append({"file": f"{name}.warc.gz", "offset": offset, "length": len(member)} | _describe(head, http))
                        offset += len(member)
                with store.open_output_stream(f"{part}.idx", compression=None) as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                # A repeated task writes the same bytes and moves them over those of its forerunner.
                store.move(f"{part}.gz", f"{folder}/{name}.warc.gz")
                store.move(f"{part}.idx", f"{folder}/{name}.jsonl")
                yield pa.RecordBatch.from_pydict({"file": [f"{name}.warc.gz"], "records": [len(index)], "bytes": [offset]}, pa.schema({"file": pa.string(), "records": pa.int64(), "bytes": pa.int64()}))

    return run


def normalise(spark, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrites every archive below source with a member per record, and an index per archive, into target.

    Returns (file, records, bytes), one row per archive. Runs at once. An archive
    is read by one task as a stream, inflated once, and written record by record, so
    that a task holds one record and the index entries of its archive. Empty files
    are passed over; a source without archives gives an empty result. Archives must
    be in a store that pyarrow.fs opens by its URI.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).where(F.col("length") > 0).select("path")
    done = files.mapInArrow(_normalise(target, level), "file string, records long, bytes long")
    return Scratch(spark, "warc-files").table(done, "files")


def _members(target: str):
    def run(batches):
        store, folder = place(target)
        for batch in batches:
            rows = batch.to_pylist()
            out, opened, name = [], None, None
            for r in rows:
                if r["file"] != name:
                    if opened:
                        opened.close()
                    opened, name = store.open_input_file(f"{folder}/{r['file']}"), r["file"]
                member = opened.read_at(r["length"], r["offset"])
                for _, head, http, payload in parse(io.BytesIO(zlib.decompress(member, 31))):
                    own = _describe(head, http)
                    if own["record_type"] == "response":
                        own |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
                    out.append({k: r[k] for k in ("file", "offset", "length")} | own)
            if opened:
                opened.close()
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return run


def read_members(spark, target: str) -> DataFrame:
    """A row per record of the normalised archives, each read at its offset; response digests are taken of what was read.

    Headers that a record lacks are null; repeated records have a row each. target
    must hold an index, and an empty index has no rows.
    """
    index = spark.read.schema(INDEX).json(f"{target}/*.jsonl")
    return index.mapInArrow(_members(target), INDEX)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, uri, file, offset, length) per page, read back.

    Null html is an empty payload, a null url gives no target URI and a null
    page_id an empty record id; rows that repeat a page_id have a record each;
    rows that repeat payload and page_id of the first are responses too. Further
    columns are not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    work = Scratch(spark, "warc")
    whole, parts = work.path("monolithic"), work.path("normalised")
    write_monolithic(pages, whole)
    store, folder = place(parts)
    store.create_dir(folder)
    normalise(spark, whole, parts)
    work.drop(whole)
    if not any(x.path.endswith(".jsonl") for x in store.get_file_info(fs.FileSelector(folder))):
        index = spark.createDataFrame([], INDEX)
    else:
        index = read_members(spark, parts)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long").alias
    return index.select(number("record_id")("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to")("refers_to"), "uri", "file", "offset", "length")
