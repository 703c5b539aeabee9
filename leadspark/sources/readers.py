"""Sources: log lines, reference dimensions, campaign blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "timestamp timestamp, level string, event string, service string, agent string, data map<string,string>"
PROFILE = "id string, displayName string, shortName string, domainSuffix string, callingCode string, cities array<string>, countryNameAliases array<string>, businessSuffixes array<string>"


def read_log(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Log records of daily line files below path (dt=YYYY-MM-DD/); lines that are no JSON object are left out. A day prunes the partitions."""
    lines = spark.read.text(path)
    if day:
        lines = lines.where(F.col("dt") == F.lit(day).cast("date"))
    return parse_log(lines)


def parse_log(lines: DataFrame) -> DataFrame:
    """Records of lines(value, ...): a bad line has no event and goes."""
    own = lines.withColumn("r", F.from_json("value", RECORD)).where("r.event is not null")
    return own.select(*[c for c in lines.columns if c != "value"], "r.*")


REPORTED = "timestamp string, level string, event string, agent string, message string, requestId string, sessionId string, campaignId string, error struct<message: string>, data string"


def parse_records(lines: DataFrame, time: str = "timestamp") -> DataFrame:
    """Records of lines(value) as log reports read them, data as JSON; lines that are no JSON object go, as does a last one cut short."""
    # A generator reads its argument once for a row; a filter on fields of a parsed column would be pushed below it and parse again.
    parsed = F.filter(F.array(F.from_json("value", REPORTED)), lambda r: r["event"].isNotNull() & r["timestamp"].isNotNull())
    own = lines.select(F.inline(parsed))
    names = {"ts": F.col("timestamp").try_cast(time), "request_id": F.col("requestId"), "session_id": F.col("sessionId"), "campaign_id": F.col("campaignId"), "error_message": F.col("error.message")}
    return own.select(*[c.alias(n) for n, c in names.items()], "level", "event", "agent", "message", "data")


def read_dimension(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row per JSON file, with its path; files of a schema folder are left out."""
    own = spark.read.option("multiLine", True).schema(schema).json(glob).withColumn("file", F.input_file_name())
    return own.where(~F.col("file").rlike("/schema/"))


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """(market, version, json, file): one row per file below path/market=<market>/version=<version>; filters on both prune folders."""
    own = spark.read.schema("value string, market string, version string").option("wholetext", True).text(path)
    return own.select("market", "version", F.trim("value").alias("json"), F.col("_metadata.file_path").alias("file"))


def manual_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Candidates a user typed in."""
    return spark.createDataFrame([(u, "manual") for u in urls], "url string, search_mode string")
