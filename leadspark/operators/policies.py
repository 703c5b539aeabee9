"""Policy versions: manifests that name the active one, files that hold the content, and whether both agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nested import content_hash
from ..sources.readers import read_versions
from .evidence import bounded
from .rules import text_at


def policy_problems(manifests: DataFrame, versions: DataFrame) -> DataFrame:
    """(market, version, problem): manifests(market, version, hash) that versions(market, version, json) do not bear out.

    missing: no such version; json: its text is none; market: the content is of
    another market; hash: the content is not what was recorded. The hash is of the
    canonical form, so white space and the order of names do not count. A manifest
    may have several problems; of repeated rows each is told.
    """
    found = versions.select("market", "version", "json", F.lit(True).alias("there"))
    rows = manifests.select("market", "version", "hash").join(found, ["market", "version"], "left")
    v = F.try_parse_json("json")
    problems = F.array(
        F.when(F.col("there").isNull(), "missing"),
        F.when(F.col("there") & v.isNull(), "json"),
        F.when(v.isNotNull() & ~text_at(v, "marketId").eqNullSafe(F.col("market")), "market"),
        F.when(v.isNotNull() & ~content_hash(F.col("json")).eqNullSafe(F.col("hash")), "hash"),
    )
    return rows.select("market", "version", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def active_policies(spark: SparkSession, root: str) -> DataFrame:
    """(market, version, hash, json, file): the version that each market's manifest names, with null json where there is none.

    Manifests lie in root/active/market=<market>, versions in
    root/versions/market=<market>/version=<version>. The versions' folders are joined
    with the manifests' names at run time, so files of other versions are not opened.
    """
    manifests = spark.read.schema("version string, hash string, market string").json(f"{root}/active")
    # One key of both folders' names, so that the pair is pruned and not each name by itself.
    folder = F.concat("market", F.lit("/"), "version")
    named = manifests.where("version <> ''").select(folder.alias("folder"))
    held = read_versions(spark, f"{root}/versions").join(bounded(named), folder == F.col("folder"), "left_semi")
    return manifests.select("market", "version", "hash").join(held.hint("merge"), ["market", "version"], "left")


def write_policies(versions: DataFrame, manifests: DataFrame, root: str) -> None:
    """Files of versions(market, version, json) and manifests(market, version, hash) in the layout of active_policies()."""
    versions.select("market", "version", F.col("json").alias("value")).write.partitionBy("market", "version").text(f"{root}/versions")
    manifests.select("market", "version", "hash").write.partitionBy("market").json(f"{root}/active")
