"""Streaming jobs: log metrics, cross-round dedupe, and discovery state per campaign."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import logs as logs_of
from ..operators.rounds import LOW_NEW, SATURATED, stop_reason

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def log_metrics(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and durations by event and hour; hours stay open for `late` (the window is this library's addition)."""
    own = logs.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event")
    return own.agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms")).select(F.col("w.start").alias("hour"), "event", "n", "total_ms")


def new_companies(hits: DataFrame, ttl: str | None = None) -> DataFrame:
    """The first hit of each campaign and domain; with a ttl, keys are forgotten after it."""
    if ttl:
        return hits.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["campaign", "domain"])
    return hits.dropDuplicates(["campaign", "domain"])


class FirstPlaces(StatefulProcessor):
    """Where each domain of one bucket of a campaign was seen first: (round, grp), the order in which rounds run."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "domain string", "round long, grp string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        raw: Counter = Counter()
        new: Counter = Counter()
        least: dict[str, tuple[int, str]] = {}
        for pdf in rows:
            for domain, round_, grp in zip(pdf["domain"], pdf["round"], pdf["grp"], strict=True):
                place = int(round_), grp
                raw[place] += 1
                least[domain] = min(place, least.get(domain, place))
        for domain, place in least.items():
            held = self.first.getValue((domain,))
            if held is None or place < tuple(held):
                self.first.updateValue((domain,), place)
                new[place] += 1
                if held is not None:  # an earlier round came late: the find moves to it
                    new[tuple(held)] -= 1
        places = sorted(raw | {p: 0 for p in new})
        yield pd.DataFrame({"campaign": key[0], "grp": [g for _, g in places], "round": [r for r, _ in places], "raw": [raw[p] for p in places], "new": [new[p] for p in places]})

    def close(self) -> None:
        pass


class GroupYield(StatefulProcessor):
    """Rounds of a query group: hits and new domains of each, and the streak of poor rounds at the end."""

    def __init__(self, low_new: int, low_rate: float, saturated: int, ttl_ms: int | None):
        self.low_new, self.low_rate, self.saturated, self.ttl_ms = low_new, low_rate, saturated, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rounds = handle.getMapState("rounds", "round long", "raw long, new long", self.ttl_ms)
        self.updates = handle.getValueState("updates", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = {k[0]: (v[0], v[1]) for k, v in self.rounds.iterator()}
        for pdf in rows:
            for round_, raw, new in zip(pdf["round"], pdf["raw"], pdf["new"], strict=True):
                held = known.get(int(round_), (0, 0))
                known[int(round_)] = held[0] + int(raw), held[1] + int(new)
                self.rounds.updateValue((int(round_),), known[int(round_)])
        streak = 0
        for at in sorted(known, reverse=True):
            raw, new = known[at]
            if new > self.low_new and new > self.low_rate * raw:
                break
            streak += 1
        n = (self.updates.get()[0] if self.updates.exists() else 0) + 1
        self.updates.update((n,))
        raw, new = (sum(x[i] for x in known.values()) for i in (0, 1))
        yield pd.DataFrame({"campaign": [key[0]], "grp": [key[1]], "seq": [n], "executed": [len(known)], "raw": [raw], "new": [new], "repeats": [raw - new], "last_new": [known[max(known)][1]], "streak": [streak], "saturated": [streak >= self.saturated]})

    def close(self) -> None:
        pass


PLACES = "campaign string, grp string, round long, raw long, new long"
GROUPS = "campaign string, grp string, seq long, executed long, raw long, new long, repeats long, last_new long, streak long, saturated boolean"


def discovery_state(hits: DataFrame, buckets: int = 64, low_new: int = LOW_NEW, low_rate: float = 0.0, saturated: int = SATURATED, ttl_ms: int | None = None) -> DataFrame:
    """GROUPS rows of the hits(campaign, grp, round, domain) so far, for every group that a micro-batch touches.

    Two stateful operators in a chain: one keyed by campaign and bucket of domains,
    which knows where each domain was seen first, and one keyed by group, which adds
    up rounds; so no campaign sits in one task. A round is poor if at most low_new
    of its domains, or low_rate of its hits, are new; `saturated` poor rounds in a
    row at the end saturate the group. seq counts a group's rows: the highest is its state. Rounds
    may come in parts and late: the state is that of all hits so far in the order of
    (round, grp). Hits with a null in these columns are left out. With ttl_ms, what
    was not touched for so long is forgotten; Spark then goes on with batches without
    data, so such a query runs until it is stopped.
    """
    mode = "ProcessingTime" if ttl_ms else "None"
    own = hits.select("campaign", "grp", F.col("round").cast("long").alias("round"), "domain").dropna()
    own = own.withColumn("bucket", F.pmod(F.xxhash64("domain"), F.lit(buckets)))
    places = own.groupBy("campaign", "bucket").transformWithStateInPandas(FirstPlaces(ttl_ms), PLACES, "Append", mode)
    return places.groupBy("campaign", "grp").transformWithStateInPandas(GroupYield(low_new, low_rate, saturated, ttl_ms), GROUPS, "Append", mode)


def discovery_groups(states: DataFrame) -> DataFrame:
    """The last state of each group of discovery_state()'s rows."""
    names = ["executed", "raw", "new", "repeats", "last_new", "streak", "saturated"]
    return states.groupBy("campaign", "grp").agg(F.max_by(F.struct(*names), "seq").alias("s")).select("campaign", "grp", "s.*")


def discovery_status(states: DataFrame, max_queries: int) -> DataFrame:
    """(campaign, executed, reason): why each campaign stops, or running; a plan that has ended is for its planner to know."""
    own = stop_reason(discovery_groups(states), "campaign", "executed", "saturated", max_queries)
    return own.withColumn("reason", F.when(F.col("reason") == "plan_exhausted", "running").otherwise(F.col("reason")))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Runs over all that there is and stops; a batch's folder is named by its number, so a repeated batch replaces itself."""

    def save(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def _slots(spark: SparkSession, path: str, before: int | None = None) -> tuple[int | None, int]:
    """(slot of the last batch, or of the last one before a number, and the slot to write next)."""
    held = {r.slot: r.batch for r in spark.read.parquet(path).groupBy("slot").agg(F.max("batch").alias("batch")).collect()}
    known = {slot: batch for slot, batch in held.items() if before is None or batch < before}
    last = max(known, key=known.get, default=None)
    return last, 1 - last if last is not None else 0


def _fold(rows: DataFrame, merge, path: str, number: int) -> None:
    """Writes merge(what was held before batch `number`, and its rows) beside what was held.

    Two slots take turns: the one of the batch before is only read, so a batch that
    runs again finds the same and gives the same.
    """
    last, target = _slots(rows.sparkSession, path, number) if number else (None, 0)
    if last is not None:
        rows = rows.unionByName(rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/slot={last}"))
    merge(rows).withColumn("batch", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{path}/slot={target}")


def fold_report(records: DataFrame, number: int, path: str, errors: int = 20) -> None:
    """Adds a batch of records to the report kept at path; running a batch again changes nothing.

    What is kept does not grow with the records: the state of logs.log_state() and the
    newest errors.
    """
    records.persist()
    try:
        _fold(logs_of.log_state(records), logs_of.merged_states, f"{path}/state", number)
        _fold(logs_of.error_records(records), lambda rows: logs_of.newest(rows, errors), f"{path}/errors", number)
    finally:
        records.unpersist()


def kept_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(figures, newest errors) of all batches folded so far."""
    state, errors = (spark.read.parquet(f"{path}/{name}/slot={_slots(spark, f'{path}/{name}')[0] or 0}").drop("batch") for name in ("state", "errors"))
    return logs_of.report(state), errors


def report_to_end(records: DataFrame, path: str, checkpoint: str) -> None:
    """Folds all that a stream of records has into the report at path, and stops."""
    query = records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, number: fold_report(df, number, path)).start()
    query.awaitTermination()
