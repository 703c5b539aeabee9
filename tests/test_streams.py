"""Streaming jobs against their batch counterparts, with restarts and late parts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leadspark.operators import logs, rounds
from leadspark.sources import readers
from leadspark.streaming import jobs

HITS = "campaign string, grp string, round long, domain string"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)


def some_hits(seed):
    rng = random.Random(seed)
    return [(c, g, r, f"d{rng.randrange(40 if g == 'x' else 400)}") for c in ("a", "b") for g in ("x", "y") for r in range(12) for _ in range(rng.randrange(1, 12))]


def run(spark, path, files, **options):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, HITS).coalesce(1).write.mode("append").parquet(f"{path}/landing")
    stream = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).parquet(f"{path}/landing")
    jobs.run_to_end(jobs.discovery_state(stream, buckets=3, **options), f"{path}/out", f"{path}/state", "append")
    return spark.read.parquet(f"{path}/out")


def test_discovery_state_follows_the_replay_round_by_round(spark, rocks, tmp_path):
    hits = spark.createDataFrame(some_hits(1), HITS)
    replayed = {(r.campaign, r.grp, r["round"]): r.new for r in rounds.replay_saturation(hits, low_new=2).collect() if r.executed}
    ran = [h for h in some_hits(1) if h[:3] in replayed]
    assert len(ran) < len(some_hits(1))
    # Three rounds of each group a batch; after each batch the state is what the replay says of the rounds so far.
    files = [[h for h in ran if h[2] // 3 == i] for i in range(4)]
    states = run(spark, tmp_path, files, low_new=2)
    for batch in range(4):
        got = {(r.campaign, r.grp): r for r in jobs.discovery_groups(states.where(F.col("batch") <= batch)).collect()}
        for (campaign, grp), r in got.items():
            new = [n for (c, g, i), n in sorted(replayed.items()) if (c, g) == (campaign, grp) and i // 3 <= batch]
            streak = next((k for k, n in enumerate(reversed(new)) if n > 2), len(new))
            raw = sum(h[:2] == (campaign, grp) and h[2] // 3 <= batch for h in ran)
            assert (r.executed, r.raw, r.new, r.repeats, r.last_new, r.streak, r.saturated) == (len(new), raw, sum(new), raw - sum(new), new[-1], streak, streak >= 3)
    status = {r.campaign: r.reason for r in jobs.discovery_status(states, 1000).collect()}
    done = {c: all(r.saturated for r in jobs.discovery_groups(states).where(F.col("campaign") == c).collect()) for c in ("a", "b")}
    assert status == {c: "all_groups_saturated" if d else "running" for c, d in done.items()}
    assert {r.reason for r in jobs.discovery_status(states, 3).collect()} == {"max_queries"}


def test_discovery_state_survives_restarts_and_late_parts(spark, rocks, tmp_path):
    rows = some_hits(2) + [(None, "x", 1, "d"), ("a", "x", 1, None)]
    mixed = rows[:]
    random.Random(3).shuffle(mixed)  # parts of rounds in any order
    parts = [mixed[i::3] for i in range(3)]
    whole = lambda df: sorted(map(tuple, jobs.discovery_groups(df).collect()))
    want = whole(run(spark, tmp_path / "once", [rows]))
    run(spark, tmp_path / "twice", parts[:1])
    assert whole(run(spark, tmp_path / "twice", parts[1:])) == want
    assert sum(r[4] for r in want) == len({(h[0], h[3]) for h in rows if None not in h})


def line(second, event, level="info", data=None, **more):
    return json.dumps({"timestamp": f"2024-01-01T00:00:{second:02d}.5Z", "level": level, "event": event, "data": data or {}, **more})


SOME_LINES = [
    line(3, "http.request.completed", data={"statusCode": 200, "durationMs": 10}),
    line(1, "http.request.completed", data={"statusCode": 503, "durationMs": 15.5}, message="down", error={"message": "no route"}, requestId="r1"),
    line(2, "http.request.completed", data={"statusCode": "404", "durationMs": "99"}),
    line(4, "agent.trace.recorded", agent="scout", data={"durationMs": 7}),
    line(5, "orchestrator.agent.completed", data={"durationMs": 8}),
    line(6, "agent.run.failed", level="error", message="broke", sessionId="s", campaignId="c"),
    line(7, "search.serper.completed", data={"hitCount": 4}),
    line(8, "search.serper.cache_hit", data={"hitCount": 50}),
    line(8, "crawler.completed", data={"pageCount": 3, "contactCandidateCount": 2, "durationMs": None}),
    line(9, "crawler.inflight_reused"),
    line(10, "pipeline.campaign.completed", data={"leadCount": 5, "qualified": 2, "needsReview": 1, "rejected": 2, "analysisFailures": 1}),
    line(11, "discovery.candidate.retry_scheduled", level="warn"),
    line(12, "orchestrator.execution.failed", level="error", error={"name": "x"}),
    line(13, "unheard.of", data=[1, 2]),
    "", "[]", "null", '{"timestamp": "2024-01-01T00:00:50Z", "level": "in', '{"event": "no.time"}',
    '{"timestamp": "2024-01-01T00:00:14Z", "event": "no.level", "data": "text"}',
]


def records(spark, lines):
    return readers.parse_records(spark.createDataFrame([(x,) for x in lines], "value string"))


def figures(df):
    return {(r.part, r.name): r.value if r.part != "period" else str(r["at"]) for r in df.collect()}


def test_report_has_every_part(spark):
    got = figures(logs.report(logs.log_state(records(spark, SOME_LINES))))
    want = {
        ("total", "records"): 15, ("http", "requests"): 3, ("http", "failed"): 1, ("http", "average_ms"): 9, ("http", "maximum_ms"): 15.5,
        ("http_status", "0"): 1, ("http_status", "200"): 1, ("http_status", "503"): 1, ("agents", "completed"): 2, ("agents", "failed"): 1,
        ("agents", "average_ms"): 8, ("by_agent", "scout"): 1, ("by_agent", "unknown"): 1, ("search", "requests"): 1, ("search", "cache_hits"): 1,
        ("search", "returned_hits"): 4, ("search", "failed"): 0, ("crawler", "completed"): 1, ("crawler", "failed"): 0, ("crawler", "cache_hits"): 1,
        ("crawler", "average_ms"): 0, ("crawler", "pages"): 3, ("crawler", "contact_candidates"): 2, ("campaigns", "completed"): 1, ("campaigns", "leads"): 5,
        ("campaigns", "qualified"): 2, ("campaigns", "needs_review"): 1, ("campaigns", "rejected"): 2, ("campaigns", "analysis_failures"): 1,
        ("campaigns", "retries"): 1, ("orchestrator", "sessions_created"): 0, ("orchestrator", "executions_failed"): 1, ("levels", "error"): 2,
        ("levels", "warn"): 1, ("levels", "unknown"): 1, ("events", "http.request.completed"): 3, ("events", "unheard.of"): 1,
        ("period", "from"): "2024-01-01 00:00:01.500000", ("period", "to"): "2024-01-01 00:00:14",
    }
    assert {k: v for k, v in got.items() if k in want} == want
    errors = logs.newest(logs.error_records(records(spark, SOME_LINES))).collect()
    assert [(r.event, r.message, r.request_id, r.session_id, r.campaign_id) for r in errors] == [
        ("orchestrator.execution.failed", None, None, None, None), ("agent.run.failed", "broke", None, "s", "c"), ("http.request.completed", "no route", "r1", None, None)]


def test_report_of_nothing(spark):
    got = figures(logs.report(logs.log_state(records(spark, [""]))))
    assert got["total", "records"] == 0 and got["http", "average_ms"] == 0 and got["period", "from"] == "None" and ("levels", "info") not in got


def test_states_merge_in_any_order(spark):
    want = figures(logs.report(logs.log_state(records(spark, SOME_LINES))))
    parts = [logs.log_state(records(spark, SOME_LINES[i::3])) for i in range(3)]
    assert figures(logs.report(logs.merged_states(parts[2].unionByName(logs.merged_states(parts[0].unionByName(parts[1])))))) == want


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    path = f"{tmp_path}/report"
    rows = SOME_LINES * 3
    for number in (0, 0, 1, 2, 2, 3, 3):  # as after a crash between the write and the commit of a batch
        jobs.fold_report(records(spark, rows[number::4]), number, path, errors=4)
        if number == 0:
            first = figures(jobs.kept_report(spark, path)[0])
            assert first == figures(logs.report(logs.log_state(records(spark, rows[0::4]))))
    report, errors = jobs.kept_report(spark, path)
    assert figures(report) == figures(logs.report(logs.log_state(records(spark, rows))))
    assert sorted(map(str, errors.collect())) == sorted(map(str, logs.newest(logs.error_records(records(spark, rows)), 4).collect()))


def test_report_of_a_stream_goes_on_after_a_restart(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(x,) for x in SOME_LINES], "value string").repartition(3).write.mode("append").text(f"{tmp_path}/landing")
        lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(f"{tmp_path}/landing")
        jobs.report_to_end(readers.parse_records(lines), f"{tmp_path}/report", f"{tmp_path}/offsets")
        got = figures(jobs.kept_report(spark, f"{tmp_path}/report")[0])
        assert got == figures(logs.report(logs.log_state(records(spark, SOME_LINES * (i + 1)))))


def test_a_log_line_is_parsed_once(spark):
    from leadspark.sources.readers import parse_records

    plan = parse_records(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
