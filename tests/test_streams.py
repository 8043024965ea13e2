"""Streams with state on files that arrive one after the other, and the text index."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from dossier.streaming import live

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def played(spark, tmp_path, schema, batches, build, name):
    """The rows that come out when each batch of rows is a file of its own."""
    folder = tmp_path / name
    folder.mkdir()
    for k, rows in enumerate(batches):
        (folder / f"{k:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{k:03d}.json", (k + 1, k + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}.state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def at(seconds):
    return (T0 + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def event(kind, seconds, id=None, owner=None, type="scan", **more):
    return {"type": type, "id": id, "at": at(seconds), "event": kind, "owner": owner, **more}


def story(rows):
    seconds = lambda t: round((t.replace(tzinfo=timezone.utc) - T0).total_seconds())
    return [(r.id, seconds(r.at), r.state, r.attempts, r.owner, r.why) for r in sorted(rows, key=lambda r: (r.at, r.id, r.state))]


def test_jobs_are_claimed_once_oldest_first(stateful, tmp_path):
    batches = [
        [event("enqueue", 0, "b"), event("enqueue", 1, "a"), event("enqueue", 1, "other", type="text"), event("enqueue", 2, "a")],
        [event("claim", 5, owner="w1"), event("claim", 6, owner="w2"), event("claim", 7, owner="w3")],
        [event("done", 8, "b", "w2"), event("done", 9, "b", "w1"), event("done", 10, "b", "w1"), event("fail", 11, "a", "w2", note="disk")],
        [event("claim", 12, owner="w3"), event("fail", 13, "a", "w3", no_retry=True), event("claim", 14, owner="w1")],
    ]
    got = played(stateful, tmp_path, live.EVENT, batches, live.live_jobs, "claims")
    assert story([r for r in got if r.type == "scan"]) == [
        ("b", 0, "queued", 0, None, "enqueued"),
        ("a", 1, "queued", 0, None, "enqueued"),
        ("b", 5, "running", 1, "w1", "claimed"),
        ("a", 6, "running", 1, "w2", "claimed"),
        ("b", 9, "done", 1, "w1", "done"),
        ("a", 11, "queued", 1, None, "disk"),
        ("a", 12, "running", 2, "w3", "claimed"),
        ("a", 13, "failed", 2, "w3", "fail"),
    ]
    assert [r.id for r in got if r.type == "text"] == ["other"]


def test_stale_jobs_are_queued_again_and_fail_after_five_attempts(stateful, tmp_path):
    batches = [[event("enqueue", 0, "j")]]
    now = 0
    for k in range(5):
        batches.append([event("claim", now + 1, owner=f"w{k}")])
        if k == 0:
            batches.append([event("heartbeat", now + 60, "j", "w0"), event("heartbeat", now + 70, "j", "someone else")])
            now += 59
        batches.append([event("claim", now + 1 + 95, owner="late", type="tick")])  # moves the watermark past the timer
        batches.append([event("claim", now + 1 + 96, owner="late", type="tick")])
        now += 100
    batches.append([event("done", now, "j", "w4")])
    got = story(r for r in played(stateful, tmp_path, live.EVENT, batches, live.live_jobs, "stale") if r.type == "scan")
    assert [(s, n, why) for _, _, s, n, _, why in got] == [("queued", 0, "enqueued")] + [x for k in range(1, 6) for x in (("running", k, "claimed"), ("queued" if k < 5 else "failed", k, "stale"))]
    assert [t for _, t, _, _, _, why in got if why == "stale"][0] == 150  # 90 s after the heartbeat at 60 s, not after the claim


def test_cancelled_jobs_end(stateful, tmp_path):
    batches = [
        [event("enqueue", 0, "q"), event("cancel", 1, "q"), event("claim", 2, owner="w"), event("enqueue", 3, "r"), event("claim", 4, owner="w"), event("cancel", 5, "r")],
        [event("done", 6, "r", "w"), event("enqueue", 7, "r")],
        [event("enqueue", 90_000, "x")],
        [event("enqueue", 90_001, "y")],
        [event("enqueue", 90_002, "q"), event("enqueue", 90_003, "r")],
    ]
    got = story(played(stateful, tmp_path, live.EVENT, batches, live.live_jobs, "cancels"))
    assert [(i, s) for i, t, s, *_ in got if t < 90_000] == [("q", "queued"), ("q", "cancelled"), ("r", "queued"), ("r", "running"), ("r", "cancelling"), ("r", "cancelled")]
    assert [(i, s) for i, t, s, *_ in got if t >= 90_002] == [("q", "queued"), ("r", "queued")]  # a day later both are forgotten, and may come again


def test_sessions_and_sliding_windows(spark, tmp_path):
    rows = [[{"key": "a", "at": at(60 * m)} for m in (0, 10, 50, 55)] + [{"key": "b", "at": at(60 * 5)}], [{"key": "a", "at": at(60 * 200)}], [{"key": "b", "at": at(60 * 201)}], [{"key": "a", "at": at(60 * 20)}], [{"key": "b", "at": at(60 * 500)}], [{"key": "b", "at": at(60 * 501)}]]
    minutes = lambda t: round((t.replace(tzinfo=timezone.utc) - T0).total_seconds() / 60)
    got = played(spark, tmp_path, "key string, at timestamp", rows, lambda s: live.sessions(s, "key"), "sessions")
    assert sorted((r.key, minutes(r.start), minutes(r.end), r.n) for r in got) == [("a", 0, 40, 2), ("a", 50, 85, 2), ("a", 200, 230, 1), ("b", 5, 35, 1), ("b", 201, 231, 1)]  # what came at 20 was late
    got = played(spark, tmp_path, "key string, at timestamp", rows, lambda s: live.sliding(s, "key"), "sliding")
    found = {(r.key, minutes(r.start), r.n) for r in got if minutes(r.start) <= 60 and r.key == "a"}
    assert found == {("a", s, sum(s <= m < s + 60 for m in (0, 10, 50, 55))) for s in range(-45, 60, 15)} - {("a", s, 0) for s in range(-60, 90, 15)}


def test_text_index_finds_what_a_scan_finds(spark, tmp_path):
    from dossier.operators import search
    from dossier.operators.text_index import TextIndex

    docs = spark.range(3000).select("id", F.concat(F.lit("Common words "), F.when(F.col("id") % 500 == 7, "Zyxquark ").otherwise(""), F.format_string("item%04d", "id"), F.when(F.col("id") == 11, F.lit(None)).otherwise(F.lit(" Größe"))).alias("text"))
    index = TextIndex.build(docs, F.col("text"), str(tmp_path / "index"), "id", per_file=100)
    files = len(list((tmp_path / "index/rows").glob("*.parquet")))
    assert files >= 25
    for query in ("zyxquark", "item0123", "common GRÖSSE", "größe item29", "no such thing", "it", "", "zyx item0507", "mm"):
        want = sorted(r.id for r in docs.where(search.has_all(F.col("text"), search.tokens(query))).collect())
        found = index.search(query)
        assert sorted(r.id for r in found.collect()) == want and found.columns == ["id", "text"]
    assert len(index.search("item0123").inputFiles()) <= 3 and len(index.search("zyxquark").inputFiles()) == 6
    assert len(index.search("it").inputFiles()) == files and index.files_of(["nosuchthing"]) == []
