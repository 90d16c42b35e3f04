import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import state, usage
from lodestone.sources import shared
from lodestone.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_counters_match_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    schema = batch.schema
    live = jobs.tail_parquet(spark, SF, schema, pattern="events.parquet")
    counts = jobs.live_counters(live, "user_id", "event_type", "event_id")
    jobs.run_once(counts, "live_counts", "complete", str(tmp_path / "c"))
    want = batch.groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.sum("event_id").alias("returned"))
    assert spark.table("live_counts").exceptAll(want).count() == 0 and spark.table("live_counts").count() == want.count()


def test_limiter_matches_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    live = jobs.tail_parquet(spark, str(tmp_path / "in"), batch.schema, files_per_trigger=1000)
    jobs.run_once(jobs.limiter_stream(live, "user_id", seconds=36_000), "live_status", "append", str(tmp_path / "c"))
    want = usage.limiter_status(batch, "user_id", seconds=36_000)
    assert spark.table("live_status").exceptAll(want).count() == 0 and want.count() == spark.table("live_status").count()


def test_upserts(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), spark.createDataFrame([], "k int, v int").schema
    write = jobs.upsert_into(folder, ["k"], ["v"], merge_every=2)
    now = lambda upto=None: {(r["k"], r["v"]) for r in jobs.read_latest(spark, folder, ["k"], ["v"], schema, upto).collect()}
    assert now() == set()
    for epoch, rows in enumerate(([(1, 1), (2, 5)], [(1, 3), (2, 4)], [(3, 1)], [(1, 9)])):
        write(spark.createDataFrame(rows, schema), epoch)
        write(spark.createDataFrame(rows, schema), epoch)  # a batch is repeated after a failure
    assert now(1) == {(1, 3), (2, 5)} and now() == {(1, 9), (2, 5), (3, 1)}
    assert shared.complete_versions(spark, f"{folder}/full") == [2]


def drained(frame, name, mode, tmp_path):
    jobs.run_once(frame, name, mode, str(tmp_path / f"{name}-c"))
    return frame.sparkSession.table(name)


def as_stream(spark, frame, folder, pieces):
    """The rows as files, one micro-batch each, in the order of their time."""
    rows = frame.collect()
    for k in range(pieces):
        part = rows[k * len(rows) // pieces : (k + 1) * len(rows) // pieces]
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)
    return jobs.tail_parquet(spark, str(folder), frame.schema, files_per_trigger=1)


def timed(spark, rows, schema):
    frame = spark.createDataFrame(rows, f"event_id long, sec double, {schema}")
    return frame.withColumn("ts", F.timestamp_micros((F.lit(1_700_000_000_000_000) + F.col("sec") * 1_000_000).cast("long"))).drop("sec").orderBy("ts", "event_id")


def same_rows(a, b):
    assert sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


def test_reuse_matches_batch_beyond_its_entries(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, k * 3.0 + (2000 if k > 300 else 0), rng.choice("ab"), f"q{rng.randrange(90)}", rng.choice("xy")) for k in range(420)]
    batch = timed(spark, rows, "s string, q string, d string")
    live = as_stream(spark, batch, tmp_path / "in", 3)
    got = drained(jobs.reuse_stream(live, "s", "q", "d"), "live_reuse", "append", tmp_path)
    want = state.reused(batch, "s", "q", "d", "ts", "event_id").join(batch, "event_id").select("s", "event_id", "reused")
    same_rows(got, want)
    held, out = {"a": state.ReuseMap(), "b": state.ReuseMap()}, {}
    for k, sec, s, q, d in rows:
        out[k] = held[s].seen(q, d, int(sec * 1e6))
        assert len(held[s].held) <= 64
    assert {r["event_id"]: r["reused"] for r in got.collect()} == out and any(out.values())


def test_reuse_counts_from_when_a_result_was_stored():
    m = state.ReuseMap()
    minute = 60_000_000
    assert [m.seen("k", "d", t * minute) for t in (0, 6, 9, 10, 12)] == [False, True, True, False, True]
    assert not m.seen("k", "e", 13 * minute) and m.seen("k", "e", 14 * minute)
    small = state.ReuseMap(entries=2)
    assert [small.seen(k, "d", t) for t, k in enumerate("abcab")] == [False] * 5 and len(small.held) == 2


@pytest.mark.parametrize("limit", [state.LOG_BYTES, state.CAPTURE_BYTES])
def test_newest_bytes_at_the_limits(limit):
    k = state.KeepLast(limit)
    k.write(b"x" * (limit - 1))
    assert not k.truncated
    k.write("é".encode())
    assert k.truncated and len(k.held) == limit and k.text().endswith("xé")
    k.write("é".encode() * (limit // 2 + 1))
    assert len(k.held) == limit and k.text() == "é" * (limit // 2)
    k.write(b"a")  # cuts the first é in two
    assert k.text() == "é" * (limit // 2 - 1) + "a"
    assert state.whole_runes("日本".encode()[1:-1]) == b"" and state.whole_runes("a日".encode()[:-1]) == b"a" and state.whole_runes("a日".encode()) == "a日".encode() and state.whole_runes(b"") == b""


def test_newest_bytes_match_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, float(k), rng.choice(["a", "b", None]), rng.choice(["", "é" * 30, "日本" * 9, "x" * 200, None])) for k in range(60)]
    batch = timed(spark, rows, "job string, data string")
    got = drained(jobs.keep_last_stream(as_stream(spark, batch, tmp_path / "in", 3), "job", "event_id", limit=150), "live_kept", "update", tmp_path)
    last = {}
    for r in got.collect():
        last[r["job"]] = tuple(r)  # the last of each key is that of the last micro-batch
    want = {}
    for job in ("a", "b", None):
        whole = "".join(d or "" for _, _, j, d in rows if j == job).encode()
        want[job] = (job, state.whole_runes(whole[-150:]).decode(), len(whole) > 150)
    assert {r["job"]: tuple(r) for r in state.keep_last(batch, "job", "event_id", limit=150, slot=7).collect()} == want and last == want


JOBS = "w string, j string, e string"


def job_events(seed, n, owners="uv"):
    rng, rows, open_ = random.Random(seed), [], {w: [] for w in owners}
    for k in range(n):
        w = rng.choice(owners)
        if open_[w] and rng.random() < 0.45:
            rows.append((k, k * 10.0, w, open_[w].pop(rng.randrange(len(open_[w]))), "finish"))
        else:
            open_[w].append(f"j{k}")
            rows.append((k, k * 10.0, w, f"j{k}", "start"))
    return rows


@pytest.mark.parametrize("limits", [{"seconds": 300, "live": 999, "done": 999}, {"seconds": 10**6, "live": 3, "done": 999}, {"seconds": 10**6, "live": 999, "done": 4}, {"seconds": 400, "live": 3, "done": 4}])
def test_retention_matches_batch(spark, tmp_path, limits):
    batch = timed(spark, [*job_events(5, 120), (900, 5000.0, "z", "late", "start")], JOBS)
    name = "jobs_" + "_".join(map(str, limits.values()))
    got = drained(jobs.job_stream(as_stream(spark, batch, tmp_path / "in", 3), "w", "j", "e", "ts", "event_id", **limits), name, "append", tmp_path)
    end = 1_700_005_000_000_000
    want = state.job_log(batch, "w", "j", "e", "ts", "event_id", until_us=end, **limits)
    same_rows(got, want)
    kinds = {r["e"] for r in got.collect()}
    assert ("killed" in kinds) == (limits["seconds"] < 10**6) and ("rejected" in kinds) == (limits["live"] < 999) and "forgotten" in kinds or limits["live"] < 999


def test_retention_defaults():
    log, j = [], state.Jobs()
    for k in range(17):
        log += j.start(f"j{k}", k)
    assert log[-1] == ("j16", "rejected", 16) and len(j.running) == 16
    for k in range(70):
        j.expire(10)
        log += j.start(f"k{k}", 20 + k) if k >= 16 else []
        log += j.finish(f"j{k}" if k < 16 else f"k{k}", 100 + k)
    assert len(j.finished) == 64 and [x for x in log if x[1] == "forgotten"][0][0] == "j0"
    hour = 3600 * 1_000_000
    assert j.expire(hour) == [] and j.next_expiry() == min(j.finished.values()) + hour + 1
    j.start("old", hour // 2)
    assert ("old", "killed", hour // 2 + hour) in j.expire(3 * hour) and not j.finished and not j.running


def test_retention_by_the_wall_clock(spark, tmp_path):
    batch = spark.sql("SELECT 'w' AS w, 'j' AS j, 'start' AS e, current_timestamp() AS ts, 1L AS event_id")
    batch.write.parquet(str(tmp_path / "in"))
    live = jobs.job_stream(jobs.tail_parquet(spark, str(tmp_path / "in"), batch.schema), "w", "j", "e", "ts", "event_id", seconds=1, clock="processing")
    query = live.writeStream.outputMode("append").format("memory").queryName("clocked").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("clocked").count() < 2:
            time.sleep(0.3)
    finally:
        query.stop()
    assert [r["e"] for r in spark.table("clocked").orderBy("us").collect()] == ["started", "killed"]


def test_ok_calls_are_read_from_the_state(spark, tmp_path):
    rows = [(k, k * 7.0, f"u{k % 3}") for k in range(60)]
    batch = timed(spark, rows, "u string")
    drained(jobs.limiter_stream(as_stream(spark, batch, tmp_path / "in", 2), "u"), "limited", "append", tmp_path)
    now = 1_700_000_000_000_000 + 59 * 7_000_000
    got = {r["u"]: r["ok"] for r in jobs.ok_in_window(spark, str(tmp_path / "limited-c"), "u", now).collect()}
    status = usage.limiter_status(batch, "u").join(batch, ["event_id", "u"]).filter((F.col("status") == "ok") & (usage.micros(F.col("ts")) > now - 60_000_000))
    assert got == {r["u"]: r["n"] for r in status.groupBy("u").agg(F.count("*").alias("n")).collect()} and got


def test_changed_files_are_known_anew_after_three_seconds(spark):
    clock, tables, seen = [0.0], [None], []
    side = jobs.Refreshed(lambda: tables[0], clock=lambda: clock[0])
    run = jobs.marked_batches(side, lambda frame, epoch: seen.append({r["path"]: (r["tag"], r["dirty"]) for r in frame.collect()}))
    hits = spark.createDataFrame([("a",), ("b",)], "path string")
    for at, paths in ((0.0, None), (1.0, [("a", "M")]), (2.9, [("a", "M")]), (3.0, [("a", "M"), ("a", "A")]), (4.0, []), (6.0, []), (7.0, [("b", "??")]), (9.0, [("b", "??")])):
        clock[0], tables[0] = at, None if paths is None else spark.createDataFrame(paths, "path string, tag string")
        run(hits, int(at))
    clean, a, b = {"a": (None, False), "b": (None, False)}, {"a": ("M", True), "b": (None, False)}, {"a": (None, False), "b": ("??", True)}
    assert [x["b"] for x in seen] == [clean["b"]] * 7 + [b["b"]] and [x["a"][1] for x in seen] == [False, False, False, True, True, False, False, False]
    assert seen[0] == clean and seen[3]["a"][0] in ("M", "A") and a["b"] == seen[3]["b"]


def test_tail_and_in_flight(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"tool": "x", "output_len": 3}\n\nbroken\n{"tool": "y", "output_len": 4}\n')
    got = drained(jobs.tail_audit(spark, str(tmp_path / "log")).select("tool", "output_len"), "tailed", "append", tmp_path)
    assert {tuple(r) for r in got.collect() if r["tool"]} == {("x", 3), ("y", 4)}
    batch = timed(spark, [(0, 0.0, "u", "s"), (1, 5.0, "u", "s"), (2, 6.0, "v", "s"), (3, 7.0, "u", "t")], "url string, source string")
    got = drained(jobs.first_in_flight(as_stream(spark, batch, tmp_path / "f", 2)), "flight", "append", tmp_path)
    assert {r["event_id"] for r in got.collect()} == {0, 2, 3}
