"""Structured Streaming twins: log tailing, live counters, the sliding-window limiter, reuse, keep-last."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import CAPTURE_BYTES, DONE_JOBS, JOB_SECONDS, LIVE_JOBS, REUSE_ENTRIES, REUSE_SECONDS, Jobs, KeepLast, ReuseMap
from ..operators.usage import WINDOW_SECONDS, Limiter, micros
from ..sources.shared import complete_versions
from ..sources.tables import audit_schema


def tail_audit(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Call records as their files arrive."""
    return spark.readStream.schema(audit_schema()).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def tail_parquet(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 10, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def live_counters(calls: DataFrame, session: str = "session_id", tool: str = "tool", size: str = "output_len") -> DataFrame:
    """Running counts of every session and tool; write in update or complete mode."""
    return calls.groupBy(session, tool).agg(F.count("*").alias("calls"), F.sum(size).alias("returned"))


def windowed_counters(calls: DataFrame, ts: str, tool: str, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts per event-time window; windows close when the watermark passes them."""
    return calls.withWatermark(ts, lateness).groupBy(F.window(ts, width), tool).agg(F.count("*").alias("calls"))


def first_in_flight(fetches: DataFrame, ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """One fetch per URL and source while a former one is fresh."""
    return fetches.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["url", "source"])


def limiter_stream(calls: DataFrame, key: str, ts: str = "ts", order: str = "event_id", throttle: int = 4, block: int = 9, seconds: int = WINDOW_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """Statuses by the sliding-window limiter; state per key is two rings of at most 64 times.

    Rows of a micro-batch are put in order; the state ends once the watermark is a window past the last call.
    """
    types = dict(calls.dtypes)
    out = f"{key} {types[key]}, {order} {types[order]}, status string"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(throttle, block, seconds)
        if state.exists:
            limiter.attempts, limiter.ok = (list(x) for x in state.get)
        rows = pd.concat(list(batches)).sort_values(["us", order])
        status = [limiter.allow(us) for us in rows["us"]]
        state.update((limiter.attempts, limiter.ok))
        until = int(rows["us"].max()) // 1000 + seconds * 1000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order].tolist(), "status": status})

    rows = calls.withWatermark(ts, lateness).select(key, order, ts, micros(F.col(ts)).alias("us"))
    return rows.groupBy(key).applyInPandasWithState(step, out, "attempts array<long>, ok array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def reuse_stream(results: DataFrame, session: str, key: str, digest: str, ts: str = "ts", order: str = "event_id", seconds: int = REUSE_SECONDS, entries: int = REUSE_ENTRIES, lateness: str = "1 minute") -> DataFrame:
    """(session, order, reused) of every result; the state of a session is a map of at most ``entries`` results, gone when none can be reused any more."""
    kind = dict(results.dtypes)[order]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {key: (digest, us) for key, digest, us in zip(*state.get, strict=True)} if state.exists else None
        reuse, rows = ReuseMap(seconds, entries, held), pd.concat(list(batches)).sort_values(["us", "o"])
        out = [reuse.seen(*x) for x in zip(rows["k"], rows["d"], rows["us"], strict=True)]
        state.update((list(reuse.held), [d for d, _ in reuse.held.values()], [us for _, us in reuse.held.values()]))
        state.setTimeoutTimestamp(max(int(rows["us"].max()) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"s": [k[0]] * len(rows), "o": rows["o"].tolist(), "reused": out})

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = results.withWatermark(ts, lateness).select(text(session).alias("s"), text(key).alias("k"), text(digest).alias("d"), F.col(order).alias("o"), ts, micros(F.col(ts)).alias("us"))
    out = rows.groupBy("s").applyInPandasWithState(step, f"s string, o {kind}, reused boolean", "keys array<string>, digests array<string>, stored array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("s").alias(session), F.col("o").alias(order), "reused")


def keep_last_stream(chunks: DataFrame, key: str, order: str, data: str = "data", limit: int = CAPTURE_BYTES, idle_ms: int | None = None) -> DataFrame:
    """(key, kept, truncated) after every micro-batch that wrote to a key, in update mode; the state of a key has at most ``limit`` bytes.

    With ``idle_ms`` a key's state ends when nothing was written for so long; such a stream runs on until it is stopped.
    """
    kind = dict(chunks.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = KeepLast(limit, *((bytes(state.get[0]), state.get[1]) if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values("o", kind="stable")
        for d in rows["d"]:
            kept.write(bytes(d))
        state.update((kept.held, kept.truncated))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"k": [k[0]], "kept": [kept.text()], "truncated": [kept.truncated]})

    rows = chunks.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("d"))
    out = rows.groupBy("k").applyInPandasWithState(step, f"k {kind}, kept string, truncated boolean", "held binary, truncated boolean", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
    return out.select(F.col("k").alias(key), "kept", "truncated")


def job_stream(events: DataFrame, owner: str, job: str, what: str, ts: str, order: str, seconds: int = JOB_SECONDS, live: int = LIVE_JOBS, done: int = DONE_JOBS, clock: str = "event", lateness: str = "0 seconds") -> DataFrame:
    """(owner, job, what, us): what becomes of the jobs of each owner, in append mode.

    ``clock`` says what makes a job too old when no event of its owner comes any more: the watermark (``event``) or the wall clock of the
    cluster (``processing``). The state of an owner is the times of its live and kept jobs, ``live`` + ``done`` at most.
    """
    by_clock = clock == "processing"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [dict(zip(state.get[i], state.get[i + 1], strict=True)) for i in (0, 2)] if state.exists else [None, None]
        jobs, out = Jobs(seconds, live, done, *held), []
        if state.hasTimedOut:
            now = state.getCurrentProcessingTimeMs() if by_clock else state.getCurrentWatermarkMs()
            out += jobs.expire(now * 1000)
        else:
            rows = pd.concat(list(batches)).sort_values(["us", "o"])
            for j, e, us in zip(rows["j"], rows["e"], rows["us"], strict=True):
                out += (jobs.start if e == "start" else jobs.finish)(j, us)
        ahead = jobs.next_expiry()
        if ahead is None:
            if state.exists:
                state.remove()
        else:
            state.update((list(jobs.running), list(jobs.running.values()), list(jobs.finished), list(jobs.finished.values())))
            if by_clock:
                state.setTimeoutDuration(max(1, ahead // 1000 - state.getCurrentProcessingTimeMs() + 1))
            else:
                state.setTimeoutTimestamp(max(-(-ahead // 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], *x) for x in out], columns=["w", "j", "e", "us"])

    rows = events.filter(F.col(what).isin("start", "finish") & F.col(owner).isNotNull() & F.col(job).isNotNull())
    rows = rows if by_clock else rows.withWatermark(ts, lateness)
    plain = rows.select(F.col(owner).cast("string").alias("w"), F.col(job).cast("string").alias("j"), F.col(what).alias("e"), ts, micros(F.col(ts)).alias("us"), F.col(order).alias("o"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if by_clock else GroupStateTimeout.EventTimeTimeout
    out = plain.groupBy("w").applyInPandasWithState(step, "w string, j string, e string, us long", "running array<string>, began array<long>, finished array<string>, done array<long>", "append", timeout)
    return out.select(F.col("w").alias(owner), F.col("j").alias(job), F.col("e").alias(what), "us")


def ok_in_window(spark: SparkSession, checkpoint: str, key: str, now_us: int, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(key, ok): how many calls the limiter's stream has let through in the last ``seconds``, read from the state in its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    recent = F.filter(F.col("value.groupState.ok"), lambda t: t > now_us - seconds * 1_000_000)
    return state.select(F.col(f"key.{key}").alias(key), F.size(recent).cast("long").alias("ok")).filter("ok > 0")


class Refreshed:
    """A small side table that is loaded again when it is older than ``seconds``; that there is none is kept as long."""

    def __init__(self, load: Callable[[], DataFrame | None], seconds: float = 3.0, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.until, self.rows = float("-inf"), None

    def get(self) -> list | None:
        """The rows, or None if there is no table."""
        now = self.clock()
        if now >= self.until:
            frame = self.load()
            self.rows = None if frame is None else (frame.schema, frame.limit(MOST_CHANGED + 1).collect())
            if self.rows is not None and len(self.rows[1]) > MOST_CHANGED:
                raise ValueError(f"over {MOST_CHANGED} changed files")
            self.until = now + self.seconds
        return self.rows


#: The most changed files that a working copy may have for its state to go to every task.
MOST_CHANGED = 100_000


def marked_batches(changed: Refreshed, write: Callable[[DataFrame, int], None]):
    """A foreachBatch function: hits (path, ...) with the tag of changed files and whether they are ``dirty``, changed ones known as of the last refresh."""

    def run(batch: DataFrame, epoch: int) -> None:
        found = changed.get()
        schema, rows = found if found is not None else (T.StructType([T.StructField("path", T.StringType()), T.StructField("tag", T.StringType())]), [])
        side = batch.sparkSession.createDataFrame(rows, schema).select("path", "tag").dropDuplicates(["path"])
        write(batch.join(F.broadcast(side), "path", "left").withColumn("dirty", F.col("tag").isNotNull()), epoch)

    return run


def upsert_into(folder: str, key: list[str], order: list[str], merge_every: int = 20):
    """A foreachBatch function that keeps the latest row per key, for ``read_latest``.

    A batch writes its own rows only; every ``merge_every`` batches the table so far is written as one. A batch that is repeated writes
    the same folder again, and a batch after a restart builds on what is complete.
    """
    from ..operators.store import latest

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest(batch, key, order).write.mode("overwrite").parquet(f"{folder}/delta/v{epoch}")
        if epoch and epoch % merge_every == 0:
            read_latest(spark, folder, key, order, batch.schema, epoch).write.mode("overwrite").parquet(f"{folder}/full/v{epoch}")

    return write


def read_latest(spark: SparkSession, folder: str, key: list[str], order: list[str], schema: T.StructType, upto: int | None = None) -> DataFrame:
    """The latest row per key of a table that ``upsert_into`` writes, up to a batch."""
    from ..operators.store import latest

    full = max((v for v in complete_versions(spark, f"{folder}/full") if upto is None or v < upto), default=None)
    parts = [f"{folder}/delta/v{v}" for v in complete_versions(spark, f"{folder}/delta") if (full is None or v > full) and (upto is None or v <= upto)]
    parts += [] if full is None else [f"{folder}/full/v{full}"]
    return latest(spark.read.schema(schema).parquet(*parts), key, order) if parts else spark.createDataFrame([], schema)


def run_once(frame: DataFrame, name: str, mode: str, checkpoint: str) -> None:
    """Drains what is there into a memory table."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
