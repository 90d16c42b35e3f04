"""Usage analytics over call logs: totals, per-tool counters, savings, batches, limits, reuse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import severity


def micros(ts: Column) -> Column:
    """Microseconds since 1970, of either timestamp type."""
    return F.unix_micros(ts.cast("timestamp"))


def audit_totals(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, bytes out, indexed and truncated calls."""
    return calls.groupBy(*(by or [])).agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("output_len"), F.lit(0)).alias("output_len"),
        F.count_if("indexed").alias("indexed"),
        F.count_if("truncated").alias("truncated"),
    )


def tool_usage(calls: DataFrame) -> DataFrame:
    """Per tool: calls, bytes returned and kept out, estimated tokens kept out."""
    g = calls.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("returned").alias("returned"), F.sum("kept_out").alias("kept_out"))
    return g.withColumn("est_tokens", F.col("kept_out") / 4.0)


def savings(usage: DataFrame) -> DataFrame:
    total = usage.agg(F.coalesce(F.sum("returned"), F.lit(0)).alias("returned"), F.coalesce(F.sum("kept_out"), F.lit(0)).alias("kept_out"))
    all_ = F.col("returned") + F.col("kept_out")
    return total.withColumn("ratio", F.when(all_ > 0, F.col("kept_out") * 100.0 / all_).otherwise(0.0))


def batch_rollup(results: DataFrame, key: str = "run") -> DataFrame:
    """Per batch (rows with idx, label, exit_code, size, truncated, indexed, error_class): the first failure decides."""
    failed = F.col("exit_code") != 0
    first = lambda c: F.min_by(c, F.when(failed, F.col("idx")))
    return results.groupBy(key).agg(
        F.coalesce(first("exit_code"), F.lit(0)).alias("exit_code"),
        F.sum("size").alias("size"),
        F.bool_or("truncated").alias("truncated"),
        F.count_if("indexed").alias("indexed"),
        F.count_if(failed).alias("failures"),
        first("label").alias("first_failed"),
        first("error_class").alias("error_class"),
    )


def worst_verdict(screens: DataFrame, key: str = "run") -> DataFrame:
    """Per batch (rows with idx, verdict, rule): the severest, the first of equals."""
    best = F.max_by(F.struct("verdict", "rule"), F.struct(severity(F.col("verdict"), F.col("rule")), -F.col("idx")))
    return screens.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.verdict").alias("verdict"), F.col("_b.rule").alias("rule"))


def attempts_in_window(events: DataFrame, key: list[str], ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Earlier attempts of the same key with a time strictly after ts - seconds, the row itself not counted."""
    ranged = Window.partitionBy(*key).orderBy("_us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    same = Window.partitionBy(*key, "_us")
    rows = events.withColumn("_us", micros(F.col(ts)))
    own = F.count("*").over(same)
    return rows.withColumn("attempts", F.count("*").over(ranged) - own).drop("_us")


# Fixed values: (throttle at, block at) of each bucket, and the window.
LIMITS = {"global": (4, 9), "rg": (20, 40), "fetch": (8, 16)}
WINDOW_SECONDS = 60
# End of fixed values.


class Limiter:
    """Two rings of times: attempts are always recorded, ok ones only when the answer is ok."""

    def __init__(self, throttle: int, block: int, seconds: int = WINDOW_SECONDS):
        self.throttle, self.block, self.span = throttle, block, seconds * 1_000_000
        self.attempts: list[int] = []
        self.ok: list[int] = []

    def allow(self, us: int) -> str:
        self.attempts = [t for t in self.attempts if t > us - self.span]
        self.ok = [t for t in self.ok if t > us - self.span]
        status = "blocked" if len(self.attempts) >= self.block else "throttled" if len(self.ok) >= self.throttle else "ok"
        self.attempts = [*self.attempts, us][-max(64, self.block) :]
        if status == "ok":
            self.ok.append(us)
        return status


def stretches(rows: DataFrame, key: str, us: str, seconds: int) -> DataFrame:
    """Adds ``_stretch``, the number of a key's first time slot of so many seconds after an empty slot (or its first at all).

    Between two stretches of a key lie more than ``seconds`` without a row, so what only remembers so long begins anew, and a busy key is
    dealt to as many tasks as it has stretches. Slots are counted before they are numbered: the window has a row per slot and key.
    """
    slot = F.floor(F.col(us) / (seconds * 1_000_000))
    used = rows.select(key, slot.alias("_slot")).distinct()
    w = Window.partitionBy(key).orderBy("_slot")
    first = F.when(F.coalesce(F.col("_slot") - F.lag("_slot").over(w), F.lit(2)) > 1, F.col("_slot"))
    of = used.withColumn("_first", first).withColumn("_stretch", F.last("_first", ignorenulls=True).over(w)).select(F.col(key).alias("_key"), F.col("_slot").alias("_at"), "_stretch")
    dealt = rows.withColumn("_slot", slot)
    return dealt.join(of, dealt[key].eqNullSafe(of["_key"]) & (dealt["_slot"] == of["_at"])).drop("_slot", "_key", "_at")


def limiter_status(events: DataFrame, key: str, ts: str = "ts", order: str = "event_id", throttle: int = 4, block: int = 9, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The status of every call: key, order column, status. A stream of sorted rows, a constant state per key and stretch without a pause of the window."""
    types = dict(events.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, limiter = None, None
        for b in batches:
            out = []
            for k, us in zip(zip(b["k"].fillna("") if b["k"].dtype == object else b["k"], b["_stretch"], strict=True), b["us"], strict=True):
                if limiter is None or k != last:
                    last, limiter = k, Limiter(throttle, block, seconds)
                out.append(limiter.allow(us))
            yield b[["k", "o"]].assign(status=out)

    rows = events.select(F.col(key).alias("k"), F.col(order).alias("o"), micros(F.col(ts)).alias("us"))
    dealt = stretches(rows, "k", "us", seconds).repartition("k", "_stretch").sortWithinPartitions("k", "_stretch", "us", "o")
    out = dealt.mapInPandas(run, f"k {types[key]}, o {types[order]}, status string")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "status")


def next_status(calls: DataFrame, now: str, bucket: str = "global", ts: str = "ts") -> str:
    """What the limiter says to a call at ``now`` after the calls of its bucket (rows with a time)."""
    throttle, block = LIMITS[bucket]
    stamp = F.lit(now).cast("timestamp")
    one = calls.sparkSession.range(1).select(stamp.alias("ts"), F.lit(1).alias("event_id"))
    rows = calls.select(F.col(ts).cast("timestamp").alias("ts"), F.lit(0).alias("event_id")).filter(F.col("ts") <= stamp).unionByName(one).withColumn("k", F.lit(0))
    return limiter_status(rows, "k", throttle=throttle, block=block).filter("event_id = 1").first()["status"]


def within_budget(steps: DataFrame, key: str, order: str, duration: Column, budget: float) -> DataFrame:
    """Steps that still start within a shared budget; later ones are marked skipped."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(duration).over(w), F.lit(0.0))
    return steps.withColumn("skipped", spent > budget)


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, at its first place."""
    return rows.groupBy(key).agg(F.min(order).alias(order))
