"""Small states that calls go through in order: reuse of results, newest bytes, background jobs.

Each is a plain class with a bounded memory, used by a batch job here and by its stream in ``streaming``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .usage import micros, stretches

# How long and how many results can be reused; newest bytes of a log and of a capture; age and number of background jobs.
REUSE_SECONDS, REUSE_ENTRIES = 600, 64
LOG_BYTES, CAPTURE_BYTES = 16 << 20, 10 << 20
JOB_SECONDS, LIVE_JOBS, DONE_JOBS = 3600, 16, 64
# End of fixed values.


class ReuseMap:
    """key -> (digest, time it was stored). A result can be reused for ten minutes from when it was stored; a new one puts out the oldest of 64."""

    def __init__(self, seconds: int = REUSE_SECONDS, entries: int = REUSE_ENTRIES, held: dict[str, tuple[str, int]] | None = None):
        self.span, self.entries, self.held = seconds * 1_000_000, entries, held or {}

    def seen(self, key: str, digest: str, us: int) -> bool:
        old = self.held.get(key)
        if old is not None and us - old[1] < self.span and old[0] == digest:
            return True
        if len(self.held) >= self.entries:
            del self.held[min(self.held, key=lambda k: (self.held[k][1], k))]
        self.held[key] = (digest, us)
        return False


def reused(rows: DataFrame, session: str, key: str, digest: str, ts: str, order: str, seconds: int = REUSE_SECONDS, entries: int = REUSE_ENTRIES) -> DataFrame:
    """(order, reused) of every result of a session, in the order of time: whether the same result of its key can be reused.

    Sorted rows go through one bounded state; sessions are cut where nothing can be reused any more, so a busy one is more than one task.
    Null keys and digests count as empty texts.
    """
    kind = dict(rows.dtypes)[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            for s, part, k, d, us in zip(b["s"], b["_stretch"], b["k"], b["d"], b["us"], strict=True):
                if state is None or (s, part) != last:
                    last, state = (s, part), ReuseMap(seconds, entries)
                out.append(state.seen(k, d, us))
            yield b[["o"]].assign(reused=out)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = rows.select(text(session).alias("s"), text(key).alias("k"), text(digest).alias("d"), F.col(order).alias("o"), micros(F.col(ts)).alias("us"))
    dealt = stretches(plain, "s", "us", seconds).repartition("s", "_stretch").sortWithinPartitions("s", "_stretch", "us", "o")
    return dealt.mapInPandas(run, f"o {kind}, reused boolean").select(F.col("o").alias(order), "reused")


def whole_runes(raw: bytes, tail: bool = True) -> bytes:
    """Without the bytes of a character that is cut at the beginning, or (with ``tail``) at the end."""
    start = 0
    while start < min(3, len(raw)) and 0x80 <= raw[start] <= 0xBF:
        start += 1
    raw = raw[start:]
    for back in range(1, min(4, len(raw)) + 1) if tail else ():
        lead = raw[-back]
        if lead >= 0xC0:
            need = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2
            return raw[:-back] if need > back else raw
        if lead < 0x80:
            break
    return raw


class KeepLast:
    """The newest bytes of what is written, and whether older ones were dropped."""

    def __init__(self, limit: int = CAPTURE_BYTES, held: bytes = b"", truncated: bool = False):
        self.limit, self.held, self.truncated = limit, held, truncated

    def write(self, data: bytes) -> None:
        if not data:
            return
        self.truncated |= len(self.held) + len(data) > self.limit
        self.held = (self.held + data if len(data) < self.limit else data)[-self.limit :] if self.limit > 0 else b""

    def text(self, tail: bool = True) -> str:
        return whole_runes(self.held, tail).decode("utf-8", "replace")


def keep_last(chunks: DataFrame, key: str, order: str, data: str = "data", limit: int = CAPTURE_BYTES, slot: int = 1000) -> DataFrame:
    """(key, kept, truncated): per key the newest ``limit`` bytes of its chunks (binary or text) as text of whole characters.

    Sizes are summed per slot of the order number first, and only the chunks of the last slots that hold ``limit`` bytes come together.
    """
    raw = chunks.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("d"))
    slots = raw.groupBy("k", F.floor(F.col("o") / slot).alias("slot")).agg(F.sum(F.octet_length("d")).alias("n"))
    after = Window.partitionBy("k").orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = slots.withColumn("after", F.coalesce(F.sum("n").over(after), F.lit(0))).groupBy("k").agg(F.min(F.when(F.col("after") < limit, F.col("slot"))).alias("first"), F.sum("n").alias("size"))
    near = raw.alias("r").join(first.alias("f"), F.col("r.k").eqNullSafe(F.col("f.k"))).filter(F.floor(F.col("o") / slot) >= F.col("first"))
    schema = f"k {dict(chunks.dtypes)[key]}, kept string, truncated boolean"

    def run(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        state = KeepLast(limit)
        for d in part.sort_values("o", kind="stable")["d"]:
            state.write(bytes(d))
        return pd.DataFrame({"k": [k[0]], "kept": [state.text()], "truncated": [bool(part["size"].iloc[0] > limit)]})

    out = near.select(F.col("r.k").alias("k"), "o", "d", "size").groupBy("k").applyInPandas(run, schema)
    return out.select(F.col("k").alias(key), "kept", "truncated")


class Jobs:
    """Running and finished jobs of one owner: at most 16 run, none longer than an hour, and the last 64 finished ones are kept for an hour."""

    def __init__(self, seconds: int = JOB_SECONDS, live: int = LIVE_JOBS, done: int = DONE_JOBS, running: dict[str, int] | None = None, finished: dict[str, int] | None = None):
        self.span, self.most_live, self.most_done = seconds * 1_000_000, live, done
        self.running, self.finished = running or {}, finished or {}  # job -> when it began

    def expire(self, us: int) -> list[tuple[str, str, int]]:
        """Before what happens at a time: (job, what, when) of the jobs that are too old by then, the oldest first."""
        old = sorted((began, job, what) for what, held in (("killed", self.running), ("forgotten", self.finished)) for job, began in held.items() if us - began > self.span)
        out = []
        for began, job, what in old:
            if what == "killed":
                del self.running[job]  # its age makes it forgotten as well
            else:
                del self.finished[job]
            out.append((job, what, began + self.span))
        return out

    def start(self, job: str, us: int) -> list[tuple[str, str, int]]:
        out = self.expire(us)
        if len(self.running) >= self.most_live:
            return [*out, (job, "rejected", us)]
        self.running[job] = us
        return [*out, (job, "started", us)]

    def finish(self, job: str, us: int) -> list[tuple[str, str, int]]:
        out = self.expire(us)
        if job not in self.running:
            return out
        self.finished[job] = self.running.pop(job)
        out.append((job, "finished", us))
        while len(self.finished) > self.most_done:
            oldest = min(self.finished, key=lambda j: (self.finished[j], j))
            del self.finished[oldest]
            out.append((oldest, "forgotten", us))
        return out

    def next_expiry(self) -> int | None:
        """When the first job will be too old."""
        began = [*self.running.values(), *self.finished.values()]
        return min(began) + self.span + 1 if began else None


def job_log(events: DataFrame, owner: str, job: str, what: str, ts: str, order: str, until_us: int | None = None, seconds: int = JOB_SECONDS, live: int = LIVE_JOBS, done: int = DONE_JOBS) -> DataFrame:
    """(owner, job, what, us): what becomes of jobs, from their ``start`` and ``finish`` events in order; with ``until_us`` also of what is too old by then."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, jobs, out = None, None, []

        def ended() -> list[tuple]:
            return [(last, *x) for x in jobs.expire(until_us)] if jobs is not None and until_us is not None else []

        for b in batches:
            for w, j, e, us in zip(b["w"], b["j"], b["e"], b["us"], strict=True):
                if jobs is None or w != last:
                    out += ended()
                    last, jobs = w, Jobs(seconds, live, done)
                out += [(w, *x) for x in (jobs.start if e == "start" else jobs.finish)(j, us)]
            yield pd.DataFrame(out, columns=["w", "j", "e", "us"])
            out = []
        yield pd.DataFrame(ended(), columns=["w", "j", "e", "us"])

    rows = events.select(F.col(owner).cast("string").alias("w"), F.col(job).cast("string").alias("j"), F.col(what).alias("e"), micros(F.col(ts)).alias("us"), F.col(order).alias("o"))
    sorted_ = rows.filter(F.col("e").isin("start", "finish") & F.col("w").isNotNull() & F.col("j").isNotNull()).repartition("w").sortWithinPartitions("w", "us", "o")
    out = sorted_.mapInPandas(run, "w string, j string, e string, us long")
    return out.select(F.col("w").alias(owner), F.col("j").alias(job), F.col("e").alias(what), "us")
