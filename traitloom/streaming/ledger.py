"""Ledgers as streams: blockers, idempotent executions, latest states, claims, and windowed counts.

The windowed counts go beyond the ledgers of the original product; they serve event tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Kinds of blocker and the wording that tells them.
REASONS = (("rate_limited", "(?i)429|rate limit|too many requests"), ("timeout", "(?i)timed? ?out"), ("forbidden", "(?i)403|forbidden|robots"), ("not_found", "(?i)404|not found"), ("too_large", "(?i)too large|exceeds"))

#: Rows that are Python objects at a time.
ROWS = 1 << 14


def read_events(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A Parquet table (a folder or one file) as a stream.

    Times without a zone become UTC times, so they can carry a watermark.
    """
    there = spark.read.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    source = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", per_trigger)
    if any(f.rstrip("/").endswith(f"/{name}") for f in there.inputFiles()):
        source, path = source.option("pathGlobFilter", name), folder
    return source.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def blocker_reason(detail: Column) -> Column:
    out = F.when(detail.isNull(), "unknown")
    for reason, pattern in REASONS:
        out = out.when(detail.rlike(pattern), reason)
    return out.otherwise("other")


def blockers(events: DataFrame) -> DataFrame:
    """Failures as ledger rows; no state."""
    return events.where("event_type = 'error'").select("event_id", "ts", F.col("user_id").alias("source_id"), blocker_reason(F.col("props")).alias("reason"))


def once_per_key(events: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the delay; the key's state goes when the watermark passes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    counted = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def latest_states(events: DataFrame) -> DataFrame:
    """The latest state of each key; an update-mode aggregate."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))


def settle_claims(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The verdicts on a slot's rows of one trigger, in bounded tables."""
    active = state.get[0] if state.exists else None
    # A row of a slot is held as some twenty bytes, not as objects.
    index: dict = {}
    parts = [(b["seq"].to_numpy(), np.fromiter((index.setdefault(h, len(index)) for h in b["holder"]), np.int32, len(b)), (b["action"] == "claim").to_numpy()) for b in batches]
    seqs, codes, claimed = (np.concatenate(p) for p in zip(*parts, strict=True))
    del parts
    holders, order = list(index), np.argsort(seqs, kind="stable")
    for at in range(0, len(order), ROWS):
        own, out = order[at : at + ROWS], []
        for seq, code, claim in zip(seqs[own].tolist(), codes[own].tolist(), claimed[own].tolist(), strict=True):
            holder = holders[code]
            if claim:
                verdict = "claimed" if active is None else "skipped"
                active = active or holder
            else:
                verdict = "released" if active == holder else "ignored"
                active = None if active == holder else active
            out.append((key[0], seq, holder, verdict))
        yield pd.DataFrame(out, columns=["slot", "seq", "holder", "verdict"])
    state.update((active,))


def claims(requests: DataFrame) -> DataFrame:
    """One active holder for each slot: a request claims a free slot, its release frees it, others are skipped.

    ``requests`` has (slot, seq, holder, action); rows of a slot are taken in ``seq`` order
    within a trigger. The state is one holder for each slot.
    """
    return requests.groupBy("slot").applyInPandasWithState(settle_claims, "slot long, seq long, holder string, verdict string", "active string", "append", GroupStateTimeout.NoTimeout)


def resolutions(blockers: DataFrame, resolved: DataFrame, within: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """(blocker_id, source_id, ts, resolution_id, resolved_at): blockers with each resolution of their source that follows in time, or without any.

    Two streams are joined: ``blockers`` (blocker_id, source_id, ts) and ``resolved``
    (resolution_id, source_id, resolved_at). A blocker waits in the state until both streams
    have passed the end of its time, and comes out unresolved, once, if none has come by then.
    A resolution waits only as long as a blocker that it may follow can still come. Rows later
    than ``delay`` are dropped. Of tables the result is the same, all at once.
    """
    b = blockers.withWatermark("ts", delay) if blockers.isStreaming else blockers
    r = resolved.withColumnRenamed("source_id", "resolved_source")
    r = r.withWatermark("resolved_at", delay) if resolved.isStreaming else r
    on = f"source_id = resolved_source AND resolved_at >= ts AND resolved_at <= ts + INTERVAL {within}"
    return b.join(r, F.expr(on), "left_outer").select("blocker_id", "source_id", "ts", "resolution_id", "resolved_at")


def progress(events: DataFrame) -> DataFrame:
    """The newest snapshot of each run's progress; an update-mode aggregate, so a sink overwrites by run."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("phase", "done", "total"), "seq").alias("p"), F.max("seq").alias("seq")).select("run_id", "p.*", "seq")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there into Parquet files, then stop; a restart goes on where this ended."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Hand each batch to ``write``, which must be idempotent by batch number."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
