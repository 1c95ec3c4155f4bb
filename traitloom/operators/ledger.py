"""Run ledgers: coverage, changes between runs, blockers, due times and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitloom.operators.ranking import first_by

#: Item states from worst to best.
STATUS_RANK = {"failed": 0, "skipped": 1, "blocked": 2, "no_candidates": 3, "fetched_locked": 4, "fetched": 5}
FETCHED = ("fetched", "fetched_locked")


def coverage(status: Column) -> Column:
    """The share of fetched items to three places; null for no items."""
    return F.round(F.count_if(status.isin(*FETCHED)) / F.nullif(F.count("*"), F.lit(0)), 3)


def run_summary(items: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run the number of items in each state, their total and the coverage."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUS_RANK]
    return items.groupBy(run).agg(F.count("*").alias("total"), *counts, coverage(F.col("status")).alias("coverage"))


def coverage_changes(runs: DataFrame) -> DataFrame:
    """Completed runs of a list with the difference of coverage to the one before, to three places.

    Halves round up, also below zero.
    """
    before = F.lag("coverage").over(Window.partitionBy("list_name").orderBy("run_id"))
    return runs.where("status = 'completed'").withColumn("previous", before).withColumn("delta", F.floor((F.col("coverage") - F.col("previous")) * 1000 + 0.5) / 1000)


def last_two(runs: DataFrame) -> DataFrame:
    """The latest and the previous completed run of each list, by ``place`` 1 and 2."""
    place = F.row_number().over(Window.partitionBy("list_name").orderBy(F.col("run_id").desc()))
    return runs.where("status = 'completed'").withColumn("place", place).where("place <= 2")


def item_key(title: Column, author: Column) -> Column:
    return F.concat_ws("|", F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(F.trim(F.coalesce(author, F.lit("")))))


def transition(now: Column, before: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    a, b = F.try_element_at(rank, now), F.try_element_at(rank, before)
    return F.when(before.isNull(), "new").when(a > b, "improved").when(a < b, "regressed").otherwise("unchanged")


def item_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Items of a run with their state before; of repeated keys in the run before the last counts."""
    key = item_key(F.col("title"), F.col("author"))
    before = previous.withColumn("key", key).groupBy("key").agg(F.max_by("status", "pos").alias("before"))
    now = current.withColumn("key", key)
    return now.join(before, "key", "left").select("pos", "title", "author", "status", "before", transition(F.col("status"), F.col("before")).alias("change"))


def blocker_groups(blockers: DataFrame) -> DataFrame:
    """Per reason and source: the count, the first three addresses and the first detail (300 characters)."""
    seen = blockers.groupBy("reason", "source_id", "url").agg(F.min("id").alias("id")).where("url is not null")
    rank = F.row_number().over(Window.partitionBy("reason", "source_id").orderBy("id"))
    urls = seen.withColumn("rn", rank).where("rn <= 3").groupBy("reason", "source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "url"))), lambda x: x["url"]).alias("urls"))
    counts = blockers.groupBy("reason", "source_id").agg(F.count("*").alias("n"), F.substring(F.min_by("detail", F.when(F.col("detail").isNotNull(), F.col("id"))), 1, 300).alias("detail"))
    return counts.join(urls, counts.reason.eqNullSafe(urls.reason) & counts.source_id.eqNullSafe(urls.source_id), "left").select(counts.reason, counts.source_id, "n", "detail", "urls")


def recurring(blockers: DataFrame, runs: DataFrame, n_runs: int = 15, least: int = 2, most: int = 3) -> DataFrame:
    """The reasons seen most over the last runs, at least twice."""
    latest = runs.where("status = 'completed'").orderBy(F.col("run_id").desc()).limit(n_runs).select("run_id")
    counted = blockers.join(latest, "run_id", "left_semi").groupBy("reason").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).orderBy(F.col("n").desc(), "reason").limit(most)


def once_per_run(blockers: DataFrame) -> DataFrame:
    """Blockers of a whole source count once in a run; others always."""
    shared = blockers.where("key is not null")
    return first_by(shared, ["run_id", "key"], [F.col("seq")]).unionByName(blockers.where("key is null"))


def queue(blockers: DataFrame, held: DataFrame, candidates: DataFrame) -> DataFrame:
    """Open blockers whose work is not held yet, with the candidate's title, newest per address."""
    missing = blockers.join(held.select("work_id").distinct(), "work_id", "left_anti")
    named = missing.join(candidates.select("edition_id", "title"), "edition_id", "left")
    return first_by(named.withColumn("address", F.coalesce("url", F.concat_ws("|", "source_id", "reason", "detail"))), ["address"], [F.col("id").desc()])


def local_parts(ts: Column, zone: Column) -> dict[str, Column]:
    """Local date, time and weekday (Sunday is 0) of a UTC time."""
    local = F.from_utc_timestamp(ts, zone)
    return {"local_date": F.date_format(local, "yyyy-MM-dd"), "local_time": F.date_format(local, "HH:mm"), "weekday": F.dayofweek(local) - 1}


def due(routines: DataFrame, now: Column) -> DataFrame:
    """Enabled routines whose local time has come on one of their weekdays."""
    with_now = routines.withColumns(local_parts(now, F.col("zone")))
    return with_now.where(F.col("enabled") & (F.col("local_time") >= F.col("at")) & F.array_contains("weekdays", F.col("weekday")))


def latest_state(events: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(state, seq).alias(state), F.max(seq).alias(seq))


def orphans(runs: DataFrame, boot: Column) -> DataFrame:
    """Runs that are still running but began before the start of the process."""
    return runs.where((F.col("status") == "running") & (F.col("started_at") < boot))


def salvage(done: Column, planned: Column) -> Column:
    """Outcomes so far, then the items that were left as skipped; arrays of (title, status)."""
    rest = F.slice(planned, F.size(done) + 1, F.greatest(F.lit(0), F.size(planned) - F.size(done)))
    return F.concat(done, F.transform(rest, lambda t: F.struct(t.alias("title"), F.lit("skipped").alias("status"))))


def to_retry(status: Column) -> Column:
    return ~status.isin(*FETCHED)


def retry_list(items: Column) -> Column:
    """The items of a written list, an array of (title, status), that are to be tried again."""
    return F.filter(items, lambda x: to_retry(x["status"]))


def outcome(fetched: Column, locked: Column, blocked: Column, failed: Column, candidates: Column) -> Column:
    """An item's state from the counts of its cycle, by priority."""
    return (F.when(fetched > 0, "fetched").when(locked > 0, "fetched_locked").when(blocked > 0, "blocked").when(failed > 0, "failed")
            .when(candidates == 0, "no_candidates").otherwise("skipped"))


def finished(executions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Executions (id, status, run_id, error, report) after outcomes (id, run_id, summary, error): completed with a summary, failed without one; others stay."""
    o = outcomes.select(F.col("id").alias("__id"), F.col("run_id").alias("__run"), F.col("summary").alias("__summary"), F.coalesce("error", F.lit("no summary")).alias("__error"))
    both = executions.join(o, F.col("id") == F.col("__id"), "left")
    done, good = F.col("__id").isNotNull() & (F.col("status") == "running"), F.col("__summary").isNotNull()
    return both.select("id", F.when(done, F.when(good, "completed").otherwise("failed")).otherwise(F.col("status")).alias("status"), F.when(done, F.col("__run")).otherwise(F.col("run_id")).alias("run_id"),
                       F.when(done & ~good, F.col("__error")).otherwise(F.col("error")).alias("error"), F.when(done & good, F.col("__summary")).otherwise(F.col("report")).alias("report"), "email_status")


def released(routines: DataFrame, ended: DataFrame) -> DataFrame:
    """Routines (id, active_execution_id) without the claims of executions that ended; a later claim is never cleared."""
    own = ended.select(F.col("id").alias("__ended")).distinct()
    return routines.join(own, F.col("active_execution_id") == F.col("__ended"), "left").select("id", F.when(F.col("__ended").isNull(), F.col("active_execution_id")).alias("active_execution_id"))


def recovered(executions: DataFrame) -> DataFrame:
    """Executions after a restart: what was running failed and its report is unsent; a report that was being sent is unknown and is not sent again."""
    running = F.col("status") == "running"
    return executions.select("id", F.when(running, "failed").otherwise(F.col("status")).alias("status"), "run_id", F.when(running, "ended before completion").otherwise(F.col("error")).alias("error"), "report",
                             F.when(running, "pending").when(F.col("email_status") == "sending", "unknown").otherwise(F.col("email_status")).alias("email_status"))


def unsent(executions: DataFrame) -> DataFrame:
    """(id, action) for reports that wait after a restart: a failure's, a completed run's, or none can be made."""
    waiting = executions.where(F.col("status").isin("completed", "failed") & (F.col("email_status") == "pending"))
    return waiting.select("id", F.when(F.col("status") == "failed", "send_failure").when(F.col("run_id").isNotNull() & F.col("report").isNotNull(), "send_report").otherwise("mark_unknown").alias("action"))


def new_executions(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Executions whose key is not known yet, each once."""
    return proposed.dropDuplicates(["execution_key"]).join(known.select("execution_key"), "execution_key", "left_anti")
