"""Run ledgers, blockers and streams over events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from traitloom.operators import graph, ledger, ranking
from traitloom.plans import stand_in as st
from traitloom.plans.registry import query, table
from traitloom.sources import records
from traitloom.sources.scratch import scratch_folder
from traitloom.streaming import keyed
from traitloom.streaming import ledger as stream

I, B = st.ITEMS_SQL, st.BLOCKERS_SQL
FETCHED = "status IN ('fetched', 'fetched_locked')"
RUNS = f"""{I}, runs AS (SELECT list_name, run_id, CASE WHEN run_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, round(count(*) FILTER ({FETCHED}) / count(*), 3) AS coverage FROM items GROUP BY list_name, run_id)"""


def runs(spark, d):
    found = st.items(spark, d).groupBy("list_name", "run_id").agg(ledger.coverage(F.col("status")).alias("coverage"))
    return found.withColumn("status", F.when(F.col("run_id") % 7 == 0, "failed").otherwise("completed"))


@query("A14_coverage", f"WITH {I} SELECT run_id, round(count(*) FILTER ({FETCHED}) / nullif(count(*), 0), 3) AS coverage FROM items GROUP BY run_id")
def coverage(spark, d):
    return st.items(spark, d).groupBy("run_id").agg(ledger.coverage(F.col("status")).alias("coverage"))


@query("A15_run_summary", f"""WITH {I} SELECT run_id, count(*) AS total, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'blocked') AS blocked,
    count(*) FILTER (status = 'no_candidates') AS no_candidates, count(*) FILTER (status = 'fetched_locked') AS fetched_locked, count(*) FILTER (status = 'fetched') AS fetched, round(count(*) FILTER ({FETCHED}) / count(*), 3) AS coverage FROM items GROUP BY run_id""")
def run_summary(spark, d):
    return ledger.run_summary(st.items(spark, d))


@query("A16_blocker_groups", f"""WITH {B}, u AS (SELECT reason, source_id, url, min(id) AS id FROM blockers GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY reason, source_id ORDER BY id) AS rn FROM u)
    SELECT reason, source_id, count(*) AS n, substr(min_by(detail, id), 1, 300) AS detail, (SELECT string_agg(url, '|' ORDER BY r.id) FROM r WHERE r.reason = blockers.reason AND r.source_id = blockers.source_id AND rn <= 3) AS urls FROM blockers GROUP BY reason, source_id""")
def blocker_groups(spark, d):
    return ledger.blocker_groups(st.blockers(spark, d)).withColumn("urls", F.array_join("urls", "|"))


@query("A17_reasons", f"WITH {B} SELECT reason, count(*) AS n FROM blockers GROUP BY reason ORDER BY n DESC, reason")
def reasons(spark, d):
    return st.blockers(spark, d).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "reason")


@query("A18_recurring", f"""WITH {B}, r AS (SELECT DISTINCT run_id FROM blockers WHERE run_id % 7 <> 0 ORDER BY run_id DESC LIMIT 15)
    SELECT reason, count(*) AS n FROM blockers WHERE run_id IN (SELECT run_id FROM r) GROUP BY reason HAVING count(*) >= 2 ORDER BY n DESC, reason LIMIT 3""")
def recurring(spark, d):
    b = st.blockers(spark, d)
    known = b.select("run_id").distinct().withColumn("status", F.when(F.col("run_id") % 7 == 0, "failed").otherwise("completed"))
    return ledger.recurring(b, known)


@query("A19_region_stats", """WITH o AS (SELECT n_regionkey AS region, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), t AS (SELECT n_regionkey AS region, count(*) AS texts FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
    c AS (SELECT region, count(*) AS cycles, count(*) FILTER (s = 'F') AS successes, count(*) FILTER (s = 'P') AS failures FROM o GROUP BY region)
    SELECT coalesce(c.region, t.region) AS region, coalesce(cycles, 0) AS cycles, coalesce(successes, 0) AS successes, coalesce(failures, 0) AS failures, coalesce(texts, 0) AS texts FROM c FULL JOIN t ON c.region = t.region""")
def region_stats(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    cycles = o.groupBy("region").agg(F.count("*").alias("cycles"), F.count_if(F.col("o_orderstatus") == "F").alias("successes"), F.count_if(F.col("o_orderstatus") == "P").alias("failures"))
    texts = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("region").agg(F.count("*").alias("texts"))
    return cycles.join(texts, "region", "full_outer").na.fill(0)


@query("A20_texts_per_region", "SELECT r_name AS region, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def texts_per_region(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"))


@query("A21_blocked_reasons", f"WITH {B} SELECT source_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT source_id, reason, count(*) AS n FROM blockers GROUP BY ALL) GROUP BY source_id")
def blocked_reasons(spark, d):
    counted = st.blockers(spark, d).groupBy("source_id", "reason").agg(F.count("*").alias("n"))
    return counted.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", "n"))), ",").alias("reasons"))


@query("A22_cycle_counters", """SELECT count(*) AS leads, count(*) FILTER (event_type = 'purchase') AS downloaded, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT user_id) AS sources, round(sum(value), 2) AS bytes FROM events""")
def cycle_counters(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count("*").alias("leads"), F.count_if(F.col("event_type") == "purchase").alias("downloaded"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_distinct("user_id").alias("sources"), F.round(F.sum("value"), 2).alias("bytes"))


@query("A25_totals", "SELECT l_returnflag AS part, count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def totals(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("part")).agg(F.count("*").alias("files"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))


@query("A29_bucket_counts", "SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def bucket_counts(spark, d):
    bucket = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "middle").otherwise("high")
    return table(spark, d, "events").groupBy(bucket.alias("bucket"), "event_type").agg(F.count("*").alias("n"))


@query("A31_item_outcome", f"""WITH {I}, c AS (SELECT title, count(*) FILTER (status = 'fetched' AND run_id = 1) AS f, count(*) FILTER (status = 'fetched_locked' AND run_id = 1) AS l, count(*) FILTER (status = 'blocked' AND run_id = 1) AS b, count(*) FILTER (status = 'failed' AND run_id = 1) AS x, count(*) FILTER (run_id = 1) AS n FROM items GROUP BY title)
    SELECT title, CASE WHEN f > 0 THEN 'fetched' WHEN l > 0 THEN 'fetched_locked' WHEN b > 0 THEN 'blocked' WHEN x > 0 THEN 'failed' WHEN n = 0 THEN 'no_candidates' ELSE 'skipped' END AS outcome FROM c""")
def item_outcome(spark, d):
    of = lambda s: F.count_if((F.col("status") == s) & (F.col("run_id") == 1))
    c = st.items(spark, d).groupBy("title").agg(of("fetched").alias("f"), of("fetched_locked").alias("l"), of("blocked").alias("b"), of("failed").alias("x"), F.count_if(F.col("run_id") == 1).alias("n"))
    return c.select("title", ledger.outcome(F.col("f"), F.col("l"), F.col("b"), F.col("x"), F.col("n")).alias("outcome"))


@query("A32_next_id", "SELECT greatest(coalesce(max(event_id), 0), 1) AS next_id FROM events")
def next_id(spark, d):
    return table(spark, d, "events").agg(F.greatest(F.coalesce(F.max("event_id"), F.lit(0)), F.lit(1)).alias("next_id"))


@query("W2_last_two_runs", f"WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY list_name ORDER BY run_id DESC) AS place FROM runs WHERE status = 'completed') SELECT list_name, run_id, coverage, place FROM r WHERE place <= 2")
def last_two_runs(spark, d):
    return ledger.last_two(runs(spark, d)).select("list_name", "run_id", "coverage", "place")


@query("W3_newest_per_url", f"WITH {B}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS rn FROM blockers) SELECT url, id, reason FROM r WHERE rn = 1")
def newest_per_url(spark, d):
    return ranking.first_by(st.blockers(spark, d), ["url"], [F.col("id").desc()]).select("url", "id", "reason")


@query("W4_sequential_ids", "SELECT event_id, 'rec' || lpad(CAST(row_number() OVER (ORDER BY event_id) - 1 AS VARCHAR), 6, '0') AS id FROM events")
def sequential_ids(spark, d):
    return records.number(table(spark, d, "events").select("event_id"), "event_id")


@query("W6_coverage_delta", f"WITH {RUNS}, c AS (SELECT *, lag(coverage) OVER (PARTITION BY list_name ORDER BY run_id) AS previous FROM runs WHERE status = 'completed') SELECT list_name, run_id, coverage, previous, floor((coverage - previous) * 1000 + 0.5) / 1000 AS delta FROM c")
def coverage_delta(spark, d):
    return ledger.coverage_changes(runs(spark, d)).select("list_name", "run_id", "coverage", "previous", "delta")


CHANGES = f"""{I}, now AS (SELECT title, max_by(status, pos) AS status, max(pos) AS pos FROM items WHERE run_id = 2 GROUP BY title), old AS (SELECT title, max_by(status, pos) AS before FROM items WHERE run_id = 1 GROUP BY title),
    k(s, r) AS (VALUES ('failed', 0), ('skipped', 1), ('blocked', 2), ('no_candidates', 3), ('fetched_locked', 4), ('fetched', 5)),
    j AS (SELECT now.*, before, a.r AS ra, b.r AS rb FROM now LEFT JOIN old USING (title) LEFT JOIN k a ON a.s = status LEFT JOIN k b ON b.s = before)"""


def _changes(spark, d):
    i = st.items(spark, d)
    now = i.where("run_id = 2").groupBy("title", "author").agg(F.max_by("status", "pos").alias("status"), F.max("pos").alias("pos"))
    return ledger.item_changes(now, i.where("run_id = 1"))


@query("J10_item_diff", f"WITH {CHANGES} SELECT title, status, before FROM j")
def item_diff(spark, d):
    return _changes(spark, d).select("title", "status", "before")


@query("W7_transitions", f"WITH {CHANGES} SELECT title, CASE WHEN before IS NULL THEN 'new' WHEN ra > rb THEN 'improved' WHEN ra < rb THEN 'regressed' ELSE 'unchanged' END AS change FROM j")
def transitions(spark, d):
    return _changes(spark, d).select("title", "change")


@query("W9_once_per_run", f"WITH {B}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, source_id ORDER BY id) AS rn FROM blockers WHERE reason = 'error_0') SELECT id, run_id, source_id FROM r WHERE rn = 1 UNION ALL SELECT id, run_id, source_id FROM blockers WHERE reason <> 'error_0'")
def once_per_run(spark, d):
    b = st.blockers(spark, d).withColumns({"key": F.when(F.col("reason") == "error_0", F.col("source_id")), "seq": F.col("id")})
    return ledger.once_per_run(b).select("id", "run_id", "source_id")


@query("J9_fetch_queue", f"""WITH {B}, h AS (SELECT DISTINCT user_id AS work_id FROM events WHERE event_type = 'purchase' AND value > 60), m AS (SELECT * FROM blockers ANTI JOIN h USING (work_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS rn FROM m) SELECT id, url, p_name AS title FROM r LEFT JOIN part ON p_partkey = work_id WHERE rn = 1""")
def fetch_queue(spark, d):
    b = st.blockers(spark, d).withColumn("edition_id", F.col("work_id"))
    held = table(spark, d, "events").where("event_type = 'purchase' AND value > 60").select(F.col("user_id").alias("work_id"))
    candidates = table(spark, d, "part").select(F.col("p_partkey").alias("edition_id"), F.col("p_name").alias("title"))
    return ledger.queue(b, held, candidates).select("id", "url", "title")


@query("J21_verdict_cache", "WITH c AS (SELECT doc_id, quality FROM labels) SELECT d.doc_id, c.quality FROM documents d LEFT JOIN c USING (doc_id)")
def verdict_cache(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("J21_cache_misses", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def cache_misses(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("J20_already_held", "SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def already_held(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("J27_blocker_candidate", f"""WITH {B}, a AS (SELECT id, p_name AS by_edition FROM blockers LEFT JOIN part ON p_partkey = work_id AND p_size > 25), u AS (SELECT 'https://example.org/' || p_size AS url, min(p_name) AS by_url FROM part GROUP BY 1)
    SELECT b.id, coalesce(by_edition, by_url) AS candidate FROM blockers b JOIN a USING (id) LEFT JOIN u USING (url)""")
def blocker_candidate(spark, d):
    part = table(spark, d, "part")
    by_edition = part.where("p_size > 25").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("by_edition"))
    by_url = part.groupBy(F.concat(F.lit("https://example.org/"), "p_size").alias("url")).agg(F.min("p_name").alias("by_url"))
    return st.blockers(spark, d).join(by_edition, "work_id", "left").join(by_url, "url", "left").select("id", F.coalesce("by_edition", "by_url").alias("candidate"))


@query("T1_blocker_ledger", """SELECT event_id, user_id AS source_id, CASE WHEN regexp_matches(props, '(?i)429|rate limit|too many requests') THEN 'rate_limited' WHEN regexp_matches(props, '(?i)timed? ?out') THEN 'timeout' WHEN regexp_matches(props, '(?i)403|forbidden|robots') THEN 'forbidden'
    WHEN regexp_matches(props, '(?i)404|not found') THEN 'not_found' WHEN regexp_matches(props, '(?i)too large|exceeds') THEN 'too_large' ELSE 'other' END AS reason FROM events WHERE event_type = 'error'""")
def blocker_ledger(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.blockers(e).drop("ts")


def _streamed(spark, d, make, mode="append"):
    """The stream's result after all input, as a table."""
    at = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    made = make(stream.read_events(spark, f"{d}/events.parquet"))
    stream.run_once(made, f"{at}/out", f"{at}/checkpoint", mode)
    return spark.read.schema(made.schema).parquet(f"{at}/out")


@query("T1_blocker_stream", "SELECT event_id, user_id AS source_id, CASE WHEN props IS NULL THEN 'unknown' " + " ".join(f"WHEN regexp_matches(props, '{p}') THEN '{r}'" for r, p in stream.REASONS) + " ELSE 'other' END AS reason FROM events WHERE event_type = 'error'")
def blocker_stream(spark, d):
    return _streamed(spark, d, stream.blockers).select("event_id", "source_id", "reason")


@query("T2_idempotent_executions", "SELECT execution_key, min(event_id) AS event_id FROM (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS execution_key, event_id FROM events) GROUP BY 1")
def idempotent_executions(spark, d):
    e = table(spark, d, "events").select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("execution_key"), "event_id")
    return ranking.first_by(e, ["execution_key"], [F.col("event_id")])


@query("T2_idempotent_stream", "SELECT DISTINCT user_id || ':' || strftime(ts, '%Y-%m-%d') AS execution_key FROM events")
def idempotent_stream(spark, d):
    keyed = lambda e: stream.once_per_key(e.withColumn("execution_key", F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd"))), "execution_key", "40 days").select("execution_key")
    return _streamed(spark, d, keyed)


@query("T3_local_time", """SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS local_date, strftime(ts + INTERVAL 9 HOUR, '%H:%M') AS local_time, CAST(dayofweek(ts + INTERVAL 9 HOUR) AS INTEGER) AS weekday FROM events""")
def local_time(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", *[c.alias(n) for n, c in ledger.local_parts(F.col("ts"), F.lit("Asia/Tokyo")).items()])


@query("T6_latest_state", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_state(spark, d):
    return ledger.latest_state(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("T7_orphans", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01'")
def orphans(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.col("o_orderdate").alias("started_at"))
    return ledger.orphans(r, F.expr("TIMESTAMP_NTZ '1996-01-01'")).select("o_orderkey")


@query("T9_retry_list", f"WITH {I} SELECT list_name, run_id, count(*) FILTER (NOT ({FETCHED})) AS n_retry FROM items GROUP BY ALL")
def retry_list(spark, d):
    return st.items(spark, d).groupBy("list_name", "run_id").agg(F.count_if(ledger.to_retry(F.col("status"))).alias("n_retry"))


@query("T13_timezone_guard", "SELECT user_id, bool_and(CAST(ts AS DATE) = CAST(ts + INTERVAL 9 HOUR AS DATE)) AS safe FROM events GROUP BY user_id")
def timezone_guard(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_and(F.to_date(ts) == F.to_date(F.from_utc_timestamp(ts, "Asia/Tokyo"))).alias("safe"))


@query("T_extension_tumbling", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.windowed(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("T_extension_sessions", """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("J14_group_pairs", """WITH m AS (SELECT n_regionkey AS g, n_nationkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos FROM nation) SELECT a.g AS "group", a.id AS src, b.id AS dst FROM m a JOIN m b ON a.g = b.g AND a.pos < b.pos""")
def group_pairs(spark, d):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return graph.group_pairs(table(spark, d, "nation").select(F.col("n_regionkey").alias("group"), F.col("n_nationkey").alias("id"), F.row_number().over(w).alias("pos")))


@query("T4_slot_claims", """
    WITH RECURSIVE e AS (SELECT user_id % 5 AS slot, event_id AS seq, 'u' || user_id AS holder, event_type = 'purchase' AS freed, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS k FROM events),
    s AS (SELECT DISTINCT slot, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS holder, '' AS verdict, CAST(NULL AS VARCHAR) AS active FROM e
        UNION ALL SELECT e.slot, e.k, e.seq, e.holder, CASE WHEN freed AND coalesce(active = e.holder, false) THEN 'released' WHEN freed THEN 'ignored' WHEN active IS NULL THEN 'claimed' ELSE 'skipped' END,
            CASE WHEN freed AND coalesce(active = e.holder, false) THEN NULL WHEN freed THEN active ELSE coalesce(active, e.holder) END
        FROM s JOIN e ON s.slot = e.slot AND e.k = s.k + 1)
    SELECT slot, seq, holder, verdict FROM s WHERE k > 0""")
def slot_claims(spark, d):
    """Users claim the slot of their list at each event and release it at a purchase."""
    def make(e):
        requests = e.select((F.col("user_id") % 5).alias("slot"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), "user_id").alias("holder"), F.when(F.col("event_type") == "purchase", "release").otherwise("claim").alias("action"))
        return stream.claims(requests)

    return _streamed(spark, d, make)


@query("T12_ttl_cache", """
    WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS fetched, '' AS verdict FROM e
        UNION ALL SELECT e.key, e.k, e.seq, CASE WHEN t - fetched <= 21600 THEN fetched ELSE t END, CASE WHEN t - fetched <= 21600 THEN 'hit' ELSE 'miss' END FROM s JOIN e ON s.key = e.key AND e.k = s.k + 1)
    SELECT key, seq, verdict FROM s WHERE k > 0""")
def ttl_cache(spark, d):
    """Whether each event's user is still in a cache of six hours; what is older leaves the state by a timer."""
    keyed.with_timers(spark)
    return _streamed(spark, d, lambda e: keyed.cached(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts"), 6 * 3600.0))


@query("T4_leased_claims", """
    WITH RECURSIVE e AS (SELECT user_id AS slot, epoch(ts) AS t, event_type = 'purchase' AS freed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('purchase', 'error')),
    s AS (SELECT DISTINCT slot, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS since, CAST(0 AS BIGINT) AS claimed, CAST(0 AS BIGINT) AS released FROM e
        UNION ALL SELECT s.slot, e.k, CASE WHEN freed THEN NULL WHEN t - since <= 86400 THEN since ELSE t END,
            claimed + CASE WHEN NOT freed AND coalesce(t - since > 86400, true) THEN 1 ELSE 0 END, released + CASE WHEN freed AND coalesce(t - since <= 86400, false) THEN 1 ELSE 0 END
        FROM s JOIN e ON s.slot = e.slot AND e.k = s.k + 1)
    SELECT slot, claimed, released FROM s QUALIFY row_number() OVER (PARTITION BY slot ORDER BY k DESC) = 1""")
def leased_claims(spark, d):
    """Each user's errors claim a slot for a day at most, which a purchase releases: the claims and releases that took effect."""
    keyed.with_timers(spark)

    def make(e):
        own = e.where("event_type IN ('purchase', 'error')")
        return keyed.leased(own.select(F.col("user_id").alias("slot"), F.col("event_id").alias("seq"), "ts", F.lit("h").alias("holder"), F.when(F.col("event_type") == "purchase", "release").otherwise("claim").alias("action")), 86400.0)

    return _streamed(spark, d, make).groupBy("slot").agg(F.count_if(F.col("verdict") == "claimed").alias("claimed"), F.count_if(F.col("verdict") == "released").alias("released"))


@query("J27_resolution_stream", """
    WITH b AS (SELECT event_id AS blocker_id, user_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT event_id AS resolution_id, user_id, ts AS done FROM events WHERE event_type = 'purchase')
    SELECT blocker_id, b.user_id AS source_id, resolution_id FROM b LEFT JOIN r ON b.user_id = r.user_id AND done >= ts AND done <= ts + INTERVAL 6 HOUR
    WHERE ts < (SELECT least(max(ts) FILTER (event_type = 'error'), max(ts) FILTER (event_type = 'purchase')) FROM events) - INTERVAL 8 HOUR""")
def resolution_stream(spark, d):
    """Errors and the purchases of the same user within six hours as two streams; of blockers whose time had passed when the streams ended."""
    def make(e):
        blocked = e.where("event_type = 'error'").select(F.col("event_id").alias("blocker_id"), F.col("user_id").alias("source_id"), "ts")
        return stream.resolutions(blocked, e.where("event_type = 'purchase'").select(F.col("event_id").alias("resolution_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("resolved_at")))

    ends = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).agg(*[F.max(F.when(F.col("event_type") == k, F.col("ts"))).alias(k) for k in ("error", "purchase")])
    over = ends.select((F.least("error", "purchase") - F.expr("INTERVAL 8 HOURS")).alias("over"))
    # One row on the right.
    return _streamed(spark, d, make).join(F.broadcast(over), F.col("ts") < F.col("over")).select("blocker_id", "source_id", "resolution_id")


@query("T10_progress", "SELECT user_id % 50 AS run_id, arg_max(event_type, event_id) AS phase, max(event_id) AS done FROM events GROUP BY 1")
def progress(spark, d):
    """The newest snapshot of each run, overwritten batch by batch."""
    at = f"{scratch_folder(spark)}/progress-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/{number}")

    e = stream.read_events(spark, f"{d}/events.parquet").select((F.col("user_id") % 50).alias("run_id"), F.col("event_type").alias("phase"), F.col("event_id").alias("done"), F.lit(0).alias("total"), F.col("event_id").alias("seq"))
    stream.run_batches(stream.progress(e), write, f"{at}/checkpoint")
    written = spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out")
    return written.groupBy("run_id").agg(F.max_by(F.struct("phase", "done"), "batch").alias("p")).select("run_id", "p.phase", "p.done")
