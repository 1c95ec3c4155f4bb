"""The supplied tables in the roles of figures, edges, runs, items and blockers; Spark and SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.operators import traits as tr
from traitloom.plans.registry import spread, table

#: Fixed values of the roles: which item state an event type stands for.
STATES = {"purchase": "fetched", "signup": "fetched_locked", "view": "blocked", "click": "skipped", "error": "failed"}


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as figures: brand for tradition, words of the name, type and size for traits."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("tradition"), F.replace("p_name", F.lit(" "), F.lit(",")).alias("words"),
        F.col("p_type").alias("kind"), F.col("p_size").cast("string").alias("size"), F.col("p_size").alias("n"), F.col("p_retailprice").alias("price"))


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.figure_traits(spread(figures(spark, sf_dir)), "id", {"words": "name", "kind": "type", "size": "size"})


TRAITS_SQL = """
raw AS (
    SELECT p_partkey AS figure_id, 'name' AS category, lower(trim(unnest(string_split(p_name, ' ')))) AS t FROM part
    UNION ALL SELECT p_partkey, 'type', lower(trim(p_type)) FROM part
    UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part
), traits AS (
    SELECT DISTINCT figure_id, category,
           CASE WHEN length(t) >= 4 AND regexp_matches(t, 's$') AND NOT regexp_matches(t, '(ss|us|is|os|as)$') THEN substr(t, 1, length(t) - 1) ELSE t END AS token
    FROM raw WHERE length(t) BETWEEN 2 AND 59
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations joined by trade: a customer's and a supplier's nation of the same line, by ship flag."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    joined = line.join(order, line.l_orderkey == order.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_returnflag").alias("relation")).distinct()


EDGES_SQL = """
edges AS (
    SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst, l_returnflag AS relation
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of daily runs of three lists."""
    e = table(spark, sf_dir, "events")
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return e.select(F.col("event_id").alias("pos"), F.dayofmonth("ts").alias("run_id"), F.concat(F.lit("list "), F.col("user_id") % 3).alias("list_name"),
                    F.concat(F.lit("user "), F.col("user_id")).alias("title"), F.lit(None).cast("string").alias("author"), F.try_element_at(state, F.col("event_type")).alias("status"))


ITEMS_SQL = """
items AS (
    SELECT event_id AS pos, CAST(day(ts) AS INTEGER) AS run_id, 'list ' || (user_id % 3) AS list_name, 'user ' || user_id AS title, CAST(NULL AS VARCHAR) AS author,
           CASE event_type WHEN 'purchase' THEN 'fetched' WHEN 'signup' THEN 'fetched_locked' WHEN 'view' THEN 'blocked' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'failed' END AS status
    FROM events
)"""


def blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and views as blockers; the reason and the address come from the payload's number."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(F.col("event_id").alias("id"), F.dayofmonth("ts").alias("run_id"), F.concat(F.lit("src"), F.col("user_id") % 10).alias("source_id"),
                    F.concat(F.col("event_type"), F.lit("_"), F.col("k") % 4).alias("reason"), F.concat(F.lit("https://example.org/"), F.col("k")).alias("url"), F.col("props").alias("detail"), F.col("user_id").alias("work_id"))


BLOCKERS_SQL = """
blockers AS (
    SELECT event_id AS id, CAST(day(ts) AS INTEGER) AS run_id, 'src' || (user_id % 10) AS source_id,
           event_type || '_' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) AS reason,
           'https://example.org/' || json_extract_string(props, '$.k') AS url, props AS detail, user_id AS work_id
    FROM events WHERE event_type IN ('error', 'view')
)"""


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as editions: four to a work, the source's last digit for format and role."""
    d = table(spark, sf_dir, "documents")
    return d.select((F.col("doc_id") / 4).cast("long").alias("work_id"), F.concat(F.lit("ed"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("edition_id"), F.col("lang").alias("language"),
                    F.when(F.col("doc_id") % 2 == 0, "original").otherwise("translation").alias("language_role"), F.when(F.col("doc_id") % 3 == 0, "txt").when(F.col("doc_id") % 3 == 1, "html").otherwise("pdf").alias("format"),
                    (F.col("doc_id") % 5 != 0).alias("available"), F.lower("text").alias("evidence"))
