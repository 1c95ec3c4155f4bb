"""Queries over versioned tables: changes merged on read, writers side by side, lookups by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.plans.registry import query, table
from traitloom.sources.scratch import scratch_folder
from traitloom.sources.versioned import ConflictError, Store


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{scratch_folder(spark)}/versioned-{uuid.uuid4().hex}")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


@query("M2_merge_on_read", """
    SELECT o_orderkey AS id, o_custkey AS customer,
           CASE WHEN o_orderkey % 194 = 1 THEN 1.5 WHEN o_orderkey % 200 = 0 THEN 7.0 WHEN o_orderkey % 50 = 0 THEN 2 * o_totalprice ELSE o_totalprice END AS price,
           CASE WHEN o_orderkey % 300 = 0 THEN 'Z' WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END AS status
    FROM orders WHERE o_orderkey % 97 <> 1 OR o_orderkey % 194 = 1""")
def merge_on_read(spark, d):
    """Fields set twice, rows deleted and some added again under the same key, a compaction in between."""
    kept, orders = _store(spark), _orders(spark, d)
    kept.commit({"orders": orders})
    kept.update("orders", orders.where("id % 50 = 0").select("id", (2 * F.col("price")).alias("price")), ("price", "status"))
    kept.update("orders", orders.where("id % 100 = 0").select("id", F.lit("X").alias("status")), ("price", "status"))
    kept.compact("orders")
    kept.delete("orders", orders.where("id % 97 = 1"))

    def back(change):
        change.add("orders", orders.where("id % 194 = 1").withColumn("price", F.lit(1.5)))
        change.update("orders", orders.where("id % 200 = 0").select("id", F.lit(7.0).alias("price"), F.when(F.col("id") % 300 == 0, "Z").alias("status")))
        change.update("orders", orders.where("id % 300 = 0").select("id", F.lit("Z").alias("status")))

    kept.transact(back)
    return kept.read("orders")


@query("M5_interleaved_writers", """
    WITH a AS (SELECT r_name AS name FROM region), b AS (SELECT n_name AS name FROM nation), c AS (SELECT DISTINCT p_brand AS name FROM part), n AS (SELECT count(*) AS n FROM a)
    SELECT row_number() OVER (ORDER BY name) AS id, name FROM c
    UNION ALL SELECT (SELECT count(*) FROM c) + row_number() OVER (ORDER BY name), name FROM a
    UNION ALL SELECT (SELECT count(*) FROM c) + (SELECT n FROM n) + row_number() OVER (ORDER BY name), name FROM b""")
def interleaved_writers(spark, d):
    """Two writers begin on one version and both add rows; the second is refused and works anew on what the first left."""
    kept = _store(spark)
    names = lambda t, c: table(spark, d, t).select(F.lit(None).cast("long").alias("id"), F.col(c).alias("name"))
    kept.commit({"names": names("part", "p_brand").limit(0)})
    kept.insert("names", names("part", "p_brand").distinct())
    first, second = kept.begin(), kept.begin()
    second.insert("names", names("nation", "n_name"))
    first.insert("names", names("region", "r_name"))
    first.commit()
    try:
        second.commit()
    except ConflictError:
        kept.insert("names", names("nation", "n_name"))
    return kept.read("names")


@query("S2_range_lookup", "SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS price FROM orders WHERE o_orderkey IN (SELECT 11 * n_nationkey * n_nationkey FROM nation)")
def range_lookup(spark, d):
    """Rows by key: only the ranges of the key that may hold them are opened, and the changes of these keys laid over them."""
    kept, orders = _store(spark), _orders(spark, d)
    kept.commit({"orders": orders})
    kept.update("orders", orders.where("id % 2 = 0").select("id", (F.col("price") + 1).alias("price")), ("price",))
    wanted = [r["k"] for r in table(spark, d, "nation").select((11 * F.col("n_nationkey").cast("long") * F.col("n_nationkey")).alias("k")).collect()]
    return kept.lookup("orders", wanted).select("id", "customer", "price")
