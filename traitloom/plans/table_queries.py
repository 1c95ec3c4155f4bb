"""Scans, predicates, joins, sorts and set operations over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.functions import tokens as tk
from traitloom.functions import web
from traitloom.operators import graph, ranking, validation
from traitloom.plans import stand_in as st
from traitloom.plans.registry import query, table

E = st.EDGES_SQL


@query("S1_full_scan", "SELECT * FROM nation")
def full_scan(spark, d):
    return table(spark, d, "nation")


@query("S2_keyed_lookup", "SELECT * FROM part WHERE p_partkey = 17")
def keyed_lookup(spark, d):
    return table(spark, d, "part").where("p_partkey = 17").limit(1)


@query("S3_scoped_scan", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def scoped_scan(spark, d):
    return table(spark, d, "nation").where("n_regionkey = 2").select("n_nationkey", "n_name")


@query("S4_graph_bundle", "SELECT r_name, count(*) AS n, string_agg(n_name, '|' ORDER BY n_nationkey) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def graph_bundle(spark, d):
    nested = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    return nested.select("r_name", F.size("nations").cast("long").alias("n"), F.array_join("nations.n_name", "|").alias("nations"))


@query("S30_fresh_cache", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20'")
def fresh_cache(spark, d):
    return table(spark, d, "events").where("ts > TIMESTAMP_NTZ '2024-01-20'").select("event_id")


@query("S32_robots", """WITH r(rule, allow) AS (VALUES ('/en', false), ('/en/1', true), ('/fr', false), ('/fr/2', true)), p AS (SELECT DISTINCT '/' || split_part(split_part(url, '://', 2), '/', 2) || '/' || regexp_extract(url, '/(\\d+)', 1) AS path FROM pages),
    m AS (SELECT path, max_by(allow, length(rule) * 2 + CAST(allow AS INTEGER)) AS a FROM p JOIN r ON starts_with(path, rule) GROUP BY path) SELECT path, coalesce(a, true) AS allowed FROM p LEFT JOIN m USING (path)""")
def robots(spark, d):
    url = F.col("url")
    path = F.concat(F.lit("/"), F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2)), F.lit("/"), F.regexp_extract(url, r"/(\d+)", 1))
    paths = table(spark, d, "pages").select(F.lit("h").alias("host"), path.alias("path")).distinct()
    rules = spark.createDataFrame([("h", "/en", False), ("h", "/en/1", True), ("h", "/fr", False), ("h", "/fr/2", True)], "host string, rule string, allow boolean")
    return ranking.robots_decisions(paths, rules).select("path", "allowed")


@query("P1_projection", "SELECT c_name, c_acctbal FROM customer")
def projection(spark, d):
    return table(spark, d, "customer").select("c_name", "c_acctbal")


@query("P2_drop_column", "SELECT event_id, user_id, event_type, value FROM events")
def drop_column(spark, d):
    return table(spark, d, "events").drop("props", "ts")


@query("P3_conjunction", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def conjunction(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("P4_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("P5_like_and_range", "SELECT p_partkey FROM part WHERE p_name LIKE '%ring' AND p_retailprice < 1000 AND p_brand IS NOT NULL")
def like_and_range(spark, d):
    return table(spark, d, "part").where(F.col("p_name").like("%ring") & (F.col("p_retailprice") < 1000) & F.col("p_brand").isNotNull()).select("p_partkey")


@query("P6_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) < 10")
def json_path(spark, d):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    return table(spark, d, "events").where(k < 10).select("event_id", k.alias("k"))


@query("P7_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\\x00-\\x7F]') AND text NOT LIKE '%(%'")
def regex(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(r"[^\x00-\x7F]") & ~F.col("text").like("%(%")).select("doc_id")


@query("P8_array_contains", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'gizmo')")
def array_contains(spark, d):
    return table(spark, d, "part").where(F.array_contains(F.split("p_name", " "), "gizmo")).select("p_partkey")


@query("P9_token_in_csv", "SELECT p_partkey FROM part WHERE ',' || replace(p_name, ' ', ',') || ',' LIKE '%,hot,%'")
def token_in_csv(spark, d):
    return st.figures(spark, d).where(F.array_contains(F.split("words", ","), "hot")).select(F.col("id").alias("p_partkey"))


@query("P10_undirected_pairs", f"WITH {E} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM edges GROUP BY 1, 2")
def undirected_pairs(spark, d):
    return graph.unordered(st.edges(spark, d)).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count("*").alias("n"))


@query("P11_text_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'old') OR contains(lower(p_type), 'old') OR contains(lower(p_brand), '#25')")
def text_search(spark, d):
    has = lambda c, q: F.contains(F.lower(c), F.lit(q))
    return table(spark, d, "part").where(has("p_name", "old") | has("p_type", "old") | has("p_brand", "#25")).select("p_partkey")


@query("P12_map_search", "SELECT event_id FROM events WHERE list_contains(list_transform(map_values(MAP {'kind': event_type, 'props': props}), lambda x: contains(lower(x), '99')), true)")
def map_search(spark, d):
    m = F.create_map(F.lit("kind"), "event_type", F.lit("props"), "props")
    return table(spark, d, "events").where(F.exists(F.map_values(m), lambda x: F.contains(F.lower(x), F.lit("99")))).select("event_id")


NAMED = f"{E}, named AS (SELECT e.*, a.n_name AS src_name, b.n_name AS dst_name FROM edges e LEFT JOIN nation a ON src = a.n_nationkey LEFT JOIN nation b ON dst = b.n_nationkey)"


def _named(spark, d):
    return graph.with_names(st.edges(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("J5_edge_names", f"WITH {NAMED} SELECT src, dst, relation, src_name, dst_name FROM named")
def edge_names(spark, d):
    return _named(spark, d).select("src", "dst", "relation", "src_name", "dst_name")


@query("P13_edge_search", f"WITH {NAMED} SELECT src, dst, relation FROM named WHERE contains(lower(src_name), 'nation_2') OR contains(lower(dst_name), 'nation_2') OR contains(lower(relation), 'nation_2')")
def edge_search(spark, d):
    return graph.search_edges(_named(spark, d), "NATION_2").select("src", "dst", "relation")


@query("P14_filters_and_counts", "SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (contains(lower(text), 'license')) AS hits FROM documents WHERE n_chars > 500")
def filters_and_counts(spark, d):
    return table(spark, d, "documents").where("n_chars > 500").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("source") == "src0").alias("src0"), F.count_if(F.contains(F.lower("text"), F.lit("license"))).alias("hits"))


@query("P16_visibility", "SELECT p_partkey FROM part WHERE coalesce(p_brand, '') <> 'Brand#1' AND p_brand IN ('Brand#2', 'Brand#3', 'Brand#1')")
def visibility(spark, d):
    f = st.figures(spark, d)
    return f.where((F.coalesce("tradition", F.lit("")) != "Brand#1") & F.col("tradition").isin("Brand#2", "Brand#3", "Brand#1")).select(F.col("id").alias("p_partkey"))


@query("P17_visible_edges", f"WITH {E} SELECT src, dst, relation FROM edges WHERE relation IN ('A', 'R') AND src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def visible_edges(spark, d):
    nodes = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    return graph.visible_edges(st.edges(spark, d), nodes, ["A", "R"])


@query("P18_nonempty_map", "SELECT event_id FROM events WHERE cardinality(map_keys(CASE WHEN value > 20 THEN MAP {'v': value} ELSE MAP {} END)) > 0")
def nonempty_map(spark, d):
    m = F.when(F.col("value") > 20, F.create_map(F.lit("v"), "value")).otherwise(F.create_map().cast("map<string,double>"))
    return table(spark, d, "events").where(F.coalesce(F.size(m), F.lit(0)) > 0).select("event_id")


@query("P20_unique_ids", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_ids(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1").select("o_custkey")


@query("P23_allowed_urls", """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, scheme = 'https' AND (host = 'example.net' OR host LIKE '%.example.net' OR host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en') AS allowed FROM p""")
def allowed_urls(spark, d):
    return table(spark, d, "pages").select("page_id", web.url_allowed(F.col("url"), ["example.net", "example.com"], ["/en"]).alias("allowed"))


@query("P31_lead_gate", r"""WITH r(host, automated) AS (VALUES ('example.com', true), ('example.org', false)), p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages),
    h AS (SELECT page_id, bool_or(automated) AS automated FROM p JOIN r ON p.host = r.host OR ends_with(p.host, '.' || r.host) GROUP BY 1)
    SELECT page_id AS lead_id, CASE WHEN NOT regexp_matches(url, '(?i)^https://') THEN 'not_https' WHEN automated IS NULL THEN 'unregistered_host' WHEN NOT automated THEN 'automated_download_forbidden' END AS reason FROM p LEFT JOIN h USING (page_id)""")
def lead_gate(spark, d):
    registry = spark.createDataFrame([("example.com", True), ("example.org", False)], "host string, automated boolean")
    return validation.lead_gate(table(spark, d, "pages").select(F.col("page_id").alias("lead_id"), "url"), registry).select("lead_id", "reason")


@query("J6_id_remap", """WITH o AS (SELECT n_nationkey AS old, 'm' || (n_nationkey % 7) AS name FROM nation), w AS (SELECT s_nationkey + 100 AS new, 'm' || (s_nationkey % 7) AS name FROM supplier WHERE s_nationkey < 5 GROUP BY ALL), i AS (SELECT old, new FROM o JOIN w USING (name)), e AS (SELECT n_nationkey AS src, n_regionkey AS dst, 'in' AS relation FROM nation)
    SELECT a.new AS src, b.new AS dst, relation FROM e JOIN i a ON src = a.old JOIN i b ON dst = b.old""")
def id_remap(spark, d):
    nation = table(spark, d, "nation")
    old = nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("m"), F.col("n_nationkey") % 7).alias("name"))
    new = table(spark, d, "supplier").where("s_nationkey < 5").select((F.col("s_nationkey") + 100).alias("id"), F.concat(F.lit("m"), F.col("s_nationkey") % 7).alias("name")).distinct()
    return graph.remap_ids(nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.lit("in").alias("relation")), old, new)


@query("J7_orphan_repair", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40) THEN l_partkey END AS l_partkey FROM lineitem")
def orphan_repair(spark, d):
    known = table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("known"))
    joined = table(spark, d, "lineitem").join(known, F.col("l_partkey") == F.col("known"), "left")
    return joined.select("l_orderkey", "l_linenumber", F.when(F.col("known").isNotNull(), F.col("l_partkey")).alias("l_partkey"))


@query("J8_all_keys_resolve", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey % 5 = 0 OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25)) AND (l_suppkey % 2 = 0 OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))""")
def all_keys_resolve(spark, d):
    line = table(spark, d, "lineitem").withColumns({"a": F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")), "b": F.when(F.col("l_suppkey") % 2 != 0, F.col("l_suppkey"))})
    part = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("ka"))
    supplier = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("kb"))
    found = line.join(part, F.col("a") == F.col("ka"), "left").join(supplier, F.col("b") == F.col("kb"), "left")
    return found.where((F.col("a").isNull() | F.col("ka").isNotNull()) & (F.col("b").isNull() | F.col("kb").isNotNull())).select("l_orderkey", "l_linenumber")


@query("J11_region_fallback", "SELECT c_custkey, coalesce(r.r_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILT' END) AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 12 LEFT JOIN region r ON n_regionkey = r_regionkey")
def region_fallback(spark, d):
    named = table(spark, d, "nation").where("n_nationkey < 12").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return table(spark, d, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("r_name", F.when(F.col("c_mktsegment") == "BUILDING", "BUILT")).alias("region"))


@query("J12_dimensions", "SELECT s_suppkey, n_name AS tradition, r_name AS family FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimensions(spark, d):
    return (table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", F.col("n_name").alias("tradition"), F.col("r_name").alias("family")))


@query("J13_name_cascade", """WITH p AS (SELECT p_partkey AS probe, CASE WHEN p_partkey % 4 = 2 THEN upper(p_name) WHEN p_partkey % 4 = 3 THEN split_part(p_name, ' ', 1) ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE 'none' END AS t FROM part),
    v AS (SELECT probe, t, name, unnest(list_distinct([lower(name), replace(lower(name), 'v', 'w'), replace(lower(name), 'w', 'v')])) AS variant FROM p), n AS (SELECT p_partkey AS id, p_name AS name, p_brand AS t FROM part WHERE p_partkey % 3 = 0),
    nv AS (SELECT id, t, unnest(list_distinct([lower(name), replace(lower(name), 'v', 'w'), replace(lower(name), 'w', 'v')])) AS variant FROM n),
    h AS (SELECT probe, 2 AS level, id, p.t = n.t AS same FROM p JOIN n USING (name) UNION SELECT probe, 3, id, v.t = nv.t FROM v JOIN nv USING (variant) UNION SELECT probe, 4, id, v.t = n.t FROM v JOIN n ON lower(n.name) = variant OR lower(split_part(n.name, ' ', 1)) = variant),
    c AS (SELECT probe, level, count(*) AS k, min(id) AS one, count(*) FILTER (same) AS ks, min(id) FILTER (same) AS fs FROM h GROUP BY probe, level), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY probe ORDER BY level) = 1)
    SELECT probe, CASE WHEN k = 1 THEN one ELSE fs END AS id, CASE WHEN level = 2 AND ks > 0 THEN 1 ELSE level END AS level, coalesce(k, 0) > 1 AND fs IS NULL AS ambiguous FROM p LEFT JOIN b USING (probe)""")
def name_cascade(spark, d):
    f, k = st.figures(spark, d), F.col("id") % 4
    probes = f.select(F.col("id").alias("probe"), F.when(k == 2, F.upper("name")).when(k == 3, F.split_part("name", F.lit(" "), F.lit(1))).otherwise(F.col("name")).alias("name"), F.when(k == 0, F.col("tradition")).otherwise("none").alias("tradition"))
    return graph.name_cascade(probes, f.where("id % 3 = 0").select("id", "name", "tradition"))


@query("J15_identification", """WITH h AS (SELECT a.p_partkey AS id, a.p_name AS target, b.p_partkey AS found, row_number() OVER (PARTITION BY a.p_partkey, a.p_name ORDER BY (a.p_brand = b.p_brand), b.p_partkey) AS rn FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey)
    SELECT id, target, found FROM h WHERE rn = 1""")
def identification(spark, d):
    f = st.figures(spark, d)
    return graph.identification(f.select("id", "tradition", F.col("name").alias("target")), f.select("id", "name", "tradition"))


@query("J16_new_edges", f"WITH {E}, k AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE relation = 'A'), p AS (SELECT DISTINCT least(n_nationkey, n_regionkey) AS a, greatest(n_nationkey, n_regionkey) AS b FROM nation) SELECT a AS src, b AS dst FROM p ANTI JOIN k USING (a, b)")
def new_edges(spark, d):
    proposed = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))
    return graph.new_edges(proposed, st.edges(spark, d).where("relation = 'A'")).distinct()


@query("J17_backfill", "SELECT p_partkey AS id, count(*) OVER (PARTITION BY p_name || '::' || p_brand) AS n FROM part")
def backfill(spark, d):
    f = st.figures(spark, d).withColumn("k", F.concat_ws("::", "name", "tradition"))
    return f.select("id", "k").join(f.groupBy("k").agg(F.count("*").alias("n")), "k").select("id", "n")


@query("J18_upsert", """WITH a AS (SELECT lower(p_name) AS k, max(p_size) AS size FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT lower(p_name) AS k, min(p_size) AS size FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS name, coalesce(b.size, a.size) AS size FROM a FULL JOIN b ON a.k = b.k""")
def upsert(spark, d):
    f = st.figures(spark, d)
    old = f.where("id % 2 = 0").groupBy(F.lower("name").alias("k")).agg(F.max("n").alias("old"))
    new = f.where("id % 2 = 1").groupBy(F.lower("name").alias("k")).agg(F.min("n").alias("new"))
    return old.join(new, "k", "full_outer").select(F.col("k").alias("name"), F.coalesce("new", "old").alias("size"))


@query("M4_insert_ignore", "SELECT p_name FROM part WHERE p_size < 3 UNION SELECT p_name FROM part WHERE p_size > 48")
def insert_ignore(spark, d):
    f = st.figures(spark, d)
    held = f.where("n < 3").select("name").distinct()
    return held.union(f.where("n > 48").select("name").distinct().join(held, "name", "left_anti")).select(F.col("name").alias("p_name"))


@query("M3_cascading_delete", "SELECT c_custkey FROM customer ANTI JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) x ON c_nationkey = n_nationkey")
def cascading_delete(spark, d):
    gone = table(spark, d, "nation").where("n_regionkey = 1")
    return table(spark, d, "customer").join(gone, F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").select("c_custkey")


@query("M6_node_merge", f"WITH {E} SELECT DISTINCT CASE src WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE src END AS src, CASE dst WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE dst END AS dst, relation FROM edges WHERE CASE src WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE src END <> CASE dst WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE dst END")
def node_merge(spark, d):
    return graph.merge_nodes(st.edges(spark, d), spark.createDataFrame([(3, 1), (4, 1)], "old int, new int"))


@query("J23_related_nodes", f"WITH {E} SELECT dst AS node FROM edges WHERE src = 5 UNION SELECT src FROM edges WHERE dst = 5")
def related_nodes(spark, d):
    return graph.related(st.edges(spark, d), 5)


@query("J24_token_overlap", """WITH q AS (SELECT p_partkey AS query, unnest(list_distinct(string_split(p_name, ' '))) AS t FROM part WHERE p_partkey % 100 = 0), s AS (SELECT query, p_partkey AS id, count(*) AS score FROM part, q WHERE contains(lower(p_name || ' ' || p_brand), t) GROUP BY ALL)
    SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS "rank" FROM s QUALIFY "rank" <= 25""")
def token_overlap(spark, d):
    f = st.figures(spark, d)
    return ranking.token_overlap(f.select("id", F.col("name").alias("title"), F.col("tradition").alias("author")), f.where("id % 100 = 0").select(F.col("id").alias("query"), F.split("name", " ").alias("tokens")), 25)


@query("J25_counts_per_source", "SELECT s.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1) c USING (source)")
def counts_per_source(spark, d):
    docs = table(spark, d, "documents")
    counted = docs.where("lang = 'de'").groupBy("source").agg(F.count("*").alias("n"))
    return docs.select("source").distinct().join(counted, "source", "left").na.fill(0)


@query("J26_spouse_tags", f"WITH {E}, m AS (SELECT src AS id FROM edges WHERE relation = 'R' AND src < dst UNION SELECT dst FROM edges WHERE relation = 'R' AND src < dst) SELECT n_nationkey AS id, CASE WHEN n_nationkey IN (SELECT id FROM m) THEN 'nation|spouse' ELSE 'nation' END AS roles FROM nation")
def spouse_tags(spark, d):
    m = st.edges(spark, d).where("relation = 'R' AND src < dst")
    tagged = m.select(F.col("src").alias("id")).union(m.select("dst")).distinct().withColumn("tag", F.lit("spouse"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id")).join(tagged, "id", "left").select("id", F.array_join(F.array_compact(F.array(F.lit("nation"), "tag")), "|").alias("roles"))


@query("J28_reviews_newest_first", "SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey DESC) FILTER (o_orderkey IS NOT NULL), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def reviews_newest_first(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")), asc=False).alias("x"))
    return table(spark, d, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.array_join(F.transform("x", lambda v: v["o_orderkey"].cast("string")), ","), F.lit("")).alias("orders"))


@query("O1_order_desc", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC")
def order_desc(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())


@query("O2_order_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def order_limit(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey")


@query("O6_nulls_last", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS LAST, doc_id LIMIT 50")
def nulls_last(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").orderBy(F.col("quality").asc_nulls_last(), "doc_id").limit(50).select("doc_id", "quality")


@query("O8_best_file", """WITH f AS (SELECT l_orderkey AS item, 'l' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '-' || l_partkey || '-' || l_suppkey AS name, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS r, l_quantity AS size, l_linestatus = 'O' AS restricted FROM lineitem)
    SELECT item, (SELECT name FROM f g WHERE g.item = f.item AND NOT restricted AND r IS NOT NULL ORDER BY r, size DESC, name LIMIT 1) AS name, bool_and(restricted) AS restricted_only FROM f GROUP BY item""")
def best_file(spark, d):
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat(F.lit("l"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey").alias("name"),
                                              F.col("l_returnflag").alias("format"), F.col("l_quantity").alias("size"), (F.col("l_linestatus") == "O").alias("restricted"))
    return ranking.best_file(files, ["A", "N"])


@query("O12_distinct", "SELECT DISTINCT c_mktsegment FROM customer")
def distinct(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").distinct()


@query("U2_first_of_equals", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def first_of_equals(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("print"))
    return docs.groupBy("print", "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("U3_list_dedupe", "SELECT min(p_partkey) AS id FROM part GROUP BY lower(p_name), lower(p_brand)")
def list_dedupe(spark, d):
    f = st.figures(spark, d).withColumns({"a": F.lower("name"), "b": F.lower("tradition")})
    return ranking.first_by(f, ["a", "b"], [F.col("id")]).select("id")


@query("U4_edge_dedupe", f"WITH {E} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, relation FROM edges")
def edge_dedupe(spark, d):
    return graph.dedupe_edges(st.edges(spark, d))


@query("U5_bag_union", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def bag_union(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("U6_bag_replace", "SELECT p_partkey, p_retailprice * 2 AS price FROM part WHERE p_size = 9 UNION ALL SELECT p_partkey, p_retailprice FROM part WHERE p_size <> 9")
def bag_replace(spark, d):
    part = table(spark, d, "part")
    new = part.where("p_size = 9").select("p_partkey", (F.col("p_retailprice") * 2).alias("price"))
    return part.join(new, "p_partkey", "left_anti").select("p_partkey", F.col("p_retailprice").alias("price")).unionByName(new)


@query("U8_array_union", "SELECT p_partkey AS id, CASE WHEN p_name = lower(p_type) || ' ring' THEN p_name ELSE p_name || '|' || lower(p_type) || ' ring' END AS names FROM part")
def array_union(spark, d):
    return st.figures(spark, d).select("id", F.array_join(tk.union_normalized(F.array("name"), F.array(F.concat(F.lower("kind"), F.lit(" ring")))), "|").alias("names"))


@query("G12_components", """WITH RECURSIVE e AS (SELECT 'p' || p_partkey AS a, 'n' || p_name || p_size AS b FROM part), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a)
    SELECT node, min(reach) AS component FROM r GROUP BY node""")
def components(spark, d):
    e = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat(F.lit("n"), "p_name", "p_size").alias("dst"))
    return graph.components(e)


@query("G13_degree", f"WITH {E} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def degree(spark, d):
    return graph.degree(st.edges(spark, d))


@query("TPCH_pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    line = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n"))
