"""Readers, writers, records, lists, catalogues and stores over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from traitloom.functions import archive, names, recipes, web, wiki
from traitloom.functions import attributes as attributes_of
from traitloom.functions import text as tx
from traitloom.functions import tokens as tk
from traitloom.operators import lattice, ledger, ranking, taxonomy, validation
from traitloom.plans import stand_in as st
from traitloom.plans.registry import query, spread, table
from traitloom.plans.text_queries import ENTITIES
from traitloom.sources import adapters, lists, records, store
from traitloom.sources.scratch import materialise, scratch_folder


def folder(spark, name):
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def docs(spark, d):
    return table(spark, d, "documents")


@query("S5_export", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def export(spark, d):
    path, nodes = folder(spark, "export"), table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    store.export({"nodes": nodes, "edges": st.edges(spark, d)}, path, store.PUBLIC)
    return spark.read.schema("id int, name string").json(f"{path}/nodes")


SUGGESTIONS = "SELECT c_custkey AS id, CAST(c_nationkey + c_custkey % 4 AS BIGINT) AS nodeId, c_custkey % 9 AS edgeId FROM customer"


@query("S6_import", f"""WITH s AS ({SUGGESTIONS}), n AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey % 2 = 0) SELECT s.id, n.id AS "nodeId", CASE WHEN edgeId < 5 THEN edgeId END AS "edgeId" FROM s LEFT JOIN n ON s.nodeId = n.id""")
def product_import(spark, d):
    """A document with repeated nodes replaces nodes and edges; held suggestions lose what they no longer refer to."""
    nodes = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    listed = lambda df: df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("j"))
    document = listed(nodes.union(nodes)).crossJoin(listed(spark.range(5)).withColumnRenamed("j", "e")).select(F.concat(F.lit('{"nodes":'), "j", F.lit(',"edges":'), "e", F.lit("}")).alias("value"))
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + F.col("c_custkey") % 4).cast("long").alias("nodeId"), (F.col("c_custkey") % 9).alias("edgeId"))
    tables = store.prepare_import(store.read_export(document, {"nodes": "struct<id:long,name:string>", "edges": "struct<id:long>"}), {"suggestions": held})
    kept = store.Store(spark, folder(spark, "store"))
    kept.commit(tables)
    return kept.read("suggestions")


@query("S8_write_jsonl", "SELECT doc_id, lang, text FROM documents")
def write_jsonl(spark, d):
    path = folder(spark, "jsonl")
    records.write_jsonl(docs(spark, d).select("doc_id", "lang", "text"), path)
    return records.read_jsonl(spark, path, docs(spark, d).select("doc_id", "lang", "text").schema).drop("corrupt")


@query("S9_merge_jsonl", """WITH a AS (SELECT p_name AS name, p_brand AS brand, NULL AS size, p_partkey AS pos FROM part UNION ALL SELECT p_name, p_brand, CASE WHEN p_size > 25 THEN p_size END, p_partkey + 1000000000 FROM part),
    f AS (SELECT name, brand, size, min(pos) AS pos FROM a GROUP BY ALL) SELECT name, brand, size, 'rec' || lpad(CAST(row_number() OVER (ORDER BY pos) - 1 AS VARCHAR), 6, '0') AS id FROM f""")
def merge_jsonl(spark, d):
    p = table(spark, d, "part")
    one = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("pos"))
    two = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"), (F.col("p_partkey") + 1_000_000_000).alias("pos"))
    merged = records.merge([one, two]).drop("part")
    return records.number(records.dedupe(merged, "pos"), "pos").select("name", "brand", "size", "id")


J1 = r"""t AS (SELECT doc_id AS id, text FROM documents), m AS (SELECT id, 'clown' AS deity FROM t WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])clown($|[^\p{L}\p{N}])') OR regexp_matches(text, '(^|[^\p{L}\p{N}])scum($|[^\p{L}\p{N}])')
    UNION ALL SELECT id, 'moron' FROM t WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])moron($|[^\p{L}\p{N}])') UNION ALL SELECT id, 'MIT' FROM t WHERE regexp_matches(text, '(^|[^\p{L}\p{N}])(MIT|Apache)($|[^\p{L}\p{N}])'))"""


def _payloads(spark, d, payload):
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("source_id"), payload.alias("payload"), F.concat(F.lit("doc "), "doc_id").alias("source_work"))


def _named(family, payloads):
    good, _ = adapters.run(family, payloads, list(ENTITIES))
    return good.select(F.regexp_extract("source_work", "([0-9]+)$", 1).cast("long").alias("id"), "deity").distinct()


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("S10_plain_text", f"WITH {J1} SELECT id, deity FROM m")
def plain_text(spark, d):
    return _named("plain_text", _payloads(spark, d, F.col("text")))


def _read_as(family, payloads, **columns):
    """Id, entity and some fields of a family's records, each once."""
    good, _ = adapters.run(family, payloads, list(ENTITIES))
    return good.select(F.regexp_extract("source_work", "([0-9]+)$", 1).cast("long").alias("id"), "deity", *[F.col(c).alias(n) for n, c in columns.items()]).distinct()


@query("S11_tei", f"WITH {J1} SELECT id, deity, 'doc ' || id AS work, lang || ' of ' || source AS author FROM m JOIN documents ON id = doc_id")
def tei(spark, d):
    """Documents of one paragraph, or of one line of verse, with title and author in their heads."""
    head = F.concat(F.lit("<TEI><teiHeader><fileDesc><titleStmt><title>doc "), "doc_id", F.lit("</title><author>"), "lang", F.lit(" of <i>"), "source", F.lit("</i></author></titleStmt></fileDesc></teiHeader><text><body>"))
    mark = F.when(F.col("doc_id") % 2 == 0, "p").otherwise("l")
    return _read_as("tei", _payloads(spark, d, F.concat(head, F.lit("<"), mark, F.lit(">"), _escaped(F.col("text")), F.lit("</"), mark, F.lit("></body></text></TEI>"))), work="source_work", author="source_author")


@query("S12_oai", f"WITH {J1} SELECT id, deity, lang || '; ' || source AS author, CAST(n_chars AS VARCHAR) AS dated, 'prose; page' AS kind, 'https://h/' || id AS url FROM m JOIN documents ON id = doc_id")
def oai(spark, d):
    """Records with elements that stand twice: creators, types, and identifiers of which one is an address."""
    element = lambda name, value: F.concat(F.lit(f"<dc:{name}>"), value, F.lit(f"</dc:{name}>"))
    fields = [element("title", F.concat(F.lit("doc "), "doc_id")), element("creator", F.col("lang")), element("creator", F.col("source")), element("date", F.col("n_chars").cast("string")), element("type", F.lit("prose")), element("type", F.lit("page")),
              element("identifier", F.lit("no address")), element("identifier", F.concat(F.lit("https://h/"), "doc_id")), element("description", _escaped(F.col("text")))]
    record = F.concat(F.lit('<OAI-PMH><record><metadata><oai_dc:dc xmlns:dc="x">'), *fields, F.lit("</oai_dc:dc></metadata></record></OAI-PMH>"))
    return _read_as("oai_dc", _payloads(spark, d, record), author="source_author", dated="artwork_date", kind="artwork_classification", url="url")


@query("S13_iiif", f"WITH {J1} SELECT id, deity, 'doc ' || id AS title, 'https://i/' || id AS url FROM m")
def iiif(spark, d):
    """Manifests whose label and metadata are maps of languages, not the same for all."""
    named = lambda x: F.create_map(F.coalesce("lang", F.lit("none")), F.array(x, F.lit("second")))
    label = F.create_map(F.coalesce("lang", F.lit("none")), F.array(F.concat(F.lit("doc "), "doc_id")))
    manifest = F.to_json(F.struct(F.concat(F.lit("https://i/"), "doc_id").alias("id"), label.alias("label"), F.array(F.struct(named(F.lit("about")).alias("label"), named(F.col("text")).alias("value"))).alias("metadata")))
    return _read_as("iiif", _payloads(spark, d, manifest), title="artwork_title", url="url")


@query("S14_mediawiki", f"WITH {J1} SELECT id, deity, 'https://w/' || id AS url FROM m")
def mediawiki(spark, d):
    """Query results of two pages, one of which has no extract."""
    entry = lambda title, url, extract: F.struct(title.alias("title"), url.alias("fullurl"), extract.alias("extract"))
    page = F.create_map(F.col("doc_id").cast("string"), entry(F.concat(F.lit("doc "), "doc_id"), F.concat(F.lit("https://w/"), "doc_id"), _escaped(F.col("text"))), F.lit("-1"), entry(F.lit("File:x 0"), F.lit("https://w/file"), F.lit(None).cast("string")))
    return _read_as("mediawiki", _payloads(spark, d, F.to_json(F.struct(F.struct(page.alias("pages")).alias("query")))), url="url")


@query("S15_legacy_jsonl", f"WITH {J1} SELECT id, deity FROM m")
def legacy_jsonl(spark, d):
    good, _ = adapters.run("plain_text", _payloads(spark, d, F.col("text")), list(ENTITIES))
    lines = good.groupBy("source_work").agg(F.array_join(F.collect_list(F.to_json(F.struct(*good.columns))), "\n").alias("payload")).select(F.col("source_work").alias("source_id"), "payload")
    return _named("legacy_jsonl", lines)


@query("S16_adapter_dispatch", f"""WITH {J1}, k AS (SELECT id, CASE id % 5 WHEN 0 THEN 'plain_text' WHEN 1 THEN 'tei' WHEN 2 THEN 'oai_dc' WHEN 3 THEN 'mediawiki' ELSE 'gopher' END AS family FROM t)
    SELECT id, family, deity FROM k JOIN m USING (id) WHERE family <> 'gopher' UNION ALL SELECT id, family, NULL FROM k WHERE family = 'gopher'""")
def adapter_dispatch(spark, d):
    """Documents as payloads of four families and of one that has no adapter: the entities that each family's adapter names, and what is refused."""
    k, text = F.col("doc_id") % 5, _escaped(F.col("text"))
    page = F.to_json(F.struct(F.struct(F.create_map(F.col("doc_id").cast("string"), F.struct(F.concat(F.lit("doc "), "doc_id").alias("title"), text.alias("extract"))).alias("pages")).alias("query")))
    payload = (F.when(k == 1, F.concat(F.lit("<TEI><text><body><p>"), text, F.lit("</p></body></text></TEI>")))
               .when(k == 2, F.concat(F.lit('<OAI-PMH><record><metadata><oai_dc:dc xmlns:dc="x"><dc:title>doc '), "doc_id", F.lit("</dc:title><dc:description>"), text, F.lit("</dc:description></oai_dc:dc></metadata></record></OAI-PMH>")))
               .when(k == 3, page).otherwise(F.col("text")))
    family = F.element_at(F.array(*map(F.lit, ("plain_text", "tei", "oai_dc", "mediawiki", "gopher"))), (k + 1).cast("int"))
    payloads = docs(spark, d).select(F.col("doc_id").cast("string").alias("source_id"), payload.alias("payload"), F.concat(F.lit("doc "), "doc_id").alias("source_work"), family.alias("family"))
    good, _, refused = adapters.run_each(payloads, list(ENTITIES))
    named = good.select(F.regexp_extract("source_work", "([0-9]+)$", 1).cast("long").alias("id"), "family", "deity").distinct()
    return named.union(refused.select(F.col("source_id").cast("long"), "family", F.lit(None).cast("string")))


@query("F42_make_record", r"SELECT p_partkey AS id, p_name AS deity, p_brand || ' says' AS excerpt, CAST(len(list_filter(string_split_regex(p_brand || ' says', '\s+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM part")
def make_record(spark, d):
    f = st.figures(spark, d)
    fields = {c: F.lit(c) for c in ("source_work", "source_author", "corpus", "origin", "record_type", "translator")} | {"locator": F.col("part").cast("string"), "excerpt": F.concat(F.lit("  "), "tradition", F.lit(" \n says "))}
    made = adapters.make_records(f.withColumnRenamed("id", "part"), {"name": F.col("name"), "tradition": F.col("tradition"), "gender": F.lit("unknown")}, F.lit("x"), fields, keep=("part",))
    return made.select(F.col("part").alias("id"), "deity", "excerpt", "n_words")


@query("S17_catalog_csv", "SELECT p_partkey AS id, p_name || chr(10) || '\"x\", ' || p_brand AS title FROM part WHERE p_size % 3 = 0")
def catalog_csv(spark, d):
    path = folder(spark, "catalog")
    rows = st.figures(spark, d).select(F.col("id").alias("Text#"), F.when(F.col("n") % 3 == 0, "Text").otherwise("Sound").alias("Type"), F.concat("name", F.lit('\n"x", '), "tradition").alias("Title"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return records.read_catalog_csv(spark, path).select(F.col("Text#").cast("long").alias("id"), F.col("Title").alias("title"))


LISTED = "SELECT p_brand || ' shelf ' || (p_partkey // 100) AS name, p_name AS title, p_type AS author, min(p_partkey) AS first FROM part GROUP BY ALL"


def _lists(spark, d, head, line, foot, suffix, whole=False):
    """A list of works for each shelf of a brand, as one file; a shelf has a hundred works at most. Or one for each whole brand."""
    shelf = (F.col("tradition") if whole else F.concat("tradition", F.lit(" shelf "), F.floor(F.col("id") / 100).cast("string"))).alias("shelf")
    own = st.figures(spark, d).groupBy(shelf).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    files = own.select(F.concat(F.lit("/lists/"), "shelf", F.lit(suffix)).alias("path"), F.concat(F.lit(head), F.array_join("lines", "," if foot else "\n"), F.lit(foot)).alias("content"))
    return lists.parse_lists(files, most=10**9).select("name", F.explode("items").alias("i")).select("name", "i.title", "i.author")


@query("S18_csv_lists", f"SELECT name, title || ', \"x\"' AS title, author FROM ({LISTED})")
def csv_lists(spark, d):
    return _lists(spark, d, "Language,Author, NAME \n", F.concat(F.lit("en,"), "kind", F.lit(',"'), "name", F.lit(', ""x"""')), "", ".csv")


@query("S19_txt_lists", "SELECT p_brand AS name, p_name AS title, p_type AS author FROM part GROUP BY ALL")
def txt_lists(spark, d):
    return _lists(spark, d, "# works\n\n", F.concat("name", F.when(F.col("n") % 2 == 0, " — ").otherwise(" - "), "kind"), "", ".txt", whole=True)


@query("S20_json_lists", f"SELECT name, title, author FROM ({LISTED})")
def json_lists(spark, d):
    return _lists(spark, d, '{"sources":[', F.to_json(F.struct(F.col("name").alias("work"), F.col("kind").alias("author"))), "]}", ".json")


@query("S21_refused_lists", """
    WITH l AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT p_name || '|' || p_type) AS n, max(p_size) AS largest FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT 'order ' || l_orderkey || CASE WHEN l_orderkey % 5 = 3 THEN '.pdf' ELSE '' END AS name,
           CASE WHEN l_orderkey % 5 = 3 THEN 'unsupported file type .pdf' WHEN l_orderkey % 5 = 4 THEN 'broken JSON' WHEN l_orderkey % 5 = 0 AND largest > 48 THEN 'an address that is not https'
                WHEN n > 4 THEN n || ' items, at most 4' END AS error,
           CAST(CASE WHEN l_orderkey % 5 > 2 OR n > 4 OR (l_orderkey % 5 = 0 AND largest > 48) THEN 0 ELSE n END AS INTEGER) AS n_items FROM l""")
def refused_lists(spark, d):
    """Each order's parts as a list of works, in files of four kinds: CSV with addresses, text, JSON, one that is not read, and JSON that is cut off."""
    p = table(spark, d, "part")
    lines = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("k", F.col("l_orderkey") % 5)
    url = F.concat(F.when(F.col("p_size") > 48, "http").otherwise("https"), F.lit("://h/"), "p_partkey")
    line = F.when(F.col("k") == 0, F.concat_ws(",", "p_name", "p_type", url)).when(F.col("k") == 1, F.concat_ws(" - ", "p_name", "p_type")).otherwise(F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("author"))))
    files = lines.groupBy("l_orderkey", "k").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    content = F.when(F.col("k") == 0, F.concat(F.lit("title,author,url\n"), F.array_join("lines", "\n"))).when(F.col("k") < 2, F.array_join("lines", "\n")).otherwise(
        F.concat(F.lit("["), F.array_join("lines", ","), F.when(F.col("k") == 4, "").otherwise("]")))
    ending = F.element_at(F.array(*map(F.lit, (".csv", ".txt", ".json", ".pdf", ".json"))), (F.col("k") + 1).cast("int"))
    read = lists.parse_lists(files.select(F.concat(F.lit("x/order "), "l_orderkey", ending).alias("path"), content.alias("content")), most=4)
    return read.select("name", "error", F.size("items").alias("n_items"))


@query("S22_read_catalog", "SELECT p_name AS name, p_brand AS tradition, CAST(1 AS BIGINT) AS n_aliases, count(*) AS n FROM part GROUP BY ALL")
def read_catalog(spark, d):
    shelf = F.floor(F.col("id") / 100).alias("shelf")
    rows = st.figures(spark, d).groupBy("kind", shelf).agg(F.to_json(F.collect_list(F.struct(F.col("name").alias("deity"), "tradition", F.array("kind").alias("aliases")))).alias("j"))
    documents = rows.select(F.concat(F.lit('{"entities":'), "j", F.lit("}")).alias("document"))
    read = documents.select(F.explode(store.read_catalog(F.col("document"))).alias("e")).select("e.*")
    return read.groupBy("name", "tradition", F.size("aliases").cast("long").alias("n_aliases")).agg(F.count("*").alias("n"))


@query("S23_write_catalog", "SELECT lower(p_name) AS name, count(DISTINCT p_type) AS n_aliases FROM part GROUP BY lower(p_name), p_brand")
def write_catalog(spark, d):
    path = folder(spark, "catalogue")
    e = st.figures(spark, d).select("name", "tradition", F.lit(None).cast("string").alias("gender"), F.array("kind").alias("aliases"), F.col("id").alias("pos"))
    store.write_catalog(records.merge_catalogs(e), path)
    return spark.read.schema("name string, tradition string, gender string, aliases array<string>").json(path).select(F.lower("name").alias("name"), F.size("aliases").cast("long").alias("n_aliases"))


@query("A27_catalog_of_records", "SELECT lower(p_name) AS name, count(DISTINCT p_type) FILTER (p_type <> 'ECONOMY') AS n_aliases FROM part GROUP BY lower(p_name), p_brand")
def catalog_of_records(spark, d):
    rows = st.figures(spark, d).select(F.col("name").alias("deity"), "tradition", F.lit("unknown").alias("gender"), F.col("kind").alias("matched_alias"), F.col("id").alias("pos"))
    rejected = st.figures(spark, d).select("name", F.lit("economy").alias("alias")).distinct()
    return store.catalog_of_records(rows, rejected).select(F.lower("name").alias("name"), F.size("aliases").cast("long").alias("n_aliases"))


@query("S24_write_corpus", "SELECT source AS partition, count(DISTINCT text) AS n, count(DISTINCT text) AS n_sidecars, CAST(0 AS BIGINT) AS twice FROM documents GROUP BY 1")
def write_corpus(spark, d):
    """Texts once within a partition, each with its sidecar, whatever is written again; how many a second writing added."""
    kept = store.Store(spark, folder(spark, "corpus"))
    files = docs(spark, d).select(F.col("source").alias("partition"), F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("text").alias("content"))
    for part in (files.where("content < 'M'"), files):
        store.write_corpus(kept, part, F.lit("2024-01-01").cast("timestamp"))
    twice = store.write_corpus(kept, files, F.lit("2024-01-02").cast("timestamp"))
    count = lambda name, n: kept.read(name).groupBy("partition").agg(F.count("*").alias(n))
    return count("corpus", "n").join(count("sidecars", "n_sidecars"), "partition").withColumn("twice", F.lit(twice).cast("long"))


@query("S25_manifest", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256 FROM documents")
def manifest(spark, d):
    path = folder(spark, "manifest")
    store.write_manifest(docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256")), path)
    return store.read_manifest(spark, path, "path string, sha256 string")


@query("S26_provenance", "SELECT CAST(doc_id AS VARCHAR) AS source_id, 'sha256:' || sha256(text) AS payload_checksum, CAST(octet_length(encode(text)) AS INTEGER) AS payload_bytes, count(l.doc_id) AS record_count FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id, text")
def provenance(spark, d):
    payloads = docs(spark, d).select(F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("reference"), F.col("text").alias("payload"))
    sources = payloads.select("source_id", F.col("reference").alias("name"), F.lit("plain_text").alias("source_family"), *[F.lit("x").alias(c) for c in ("license", "terms_url", "reuse_notes")])
    made = store.provenance(payloads, table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("source_id")), sources, F.lit("2024-01-01").cast("timestamp"))
    return made.select("source_id", "payload_checksum", "payload_bytes", "record_count")


@query("S27_tsv_report", "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1")
def tsv_report(spark, d):
    path = folder(spark, "report")
    store.write_report(st.figures(spark, d).groupBy(F.col("tradition").alias("brand")).agg(F.count("*").alias("n")), path)
    return spark.read.option("sep", "\t").option("header", True).schema("brand string, n long").csv(path)


@query("S33_reader_text", "SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN 'ready' WHEN starts_with(lower(trim(html)), '<!doctype') OR len(regexp_extract_all(trim(substr(html, 1, 2000)), '</?[a-zA-Z][^>]*>')) >= 10 OR regexp_matches(trim(html), '(?i)^<(\\?xml|html)') OR (regexp_matches(trim(html), '^[\\[{]') AND json_valid(html)) THEN 'queued' ELSE 'plain' END AS readable_status FROM pages WHERE page_id % 3 <> 0")
def reader_text(spark, d):
    files = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 == 0, "locked").otherwise("public").alias("partition"), F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    ready = files.where("id % 5 = 0").select("path", F.lit("# x").alias("markdown"))
    return store.reader_text(files, ready, web.looks_like_markup(F.col("content"))).select("id", "readable_status")


@query("S34_seed_nodes", "WITH n AS (SELECT n_nationkey AS old, row_number() OVER (ORDER BY n_nationkey) AS id FROM nation WHERE n_nationkey % 3 <> 1), e AS (SELECT n_nationkey AS s, n_regionkey AS t FROM nation) SELECT a.id AS source, b.id AS target FROM e JOIN n a ON e.s = a.old JOIN n b ON e.t = b.old")
def seed_nodes(spark, d):
    n = table(spark, d, "nation")
    _, edges = store.seed_nodes(n.where("n_nationkey % 3 <> 1").select(F.col("n_nationkey").alias("id"), "n_name"), n.select(F.col("n_nationkey").alias("sourceId"), F.col("n_regionkey").alias("targetId")))
    return edges.select(F.col("sourceId").alias("source"), F.col("targetId").alias("target"))


@query("M1_insert", "SELECT 25 + row_number() OVER (ORDER BY r_name) - 1 AS id, r_name AS name FROM region")
def insert(spark, d):
    kept = store.Store(spark, folder(spark, "store"))
    kept.commit({"nodes": table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))})
    return kept.insert("nodes", table(spark, d, "region").select(F.lit(None).cast("long").alias("id"), F.col("r_name").alias("name")))


@query("M2_update", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS name, n_regionkey AS region FROM nation")
def update(spark, d):
    kept, n = store.Store(spark, folder(spark, "store")), table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    kept.commit({"nodes": n})
    kept.update("nodes", n.where("id % 4 = 0").select("id", F.lower("name").alias("name")), ("name",))
    return kept.read("nodes")


@query("M5_transaction", "SELECT 'nodes' AS name, count(*) AS n FROM nation UNION ALL SELECT 'edges', count(*) FROM region")
def transaction(spark, d):
    """Two tables change together; readers see both versions or neither."""
    kept = store.Store(spark, folder(spark, "store"))
    kept.commit({"nodes": table(spark, d, "region"), "edges": table(spark, d, "nation")})
    kept.commit({"nodes": table(spark, d, "nation"), "edges": table(spark, d, "region")})
    return kept.read("nodes").agg(F.lit("nodes").alias("name"), F.count("*").alias("n")).union(kept.read("edges").agg(F.lit("edges").alias("name"), F.count("*").alias("n")))


@query("M9_reparent", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey <> 5 THEN 5 ELSE n_regionkey END AS parent_id FROM nation")
def reparent(spark, d):
    tree = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_id"))
    return store.reparent(tree, tree.where("id % 2 = 0").select("name", F.lit("NATION_5").alias("parent_name"))).select("id", "parent_id")


REVIEWS = """f AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'public' ELSE 'locked' END AS part FROM documents),
    d AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'approve_public' ELSE 'keep_locked' END AS decision, CASE WHEN toxic = 1 THEN 'copyrighted' ELSE 'open_license' END AS status FROM labels)"""


def _reviewed(spark, d):
    files = docs(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "public").otherwise("locked").alias("partition"), F.lit("unknown").alias("status"))
    files = files.withColumn("path", F.concat_ws("/", "partition", "id"))
    decisions = table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), F.lit(1).alias("seq"), F.when(F.col("quality") == 1, "approve_public").otherwise("keep_locked").alias("decision"),
                                                 F.when(F.col("toxic") == 1, "copyrighted").otherwise("open_license").alias("status"), F.lit("checked").alias("basis"))
    return store.review(files, decisions)


@query("M10_review", f"WITH {REVIEWS} SELECT id, CASE WHEN part = 'locked' AND decision = 'approve_public' AND d.status = 'open_license' THEN 'public/' || id ELSE part || '/' || id END AS path FROM f LEFT JOIN d ON id = doc_id")
def review(spark, d):
    return _reviewed(spark, d)[0].select("id", "path")


@query("D10_promote", f"WITH {REVIEWS} SELECT id AS file_id, decision, CASE WHEN decision = 'approve_public' THEN d.status END AS determined_status FROM f JOIN d ON id = doc_id WHERE part = 'locked' AND NOT (decision = 'approve_public' AND d.status = 'copyrighted')")
def promote(spark, d):
    return _reviewed(spark, d)[1].select("file_id", "decision", "determined_status")


@query("M11_resolve_blockers", """WITH b AS (SELECT event_id AS id, user_id AS work_id FROM events WHERE event_type = 'error'), n AS (SELECT id, work_id, row_number() OVER (ORDER BY work_id, 'again', NULL, 'open') AS rn FROM b WHERE id % 5 = 2)
    SELECT id, work_id, CASE WHEN id % 5 < 2 THEN 'resolved' ELSE 'open' END AS status FROM b UNION ALL SELECT (SELECT max(id) FROM b) + row_number() OVER (ORDER BY work_id), work_id, 'open' FROM n""")
def resolve_blockers(spark, d):
    b = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("work_id"), F.lit("x").alias("reason"), F.lit(None).cast("string").alias("url"), F.lit("open").alias("status"))
    retries = b.where("id % 5 IN (1, 2)").select(F.col("id").alias("blocker_id"), (F.col("id") % 5 == 1).alias("ok"), F.lit("again").alias("reason"))
    return store.resolve_blockers(b, b.where("id % 5 = 0").select(F.col("id").alias("blocker_id")), retries).select("id", "work_id", "status")


@query("T14_provenance_rule", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN quality IS NULL THEN 1 WHEN doc_id % 2 = 0 OR doc_id % 4 = 1 THEN 2 ELSE 1 END AS run_id FROM documents LEFT JOIN labels USING (doc_id)")
def provenance_rule(spark, d):
    held = docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").where("doc_id % 4 <> 1 OR quality IS NULL")
    held = held.select(F.col("doc_id").cast("string").alias("path"), F.lit("a").alias("sha256"), F.lit(1).cast("long").alias("run_id"))
    found = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("relative_path"), F.lit("b").alias("sha256"), F.when(F.col("doc_id") % 2 == 0, "downloaded").otherwise("already_present").alias("download_status"))
    return store.merge_downloads(held, found, 2).select("path", F.col("run_id").cast("int").alias("run_id"))


CANDIDATE = """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Work 1' ELSE 'work:' || doc_id END AS work_id, CASE WHEN doc_id % 7 = 0 THEN 'tablet' ELSE 'txt' END AS fmt, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1900 END AS y FROM documents)
    SELECT doc_id, CAST(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_broken FROM c"""


@query("P21_candidate_validation", CANDIDATE)
def candidate_validation(spark, d):
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    c = docs(spark, d).select("doc_id", F.when(i % 10 == 0, "Work 1").otherwise(F.concat(F.lit("work:"), "doc_id")).alias("work_id"), F.concat(F.lit("edition:"), "doc_id").alias("edition_id"), F.lit("source:x").alias("source_id"), F.lit("t").alias("title"),
                             none.alias("author"), F.col("lang").alias("language"), F.lit("original").alias("language_role"), F.when(i % 7 == 0, "tablet").otherwise("txt").alias("format"), F.lit("https://h/x").alias("text_url"), none.alias("local_path"),
                             none.alias("metadata_url"), F.when(i % 6 == 0, 0).otherwise(1900).alias("publication_year"), F.lit(None).cast("int").alias("death_year"), none.alias("status_claim"), F.lit(None).cast("array<string>").alias("territories"),
                             none.alias("license_url"), F.lit(True).alias("download_allowed"))
    return c.select("doc_id", F.size(validation.candidate_violations()).alias("n_broken"))


@query("P22_registry_validation", "SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_broken FROM supplier")
def registry_validation(spark, d):
    k, url = F.col("s_suppkey"), F.lit("https://h/")
    r = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("source:"), F.when(k % 4 == 0, "X").otherwise("x"), k).alias("source_id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "gopher").otherwise("tei").alias("source_family"), url.alias("endpoint_url"),
                                           F.array(F.lit("text_excerpt")).alias("resource_types"), F.lit(None).cast("array<string>").alias("allowed_hosts"), F.lit("reviewed").alias("review_status"), url.alias("terms_url"), url.alias("robots_url"), F.lit("l").alias("license"),
                                           F.lit("n").alias("reuse_notes"), F.when(k % 5 == 0, 0.0).otherwise(1.0).alias("requests_per_second"))
    return validation.registry_violations(r).select("s_suppkey", F.size("broken").alias("n_broken"))


IPV4 = "CAST(event_id % 256 AS INTEGER) AS a, CAST(user_id % 256 AS INTEGER) AS b, CAST(event_id // 7 % 256 AS INTEGER) AS c"


@query("P24_private_address", f"""WITH o AS (SELECT event_id, {IPV4} FROM events) SELECT event_id, a IN (0, 10, 127) OR a >= 240 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
    OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)))) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113) AS private FROM o""")
def private_address(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws(".", F.col("event_id") % 256, F.col("user_id") % 256, F.floor(F.col("event_id") / 7) % 256, F.lit("9")).alias("ip"))
    return e.select("event_id", archive.private_address(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[::ffff:"), "ip", F.lit("]"))).otherwise(F.col("ip"))).alias("private"))


@query("P30_repairable", "SELECT event_id, event_type = 'error' AND user_id % 2 = 0 AND event_id % 3 <> 2 AS repairable FROM events")
def repairable(spark, d):
    i = F.col("event_id") % 3
    error = F.when(i == 0, "Download failed (404) for x").when(i == 1, "the target path is not allowed").otherwise("timeout")
    return table(spark, d, "events").select("event_id", archive.repairable(F.when(F.col("event_type") == "error", "failed").otherwise("downloaded"), F.col("user_id") % 2 == 0, error).alias("repairable"))


@query("J19_cross_cut", """WITH g AS (SELECT DISTINCT p_size % 5 AS grp, p_type AS t FROM part), h AS (SELECT p_partkey AS f, lower(p_type) AS token FROM part UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')) FROM part)
    SELECT grp AS "group", count(DISTINCT f) AS n_figures, count(DISTINCT token) AS n_traits FROM g JOIN h ON lower(t) = token GROUP BY 1""")
def cross_cut(spark, d):
    f = st.figures(spark, d)
    tree = f.select(F.col("kind").alias("name")).distinct().withColumn("id", F.xxhash64("name"))
    groups = f.select((F.col("n") % 5).alias("group"), "kind").distinct().select("group", F.when(F.col("group") > 2, F.xxhash64("kind")).alias("trait_id"), F.when(F.col("group") <= 2, F.col("kind")).alias("standalone"))
    holders = f.select(F.col("id").alias("figure_id"), F.explode(F.concat(F.array(F.lower("kind")), F.split("name", " "))).alias("token"))
    return taxonomy.cross_cut(groups, tree, holders)


@query("J22_fallback_editions", """WITH r AS (SELECT doc_id, doc_id // 4 AS work_id, CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'downloaded' ELSE 'not_selected' END ELSE 'not_selected' END AS s FROM documents WHERE doc_id % 4 < 3),
    f AS (SELECT work_id FROM r WHERE s = 'downloaded'), a AS (SELECT * FROM r WHERE s <> 'not_selected')
    SELECT doc_id AS edition_id, doc_id // 4 AS work_id FROM documents WHERE doc_id // 4 IN (SELECT work_id FROM a) AND doc_id // 4 NOT IN (SELECT work_id FROM f) AND doc_id NOT IN (SELECT doc_id FROM a)""")
def fallback_editions(spark, d):
    e = docs(spark, d).select(F.col("doc_id").alias("edition_id"), F.floor(F.col("doc_id") / 4).alias("work_id"))
    k = F.col("edition_id")
    status = F.when(k % 4 == 0, "failed").when((k % 4 == 1) & (k % 3 == 0), "downloaded").otherwise("not_selected")
    tried = e.where("edition_id % 4 < 3").select("work_id", "edition_id", status.alias("download_status"), F.lit("f").alias("file"))
    return ranking.fallback_editions(tried, e)


@query("O3_sorted_by", "SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_name DESC, id")
def sorted_by(spark, d):
    return ranking.sorted_by(st.figures(spark, d), "name", True, ("name", "kind")).select("id", "name")


@query("O4_multi_key", "SELECT p_brand AS tradition, p_type AS kind, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, tradition, kind")
def multi_key(spark, d):
    return st.figures(spark, d).groupBy("tradition", "kind").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tradition", "kind")


@query("O5_clamped_limit", "SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, id LIMIT 50")
def clamped_limit(spark, d):
    return st.figures(spark, d).orderBy(F.col("price").desc(), "id").limit(ranking.clamped(500, 1, 50, 5)).select("id")


@query("O7_top_k", "SELECT p_partkey AS id, p_size AS n FROM part ORDER BY n DESC, id LIMIT 10")
def top_k(spark, d):
    return ranking.top_k(st.figures(spark, d).select("id", "n"), 10, [F.col("n").desc(), F.col("id")])


@query("O10_suggested_recipe")
def suggested_recipe(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", recipes.suggested(F.col("url"), F.when(F.col("page_id") % 2 == 0, "text/html"), F.col("html")).alias("recipe"))


@query("D2_extract")
def extract(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.lit("text/html").alias("content_type"), F.col("html").alias("payload"))
    return recipes.extract(p).select("page_id", "recipe", "markdown", "error")


@query("D1_adapter_records", f"WITH {J1} SELECT deity, count(*) AS n FROM m GROUP BY 1")
def adapter_records(spark, d):
    return _named("tei", _payloads(spark, d, F.concat(F.lit("<TEI><text><body><ab>"), _escaped(F.col("text")), F.lit("</ab></body></text></TEI>")))).groupBy("deity").agg(F.count("*").alias("n"))


@query("D4_store", "SELECT count(*) AS n, sum(p_size) AS size FROM part")
def stored(spark, d):
    kept = store.Store(spark, folder(spark, "store"))
    kept.commit({"parts": table(spark, d, "part")})
    return kept.read("parts").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("U9_url_dedupe", "WITH r AS (SELECT url, page_id % 3 AS q, page_id FROM pages UNION ALL SELECT url, 5, page_id FROM pages) SELECT url, q AS query, page_id AS place FROM r WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY q, page_id) = 1")
def url_dedupe(spark, d):
    p = table(spark, d, "pages").select("url", (F.col("page_id") % 3).cast("long").alias("query"), F.col("page_id").alias("place"))
    return ranking.first_seen(p.union(p.withColumn("query", F.lit(5).cast("long"))), "url", "query", "place")


@query("G7_split_leaves")
def split_leaves(spark, d):
    return lattice.leaves(st.traits(spark, d), depth=2)


EXECUTIONS = "SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CASE WHEN event_id % 3 = 0 THEN 'sent' WHEN event_id % 3 = 1 THEN 'sending' ELSE 'pending' END AS mail FROM events"


def _executions(spark, d):
    k = F.col("event_id") % 3
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"), F.col("user_id").alias("run_id"),
                                            F.lit(None).cast("string").alias("error"), F.when(F.col("event_id") % 2 == 0, "report").alias("report"), F.when(k == 0, "sent").when(k == 1, "sending").otherwise("pending").alias("email_status"))


@query("T15_finish", f"SELECT id, CASE WHEN status = 'running' AND id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'completed' ELSE 'failed' END ELSE status END AS status, CASE WHEN id % 4 = 0 AND id % 5 <> 0 THEN NULL ELSE id END AS active_execution_id FROM ({EXECUTIONS})")
def finish(spark, d):
    e = _executions(spark, d)
    ended = e.where("id % 4 = 0").select("id", "run_id", F.when(F.col("id") % 8 == 0, "ok").alias("summary"), F.lit(None).cast("string").alias("error"))
    routines = e.select("id", F.col("id").alias("active_execution_id"))
    done = ledger.finished(e, ended).select("id", "status")
    return done.join(ledger.released(routines, ended.where("id % 5 <> 0")), "id")


@query("T16_recover", f"""WITH e AS ({EXECUTIONS}), r AS (SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'pending' WHEN mail = 'sending' THEN 'unknown' ELSE mail END AS mail FROM e)
    SELECT id, CASE WHEN status = 'failed' THEN 'send_failure' WHEN id % 2 = 0 THEN 'send_report' ELSE 'mark_unknown' END AS action FROM r WHERE mail = 'pending'""")
def recover(spark, d):
    return ledger.unsent(ledger.recovered(_executions(spark, d)))


@query("T8_salvage", "SELECT user_id, CAST(count(*) AS INTEGER) AS n, count(*) FILTER (rn > 3) AS n_skipped FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY 1")
def salvage(spark, d):
    runs = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("all"))
    done = F.transform(F.slice("all", 1, 3), lambda x: F.struct(x["event_id"].cast("string").alias("title"), x["event_type"].alias("status")))
    out = ledger.salvage(done, F.transform("all", lambda x: x["event_id"].cast("string")))
    return runs.select("user_id", F.size(out).alias("n"), F.size(F.filter(out, lambda x: x["status"] == "skipped")).cast("long").alias("n_skipped"))


def _parts(spark, d):
    return spread(st.figures(spark, d))


@query("F4_unescape", "SELECT p_partkey AS id, p_name || ' & é < ' || chr(160) || '☃ &bogus;' AS text FROM part")
def unescape(spark, d):
    return _parts(spark, d).select("id", web.unescape_html(F.concat("name", F.lit(" &amp; &#233; &LT; &nbsp;&#x2603; &bogus;"))).alias("text"))


@query("F5_strip_html", "SELECT p_partkey AS id, p_name || ' & ' || p_brand AS text FROM part")
def strip_html(spark, d):
    return _parts(spark, d).select("id", web.strip_html(F.concat(F.lit("<p> &lt;b&gt;"), "name", F.lit("</b>\n&amp; <i>"), "tradition", F.lit("</i></p>"))).alias("text"))


@query("F7_normalized_lookup")
def normalized_lookup(spark, d):
    return docs(spark, d).select("doc_id", tx.normalized_lookup(F.col("text")).alias("key"))


@query("F10_name_variants")
def name_variants(spark, d):
    return docs(spark, d).select("doc_id", names.name_variants(F.col("text")).alias("variants"))


@query("F11_norm_name", r"SELECT p_partkey AS id, trim(lower(regexp_replace(p_name, '[^a-zA-Z0-9 ]', '', 'g'))) AS plain, regexp_replace(lower('The ' || p_name), '[^\p{L}\p{N}]+', '', 'g') AS bare FROM part")
def norm_name(spark, d):
    named = F.concat(F.lit("The "), "name")
    return _parts(spark, d).select("id", names.plain_name(named).alias("plain"), names.letters_and_digits(named).alias("bare"))


@query("F13_strip_the", "SELECT p_partkey AS id, p_name || ', The Brand, nile, ' || p_type AS text FROM part")
def strip_the(spark, d):
    return _parts(spark, d).select("id", tk.strip_the(F.concat(F.lit("the "), "name", F.lit(", The Brand, THE nile, "), "kind")).alias("text"))


@query("F24_html_to_markdown")
def html_to_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", wiki.html_to_markdown(F.col("html")).alias("markdown"))


ARTICLE = ("{{Infobox deity\n| Name = '''", "'''\n| father = [[Zeus|", "]], A\n| gender = {{x}}\n}}\nThis is a long line of prose about ", " in Norse mythology, as it is told.\n== Family ==\nAnother long line about ", " and its parents.\n== See also ==\n* nothing at all to be seen here")


def _articles(spark, d):
    a, b, c, e, f = ARTICLE
    return _parts(spark, d).select("id", "name", "tradition", F.concat(F.lit(a), "name", F.lit(b), "tradition", F.lit(c), "name", F.lit(e), "tradition", F.lit(f)).alias("text"))


@query("F25_wikitext_markdown", "SELECT p_partkey AS id, 'This is a long line of prose about ' || p_name || ' in Norse mythology, as it is told.' || chr(10) || '## Family' || chr(10) || 'Another long line about ' || p_brand || ' and its parents.' || chr(10) || '## See also' || chr(10) || '* nothing at all to be seen here' AS markdown FROM part")
def wikitext_markdown(spark, d):
    return _articles(spark, d).select("id", wiki.wikitext_to_markdown(F.col("text")).alias("markdown"))


@query("F26_article", "SELECT p_partkey AS id, p_name AS name, p_brand || ', A' AS father, 'This is a long line of prose about ' || p_name || ' in Norse mythology, as it is told. Another long line about ' || p_brand || ' and its parents.' AS body, CAST(3 AS INTEGER) AS n_sections FROM part")
def article(spark, d):
    fields = tx.let(wiki.infobox(F.col("text")), lambda box: F.struct(*[F.try_element_at(box, F.lit(c)).alias(c) for c in ("name", "father")])).alias("b")
    return _articles(spark, d).select("id", "text", fields).select("id", "b.name", "b.father", wiki.body_text(F.col("text")).alias("body"), F.size(wiki.sections(F.col("text"))).alias("n_sections"))


@query("F28_relations", "SELECT p_partkey AS id, unnest([p_brand, 'none']) AS target, 'Norse' AS tradition FROM part ORDER BY ALL")
def relations(spark, d):
    a = _articles(spark, d).withColumn("text", F.replace("text", F.lit("]], A\n"), F.lit("]], none\n")))
    return a.select("id", F.explode(wiki.relations(wiki.infobox(F.col("text")))).alias("r"), wiki.tradition(F.col("text"), "Greek").alias("tradition")).select("id", "r.target", "tradition")


@query("F27_gender", "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' END AS gender FROM part")
def gender(spark, d):
    k = F.col("n") % 3
    text = F.concat("name", F.when(k == 0, " was a goddess").when(k == 1, " was a god").otherwise(" was loved by gods"))
    return _parts(spark, d).select("id", wiki.gender(F.create_map().cast("map<string,string>"), text).alias("gender"))


@query("F27_attributes", """SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN 'rain' END AS domain, CASE WHEN p_size % 2 = 0 THEN 'She was the daughter of ' || p_name || '.' ELSE 'father: ' || p_brand END AS birth,
    CASE WHEN p_size % 2 = 1 THEN 'Then ' || p_name || ' was slain by ' || p_brand || '.' END AS death, CASE WHEN p_size % 2 = 0 THEN 'taming the ' || p_name || ' of old' ELSE 'Then ' || p_name || ' stole fire from all the gods.' END AS deed FROM part""")
def attributes(spark, d):
    even, k = F.col("n") % 2 == 0, F.col("n") % 3
    text = F.concat(F.when(k == 0, F.concat(F.lit("A god of "), "name", F.lit("."))).otherwise("A figure of note."), F.when(even, F.concat(F.lit(" She was the daughter of "), "name", F.lit("."))).otherwise(F.concat(F.lit(" Then "), "name", F.lit(" was slain by "), "tradition", F.lit("."))))
    myth = F.concat(F.when(even, F.concat(F.lit("He was best known for taming the "), "name", F.lit(" of old."))).otherwise(F.concat(F.lit("Then "), "name", F.lit(" stole fire from all the gods."))))
    box = F.map_from_entries(F.filter(F.array(F.struct(F.lit("father").alias("key"), F.col("tradition").alias("value")), F.struct(F.lit("sphere").alias("key"), F.when(k == 1, "rain").alias("value"))), lambda e: e["value"].isNotNull()))
    parts = F.array(F.struct(F.lit("story").alias("title"), myth.alias("text")))
    return _parts(spark, d).select("id", wiki.domain(box, text).alias("domain"), wiki.birth(box, text).alias("birth"), wiki.death(text).alias("death"), wiki.deed(text, parts).alias("deed"))


@query("F27_objects_and_looks", """SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'silver ' || p_name || ', trident' WHEN 1 THEN 'the ' || p_brand || ', crown' END AS objects, CASE p_size % 3 WHEN 0 THEN 'owl' WHEN 1 THEN 'wolf' END AS animals,
    CASE p_size % 2 WHEN 0 THEN 'friend of ' || p_name ELSE 'cunning' END AS character, CASE p_size % 2 WHEN 0 THEN 'a maker of ' || p_brand || ', bearded' END AS looks FROM part""")
def objects_and_looks(spark, d):
    k, even = F.col("n") % 3, F.col("n") % 2 == 0
    owned = F.when(k == 0, F.concat(F.lit("She bore a silver "), "name", F.lit(". A trident. The owl was sacred."))).when(k == 1, F.concat(F.lit("Wolves come. The wolf form."), F.lit(" A crown."))).otherwise(F.lit("No more."))
    text = F.concat(owned, F.when(even, F.concat(F.lit(" Renowned as the friend of "), "name", F.lit(". A bearded one, portrayed as a maker of "), "tradition", F.lit("."))).otherwise(F.lit(" He was cunning.")))
    box = F.when(k == 1, F.create_map(F.lit("weapon"), F.concat(F.lit("the "), "tradition"))).otherwise(F.create_map().cast("map<string,string>"))
    return _parts(spark, d).select("id", attributes_of.objects(box, text).alias("objects"), attributes_of.animals(box, text).alias("animals"), attributes_of.character(text).alias("character"), attributes_of.looks(text).alias("looks"))


@query("F31_candidate_score")
def candidate_score(spark, d):
    """Scores between kinds of parts, which are those of one name, type and size and go by their least id: from each kind to all
    others; and each part with its kind, at the score of two parts of that kind."""
    f = _parts(spark, d)
    kinds = materialise(f.groupBy("name", "kind", "n").agg(F.min("id").alias("id")).withColumn("volume", F.col("n") % 4), "kinds")

    def likeness(a, b):
        item = {"title": F.concat(f"{b}.name", F.lit(" vol. "), f"{b}.volume"), "creator": F.col(f"{b}.kind"), "volume": F.lit(None).cast("int"), "identifier": F.lit("x")}
        return archive.candidate_likeness(F.concat(f"{a}.name", F.lit(", volume II")), F.col(f"{a}.kind"), item).alias("parts")

    # Few titles stand for many parts: these are dealt over the cores, which go on to the kinds of each.
    x, y = (spread(kinds.select(*c).distinct()).alias(t) for t, c in (("x", ("name", "kind")), ("y", ("name", "kind", "volume"))))
    s = x.crossJoin(y).select(F.col("x.name").alias("name"), F.col("x.kind").alias("kind"), F.col("y.name").alias("other"), F.col("y.kind").alias("creator"), F.col("y.volume").alias("volume"), likeness("x", "y")).alias("s")
    a, b = kinds.alias("a"), kinds.alias("b")
    near = a.join(s, F.col("a.name").eqNullSafe(F.col("s.name")) & F.col("a.kind").eqNullSafe(F.col("s.kind")))
    met = near.join(b, F.col("s.other").eqNullSafe(F.col("b.name")) & F.col("s.creator").eqNullSafe(F.col("b.kind")) & F.col("s.volume").eqNullSafe(F.col("b.volume")) & (F.col("a.id") != F.col("b.id")))
    pairs = met.select(F.lit("pair").alias("row"), F.col("a.id").alias("probe"), F.col("b.id").alias("id"), F.round(archive.candidate_total(F.col("s.parts"), F.col("a.n"), F.col("b.n")), 6).alias("score"))
    own = spread(kinds).alias("o").select("id", "name", "kind", "n", likeness("o", "o")).withColumn("score", F.round(archive.candidate_total(F.col("parts"), F.col("n"), F.col("n")), 6)).alias("k")
    p = f.alias("p")
    members = p.join(own, F.col("p.name").eqNullSafe(F.col("k.name")) & F.col("p.kind").eqNullSafe(F.col("k.kind")) & F.col("p.n").eqNullSafe(F.col("k.n")))
    return pairs.union(members.select(F.lit("member"), "p.id", "k.id", "k.score"))


@query("F34_family_role", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'STRIP_TO_BARE' WHEN 2 THEN 'TITLE_DUP' ELSE 'TITLE_MOVE' END AS action, CASE WHEN p_size % 4 = 1 THEN p_name END AS of_whom FROM part")
def family_role(spark, d):
    k = F.col("n") % 4
    value = F.when(k == 0, "Half-Sister").when(k == 1, F.concat(F.lit("the Mother of "), "name")).when(k == 2, F.concat(F.lit("bearer of "), "name")).otherwise("queen of all")
    role = names.family_role(value, {"domain": F.when(k == 2, F.col("name")), "character_trait": F.lit("")})
    return _parts(spark, d).select("id", role["action"].alias("action"), role["of_whom"].alias("of_whom"))


@query("F34_targets", "SELECT p_partkey AS id, p_name || '|' || p_brand AS targets, 'Hera|' || p_brand AS hints FROM part")
def targets(spark, d):
    kin = names.kin_targets(F.concat(F.lit("the "), "name", F.lit(" (twice), gods and a "), "tradition"))
    hints = names.spouse_hints(F.concat(F.lit("wife of the Hera (sister) and "), "tradition", F.lit("; his love")))["hints"]
    return _parts(spark, d).select("id", F.array_join(kin, "|").alias("targets"), F.array_join(hints, "|").alias("hints"))


@query("F35_event_type", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'the-prefix' WHEN 1 THEN 'identity-keyword' WHEN 2 THEN '3 hyphens' ELSE '1-2 hyphens' END AS bucket FROM part")
def event_type(spark, d):
    k = F.col("n") % 4
    return _parts(spark, d).select("id", names.event_type(F.when(k == 0, "The-birth").when(k == 1, "supreme lord").when(k == 2, "a-b-c-d").otherwise("flood-myth"))["bucket"].alias("bucket"))


@query("F44_identified", "SELECT p_partkey AS id, p_size % 2 = 0 AS identified FROM part")
def identified(spark, d):
    return _parts(spark, d).select("id", names.says_identified(F.concat("name", F.when(F.col("n") % 2 == 0, " was Equated  with ").otherwise(" met "), "tradition")).alias("identified"))


@query("F37_item_identifier", "SELECT p_partkey AS id, CASE WHEN p_size % 3 < 2 THEN p_name END AS identifier, replace(replace(p_name, ' ', '%20'), '#', '%23') AS encoded FROM part")
def item_identifier(spark, d):
    k, part = F.col("n") % 3, archive.encoded(F.col("name"))
    url = F.when(k == 0, F.concat(F.lit("https://x.org/details/"), part)).when(k == 1, F.concat(F.lit("https://x.org/9/items/"), part, F.lit("/a.txt"))).otherwise(F.concat(F.lit("https://x.org/about/"), part))
    return _parts(spark, d).select("id", archive.item_identifier(url).alias("identifier"), part.alias("encoded"))


@query("F39_wiki_languages", "SELECT doc_id, CASE lang WHEN 'en' THEN 'en' ELSE lang || '|en' END AS languages FROM documents")
def wiki_languages(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(archive.wiki_languages(F.concat(F.upper("lang"), F.lit("-x")), F.lit(None).cast("string"), F.lit("la")), "|").alias("languages"))


@query("F41_xml_text", "SELECT p_partkey AS id, p_name || '|' || p_brand AS texts FROM part")
def xml_text(spark, d):
    return _parts(spark, d).select("id", F.array_join(web.xml_texts(F.concat(F.lit('<a xmlns:q="u"><q:n>'), "name", F.lit("</q:n><n k='1'><b>"), "tradition", F.lit("</b></n></a>")), "n"), "|").alias("texts"))


@query("F45_wikisource_page", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'fr' END AS language, CASE WHEN p_size % 2 = 0 THEN p_name END AS title FROM part")
def wikisource_page(spark, d):
    page = archive.wikisource_page(F.concat(F.when(F.col("n") % 2 == 0, "https://fr").otherwise("https://www"), F.lit(".wikisource.org/wiki/"), F.replace("name", F.lit(" "), F.lit("_"))))
    return _parts(spark, d).select("id", page["language"].alias("language"), page["title"].alias("title"))


@query("F46_item_metadata", "SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size > 25 THEN NULL ELSE p_brand END AS creator, 1800 + p_size AS year, 'deu' AS language FROM part")
def item_metadata(spark, d):
    meta = F.struct(F.array("name", F.lit("second")).alias("title"), F.when(F.col("n") > 25, "").otherwise(F.col("tradition")).alias("creator"), F.concat(F.lit("c. "), F.col("n") + 1800, F.lit("-01")).alias("date"), F.lit("German").alias("language"))
    fields = archive.item_metadata(F.to_json(F.struct(meta.alias("metadata"))))
    return _parts(spark, d).select("id", *[fields[c].alias(c) for c in ("title", "creator", "year", "language")])


@query("F47_resolved_candidate", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Item' END AS title, 'und' AS language, 'unknown' AS status_claim, 'https://l/' AS license_url FROM part")
def resolved_candidate(spark, d):
    candidate = {"title": F.when(F.col("n") % 2 == 0, F.col("name")).otherwise(" "), "author": F.lit(None).cast("string"), "language": F.lit(""), "text_url": F.lit("https://old/"), "claimed_statement": F.lit("claimed")}
    item = {"title": F.lit("Item"), "identifier": F.lit("x"), "creator": F.lit("c"), "language": archive.language_code(F.lit("Klingon")), "license_url": F.lit("https://l/"), "download_url": F.lit("https://new/")}
    r = archive.resolved_candidate(candidate, item, "source:archive")
    return _parts(spark, d).select("id", r["title"].alias("title"), r["language"].alias("language"), r["rights"]["status_claim"].alias("status_claim"), r["rights"]["license_url"].alias("license_url"))
