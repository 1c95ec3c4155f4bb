"""Tables of the product: export, import, manifests, reviews and reports, over versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.functions.text import iso_format
from traitloom.sources.records import merge_catalogs, number_rows
from traitloom.sources.versioned import Store

#: The tables of a full export, in the order in which they are loaded, and those of the public one.
TABLES = ("projects", "nodes", "edges", "sources", "suggestions", "news", "publications", "traitHierarchy", "traitHabitat", "traitCrossCut")
PUBLIC = ("nodes", "edges")
#: Fields of tables that hold times, and the references of suggestions.
TIMES = {"sources": ("createdAt",), "suggestions": ("createdAt",), "news": ("publishedAt", "date")}
REFERENCES = {"nodeId": "nodes", "suggestionSourceNodeId": "nodes", "suggestionTargetNodeId": "nodes", "edgeId": "edges"}
#: Decisions on a locked file, and the states that make it public.
DECISIONS, PUBLIC_STATES = ("approve_public", "keep_locked"), ("public_domain", "open_license")


def export(tables: dict[str, DataFrame], path: str, names: tuple[str, ...] = TABLES) -> None:
    """One folder of JSON lines for each table. A document that held them all would pass through one task."""
    for name in names:
        if name in tables:
            tables[name].write.mode("overwrite").json(f"{path}/{name}")


def read_export(document: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of an export in one JSON document (value), such as the product writes; those it lacks are left out."""
    held = document.select(*[F.get_json_object("value", f"$.{n}").alias(n) for n in schemas])
    present = held.agg(*[F.count(n).alias(n) for n in schemas]).first()
    return {n: held.select(F.explode(F.from_json(n, f"array<{s}>")).alias("r")).select("r.*") for n, s in schemas.items() if present[n]}


def prepare_import(tables: dict[str, DataFrame], held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables as they are to be loaded: times read, the first row of each id kept, and references to nothing emptied.

    Nodes and edges must be there. Suggestions that are held and not replaced lose the references
    that the new nodes and edges no longer have.
    """
    if not {"nodes", "edges"} <= tables.keys():
        raise ValueError("an import holds nodes and edges")
    out = {}
    for name, rows in tables.items():
        for c in TIMES.get(name, ()):
            if c in rows.columns:
                rows = rows.withColumn(c, F.to_timestamp(c))
        out[name] = rows.dropDuplicates(["id"]) if "id" in rows.columns else rows
    if "suggestions" not in out and "suggestions" in held:
        kept = held["suggestions"]
        for column, target in REFERENCES.items():
            if column in kept.columns:
                known = out[target].select(F.col("id").alias("__known")).distinct()
                kept = kept.join(known, F.col(column) == F.col("__known"), "left").withColumn(column, F.when(F.col("__known").isNotNull(), F.col(column))).drop("__known")
        out["suggestions"] = kept
    return out


def next_id(rows: DataFrame) -> int:
    """What a table's counter stands at after a load."""
    return rows.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(1))).first()[0]


def seed_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered anew from 1 by their old ids, and edges (sourceId, targetId) over the new ids; edges of unknown nodes go."""
    fresh = number_rows(nodes.withColumnRenamed("id", "old_id").select("old_id", *[c for c in nodes.columns if c != "id"]), "id", 0)
    ids = fresh.select("old_id", F.col("id").alias("new_id"))
    s, t = ids.toDF("s_old", "s_new"), ids.toDF("t_old", "t_new")
    moved = edges.join(s, F.col("sourceId") == F.col("s_old")).join(t, F.col("targetId") == F.col("t_old"))
    return fresh, moved.select(*[{"sourceId": F.col("s_new"), "targetId": F.col("t_new")}.get(c, F.col(c)).alias(c) for c in edges.columns])


def reparent(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """A trait tree (id, name, parent_id) after ``moves`` (name, parent_name); a null or unknown parent makes a root, a move under itself is ignored."""
    named = tree.select(F.col("name").alias("parent_name"), F.col("id").alias("new_parent"))
    to = moves.join(named, "parent_name", "left").groupBy("name").agg(F.min("new_parent").alias("new_parent"), F.lit(True).alias("moved"))
    return tree.join(to, "name", "left").select("id", "name", F.when(F.col("moved") & (F.coalesce("new_parent", F.lit(-1)) != F.col("id")), F.col("new_parent")).otherwise(F.col("parent_id")).alias("parent_id"))


def read_catalog(document: Column) -> Column:
    """The entities of a catalogue document: an array, or an object's ``nodes`` or ``entities``; spellings of fields are made one."""
    whole = F.try_parse_json(document)
    rows = F.coalesce(*[F.try_variant_get(whole, p, "array<variant>") for p in ("$", "$.nodes", "$.entities")], F.array().cast("array<variant>"))
    text = lambda e, *names: F.coalesce(*[F.nullif(F.trim(F.try_variant_get(e, f"$.{n}", "string")), F.lit("")) for n in names])
    listed = lambda e: F.coalesce(F.try_variant_get(e, "$.aliases", "array<string>"), F.array().cast("array<string>"))
    made = F.transform(rows, lambda e: F.struct(text(e, "name", "deity").alias("name"), F.coalesce(text(e, "tradition"), F.lit("Unknown")).alias("tradition"), text(e, "gender").alias("gender"), listed(e).alias("aliases")))
    return F.filter(made, lambda x: x["name"].isNotNull())


def catalog_of_records(records: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """A catalogue from records (deity, tradition, gender, matched_alias, pos): the aliases that were matched, but rejected pairs (name, alias)."""
    rows = records.where(F.trim("deity") != "").select(F.trim("deity").alias("name"), F.coalesce(F.nullif(F.trim("tradition"), F.lit("")), F.lit("Unknown")).alias("tradition"), "gender", F.trim("matched_alias").alias("alias"), "pos")
    if rejected is not None:
        bad = rejected.select(F.lower("name").alias("bad_name"), F.lower("alias").alias("bad_alias")).distinct().withColumn("bad", F.lit(True))
        rows = rows.join(bad, (F.lower("name") == F.col("bad_name")) & (F.lower("alias") == F.col("bad_alias")), "left").withColumn("alias", F.when(F.col("bad").isNull(), F.col("alias")))
    return merge_catalogs(rows.select("name", "tradition", "gender", F.array_compact(F.array(F.nullif("alias", F.lit("")))).alias("aliases"), "pos"))


def write_catalog(entities: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").json(path)


def write_manifest(records: DataFrame, path: str) -> None:
    """Records of a corpus as JSON lines."""
    records.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a corpus; a line that is no object is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def provenance(payloads: DataFrame, records: DataFrame, sources: DataFrame, retrieved_at: Column) -> DataFrame:
    """A row for each payload (source_id, reference, payload): its checksum, its size, how many records it gave, and its source's terms."""
    counts = records.groupBy("source_id").agg(F.count("*").alias("record_count"))
    own = payloads.select("source_id", F.col("reference").alias("input_reference"), F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("payload_checksum"), F.octet_length("payload").alias("payload_bytes"))
    return own.join(sources, "source_id").join(counts, "source_id", "left").select(
        F.lit("1.0.0").alias("schema_version"), "source_id", F.col("name").alias("source_name"), "source_family", "input_reference", iso_format(retrieved_at).alias("retrieved_at"), "payload_checksum", "payload_bytes",
        F.coalesce("record_count", F.lit(0)).alias("record_count"), F.struct("license", "terms_url", "reuse_notes").alias("rights"))


#: Tables of a corpus kept in a store: its files by checksum, and a sidecar for each.
CORPUS = {"corpus": "sha256 string, path string, partition string, content string", "sidecars": "sha256 string, path string, content_bytes long, partition string, stored_at string"}


def write_corpus(kept: Store, files: DataFrame, stored_at: Column) -> int:
    """Add files (path, partition, content) that the corpus doesn't hold yet, each with its sidecar, as one change; gives how many.

    A content is held once in each partition, whoever else writes at the same time: a writer
    that comes second looks again at what is held. Of equal contents the first path stays.
    """
    checksum = F.sha2(F.concat(F.coalesce("partition", F.lit("")), F.lit("/"), F.coalesce("content", F.lit(""))), 256)
    distinct = files.withColumn("sha256", checksum).groupBy("sha256").agg(*[F.min_by(c, "path").alias(c) for c in ("path", "partition", "content")])

    def add(change) -> int:
        for name, schema in CORPUS.items():
            if name not in change.tables:
                change.write(name, kept.spark.createDataFrame([], schema), key="sha256")
        fresh = distinct.join(change.read("corpus").select("sha256"), "sha256", "left_anti")
        change.add("corpus", fresh)
        added = change.tables["corpus"].segments[-1]
        # The sidecars tell of the files as they were written.
        written = kept.scan(change.tables["corpus"], added)
        change.add("sidecars", written.select("sha256", "path", F.octet_length("content").cast("long").alias("content_bytes"), "partition", iso_format(stored_at).alias("stored_at")))
        return added.rows

    return kept.transact(add)


def write_report(rows: DataFrame, path: str) -> None:
    """A report with tabs between columns and a heading."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def review(files: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (id, partition, path, status) after decisions (file_id, seq, decision, status, basis), the audit rows, and refused decisions.

    A locked file that is approved becomes public under the stated status; other decisions
    only leave their audit row. A decision is refused if it is unknown, has no basis, states a
    status that is not public, or if its file is unknown, not locked or already decided on.
    """
    first = decisions.join(decisions.groupBy("file_id").agg(F.min("seq").alias("__first")), "file_id")
    known = first.join(files.select(F.col("id").alias("file_id"), F.col("partition").alias("__partition"), F.col("status").alias("previous_status")), "file_id", "left")
    status = F.coalesce("status", F.lit("public_domain"))
    reason = (F.when(~F.col("decision").isin(*DECISIONS), "unknown decision").when(F.coalesce(F.trim("basis"), F.lit("")) == "", "no basis")
              .when((F.col("decision") == "approve_public") & ~status.isin(*PUBLIC_STATES), "not a public status").when(F.col("__partition").isNull(), "unknown file")
              .when(F.col("__partition") != "locked", "not locked").when(F.col("seq") > F.col("__first"), "decided already"))
    told = known.withColumn("reason", reason).withColumn("determined_status", F.when(F.col("decision") == "approve_public", status)).drop("__partition", "__first", "status")
    audit = told.where("reason IS NULL").drop("reason")
    approved = audit.where("decision = 'approve_public'").select(F.col("file_id").alias("__id"), "determined_status")
    moved = files.join(approved, F.col("id") == F.col("__id"), "left").select(*[{
        "partition": F.when(F.col("__id").isNotNull(), F.lit("public")).otherwise(F.col("partition")), "status": F.coalesce("determined_status", "status"),
        "path": F.when(F.col("__id").isNotNull(), F.regexp_replace("path", "^locked/", "public/")).otherwise(F.col("path"))}.get(c, F.col(c)).alias(c) for c in files.columns])
    return moved, audit, told.where("reason IS NOT NULL")


def resolve_blockers(blockers: DataFrame, uploads: DataFrame, retries: DataFrame) -> DataFrame:
    """Blockers (id, work_id, reason, url, status) after uploads (blocker_id) and retries (blocker_id, ok, reason).

    An upload or a retry that worked resolves its blocker. A retry that failed leaves it open and
    adds one with the new reason, numbered after all others.
    """
    last = blockers.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    done = uploads.select("blocker_id").union(retries.where("ok").select("blocker_id")).distinct().withColumn("done", F.lit(True))
    after = blockers.join(done, F.col("id") == F.col("blocker_id"), "left").select(*[F.when(F.col("done") & (F.col("status") == "open"), F.lit("resolved")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in blockers.columns])
    failed = retries.where("NOT ok").select("blocker_id", F.col("reason").alias("new_reason"))
    added = blockers.join(failed, F.col("id") == F.col("blocker_id")).select(F.lit(0).cast("long").alias("id"), "work_id", F.col("new_reason").alias("reason"), "url", F.lit("open").alias("status"))
    return after.unionByName(number_rows(added.drop("id"), "id", last).select(*blockers.columns))


def merge_downloads(held: DataFrame, found: DataFrame, run_id: int) -> DataFrame:
    """Corpus files by path after a run: what it downloaded is of this run, what was there keeps the run it came by."""
    new = found.where("relative_path IS NOT NULL").select(F.col("relative_path").alias("path"), "sha256", (F.col("download_status") == "downloaded").alias("fresh")).groupBy("path").agg(
        F.max_by("sha256", F.struct(F.col("fresh"))).alias("new_sha256"), F.max("fresh").alias("fresh"))
    both = held.join(new, "path", "full")
    return both.select("path", F.when(F.col("fresh"), F.col("new_sha256")).otherwise(F.coalesce("sha256", "new_sha256")).alias("sha256"), F.when(F.col("fresh") | F.col("run_id").isNull(), F.lit(run_id)).otherwise(F.col("run_id")).cast("long").alias("run_id"))


def reader_text(files: DataFrame, readable: DataFrame, markup: Column) -> DataFrame:
    """What a reader is shown of public files (id, partition, path, content): Markdown if ready, else the text if it is no markup, else nothing yet."""
    shown = files.where("partition = 'public'").join(readable.select("path", "markdown"), "path", "left")
    state = F.when(F.col("markdown").isNotNull(), "ready").when(~markup, "plain").otherwise("queued")
    return shown.select("id", "markdown", F.when(state == "plain", F.col("content")).alias("text"), state.alias("readable_status"))
