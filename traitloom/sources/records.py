"""Records: reading, fingerprints, ids, validation, matching and corpus files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.functions.text import word_count
from traitloom.operators.dictionary import match_catalog
from traitloom.sources.scratch import materialise

#: The fields of a resource record; the second list is optional.
REQUIRED = ("deity", "tradition", "gender", "matched_alias", "record_type", "source_work", "source_author", "corpus", "origin", "locator", "excerpt")
OPTIONAL = ("url", "artwork_title", "artwork_date", "artwork_medium", "artwork_classification", "match_confidence", "excerpt_original", "original_language", "translation_method", "translator_note")
RECORD_TYPES = ("text_excerpt", "art_description", "museum_object")
MUSEUM_FIELDS = ("url", "artwork_title", "artwork_date", "artwork_medium", "artwork_classification", "match_confidence")
RECORD = T.StructType([*[T.StructField(n, T.StringType()) for n in (*REQUIRED, "translator", "id", *OPTIONAL)], T.StructField("n_words", T.IntegerType())])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines as records; blank lines go, a bad line is null but for ``corrupt``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    corrupt = T.StructType([*schema.fields, T.StructField("corrupt", T.StringType())])
    return lines.select(F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def merge(parts: list[DataFrame]) -> DataFrame:
    """All rows with all columns, first come first."""
    out = None
    for i, part in enumerate(parts):
        numbered = part.withColumn("part", F.lit(i))
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=True)
    return out


def fingerprint(columns: list[str], without: tuple[str, ...] = ("id",)) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(c for c in columns if c not in without))), 256)


def dedupe(records: DataFrame, order: str) -> DataFrame:
    """The first of the records that are equal but for their id and place."""
    keyed = records.withColumn("print", fingerprint(records.columns, ("id", order)))
    rn = F.row_number().over(Window.partitionBy("print").orderBy(order))
    return keyed.withColumn("rn", rn).where("rn = 1").drop("rn", "print")


def number(records: DataFrame, order: str, prefix: str = "rec", column: str = "id") -> DataFrame:
    """Ids ``rec000000`` in order. Ranges are sorted apart and then counted up, so no task sees all rows.

    The ranges are written before they are counted, so that both readings see the same ones.
    """
    ranged = materialise(records.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()).withColumn("own", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("p")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return ranged.join(before, F.col("part") == F.col("p")).withColumn(column, F.concat(F.lit(prefix), F.lpad((F.col("before") + F.col("own")).cast("string"), F.greatest(F.lit(6), F.length((F.col("before") + F.col("own")).cast("string"))), F.lit("0")))).drop("part", "own", "p", "before")


def number_rows(rows: DataFrame, key: str, last: int) -> DataFrame:
    """``rows`` with ``key`` counted up from ``last`` in the order of their columns; no task sees all rows."""
    ordered = rows.withColumn("__order", F.struct(*rows.columns))
    return number(ordered, "__order", "", "__number").withColumn(key, F.col("__number").cast("long") + 1 + last).drop("__number", "__order")


def violations(columns: dict[str, str]) -> Column:
    """Codes of the rules that a record breaks; ``columns`` are the record's names and types."""
    checks = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", f"missing:{c}") if c in columns else F.lit(f"missing:{c}") for c in REQUIRED]
    checks += [F.lit(f"unknown:{c}") for c in columns if c not in (*REQUIRED, *OPTIONAL, "translator", "id", "n_words")]
    if "record_type" in columns:
        checks.append(F.when(~F.col("record_type").isin(*RECORD_TYPES), "type"))
        checks += [F.when((F.col("record_type") == "museum_object") & (F.col(c).isNull() if c in columns else F.lit(True)), f"museum:{c}") for c in MUSEUM_FIELDS]
    if "n_words" in columns and "excerpt" in columns:
        checks.append(F.when(F.coalesce(F.col("n_words") != word_count(F.col("excerpt")), F.lit(True)), "words"))
    if "url" in columns:
        checks.append(F.when(F.col("url").isNotNull() & ~F.col("url").rlike("^https?://"), "url"))
    if "id" in columns:
        checks.append(F.when(F.col("id").isNotNull() & ~F.col("id").rlike("^rec[0-9a-f]{6,32}$"), "id"))
    return F.array_compact(F.array(*checks))


def match_entities(texts: DataFrame, entities: DataFrame | list[tuple[str, str, list[str]]], least_long: int = 5) -> DataFrame:
    """(id, name, tradition, alias): entities named in texts (id, text), each once by its first surface.

    Canonical names of five letters or more match in any case, all others exactly; a match is
    bounded by characters that are no letter or digit. The catalogue is a table (name,
    tradition, aliases) of any size, or a short list.
    """
    if not isinstance(entities, DataFrame):
        entities = texts.sparkSession.createDataFrame([(n, t, list(a)) for n, t, a in entities], "name string, tradition string, aliases array<string>")
    return match_catalog(texts, entities, least_long)


def list_rows(text: Column) -> Column:
    """Title and author of the lines ``Title — Author`` of a text list, comments and blanks left out."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    parts = F.transform(lines, lambda x: F.split(x, r"\s+[—–]\s+|\s+-\s+", 2))
    return F.transform(parts, lambda p: F.struct(F.trim(F.get(p, F.lit(0))).alias("title"), F.trim(F.get(p, F.lit(1))).alias("author")))


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted catalogue with line breaks in fields; rows of type Text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').where(F.col("Type") == "Text")


def read_oai_records(spark: SparkSession, path: str) -> DataFrame:
    """Dublin Core records of an OAI response, repeated elements as arrays."""
    schema = "header struct<identifier:string>, metadata struct<dc:struct<title:array<string>,creator:array<string>,date:array<string>,type:array<string>,format:array<string>,description:array<string>>>"
    raw = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").schema(schema).load(path)
    return raw.select(F.col("header.identifier").alias("identifier"), "metadata.dc.*")


def tei_passages(xml: Column) -> Column:
    """The paragraphs of a TEI document, else its verse lines, else its body as one passage."""
    plain = F.regexp_replace(F.coalesce(xml, F.lit("")), r"\sxmlns(:\w+)?=\"[^\"]*\"|\sxml:(?=\w+=)", " ")
    body = F.regexp_extract(plain, r"(?s)<body[^>]*>(.*)</body>", 1)
    text = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " "))
    found = [F.filter(F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(1)), text), lambda x: x != "") for p in (r"(?s)<(?:p|ab)\b[^>]*>(.*?)</(?:p|ab)>", r"(?s)<l\b[^>]*>(.*?)</l>")]
    return F.when(F.size(found[0]) > 0, found[0]).when(F.size(found[1]) > 0, found[1]).otherwise(F.filter(F.array(text(body)), lambda x: x != ""))


def iiif_labels(manifest: Column) -> dict[str, Column]:
    """Id, first label and metadata pairs of a manifest given as JSON text."""
    v = F.try_parse_json(manifest)
    pairs = F.from_json(F.get_json_object(manifest, "$.metadata"), "array<struct<label:map<string,array<string>>,value:map<string,array<string>>>>")
    first = lambda m: F.get(F.flatten(F.map_values(m)), F.lit(0))
    return {"id": F.try_variant_get(v, "$.id", "string"), "label": first(F.from_json(F.get_json_object(manifest, "$.label"), "map<string,array<string>>")),
            "metadata": F.transform(pairs, lambda p: F.struct(first(p["label"]).alias("label"), first(p["value"]).alias("value")))}


def wiki_pages(payload: Column) -> Column:
    """The pages of a MediaWiki query result as structs (pageid, ns, title, fullurl)."""
    pages = F.from_json(F.get_json_object(payload, "$.query.pages"), "map<string,struct<pageid:long,ns:int,title:string,fullurl:string>>")
    return F.array_sort(F.map_values(pages))


def verify_corpus(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Counts of files that agree with the manifest (path, sha256), differ, are missing or are not listed."""
    actual = files.select("path", F.sha2("content", 256).alias("actual"))
    both = manifest.join(actual, "path", "full_outer")
    return both.agg(F.count_if(F.col("sha256") == F.col("actual")).alias("ok"), F.count_if(F.col("sha256") != F.col("actual")).alias("changed"),
                    F.count_if(F.col("actual").isNull()).alias("missing"), F.count_if(F.col("sha256").isNull()).alias("unlisted"))


def merge_catalogs(entities: DataFrame) -> DataFrame:
    """Entities (name, tradition, gender, aliases, pos) by name and tradition whatever their case: all aliases, the first known gender."""
    grouped = entities.groupBy(F.lower("name").alias("k1"), F.lower(F.coalesce("tradition", F.lit(""))).alias("k2")).agg(
        F.min_by("name", "pos").alias("name"), F.min_by("tradition", "pos").alias("tradition"), F.min_by("gender", F.when(F.col("gender").isNotNull() & (F.col("gender") != "unknown"), F.col("pos"))).alias("gender"),
        F.array_sort(F.collect_list(F.struct("pos", "aliases"))).alias("lists"))
    return grouped.select("name", "tradition", "gender", F.array_distinct(F.flatten(F.transform("lists", lambda x: x["aliases"]))).alias("aliases"))
