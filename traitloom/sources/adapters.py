"""Sources of six families as records: each adapter reads payloads (source_id, payload) and makes the same record.

An adapter is a function from payloads, with their source's defaults beside them, and a catalogue to a
DataFrame of records; ``run`` picks it by family and puts aside what breaks a record's rules.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.functions.text import chunk_text, let, normalize_space, word_count
from traitloom.functions.web import strip_html
from traitloom.operators.validation import put_aside
from traitloom.sources.records import OPTIONAL, RECORD, match_entities, tei_passages, violations
from traitloom.sources.scratch import materialise

Entities = list[tuple[str, str, list[str]]]
#: What a source says of its works: columns of the payloads, with what stands for a null.
DEFAULTS = {"record_type": "text_excerpt", "source_work": "Unknown", "source_author": "Unknown", "corpus": "unknown", "origin": "primary_source", "translator": None}
PASSAGES = "array<struct<locator:string,excerpt:string,source_work:string,source_author:string,optional:map<string,string>>>"


def make_records(rows: DataFrame, entity: dict[str, Column], alias: Column, fields: dict[str, Column], optional: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows as records: blanks tidied, words counted, and the id a hash of all else; columns ``keep`` come first."""
    tidy = {"deity": entity["name"], "tradition": entity["tradition"], "gender": entity["gender"], "matched_alias": normalize_space(alias)}
    tidy |= {c: normalize_space(fields[c]) for c in ("source_work", "source_author", "corpus", "origin", "locator", "excerpt")} | {"record_type": fields["record_type"]}
    tidy["translator"] = F.nullif(normalize_space(fields["translator"]), F.lit(""))
    tidy |= {c: F.when(v.isNotNull(), normalize_space(v)) for c, v in (optional or {}).items() if c in OPTIONAL}
    tidy |= {c: F.lit(None).cast("string") for c in OPTIONAL if c not in tidy}
    # Written once: the id reads every column, and each would be tidied again for it.
    made = materialise(rows.select(*keep, *[c.cast("string").alias(n) for n, c in tidy.items()]), "records")
    counted = made.withColumn("n_words", word_count(F.col("excerpt")).cast("int"))
    content = F.to_json(F.struct(*sorted([*tidy, "n_words"])))
    return counted.withColumn("id", F.concat(F.lit("rec"), F.substring(F.sha2(content, 256), 1, 16))).select(*keep, *[f.name for f in RECORD])


def _records(payloads: DataFrame, passages: Column, entities: Entities, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of the entities named in the passages of payloads; columns ``keep`` of these come first.

    ``passages`` gives structs of locator, excerpt, work, author and optional fields; nulls fall back on the source.
    """
    kept = [c for c in payloads.columns if c != "payload"]
    spread = payloads.select(*kept, F.posexplode(passages.cast(PASSAGES)).alias("place", "p")).where("p.excerpt IS NOT NULL AND p.excerpt <> ''")
    # Written once: names are looked for in the passages, and records made of them, which would read each payload twice. The
    # names too, so that their size is known to the join and few of them do not make all passages move.
    keyed = materialise(spread.withColumn("key", F.concat_ws("#", "source_id", "place")), "passages")
    named = materialise(match_entities(keyed.select(F.col("key").alias("id"), F.col("p.excerpt").alias("text")), entities), "named")
    own = {c: F.coalesce(F.col(c) if c in payloads.columns else F.lit(None).cast("string"), F.lit(v).cast("string")) for c, v in DEFAULTS.items()}
    own |= {"locator": F.coalesce("p.locator", F.concat(F.coalesce(F.col("endpoint_url") if "endpoint_url" in payloads.columns else F.lit(None).cast("string"), F.lit("")), F.lit("#chunk-"), F.col("place") + 1)),
            "excerpt": F.col("p.excerpt"), "source_work": F.coalesce("p.source_work", own["source_work"]), "source_author": F.coalesce("p.source_author", own["source_author"])}
    optional = {c: F.try_element_at("p.optional", F.lit(c)) for c in OPTIONAL}
    joined = keyed.join(named.withColumnRenamed("id", "match_key"), F.col("key") == F.col("match_key"))
    return make_records(joined, {"name": F.col("name"), "tradition": F.col("tradition"), "gender": F.lit("unknown")}, F.col("alias"), own, optional, keep)


def _passage(excerpt: Column, locator: Column | None = None, work: Column | None = None, author: Column | None = None, optional: dict[str, Column] | None = None) -> Column:
    null = F.lit(None).cast("string")
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (optional or {}).items()])) if optional else F.create_map().cast("map<string,string>")
    return F.struct((locator if locator is not None else null).alias("locator"), excerpt.alias("excerpt"), (work if work is not None else null).alias("source_work"), (author if author is not None else null).alias("source_author"), pairs.alias("optional"))


def plain_text() -> Column:
    return F.transform(chunk_text(F.col("payload")), lambda x: _passage(x))


def tei() -> Column:
    """Passages of TEI documents with the title and the author of their headers."""
    plain = F.regexp_replace(F.col("payload"), r"\sxmlns(:\w+)?=\"[^\"]*\"", " ")
    head = lambda x, tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(x, rf"(?s)<titleStmt>.*?<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")), F.lit(""))
    heads = let(plain, lambda x: F.struct(head(x, "title").alias("title"), head(x, "author").alias("author")))
    return let(heads, lambda h: F.transform(tei_passages(F.col("payload")), lambda x: _passage(x, work=h["title"], author=h["author"])))


def oai_dc() -> Column:
    """A museum's Dublin Core records, repeated elements joined."""
    records = F.regexp_extract_all("payload", F.lit(r"(?s)<record\b[^>]*>(.*?)</record>"), F.lit(1))
    texts = lambda r, tag: F.transform(F.regexp_extract_all(r, F.lit(rf"(?s)<(?:\w+:)?{tag}\b[^>]*>(.*?)</(?:\w+:)?{tag}>"), F.lit(1)), strip_html)

    def row(e: Column) -> Column:
        joined = lambda tag: F.nullif(e[tag], F.lit(""))
        url = F.get(F.filter(e["identifier"], lambda x: x.rlike("^https?://")), F.lit(0))
        return _passage(F.concat_ws(" ", joined("title"), joined("description"), joined("subject")), F.get(e["identifier"], F.lit(0)), joined("title"), joined("creator"),
                        {"url": url, "artwork_title": joined("title"), "artwork_date": joined("date"), "artwork_medium": joined("format"), "artwork_classification": joined("type")})

    # An element is read once, however many fields it goes into.
    told = lambda r: F.struct(texts(r, "identifier").alias("identifier"), *[F.array_join(texts(r, tag), "; ").alias(tag) for tag in ("title", "description", "subject", "creator", "date", "format", "type")])
    return F.transform(F.transform(records, told), row)


def iiif() -> Column:
    """The label and the metadata of manifests, of whichever language comes first."""
    pairs = F.from_json(F.get_json_object("payload", "$.metadata"), "array<struct<label:map<string,array<string>>,value:map<string,array<string>>>>")
    first = lambda m: F.get(F.flatten(F.map_values(m)), F.lit(0))
    label = first(F.from_json(F.get_json_object("payload", "$.label"), "map<string,array<string>>"))
    told = F.transform(F.coalesce(pairs, F.array().cast("array<struct<label:map<string,array<string>>,value:map<string,array<string>>>>")), lambda p: F.concat_ws(": ", first(p["label"]), first(p["value"])))
    heads = F.struct(label.alias("label"), F.get_json_object("payload", "$.id").alias("id"))
    return let(heads, lambda h: F.array(_passage(F.concat_ws(" ", h["label"], F.array_join(told, " ")), h["id"], h["label"], optional={"url": h["id"], "artwork_title": h["label"]})))


def mediawiki() -> Column:
    """The extracts of the pages of a query's result, in chunks."""
    pages = F.map_values(F.from_json(F.get_json_object("payload", "$.query.pages"), "map<string,struct<title:string,fullurl:string,extract:string>>"))
    return F.flatten(F.transform(F.coalesce(pages, F.array().cast("array<struct<title:string,fullurl:string,extract:string>>")),
                                 lambda p: let(strip_html(p["extract"]), lambda text: F.transform(chunk_text(text), lambda x, i: _passage(x, F.concat(F.coalesce(p["fullurl"], p["title"]), F.lit("#chunk-"), i + 1), p["title"], optional={"url": p["fullurl"]})))))


def legacy_jsonl(payloads: DataFrame, entities: Entities) -> DataFrame:
    """Records as they were written, line by line, none of their fields changed; other lines give a row of nulls."""
    lines = payloads.select(F.explode(F.split("payload", "\r?\n")).alias("line")).where(F.trim("line") != "")
    return lines.select(F.inline(F.array(F.from_json("line", RECORD))))


#: How the passages of a payload are read, by family.
READERS: dict[str, Callable[[], Column]] = {"iiif": iiif, "mediawiki": mediawiki, "oai_dc": oai_dc, "plain_text": plain_text, "tei": tei}
ADAPTERS: dict[str, Callable[[DataFrame, Entities], DataFrame]] = {"legacy_jsonl": legacy_jsonl} | {f: lambda payloads, entities, read=read: _records(payloads, read(), entities) for f, read in READERS.items()}


def _checked(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    return put_aside(records, violations({f.name: f.dataType.simpleString() for f in records.schema if isinstance(f.dataType, (T.StringType, T.IntegerType)) and f.name != "family"}))


def run(family: str, payloads: DataFrame, entities: Entities) -> tuple[DataFrame, DataFrame]:
    """A family's records that keep the rules, and those that break some, with the codes as ``broken``."""
    if family not in ADAPTERS:
        raise ValueError(f"no adapter for the source family {family!r}")
    return _checked(ADAPTERS[family](payloads, entities))


def run_each(payloads: DataFrame, entities: Entities) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payloads of all families (``family`` beside the rest), each read by its family's adapter: good records, broken ones, and payloads of unknown families.

    Records carry their family. Families whose passages are read go through one pass together.
    """
    family = F.col("family")
    passages = reduce(lambda out, f: out.when(family == f, READERS[f]().cast(PASSAGES)), sorted(READERS), F.when(F.lit(False), F.array().cast(PASSAGES)))
    made = [_records(payloads.where(family.isin(*READERS)), passages, entities, ("family",))]
    made += [ADAPTERS[f](payloads.where(family == f).drop("family"), entities).withColumn("family", F.lit(f)) for f in sorted(ADAPTERS) if f not in READERS]
    good, broken = _checked(reduce(DataFrame.unionByName, made))
    return good, broken, payloads.where(~F.coalesce(family.isin(*ADAPTERS), F.lit(False)))
