"""Validation of candidates, policies and registries: the codes of the rules that a row breaks.

The rules are data, so a table of any size is checked in one pass and broken rows can be put
aside; a record's own rules are in ``sources.records``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the fields of a candidate may hold.
LANGUAGE_ROLES = ("original", "translation", "parallel", "unknown")
FORMATS = ("txt", "tei_xml", "xml", "html", "epub", "pdf", "json")
RIGHTS_CLAIMS = ("public_domain", "open_license", "copyrighted", "unknown")
#: Families of sources and states of their review.
FAMILIES = ("iiif", "legacy_jsonl", "mediawiki", "oai_dc", "plain_text", "tei")
REVIEWS = ("reviewed", "conditional", "blocked")
HTTP = r"(?i)^https?://[^/\s]+"


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _codes(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(code)) for broken, code in rules]))


def candidate_violations() -> Column:
    """Codes for a candidate (work_id, edition_id, source_id, title, author, language, language_role, format, text_url,
    local_path, metadata_url, publication_year, death_year, status_claim, territories, license_url, download_allowed)."""
    url = lambda name: (F.col(name).isNotNull() & ~F.col(name).rlike(HTTP), f"{name}: address")
    year = lambda name: (F.col(name).isNotNull() & ~F.col(name).between(1, 9999), f"{name}: year")
    return _codes([*[(~F.col(c).rlike("^[a-z][a-z0-9_-]*:.+$"), f"{c}: form") for c in ("work_id", "edition_id", "source_id")], *[(_blank(F.col(c)), f"{c}: empty") for c in ("title", "language")],
                   (~F.col("language_role").isin(*LANGUAGE_ROLES), "language_role: unknown"), (~F.col("format").isin(*FORMATS), "format: unknown"),
                   (_blank(F.col("text_url")) & _blank(F.col("local_path")), "text_url: nor local_path"), url("text_url"), url("metadata_url"), year("publication_year"), year("death_year"),
                   (~F.coalesce("status_claim", F.lit("unknown")).isin(*RIGHTS_CLAIMS), "status_claim: unknown"), (F.exists(F.coalesce("territories", F.array().cast("array<string>")), _blank), "territories: empty"),
                   url("license_url"), (F.col("download_allowed").isNull(), "download_allowed: missing")])


def policy_violations() -> Column:
    """Codes for a policy (schema_version, target_jurisdiction, current_year, ai_translatable_languages, preferred_formats,
    unlock_likely_public_domain, maximum_file_bytes)."""
    listed = lambda name: (F.col(name).isNull() | (F.size(name) == 0) | F.exists(name, _blank), f"{name}: list")
    return _codes([(F.col("schema_version") != "1.0.0", "schema_version"), (F.col("target_jurisdiction").isNull(), "target_jurisdiction: missing"), (~F.col("current_year").between(1900, 9999), "current_year"),
                   listed("ai_translatable_languages"), listed("preferred_formats"), (F.col("unlock_likely_public_domain").isNull(), "unlock_likely_public_domain: missing"), (F.col("maximum_file_bytes") <= 0, "maximum_file_bytes")])


def registry_violations(registry: DataFrame) -> DataFrame:
    """``registry`` with ``broken``: codes for each source (source_id, name, source_family, endpoint_url, resource_types,
    allowed_hosts, review_status, terms_url, robots_url, license, reuse_notes, requests_per_second)."""
    repeated = registry.groupBy("source_id").agg(F.count("*").alias("__n"))
    url = lambda name: (~F.col(name).rlike(HTTP), f"{name}: address")
    codes = _codes([(~F.col("source_id").rlike("^source:[a-z0-9][a-z0-9_-]*$"), "source_id: form"), (F.coalesce("__n", F.lit(1)) > 1, "source_id: repeated"), (_blank(F.col("name")), "name: empty"),
                    (~F.col("source_family").isin(*FAMILIES), "source_family: unknown"), url("endpoint_url"), (F.col("resource_types").isNull() | (F.size("resource_types") == 0), "resource_types: list"),
                    (F.size(F.array_distinct("resource_types")) < F.size("resource_types"), "resource_types: repeated"),
                    (F.col("allowed_hosts").isNotNull() & ((F.size("allowed_hosts") == 0) | F.exists("allowed_hosts", _blank)), "allowed_hosts: list"), (~F.col("review_status").isin(*REVIEWS), "review_status: unknown"),
                    url("terms_url"), url("robots_url"), *[(_blank(F.col(c)), f"{c}: empty") for c in ("license", "reuse_notes")], (F.col("requests_per_second") <= 0, "requests_per_second")])
    return registry.join(repeated, "source_id", "left").withColumn("broken", codes).drop("__n")


def put_aside(rows: DataFrame, broken: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that break no rule, and those that do with the codes as ``broken``."""
    told = rows.withColumn("broken", broken)
    return told.where(F.size("broken") == 0).drop("broken"), told.where(F.size("broken") > 0)


def lead_gate(leads: DataFrame, registry: DataFrame) -> DataFrame:
    """Leads (lead_id, url, …) with the first ``reason`` that stops them, null for those that pass.

    ``registry`` has (host, automated). A lead's host is a registered one or below it.
    """
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = registry.select(F.lower("host").alias("__host"), "automated").groupBy("__host").agg(F.max("automated").alias("automated"))
    spread = leads.select("lead_id", F.explode(suffixes).alias("__host")).join(known, "__host").groupBy("lead_id").agg(F.max("automated").alias("__automated"))
    told = leads.join(spread, "lead_id", "left")
    reason = (F.when(~F.coalesce(F.col("url").rlike("(?i)^https://"), F.lit(False)), "not_https").when(F.col("__automated").isNull(), "unregistered_host").when(~F.col("__automated"), "automated_download_forbidden"))
    return told.withColumn("reason", reason).drop("__automated")
