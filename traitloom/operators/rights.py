"""Rights evidence as one decision, and the choice of an edition for each work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States that unlock a text where its territory is covered, and states by preference.
UNLOCKED = ("public_domain", "open_license")
STATUS_ORDER = ("public_domain", "open_license", "public_domain_likely", "public_domain_jurisdictional", "restricted_license", "copyrighted", "conflicting", "unknown")
#: Wording of notices.
RESTRICTIONS = ("all rights reserved", "posted with permission of the copyright holder", "not in the public domain", "not public domain")
FEW_WORKS = "one of the few individual works restricted by copyright"
US_ONLY = ("not restricted by u.s. copyright law", "public domain in the united states", "not protected by copyright in the united states")
LATE_MARKERS = ("restricted by copyright", "protected by copyright", "copyrighted work")
NO_DERIVATIVES = ("/by-nd/", "/by-nc-nd/", "cc by-nd", "cc by-nc-nd", "no derivatives", "noderivatives")
NONCOMMERCIAL = ("/by-nc", "cc by-nc", "noncommercial")
SHARE_ALIKE = ("/by-sa/", "cc by-sa", "sharealike")
#: Why a text is judged as it is, and what its use obliges to.
REASONS = {
    "conflict": "open licence marker conflicts with restrictive copyright evidence",
    "marker": "standardized Creative Commons marker",
    "statement": "standardized RightsStatements.org marker",
    "restricted": "explicit copyright restriction",
    "us_only": "explicit United States-only public-domain statement",
    "claimed": "explicit public-domain claim",
    "unnamed": "open-license claim lacks a recognized licence marker",
    "died": "edition copyright author death year exceeds life-plus-70",
    "printed": "publication date exceeds conservative 95-year term",
    "nothing": "no conclusive rights evidence",
}
DUTIES = {
    "conflict": "resolve_conflicting_rights_evidence",
    "attribution": "attribution",
    "no_derivatives": "no_derivatives",
    "noncommercial": "noncommercial_only",
    "share_alike": "share_alike",
    "restricted": "do_not_publish_without_permission",
    "limited": "review_known_restrictions",
    "us_stated": "public_domain_determination_is_us_only",
    "us_only": "verify_status_outside_the_united_states",
    "elsewhere": "verify_target_jurisdiction",
    "unnamed": "identify_exact_open_license",
    "died": "human_review_of_authorship_and_term_exceptions",
    "printed": "human_review_of_us_publication_history",
    "nothing": "rights_review_required",
}
NOTICE_BYTES = 64 << 10


@dataclass(frozen=True)
class Policy:
    target: str = "FR"
    current_year: int = 2025
    unlock_likely: bool = False
    languages: tuple[str, ...] = ("en", "fr", "de")
    formats: tuple[str, ...] = ("txt", "tei_xml", "html")


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def embedded_notice(payload: Column) -> Column:
    """The first and the last 64 KiB of a file as text; bytes that are no UTF-8, such as a letter cut in two, as U+FFFD."""
    head, tail = (F.make_valid_utf8(F.substring(payload, at, NOTICE_BYTES).cast("string")) for at in (1, -NOTICE_BYTES))
    return F.when(F.octet_length(payload) > NOTICE_BYTES, F.concat_ws("\n", head, tail)).otherwise(head)


def assess(text: Column, claim: Column, territories: Column, death_year: Column, publication_year: Column, policy: Policy) -> Column:
    """A struct: status, confidence, territories, territory_covered, publication_allowed,
    translation_allowed, locked, review_required, obligations and reason.

    ``text`` is all evidence joined, in small letters. The first rule that holds decides.
    """
    text, claim = F.coalesce(text, F.lit("")), F.coalesce(claim, F.lit("unknown"))
    own = F.transform(F.coalesce(territories, F.array().cast("array<string>")), lambda x: F.upper(x))
    target = policy.target.upper()

    def verdict(status, confidence: Column | str, where: Column, translate: Column | bool, obligations: Column | tuple[str, ...], reason: str) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        duties = obligations if isinstance(obligations, Column) else F.array(*map(F.lit, obligations)).cast("array<string>")
        return F.struct(as_column(status).alias("status"), as_column(confidence).alias("confidence"), where.alias("territories"), as_column(translate).alias("translate"), duties.alias("obligations"), F.lit(reason).alias("reason"))

    def covers(where: Column) -> Column:
        hit = F.array_contains(where, "WORLDWIDE") | F.array_contains(where, target)
        return hit | F.array_contains(where, "EU") if target == "FR" else hit

    world, us = F.array(F.lit("WORLDWIDE")), F.array(F.lit("US"))
    zero = text.contains("creativecommons.org/publicdomain/zero") | text.rlike(r"\bcc0(?:\s|/|$)")
    mark = _any(text, ("creativecommons.org/publicdomain/mark", "public domain mark"))
    some_cc = _any(text, ("creative commons", "creativecommons.org/licenses/"))
    nd, nc, sa = (some_cc & _any(text, x) for x in (NO_DERIVATIVES, NONCOMMERCIAL, SHARE_ALIKE))
    by = some_cc & (text.contains("/by/") | text.rlike(r"\bcc by(?:\s|$)"))
    cc = zero | mark | nd | nc | sa | by
    plain_restriction = (claim == "copyrighted") | _any(text, RESTRICTIONS)
    limits = F.array_compact(F.array(F.lit(DUTIES["attribution"]), F.when(nd, F.lit(DUTIES["no_derivatives"])), F.when(nc, F.lit(DUTIES["noncommercial"])), F.when(sa, F.lit(DUTIES["share_alike"]))))
    named = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("UNSPECIFIED")))
    vocab = "rightsstatements.org/vocab/"
    died = death_year <= policy.current_year - 71 if target in ("FR", "EU") else F.lit(False)
    printed = publication_year <= policy.current_year - 96 if target == "US" else F.lit(False)
    chosen = (
        F.when(cc & plain_restriction, verdict("conflicting", "low", own, False, (DUTIES["conflict"],), REASONS["conflict"]))
        .when(zero | mark, verdict("public_domain", "high", world, True, (), REASONS["marker"]))
        .when(nd | nc, verdict("restricted_license", "high", world, ~nd, limits, REASONS["marker"]))
        .when(sa, verdict("open_license", "high", world, True, (DUTIES["attribution"], DUTIES["share_alike"]), REASONS["marker"]))
        .when(by, verdict("open_license", "high", world, True, (DUTIES["attribution"],), REASONS["marker"]))
        .when(text.contains(vocab + "inc"), verdict("copyrighted", "high", own, False, (DUTIES["restricted"],), REASONS["statement"]))
        .when(_any(text, (vocab + "noc-nc", vocab + "noc-oklr", vocab + "noc-cr")), verdict("restricted_license", "high", own, False, (DUTIES["limited"],), REASONS["statement"]))
        .when(text.contains(vocab + "noc-us"), verdict("public_domain_jurisdictional", "high", us, True, (DUTIES["us_stated"],), REASONS["statement"]))
        .when(plain_restriction | text.contains(FEW_WORKS), verdict("copyrighted", "high", own, False, (DUTIES["restricted"],), REASONS["restricted"]))
        .when(_any(text, US_ONLY), verdict("public_domain" if target == "US" else "public_domain_jurisdictional", "high", us, True, (DUTIES["us_only"],), REASONS["us_only"]))
        .when(_any(text, LATE_MARKERS), verdict("copyrighted", "high", own, False, (DUTIES["restricted"],), REASONS["restricted"]))
        .when((claim == "public_domain") | _any(text, ("public domain", "no known copyright")), verdict(
            F.when(covers(named), "public_domain").otherwise("public_domain_jurisdictional"), F.when(F.size(own) > 0, "high").otherwise("medium"), named, True,
            F.when(covers(named), F.array().cast("array<string>")).otherwise(F.array(F.lit(DUTIES["elsewhere"]))), REASONS["claimed"]))
        .when(claim == "open_license", verdict("unknown", "low", own, False, (DUTIES["unnamed"],), REASONS["unnamed"]))
        .when(F.coalesce(died, F.lit(False)), verdict("public_domain_likely", "medium", F.array(F.lit(target)), True, (DUTIES["died"],), REASONS["died"]))
        .when(F.coalesce(printed, F.lit(False)), verdict("public_domain_likely", "medium", us, True, (DUTIES["printed"],), REASONS["printed"]))
        .otherwise(verdict("unknown", "low", own, False, (DUTIES["nothing"],), REASONS["nothing"])))

    def finished(v: Column) -> Column:
        is_open = v["status"] == "open_license"
        covered = covers(v["territories"]) | is_open
        allowed = is_open | (v["status"].isin(*UNLOCKED) & covers(v["territories"])) | ((v["status"] == "public_domain_likely") & F.lit(policy.unlock_likely))
        return F.struct(v["status"].alias("status"), v["confidence"].alias("confidence"), v["territories"].alias("territories"), covered.alias("territory_covered"), allowed.alias("publication_allowed"),
                        (v["translate"] & allowed).alias("translation_allowed"), (~allowed).alias("locked"), ((v["confidence"] != "high") | ~allowed).alias("review_required"), v["obligations"].alias("obligations"), v["reason"].alias("reason"))

    return F.element_at(F.transform(F.array(chosen), finished), 1)


def plan_editions(editions: DataFrame, policy: Policy) -> DataFrame:
    """Editions (work_id, edition_id, language, language_role, format, available, status,
    publication_allowed) with ``selected``, ``reason`` and ``rank``.

    A rule picks the best edition of a work among those it applies to, by rights, format and
    id; an edition keeps the reason of the lowest rank. One sort by work serves all rules.
    """
    position = lambda values, c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), c), F.lit(0)), F.lit(len(values) + 1))
    key = F.struct(position(STATUS_ORDER, F.col("status")).alias("a"), position(policy.formats, F.col("format")).alias("b"), F.col("edition_id").alias("c"))
    of_work = Window.partitionBy("work_id")
    is_open = F.col("available") & F.col("publication_allowed")
    shut = F.col("available") & ~F.col("publication_allowed")
    english, original = F.lower("language") == "en", F.col("language_role") == "original"
    other = F.col("language").isin(*policy.languages)
    marked = editions.withColumns({"k": key, "speech": position(policy.languages, F.col("language"))}).withColumns({
        "has_en": F.max(F.coalesce(is_open & english, F.lit(False))).over(of_work), "has_original": F.max(F.coalesce(is_open & original, F.lit(False))).over(of_work),
        "has_translated": F.max(F.coalesce(is_open & other & ~original, F.lit(False))).over(of_work)})
    spoken = F.struct(F.col("speech").alias("s"), F.col("k").alias("k"))
    rules = [
        ("preferred_open_english", 1, is_open & english, F.col("k")), ("preferred_open_original", 2, is_open & original, F.col("k")),
        ("fallback_open_ai_translatable", 3, is_open & other & ~F.col("has_en") & (~F.col("has_translated") | ~original), spoken),
        ("locked_english_reference", 10, shut & english & ~F.col("has_en"), F.col("k")), ("locked_original_reference", 11, shut & original & ~F.col("has_original"), F.col("k")),
    ]
    picks = F.lit(None).cast("struct<rank:int,reason:string>")
    for reason, rank, applies, order in reversed(rules):
        best = F.min(F.when(F.coalesce(applies, F.lit(False)), order)).over(of_work)
        picks = F.when(F.coalesce(applies, F.lit(False)) & (order == best), F.struct(F.lit(rank).alias("rank"), F.lit(reason).alias("reason"))).otherwise(picks)
    ruled = marked.withColumn("pick", picks)
    none = F.max(F.col("pick").isNotNull()).over(of_work)
    first = F.min(F.when(F.col("available"), F.col("k"))).over(of_work)
    last = F.when(F.col("available") & ~none & (F.col("k") == first), F.struct(F.lit(20).alias("rank"), F.lit("only_authorized_candidate").alias("reason")))
    done = ruled.withColumn("pick", F.coalesce("pick", last))
    return done.select(*editions.columns, F.col("pick").isNotNull().alias("selected"), F.coalesce("pick.reason", F.lit("not_selected")).alias("reason"), F.coalesce("pick.rank", F.lit(999)).alias("rank"))
