"""Texts, rights, web pages and matching over documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from traitloom.functions import archive
from traitloom.functions import text as tx
from traitloom.functions import web
from traitloom.functions.tokens import replace_in_array
from traitloom.operators import ranking, rights
from traitloom.plans import stand_in as st
from traitloom.plans.registry import query, table
from traitloom.sources import records
from traitloom.sources.scratch import materialise

def text():
    return F.col("text")


def docs(spark, d):
    return table(spark, d, "documents")


@query("F3_normalize_space", r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\s\p{Z}\x{FEFF}]+', ' ', 'g')) AS text FROM documents")
def normalize_space(spark, d):
    return docs(spark, d).select("doc_id", tx.normalize_space(text()).alias("text"))


@query("F6_word_count", r"SELECT doc_id, len(list_filter(string_split_regex(text, '[\s\p{Z}\x{FEFF}]+'), lambda w: w <> '')) AS n_words FROM documents")
def word_count(spark, d):
    return docs(spark, d).select("doc_id", tx.word_count(text()).alias("n_words"))


@query("F8_slug")
def slug(spark, d):
    return docs(spark, d).select("doc_id", tx.slug(text()).alias("slug"))


@query("F9_title_key")
def title_key(spark, d):
    return docs(spark, d).select("doc_id", tx.title_key(text()).alias("key"))


@query("F10_strip_diacritics", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def strip_diacritics(spark, d):
    return docs(spark, d).select("doc_id", tx.strip_diacritics(text()).alias("text"))


@query("F12_transliterate", "SELECT doc_id, strip_accents(" + "".join("replace(" for _ in tx.LETTERS) + "text" + "".join(f", '{a}', '{b}')" for a, b in tx.LETTERS.items()) + ") AS text FROM documents")
def transliterate(spark, d):
    return docs(spark, d).select("doc_id", tx.transliterate(text()).alias("text"))


@query("F17_array_replace", "SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'hot' THEN 'warm' ELSE x END), ' ') AS words FROM part")
def array_replace(spark, d):
    return st.figures(spark, d).select("id", F.array_join(replace_in_array(F.split("name", " "), "hot", "warm"), " ").alias("words"))


@query("F19_record_id", "SELECT p_partkey AS id, substr(sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\"}'), 1, 16) AS record_id FROM part")
def record_id(spark, d):
    return st.figures(spark, d).select("id", tx.record_id(F.col("tradition").alias("brand"), F.col("name").alias("name")).alias("record_id"))


PARAGRAPHS = r"""p AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS para, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) AS pi FROM documents),
    w AS (SELECT doc_id, pi, list_filter(string_split_regex(para, '[\s\p{Z}\x{FEFF}]+'), lambda x: x <> '') AS own FROM p WHERE trim(para) <> ''),
    k AS (SELECT doc_id, pi, own, unnest(range(0, CAST(greatest(0, ceil((len(own) - 260) / 225.0)) AS BIGINT) + 1)) AS c FROM w WHERE len(own) > 0)"""


@query("F20_chunk_text", f"WITH {PARAGRAPHS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pi, c) - 1 AS INTEGER) AS chunk, array_to_string(own[c * 225 + 1 : c * 225 + 260], ' ') AS text FROM k")
def chunk_text(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(tx.chunk_text(text())).alias("chunk", "text"))


@query("W5_chunk_ordinals", f"WITH {PARAGRAPHS} SELECT doc_id, doc_id || '#chunk-' || (row_number() OVER (PARTITION BY doc_id ORDER BY pi, c)) AS locator FROM k")
def chunk_ordinals(spark, d):
    numbered = docs(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), tx.chunk_count(text()))).alias("chunk")).where("chunk > 0")
    return numbered.select("doc_id", F.concat("doc_id", F.lit("#chunk-"), "chunk").alias("locator"))


@query("F21_cleanup_transcription")
def cleanup_transcription(spark, d):
    return docs(spark, d).select("doc_id", tx.cleanup_transcription(text()).alias("text"))


@query("W8_paragraphs", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: trim(p) <> '')) AS n FROM documents")
def paragraphs(spark, d):
    return docs(spark, d).select("doc_id", F.size(tx.paragraphs_of_lines(F.split("text", "\n"))).alias("n"))


@query("F22_prose_length")
def prose_length(spark, d):
    return table(spark, d, "pages").select("page_id", web.prose_length(F.col("html")).alias("prose"))


@query("F23_html_title")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", web.html_title(F.col("html")).alias("title"), F.size(web.content_links(F.col("html"), F.col("url"))).alias("n_links"))


def _nested(times, inner, pattern, to=""):
    """SQL that replaces a pattern again and again; the supplied texts nest no deeper."""
    for _ in range(times):
        inner = f"regexp_replace({inner}, '{pattern}', '{to}', 'g')"
    return inner


@query("F25_clean_wikitext", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _nested(5, r"regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>', '', 'g')", r"\{\{[^{}]*\}\}")
       + r", '(?i)\[\[(?:file|image|category):[^\[\]]*\]\]', '', 'g'), '\[\[[^\[\]|]*\|([^\[\]]*)\]\]', '\1', 'g'), '\[\[([^\[\]]*)\]\]', '\1', 'g'), '\x27{2,}', '', 'g'), '<[^>]*>', '', 'g')) AS text FROM documents")
def clean_wikitext(spark, d):
    return docs(spark, d).select("doc_id", web.clean_wikitext(text()).alias("text"))


@query("F12_strip_parens", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _nested(6, "text", r"\s*\([^()]*\)") + r", '\s+', ' ', 'g'), '\s+([,;.])', '\1', 'g'), '\s*;\s*;\s*', '; ', 'g'), '^[\s,;]+|[\s,;]+$', '', 'g')) AS text FROM documents")
def strip_parens(spark, d):
    return docs(spark, d).select("doc_id", tx.strip_parens(text()).alias("text"))


@query("F29_script_language", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{code}'" for p, code in tx.SCRIPTS) + " END AS script FROM documents")
def script_language(spark, d):
    return docs(spark, d).select("doc_id", tx.script_language(text()).alias("script"))


@query("F30_region_inference", """WITH k(region, keyword) AS (VALUES ('north', 'the'), ('north', 'ring'), ('south', 'les'), ('south', 'une'), ('east', 'und'), ('east', 'der'), ('west', 'ring'), ('west', 'una')), w AS (SELECT DISTINCT doc_id AS id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS keyword FROM documents),
    h AS (SELECT id, region, count(*) AS n FROM w JOIN k USING (keyword) GROUP BY ALL), t AS (SELECT id, region, n, max(n) OVER (PARTITION BY id) AS top FROM h), l AS (SELECT id, count(*) AS ties, min(region) AS region FROM t WHERE n = top GROUP BY id)
    SELECT doc_id AS id, CASE WHEN ties = 1 THEN region END AS region FROM documents LEFT JOIN l ON doc_id = id""")
def region_inference(spark, d):
    words = spark.createDataFrame([("north", "the"), ("north", "ring"), ("south", "les"), ("south", "une"), ("east", "und"), ("east", "der"), ("west", "ring"), ("west", "una")], "region string, keyword string")
    return ranking.region_of(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), words)


@query("F31_dice", """WITH b AS (SELECT min(p_name) AS first FROM part), w AS (SELECT p_partkey AS id, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS a, string_split(first, ' ') AS f FROM part, b)
    SELECT id, round(2.0 * len(list_intersect(a, f)) / (len(a) + len(f)), 6) AS score FROM w""")
def dice(spark, d):
    f = st.figures(spark, d)
    first = f.agg(F.min("name")).first()[0]
    return f.select("id", F.round(ranking.dice(F.concat_ws(" ", "name", "kind"), F.lit(first)), 6).alias("score"))


@query("O9_accepted_matches", """WITH s AS (SELECT a.p_partkey AS probe, b.p_partkey AS id, b.p_name AS work, 0.85 * (CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE 0.5 END) + 0.15 * CASE WHEN a.p_type = b.p_type THEN 1.0 ELSE 0.0 END AS score
    FROM part a JOIN part b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) AS rn FROM s), x AS (SELECT * FROM r WHERE rn = 1), y AS (SELECT * FROM r WHERE rn = 2)
    SELECT x.probe, x.id, CAST(round(x.score, 6) AS DOUBLE) AS score FROM x LEFT JOIN y USING (probe) WHERE x.score >= 0.62 AND NOT coalesce(x.score - y.score < 0.05 AND x.work <> y.work, false)""")
def accepted_matches(spark, d):
    """Parts of one name, type and size score alike: names and types are scored once, and the best of a kind are among the first three of each."""
    f = st.figures(spark, d).withColumn("w", F.split_part("name", F.lit(" "), F.lit(1)))
    looks = f.select("w", "name", "kind").distinct()
    a, b, none = looks.alias("a"), looks.alias("b"), F.lit(None).cast("int")
    score = archive.candidate_score(F.col("a.name"), F.col("a.kind"), none, {"title": F.col("b.name"), "creator": F.col("b.kind"), "year": none, "volume": none, "identifier": F.lit(None).cast("string")})
    scored = materialise(a.join(b, F.col("a.w") == F.col("b.w")).select(F.col("a.name").alias("name"), F.col("a.kind").alias("kind"), F.col("b.name").alias("work"), F.col("b.kind").alias("other"), score.alias("score")), "scored")
    rank = F.row_number().over(Window.partitionBy("name", "kind", "n").orderBy("id"))
    first = materialise(f.select("id", "name", "kind", "n").withColumn("rn", rank).where("rn <= 3").drop("rn"), "first-of-kind")
    asked = first.select("name", "kind", "n").distinct().alias("q").join(scored.alias("s"), (F.col("q.name") == F.col("s.name")) & F.col("q.kind").eqNullSafe(F.col("s.kind"))).select("q.*", "work", "other", "score").alias("q")
    met = asked.join(first.alias("b"), (F.col("q.work") == F.col("b.name")) & F.col("q.other").eqNullSafe(F.col("b.kind")) & (F.col("q.n") == F.col("b.n"))).select("q.name", "q.kind", "q.n", "b.id", "work", "score")
    best = met.withColumn("rn", F.row_number().over(Window.partitionBy("name", "kind", "n").orderBy(F.col("score").desc(), "id"))).where("rn <= 3").alias("b")
    p = f.alias("p")
    pairs = p.join(best, (F.col("p.name") == F.col("b.name")) & F.col("p.kind").eqNullSafe(F.col("b.kind")) & (F.col("p.n") == F.col("b.n")) & (F.col("p.id") != F.col("b.id")))
    return ranking.accepted_matches(pairs.select(F.col("p.id").alias("probe"), F.col("b.id").alias("id"), "work", "score"), same_work=archive.same_work).withColumn("score", F.round("score", 6))


def _assessed(spark, d):
    e = st.editions(spark, d)
    verdict = rights.assess(F.col("evidence"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(None).cast("int"), F.lit(None).cast("int"), rights.Policy())
    return e.withColumn("v", verdict)


STATUS = """e AS (SELECT doc_id // 4 AS work_id, 'ed' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS edition_id, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'original' ELSE 'translation' END AS role, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS fmt, doc_id % 5 <> 0 AS available, lower(text) AS t FROM documents),
    c AS (SELECT *, contains(t, 'creative commons') OR contains(t, 'creativecommons.org/licenses/') AS cc, contains(t, 'all rights reserved') OR contains(t, 'posted with permission of the copyright holder') OR contains(t, 'not in the public domain') OR contains(t, 'not public domain') AS shut FROM e),
    s AS (SELECT *, CASE WHEN cc AND shut AND (contains(t, 'noncommercial') OR contains(t, '/by-') OR contains(t, 'cc by')) THEN 'conflicting' WHEN regexp_matches(t, '\\bcc0(\\s|/|$)') THEN 'public_domain' WHEN cc AND (contains(t, 'noncommercial') OR contains(t, '/by-nc') OR contains(t, 'cc by-nc')) THEN 'restricted_license'
        WHEN cc AND (contains(t, 'cc by') OR contains(t, '/by/')) THEN 'open_license' WHEN shut THEN 'copyrighted' WHEN contains(t, 'restricted by copyright') OR contains(t, 'protected by copyright') OR contains(t, 'copyrighted work') THEN 'copyrighted'
        WHEN contains(t, 'public domain') OR contains(t, 'no known copyright') THEN 'public_domain_jurisdictional' ELSE 'unknown' END AS status FROM c)"""


@query("F32_assess_rights", f"WITH {STATUS} SELECT edition_id, status, status = 'open_license' OR status = 'public_domain' AS publication_allowed FROM s")
def assess_rights(spark, d):
    return _assessed(spark, d).select("edition_id", "v.status", "v.publication_allowed")


@query("W1_edition_plan", f"""WITH {STATUS}, p AS (SELECT *, status IN ('open_license', 'public_domain') AS open, list_position(['public_domain', 'open_license', 'public_domain_likely', 'public_domain_jurisdictional', 'restricted_license', 'copyrighted', 'conflicting', 'unknown'], status) AS sr,
        coalesce(list_position(['en', 'fr', 'de'], language), 4) AS lr FROM s),
    f AS (SELECT *, bool_or(available AND open AND language = 'en') OVER w AS has_en, bool_or(available AND open AND role = 'original') OVER w AS has_orig, bool_or(available AND open AND lr < 4 AND role <> 'original') OVER w AS has_tr FROM p WINDOW w AS (PARTITION BY work_id)),
    a AS (SELECT *, available AND open AND language = 'en' AS r1, available AND open AND role = 'original' AS r2, available AND open AND lr < 4 AND NOT has_en AND (NOT has_tr OR role <> 'original') AS r3, available AND NOT open AND language = 'en' AND NOT has_en AS r10, available AND NOT open AND role = 'original' AND NOT has_orig AS r11 FROM f),
    n AS (SELECT *, r1 AND row_number() OVER (PARTITION BY work_id, r1 ORDER BY sr, fmt, edition_id) = 1 AS b1, r2 AND row_number() OVER (PARTITION BY work_id, r2 ORDER BY sr, fmt, edition_id) = 1 AS b2, r3 AND row_number() OVER (PARTITION BY work_id, r3 ORDER BY lr, sr, fmt, edition_id) = 1 AS b3,
        r10 AND row_number() OVER (PARTITION BY work_id, r10 ORDER BY sr, fmt, edition_id) = 1 AS b10, r11 AND row_number() OVER (PARTITION BY work_id, r11 ORDER BY sr, fmt, edition_id) = 1 AS b11, available AND row_number() OVER (PARTITION BY work_id, available ORDER BY sr, fmt, edition_id) = 1 AS b20 FROM a),
    k AS (SELECT *, CASE WHEN b1 THEN 1 WHEN b2 THEN 2 WHEN b3 THEN 3 WHEN b10 THEN 10 WHEN b11 THEN 11 END AS r FROM n), z AS (SELECT *, bool_or(r IS NOT NULL) OVER (PARTITION BY work_id) AS chosen FROM k)
    SELECT work_id, edition_id, coalesce(r, CASE WHEN b20 AND NOT chosen THEN 20 END, 999) AS rank FROM z""")
def edition_plan(spark, d):
    e = _assessed(spark, d).select("work_id", "edition_id", "language", "language_role", "format", "available", "v.status", "v.publication_allowed")
    return rights.plan_editions(e, rights.Policy()).select("work_id", "edition_id", "rank")


@query("F33_embedded_notice")
def embedded_notice(spark, d):
    return docs(spark, d).select("doc_id", rights.embedded_notice(F.encode("text", "UTF-8")).alias("notice"))


@query("F36_compact_error", r"SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 299) || '…' ELSE t END AS message FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\s\p{Z}\x{FEFF}]+', ' ', 'g')) AS t FROM documents)")
def compact_error(spark, d):
    return docs(spark, d).select("doc_id", tx.compact_error(text()).alias("message"))


@query("F38_iso_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS iso FROM events")
def iso_format(spark, d):
    return table(spark, d, "events").select("event_id", tx.iso_format(F.col("ts")).alias("iso"))


@query("F40_content_type", "SELECT page_id, CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) " + " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in web.EXTENSIONS.items()) + " ELSE 'application/octet-stream' END AS kind FROM pages")
def content_type(spark, d):
    return table(spark, d, "pages").select("page_id", web.content_type(F.col("url")).alias("kind"))


@query("F43_math", "SELECT p_partkey AS id, round(log10(p_size + 1), 9) AS scale, round(pow(p_size / 50.0, 0.85), 9) AS radius, least(1.0, greatest(0.0, p_retailprice / 1000 - 0.95)) AS clamp FROM part")
def math(spark, d):
    f = st.figures(spark, d)
    return f.select("id", F.round(F.log10(F.col("n") + 1), 9).alias("scale"), F.round(F.pow(F.col("n") / 50.0, 0.85), 9).alias("radius"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("price") / 1000 - 0.95)).alias("clamp"))


@query("P25_markup", r"""WITH h AS (SELECT page_id, html, trim(substr(html, 1, 2000)) AS head FROM pages)
    SELECT page_id, regexp_matches(head, '(?i)^<(?:!doctype|\?xml|html)') OR len(regexp_extract_all(head, '</?[a-zA-Z][^>]*>')) >= 10 OR (regexp_matches(head, '^[\[{]') AND json_valid(html)) AS markup FROM h""")
def markup(spark, d):
    return table(spark, d, "pages").select("page_id", web.looks_like_markup(F.col("html")).alias("markup"))


@query("P26_interstitial", "SELECT page_id, regexp_matches(coalesce(html, ''), '(?i)(captcha|are you (a )?human|checking your browser|enable javascript)') AS interstitial FROM pages")
def interstitial(spark, d):
    return table(spark, d, "pages").select("page_id", web.is_interstitial(F.col("html")).alias("interstitial"))


@query("P27_index_pages")
def index_pages(spark, d):
    return table(spark, d, "pages").select("page_id", web.is_index_page(F.col("html")).alias("is_index"), web.link_count(F.col("html")).alias("n_links"))


@query("P28_wrapped_text", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x FROM documents)
    SELECT doc_id, len(x) >= 40 AND len(list_filter(x, lambda y: length(y) BETWEEN 36 AND 89 AND NOT regexp_matches(y, '[.!?:;"'')\]]$'))) > 0.4 * len(x) AS wrapped FROM l""")
def wrapped_text(spark, d):
    return docs(spark, d).select("doc_id", tx.looks_wrapped(text()).alias("wrapped"))


@query("P29_secondary_marker", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'rights') THEN 'rights' END AS marker FROM documents")
def secondary_marker(spark, d):
    found = F.filter(F.array(F.lit("license"), F.lit("rights")), lambda m: F.contains(F.lower("text"), m))
    return docs(spark, d).select("doc_id", F.get(found, F.lit(0)).alias("marker"))


def _as_records(spark, d):
    """Documents as resource records, some of them broken."""
    one = lambda x, name: F.lit(x).alias(name)
    return docs(spark, d).select(F.col("source").alias("deity"), F.col("lang").alias("tradition"), one("unknown", "gender"), one("alias", "matched_alias"), F.when(F.col("doc_id") % 11 == 0, "poem").otherwise("text_excerpt").alias("record_type"),
                                 one("work", "source_work"), one("author", "source_author"), one("corpus", "corpus"), one("primary_source", "origin"), F.col("doc_id").cast("string").alias("locator"), text().alias("excerpt"),
                                 F.when(F.col("doc_id") % 13 == 0, "ftp://x").otherwise("https://x/y").alias("url"), F.concat(F.lit("rec"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("id"),
                                 (tx.word_count(text()) + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("n_words"), F.col("doc_id"))


@query("P19_validation", r"""SELECT doc_id, CASE WHEN trim(coalesce(source, '')) = '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(lang, '')) = '' THEN 1 ELSE 0 END + CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE 0 END
    + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS n_broken FROM documents""")
def validation(spark, d):
    rows = _as_records(spark, d)
    broken = records.violations(dict(rows.drop("doc_id").dtypes))
    return rows.select("doc_id", F.size(broken).alias("n_broken"))


@query("S7_json_lines", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_lines(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


ENTITIES = (("clown", "a", ["scum"]), ("moron", "b", []), ("MIT", "c", ["Apache"]))


@query("J1_entity_matching", r"""WITH t AS (SELECT doc_id AS id, text FROM documents) SELECT id, 'clown' AS name, 'a' AS tradition FROM t WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])clown($|[^\p{L}\p{N}])') OR regexp_matches(text, '(^|[^\p{L}\p{N}])scum($|[^\p{L}\p{N}])')
    UNION ALL SELECT id, 'moron', 'b' FROM t WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])moron($|[^\p{L}\p{N}])')
    UNION ALL SELECT id, 'MIT', 'c' FROM t WHERE regexp_matches(text, '(^|[^\p{L}\p{N}])(MIT|Apache)($|[^\p{L}\p{N}])')""")
def entity_matching(spark, d):
    return records.match_entities(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), list(ENTITIES)).drop("alias")


def named_parts(spark, d):
    """A catalogue of five surfaces for each part, and one entity for each brand."""
    p, key = table(spark, d, "part"), F.col("p_partkey").cast("string")
    parts = p.select(F.concat_ws(" ", "p_brand", "p_name", key).alias("name"), F.col("p_brand").alias("tradition"),
                     F.array(F.concat_ws(" ", "p_type", key), F.concat_ws("-", "p_size", "p_type", key), F.concat(F.lit("No. "), key), F.concat_ws("/", key, "p_size")).alias("aliases"))
    return parts.union(p.select(F.col("p_brand").alias("name"), F.lit("brand").alias("tradition"), F.array().cast("array<string>").alias("aliases")).distinct())


def order_texts(spark, d):
    """What each order sells in words: parts by their names in small letters, by an alias, or by their brand alone."""
    p, key = table(spark, d, "part"), F.col("p_partkey").cast("string")
    kind = (F.col("l_partkey") + F.col("l_orderkey")) % 3
    word = F.when(kind == 0, F.lower(F.concat_ws(" ", "p_brand", "p_name", key))).when(kind == 1, F.concat_ws(" ", "p_type", key)).otherwise(F.col("p_brand"))
    said = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", word.alias("word"))
    return said.groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("Sold: "), F.array_join(F.sort_array(F.collect_list("word")), "; "), F.lit(".")).alias("text"))


@query("J1_catalogue_matching", """SELECT DISTINCT l_orderkey AS id, CASE WHEN (l_partkey + l_orderkey) % 3 = 2 THEN p_brand ELSE p_brand || ' ' || p_name || ' ' || p_partkey END AS name,
    CASE WHEN (l_partkey + l_orderkey) % 3 = 2 THEN 'brand' ELSE p_brand END AS tradition FROM lineitem JOIN part ON l_partkey = p_partkey""")
def catalogue_matching(spark, d):
    """A catalogue table of thousands of names: the longest name wins over the brand that it begins with."""
    return records.match_entities(order_texts(spark, d), named_parts(spark, d)).drop("alias")


@query("A23_corpus_verify", "SELECT count(*) FILTER (doc_id % 10 <> 0) AS ok, count(*) FILTER (doc_id % 10 = 0) AS changed, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unlisted FROM documents")
def corpus_verify(spark, d):
    files = docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    manifest = docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 10 == 0, "0").otherwise(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha256"))
    return records.verify_corpus(files, manifest)


@query("A26_catalog_merge", """SELECT lower(p_name) AS name, count(*) AS n_aliases FROM (SELECT DISTINCT p_name, p_brand, p_type FROM part) GROUP BY lower(p_name), p_brand""")
def catalog_merge(spark, d):
    e = st.figures(spark, d).select("name", "tradition", F.lit(None).cast("string").alias("gender"), F.array("kind").alias("aliases"), F.col("id").alias("pos"))
    return records.merge_catalogs(e).select(F.lower("name").alias("name"), F.size("aliases").cast("long").alias("n_aliases"))


@query("A24_library_groups", "SELECT lang, source, count(*) AS n, min(n_chars) AS shortest FROM documents GROUP BY ALL ORDER BY lang, source")
def library_groups(spark, d):
    return docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest")).orderBy("lang", "source")
