"""The registered queries of the training-data operations, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm import conversations, decontaminate, fillmiddle, langid, licenses, linededup, packing, preference, quality, secrets, simhash, tokencounts, warc
from traitloom.llm.shared import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles and components at four or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, max_distance=4)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of every text, and the verdict of the weakly supervised model."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token count, and the count after edits that mask personal data."""
    return tokencounts.recount(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item found in a document, with its best passage and overlaps."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without passages that stand elsewhere before, and what went."""
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("row.doc_id", F.col("clean").alias("text"), "removed_units", "removed_words")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by compression; rows of remainder 2 are kept from training."""
    docs = table(spark, sf_dir, "documents")
    predicted = langid.identify(docs, langid.train(docs))
    return predicted.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every text by pattern and by character model."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold when they are read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every text."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text by a ranking learned from labels; rows of remainder 0 are kept from training."""
    docs = table(spark, sf_dir, "documents")
    ranked = preference.rank(docs, preference.train(docs, table(spark, sf_dir, "labels")))
    return ranked.select("doc_id", preference.held_out("doc_id").alias("held_out"), "score", "predicted")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by their ids and repaired by the cheapest edits."""
    turns = conversations.damaged(table(spark, sf_dir, "conversations"))
    found = conversations.whole_digests(conversations.repair(turns, copies=F.col("copies")))
    return found.withColumnRenamed("conv", "conv_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at two line ends with its middle last, and the text rebuilt from that."""
    made = fillmiddle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fillmiddle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures alone, which SQL can express."""
    found = quality.measured(table(spark, sf_dir, "documents"), F.col("text"), {"doc_id": F.col("doc_id")})
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the fixed patterns alone, which SQL can express."""
    found = secrets.scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"))


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base phrases alone, which SQL can express."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), templates=())
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {
    "base_quality": base_quality,
    "base_secrets": base_secrets,
    "base_licenses": base_licenses,
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_language": op7_language,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_licenses": op10_licenses,
    "op11_preference": op11_preference,
    "op12_conversations": op12_conversations,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL with the same rows, for the queries that SQL can express.
ORACLE_SQL = {
    "base_quality": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
        ), s AS (
            SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8
        ), g AS (
            SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 7], ' ')) > 1
        ), c AS (
            SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM g) GROUP BY doc_id
        ), m AS (
            SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM t LEFT JOIN c USING (doc_id)
        )
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m""",
    "base_secrets": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
               CAST(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
               CAST(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM t""",
    "base_licenses": r"""
        WITH t AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
        ), p AS (
            SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS b,
                   list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS c FROM t
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(a) + len(b) + len(c) AS BIGINT) AS n_base, list_min(list_concat(a, b, c)) - 1 AS first_word, list_max(list_concat(a, b, c)) - 1 AS last_word,
               array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p""",
    "op9_warc": """
        WITH q AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM q LEFT JOIN f USING (payload_digest)""",
    "op12_conversations": r"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t
        ), k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT))),
                       lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 AS code FROM conversations, crc
        ), d AS (
            SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k
        ), o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM d
        ), r AS (
            SELECT *, substr(role, 1, 1) AS own, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o
        ), c AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND before || own NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1
        ), i AS (  -- up to two inserts after a last role: what they cost, their audit, their lines, the role after them
            SELECT * FROM (VALUES ('', 0, '', '', ''), ('', 5, 'I', 'user:' || chr(10), 'u'), ('', 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 'a'), ('s', 0, '', '', 's'), ('s', 5, 'I', 'user:' || chr(10), 'u'),
                ('s', 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 'a'), ('u', 0, '', '', 'u'), ('u', 5, 'I', 'assistant:' || chr(10), 'a'), ('u', 10, 'II', 'assistant:' || chr(10) || 'user:' || chr(10), 'u'),
                ('a', 0, '', '', 'a'), ('a', 5, 'I', 'user:' || chr(10), 'u'), ('a', 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 'a')) x(last, extra, letters, lines, after)
        ), e AS (  -- the edits of each row: its role in the end, its price, letter and line
            SELECT conv_id, pos, NULL AS becomes, 2 AS price, 'D' AS letter, '' AS line FROM r
            UNION ALL SELECT conv_id, pos, own, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', role || ':' || text || chr(10) FROM r WHERE fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT conv_id, pos, substr(x, 1, 1), CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', x || ':' || text || chr(10) FROM r, (VALUES ('user'), ('assistant')) v(x) WHERE fault NOT IN ('blank', 'duplicate')
        ), s AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS pos, '' AS last, 0 AS cost, '' AS audit, '' AS repaired FROM c
            UNION ALL
            SELECT conv_id, pos, last, cost, audit, repaired FROM (
                SELECT s.conv_id, e.pos, coalesce(becomes, after) AS last, cost + extra + price AS cost, audit || letters || letter AS audit, repaired || lines || line AS repaired
                FROM s JOIN i USING (last) JOIN e ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND e.pos = s.pos + 1
                WHERE becomes IS NULL OR after || becomes IN ('s', 'u', 'su', 'ua', 'au'))
            QUALIFY row_number() OVER (PARTITION BY conv_id, last ORDER BY cost, audit) = 1
        ), f AS (
            SELECT s.conv_id, cost + extra AS cost, audit || letters AS audit, repaired || lines AS repaired FROM s JOIN i USING (last) JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND pos = n WHERE after = 'a' OR (after = '' AND letters = '')
            QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY cost + extra, audit || letters) = 1
        )
        SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(regexp_replace(coalesce(repaired, ''), '\n\z', '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id""",
    "op13_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
        ), h AS (
            SELECT doc_id, text, l, len(l) AS n, CAST('0x' || d[1:8] AS BIGINT) % (len(l) + 1) AS a, CAST('0x' || d[9:16] AS BIGINT) % (len(l) + 1) AS b, CAST('0x' || d[25:32] AS BIGINT) % 100 AS o FROM t
        ), c AS (
            SELECT doc_id, text, n, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN o < 50 THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(l[1 : least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1 :], '') AS s FROM h
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM c""",
}
