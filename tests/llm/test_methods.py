"""The training-data operators against second, plain versions, and under damage and very long texts."""

import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from test_operators import DOCS, SMALL, brute_measures, brute_secrets, listed, prose
from traitloom.llm import decontaminate, langid, licenses, linededup, minhash, quality, queries, secrets, simhash, tokencounts, warc


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_language_against_plain_compression(spark):
    docs = documents(spark)
    order = lambda i: xxhash.xxh64_intdigest(str(i), 42) - (1 << 64) * (xxhash.xxh64_intdigest(str(i), 42) >> 63)
    known = defaultdict(list)
    for i, r in docs.items():
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known[r["lang"]].append((order(i), r["text"]))
    compress = {}
    for lang, own in known.items():
        own = sorted(own)[: langid.SAMPLE_DOCS]
        middle = lambda t: t[max(1, int((len(t) - langid.SAMPLE_CHARS) / 2 + 1)) - 1 :][: langid.SAMPLE_CHARS]
        share = langid.DICTIONARY_BYTES // len(own) - 1
        data = b"".join(middle(t).lower().encode()[:share] + b"\n" for _, t in own)
        compress[lang] = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                                  write_checksum=False, write_content_size=False, write_dict_id=False)
    for r in queries.op7_language(spark, SMALL).collect():
        text = docs[r["doc_id"]]["text"]
        if not re.search(r"[^\W\d_]", text or ""):
            assert r["lang_pred"] == "und"
            continue
        data = text.lower().encode()
        sizes = sorted((sum(len(c.compress(data[i : i + langid.BLOCK_BYTES])) for i in range(0, len(data), langid.BLOCK_BYTES)), lang) for lang, c in compress.items())
        assert r["lang_pred"] == sizes[0][1] and r["score"] == pytest.approx((sizes[1][0] - sizes[0][0]) / sizes[1][0])


def test_language_sample_is_cut_evenly(spark):
    rows = [(i, "中文字" * 200 if i % 2 else prose(i, 90), "zh" if i % 2 else "en", "s", 1) for i in range(3000)]
    content = langid.train(spark.createDataFrame(rows, DOCS))
    assert set(content) == {"zh", "en"} and all(len(v) <= langid.DICTIONARY_BYTES and v.count(b"\n") == langid.SAMPLE_DOCS for v in content.values())


def test_secret_spans_against_plain_python(spark):
    r = random.Random(8)
    rows = [(i, d["text"]) for i, d in documents(spark).items()]
    rows += [(10**6 + i, " ".join(r.choice((prose(i + k, 3), f"token={'%016x' % r.getrandbits(64)}", "".join(r.choices("abcXYZ012789", k=r.randrange(10, 40))), "x" * 20 + f" secret: {'%x' % r.getrandbits(90)}-tail" * 2)) for k in range(12))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.train(secrets.scan(docs, "doc_id", "text"), docs, "doc_id", "text")
    code = lambda c: secrets.ALPHABET.find(c) + 1
    got, added = {x["doc_id"]: x["spans"] for x in secrets.find_secrets(docs).collect()}, 0
    for i, text in rows:
        base = brute_secrets(text or "")
        found = []
        for m in re.finditer(secrets.CANDIDATE, text or ""):
            bits = [model[code(a) * secrets.STATES + code(b)] for a, b in zip(m.group(), m.group()[1:], strict=False)]
            if not any(a < m.end() and m.start() < b for a, _, b in base) and sum(bits) / len(bits) >= secrets.LEAST_BITS:
                found.append((m.start(), 3, m.end()))
        added += len(found)
        assert got[i] == listed(sorted(base + found)), text
    assert added > 20


def test_secrets_in_a_very_long_text(spark):
    r = random.Random(1)
    text = " ".join("%032x" % r.getrandbits(128) if i % 2 else f"password = abcdef{i}" for i in range(40_000))
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_hex"], row["n_assign"]) == (20_000, 20_000) and row["spans"] == listed(brute_secrets(text))


def test_quality_verdicts_against_plain_python(spark):
    docs, rows = documents(spark), {r["doc_id"]: r for r in quality.judge(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    votes = {}
    for i, d in docs.items():
        text, w = d["text"] or "", re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat = brute_measures(text)
        n_lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        assert (rows[i]["n_lines"], rows[i]["n_distinct_words"], rows[i]["n_capitals"], rows[i]["n_shouts"]) == (n_lines, len(set(w)), len(re.findall("[A-Z]", text)), text.count("!"))
        plain, bad = rows[i]["n_plain"], lambda x: -1 if x else 0
        votes[i] = (-1 if 10 * plain < 7 * n_words else 1 if 10 * plain >= 8 * n_words else 0, bad(10 * n_symbols > 2 * n_words), bad(10 * rows[i]["n_capitals"] > 5 * word_chars),
                    bad(10 * text.count("!") > 2 * n_words), bad(10 * n_repeat > 2 * n_words), bad(10 * n_dup_lines > 3 * n_lines),
                    bad(word_chars < 2 * n_words or word_chars > 15 * n_words), bad(n_words >= 50 and 10 * len(set(w)) < n_words))
    counted, good, right = Counter(votes.values()), 0.9, [0.9] * len(quality.RULES)

    def posterior(v):
        g, b = good, 1 - good
        for x, p in zip(v, right, strict=True):
            g, b = g * (p if x == 1 else 1 - p if x == -1 else 1), b * (p if x == -1 else 1 - p if x == 1 else 1)
        return g / (g + b)

    for _ in range(quality.ITERATIONS):
        post = {v: posterior(v) for v in counted}
        good = (sum(n * post[v] for v, n in counted.items()) + 1) / (len(votes) + 2)
        right = [min(0.99, max(0.55, (sum(n * (post[v] if v[i] == 1 else 1 - post[v]) for v, n in counted.items() if v[i]) + 1) / (sum(n for v, n in counted.items() if v[i]) + 2))) for i in range(len(right))]
    for i, v in votes.items():
        assert rows[i]["quality"] == pytest.approx(posterior(v)) and rows[i]["kept"] == (not rows[i]["base_failed"] and posterior(v) >= quality.KEEP_FROM)


def test_licence_labels_and_shares_against_plain_python(spark):
    r, docs = random.Random(3), [(i, d["text"]) for i, d in documents(spark).items()]
    for i in range(120):
        t = r.choice(licenses.TEMPLATES)
        w = t.text.split()
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = r.choice(WORDS_OF_NOTICES)
        docs.append((10**6 + i, f"{prose(i, 8)} {' '.join(w)} {prose(i + 1, 6)}"))
    rows = {x["doc_id"]: x for x in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    cut = {i: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for i, t in docs}
    held = Counter(w for own in cut.values() for w in set(own))
    idf = {w: math.log(1 + (len(docs) - held[w] + 0.5) / (held[w] + 0.5)) for w in licenses.vocabulary(licenses.TEMPLATES)}
    for i, own in cut.items():
        line, accepted = f" {' '.join(own)} ", {}
        for t in licenses.TEMPLATES:
            w = t.text.split()
            if all(f" {k} " in line for k in t.keys):
                share = max(sum(idf[x] for p, x in enumerate(w) if 0 <= d + p < len(own) and own[d + p] == x) for d in range(-len(w), len(own))) / sum(idf[x] for x in w)
                if share >= licenses.LEAST_SHARE:
                    accepted[t.label] = max(share, accepted.get(t.label, 0))
        labels = set(filter(None, rows[i]["labels"].split(","))) - set(filter(None, rows[i]["base_labels"].split(",")))
        assert labels == set(accepted) - set(rows[i]["base_labels"].split(",")), i
        assert rows[i]["score"] == pytest.approx(1.0 if rows[i]["n_base"] else min(1.0, max(accepted.values(), default=0.0)))


WORDS_OF_NOTICES = licenses.vocabulary(licenses.TEMPLATES) + ["alpha", "beta"]


def test_licence_templates_from_a_table(spark):
    table = spark.createDataFrame([("own-1.0", "The Own License: you may use, copy and sell " + prose(5, 300), ["Own License"]), ("none", None, ["x"]), ("none", "text", []), ("none", "...", ["x"])], "label string, text string, keys array<string>")
    templates = licenses.read_templates(table)
    assert [t.label for t in templates] == ["own-1.0"]
    docs = spark.createDataFrame([(1, f"{prose(9, 50)} the own license you may use copy and sell {prose(5, 300)}"), (2, "the own license")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs, templates=templates).collect()} == {1: "own-1.0", 2: ""}
    assert licenses.scan_licenses(docs, templates=()).count() == 2


def test_overlaps_against_plain_python(spark):
    docs, items = documents(spark), {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    parts = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", *[c.alias(n) for n, c in zip("qa", decontaminate.split_item(F.col("text")), strict=True)]).collect()
    for p in parts:
        plain = [x for x in re.split(r"\n+|(?<=[.?!])\s+", items[p["item_id"]].strip()) if x.strip()]
        assert (p["q"], p["a"]) == ((" ".join(plain[:-1]), plain[-1]) if len(plain) > 1 else (items[p["item_id"]], ""))
    split = {p["item_id"]: (decontaminate.words_of(p["q"]), decontaminate.words_of(p["a"])) for p in parts}
    longest = max(len(q) + len(a) for q, a in split.values())
    half, seen = max(decontaminate.HALF_PASSAGE, longest), 0
    for r in queries.op5_decontamination(spark, SMALL).collect():
        passage = decontaminate.words_of(docs[r["doc_id"]]["text"])[r["start"] : r["start"] + 2 * half]
        grams = {tuple(passage[i : i + 5]) for i in range(len(passage) - 4)}
        for own, got in zip(split[r["item_id"]], (r["question_overlap"], r["answer_overlap"]), strict=True):
            wanted = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            assert got == pytest.approx(len(wanted & grams) / len(wanted) if len(own) >= 5 else 1.0)
            seen += 1
    assert seen


def test_second_batch_of_edits_encodes_only_its_regions(spark):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count = tokencounts.encoder(*args)
    rows = [(i, prose(i, 4000)) for i in range(4)] + [(None, "one two"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("edits", F.lit("a column of that name"))
    counted, texts = tokencounts.count_leaves(docs, *args), {i: t or "" for i, t in rows}
    for batch, (start, end, new) in enumerate([(9000, 9003, "changed"), (0, 1200, " gone "), (15000, 15000, prose(50, 900)), (40, 41, "")]):
        edits = spark.createDataFrame([(i, 1, start, end, new) for i in (0, 2, None)], "doc_id long, seq long, start long, end long, replacement string")
        changed = tokencounts.apply_edits(tokencounts.gather_edits(counted, edits), *args, changed_only=True)
        assert {r["doc_id"] for r in changed.collect()} == {0, 2, None}
        counted = tokencounts.apply_edits(tokencounts.gather_edits(counted, edits), *args)
        for i in (0, 2, None):
            t = texts[i]
            texts[i] = t[:start] + new + t[end:] if start <= len(t) else t + new
        got = {r["doc_id"]: r for r in counted.collect()}
        for i, t in texts.items():
            assert (got[i]["text"], got[i]["n_tokens"]) == (t, count(t)) and sum(x["chars"] for x in got[i]["leaves"]) == len(t)
            assert got[i]["encoded_chars"] <= len(new) + (end - start) + 4 * 4 * tokencounts.LEAF_CHARS if i in (0, 2, None) else got[i]["encoded_chars"] == 0, batch
        counted = spark.createDataFrame(list(got.values()), counted.schema).drop("encoded_chars")


def test_archives_with_damage_are_read_on(spark, tmp_path):
    rows = [(i, f"http://h/{i}", prose(i, 300)) for i in range(40)]
    planned = warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    archives = warc.write_archives(planned, f"file://{tmp_path}/a").collect()
    path = archives[0]["archive"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    starts = [m.start() for m in re.finditer(re.escape(warc.MAGIC), bytes(data))]
    data[starts[7] + 40 : starts[7] + 60] = os.urandom(20)
    open(path, "wb").write(data)
    read = warc.read_archives(spark.createDataFrame([(archives[0]["archive"],)], "archive string")).collect()
    good = [r for r in read if r["error"] is None]
    assert len(good) == 39 and len(read) == 40 and [r["position"] for r in read if r["error"]] == [starts[7]]


def test_archive_digests_are_those_of_what_was_read(spark, tmp_path):
    import gzip

    page = {"id": 1, "url": "http://x/", "payload": "hello" * 90, "digest": xxhash.xxh128_hexdigest(b"") * 2, "refers_to": None}
    plain = gzip.decompress(warc._record(page, "2024-01-01T00:00:00Z")).replace(b"hellohello", b"jellohello", 1)
    (tmp_path / "a.gz").write_bytes(gzip.compress(plain))
    row = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.gz",)], "archive string")).first()
    import hashlib

    assert row["error"] == "block digest" and row["payload_digest"] == hashlib.sha256(("jello" + "hello" * 89).encode()).hexdigest()


def test_archives_of_text_ids_clashing_columns_and_a_very_long_page(spark):
    long = prose(1, 200_000)
    pages = spark.createDataFrame([("a:b c", "u", long), ("é/1", None, long), (None, "u", "")], "page_id string, url string, html string")
    for name in ("digest", "first", "id", "payload", "n", "other"):
        pages = pages.withColumn(name, F.lit(3))
    rows = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert set(rows) == {"a:b c", "é/1", None} and rows["é/1"]["refers_to"] == "a:b c" and rows["a:b c"]["payload_bytes"] == len(long)


def test_kept_rows_do_not_depend_on_the_order_of_the_input(spark):
    text = prose(1, 80)
    rows = [(1, text, "en", "A", 1), (1, text, "en", "B", 1)]
    for drop in (simhash.drop_near_duplicates, minhash.drop_similar):
        kept = {drop(spark.createDataFrame(own, DOCS).coalesce(1)).first()["source"] for own in (rows, rows[::-1])}
        assert len(kept) == 1


def test_segments_follow_the_number_of_fingerprints(spark):
    assert [simhash.segments_for(10**k, 4) for k in (5, 7, 9)] == [3, 3, 2]
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    values = sorted({(b ^ sum(1 << x for x in r.sample(range(64), k))) - (1 << 63) for b in base for k in range(6)})
    links = {(x["a"], x["b"]) for x in simhash.hamming_links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, 2).collect()}
    assert links == {(a, b) for a in values for b in values if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 4}


def test_a_crowded_group_of_near_copies_is_one_component(spark):
    r, base, rows = random.Random(5), prose(77, 120).split(), []
    for i in range(400):
        own = list(base)
        for at in r.sample(range(120), 3):
            own[at] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, prose(i, 90)) for i in range(20)]
    kept = {x["doc_id"] for x in minhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in grams}
    find = lambda i: i if label[i] == i else find(label[i])
    for a in grams:
        for b in grams:
            if a < b and find(a) != find(b) and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b]):
                label[max(find(a), find(b))] = min(find(a), find(b))
    prints = {find(i) for i in grams}
    assert kept <= prints and 0 in kept and {1000 + i for i in range(20)} <= kept and len(kept) >= 21


def test_line_dedup_of_crowded_windows_and_text_ids(spark, monkeypatch):
    monkeypatch.setattr(linededup, "CROWD", 3)
    monkeypatch.setattr(linededup, "CROWD_SHARE", 10**9)
    passage = prose(1, 70)
    rows = [(f"d{i:03d}", f"{prose(100 + i, 30)} {passage} {prose(300 + i, 30)}") for i in range(40)]
    got = {r["row"]["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()}
    assert got["d000"]["removed_words"] == 0 and all(got[i]["removed_words"] == 70 and passage not in got[i]["clean"] for i, _ in rows[1:])


def test_line_dedup_by_sieves_as_by_keys(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lambda: {(r["row"]["doc_id"], r["clean"], r["removed_words"]) for r in linededup.dedup_lines(docs).collect()}
    by_keys = rows()
    monkeypatch.setattr(linededup, "MOST_KEYS", 0)
    assert rows() == by_keys


def test_word_hashes_of_long_words_and_pieces():
    r = random.Random(1)
    words = ["".join(r.choices("abcé", k=k)) for k in (1, 3, 70, 1000, linededup.GROUP_BYTES // 2, 2 * linededup.GROUP_BYTES + 9, 5, 8)] * 2
    found = linededup.Words(" ".join(words).encode())
    half = len(words) // 2
    assert len(found.hashes) == len(words) and (found.hashes[:half] == found.hashes[half:]).all() and len(set(found.hashes.tolist())) == half and found.starts[0] == 0
    again = linededup.Words(" \n".join([*words[:3], *words]).encode())
    assert (again.hashes[:3] == found.hashes[:3]).all() and (again.hashes[3:] == found.hashes).all()


def test_texts_together_are_cut_as_each_alone():
    r = random.Random(4)
    for _ in range(200):
        texts = ["".join(r.choices("ab.!? \n\té  .\n", k=r.randrange(120))).encode() for _ in range(5)]
        group = linededup.Texts(texts)
        for i, text in enumerate(texts):
            ends = [m.end() for m in re.finditer(rb"[.!?][ \t]+|\n", text)]
            units = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if b > a]
            alone = linededup.line_chunks(text)
            assert [u for own, _ in alone for u in own] == units and [h for _, held in alone for h in held] == [u.strip() for u in units if u.strip()]
            assert [held for _, held in alone if held] == [group.held(k) for k in range(group.chunk_bounds[i], group.chunk_bounds[i + 1])]
    long = "\n".join(f"{prose(k, 9)}. {prose(k + 1, 12)}!" for k in range(6000)).encode()
    assert b"".join(u for own, _ in linededup.line_chunks(long) for u in own) == long


def test_line_dedup_of_words_whose_sums_are_equal(spark):
    """Two different words of 2048 letters that every sum of powers modulo 2^64 takes for one: neither they nor what is around them goes."""
    turns = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[t ^ k] for t in turns) for k in (0, 1))
    assert one != two and len(set(linededup.Words(f"{one} {two}".encode()).hashes.tolist())) == 1
    around = prose(41, 60)
    half = around.split()
    texts = [" ".join([*half[:30], one, *half[30:]]), " ".join([*half[:30], two, *half[30:]]), f"First here.\n{one} is one. Then comes more and more of it.\n{prose(42, 30)}", f"Second here.\n{two} is one. Then comes more and more of it.\n{prose(42, 30)}"]
    got = {r["row"]["doc_id"]: r["clean"] for r in linededup.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)).collect()}
    assert got[0] == texts[0] and got[2] == texts[2] and two in got[1] and two in got[3]


def test_a_long_item_changes_no_hit_of_a_short_one(spark):
    """The answer far from its question is no hit, whatever other items there are; the long item is found where it stands."""
    question, answer, long = prose(51, 20), "zanzibar", prose(52, 5000)
    docs = spark.createDataFrame([(1, f"{question} {prose(53, 3000)} {answer}", "en", "s", 1), (2, f"{prose(54, 500)} {question} {answer}", "en", "s", 1), (3, f"{prose(55, 100)} {long} {prose(56, 100)}", "en", "s", 1)], DOCS)
    short = spark.createDataFrame([(1, f"{question}\n{answer}")], "item_id long, text string")
    both = short.union(spark.createDataFrame([(2, f"{long}\n{prose(52, 5000).split()[-1]}")], short.schema))
    found = lambda items: {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found(short) == {(2, 1)} and found(both) == {(2, 1), (3, 2)}
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, both).collect()} == {1}
    assert [decontaminate.half_passage(n) for n in (1, 64, 65, 128, 5001)] == [64, 64, 128, 128, 8192]


def test_secrets_in_a_dense_string_of_a_megabyte(spark):
    """One string without a gap is scored in time proportional to its length."""
    r = random.Random(2)
    dense = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    docs = spark.createDataFrame([(1, dense), (2, f"token={'%032x' % r.getrandbits(128)}{'Q7z' * 9}"), (3, "some plain words stand here")], "doc_id long, text string")
    secrets.find_secrets(docs.where("doc_id > 1")).collect()
    began = time.time()
    got = {x["doc_id"]: x["spans"] for x in secrets.find_secrets(docs).collect()}
    assert got[1] in ("", "random:0:1000000") and time.time() - began < 30
    value = spark.createDataFrame([(dense,)], "value string").select(secrets.mean_bits(F.col("value"), [1.0] * secrets.STATES**2)).cache()
    began = time.time()
    assert value.first()[0] == pytest.approx(1.0) and time.time() - began < 10


def test_word_and_run_hashes_tell_bytes_apart():
    """Words of all lengths around eight bytes and the longest short one, and runs that differ in one word or in order."""
    words = [b"a" * n + b"b" * m for n in range(70) for m in range(12) if n + m] + ["é☃".encode(), b"\x00", b"\x00\x00", b"\x00a"]
    words = list(dict.fromkeys(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    prints = linededup.word_prints(b" ".join(words), ends - [len(w) for w in words], ends)
    again = linededup.word_prints(b"xx " + b" ".join(words), ends - [len(w) for w in words] + 3, ends + 3)
    assert len(set(prints.tolist())) == len(words) and np.array_equal(prints, again)
    r = np.random.default_rng(1)
    line = r.choice(prints, 400)
    runs = linededup.mixed_runs(line, 50)
    assert len(runs) == 351 and len(set(runs.tolist())) == 351
    assert linededup.mixed_runs(line[7:57], 50)[0] == runs[7] and linededup.mixed_runs(line[7:57][::-1], 50)[0] != runs[7] and len(linededup.mixed_runs(line[:49], 50)) == 0
    turns = np.array([bin(i).count("1") % 2 for i in range(2048)])
    one, two = (linededup.mixed_runs(prints[(turns ^ k) + 5], 2048)[0] for k in (0, 1))
    assert one != two


@pytest.mark.parametrize("block_bytes", [1 << 22, 5000])
def test_a_thousand_whole_licence_texts(spark, block_bytes):
    """1000 templates of 300 words, many of which share their words: planned in seconds, labels as by counting at every place."""
    r = random.Random(17)
    pool = [f"w{k}" for k in range(400)] + [f"rare{k}" for k in range(3000)]
    made = lambda n: " ".join(r.choice(pool) for _ in range(n))
    n = 1000 if block_bytes > 10_000 else 60
    templates = [licenses.Template(f"l{k}", made(300), ()) for k in range(n)]
    templates = tuple(licenses.Template(t.label, t.text, (" ".join(t.text.split()[3:6]),)) for t in templates)
    docs = []
    for i in range(40):
        w = r.choice(templates).text.split()
        for _ in range(r.choice([0, 20, 90, 200])):
            w[r.randrange(len(w))] = r.choice(pool)
        docs.append((i, f"{made(r.randrange(50))} {' '.join(w[r.choice([0, 0, 8, 160]):])} {made(30)}"))
    began = time.time()
    got = {x["doc_id"]: (x["labels"], x["score"]) for x in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates=templates, block_bytes=block_bytes).collect()}
    assert time.time() - began < 60
    cut = {i: t.split() for i, t in docs}
    held = Counter(w for own in cut.values() for w in set(own))
    idf = {w: math.log(1 + (len(docs) - held[w] + 0.5) / (held[w] + 0.5)) for w in licenses.vocabulary(templates)}
    for i, own in cut.items():
        places, line, accepted = defaultdict(list), f" {' '.join(own)} ", {}
        for at, w in enumerate(own):
            places[w].append(at)
        for t in templates:
            if f" {t.keys[0]} " in line:
                agree = Counter()
                for p, w in enumerate(t.text.split()):
                    for at in places.get(w, ()):
                        agree[at - p] += idf[w]
                share = max(agree.values(), default=0) / sum(idf[w] for w in t.text.split())
                if share >= licenses.LEAST_SHARE:
                    accepted[t.label] = share
        assert got[i][0] == ",".join(sorted(accepted)) and got[i][1] == pytest.approx(min(1.0, max(accepted.values(), default=0.0)))
    assert sum(bool(x) for x, _ in got.values()) > 10


def test_units_of_a_chunk_are_cut_once():
    """A chunk's units are asked for by itself and by its neighbours."""
    from traitloom.llm import linededup

    cut = linededup.Texts([b"one two three four five six seven eight nine.\n" * 6])
    assert cut.held(0) is cut.held(0) and cut.unit_hashes(0) is cut.unit_hashes(0)


def test_line_dedup_reads_many_texts_together():
    from traitloom.llm import linededup

    r = random.Random(3)
    texts = [" ".join(r.choices("abcdefg", k=k)).encode() for k in (0, 60, 49, 50, 200)] + [b"a b " * 70, b"one two three. \t four five\nsix!  seven? eight " * 20]
    cut = linededup.Texts(texts)
    which = [1, 3, 4, 5, 6]
    for i, listed in zip(which, linededup.listed_windows(cut, which), strict=True):
        words = texts[i].split()
        assert listed.tolist() == [k for k, _ in linededup.distinct_windows([(k, b" ".join(words[k : k + 50])) for k in range(len(words) - 49)])]
    alone = linededup.Texts(texts)
    cut.take(np.array([0, len(cut.heads) - 1]))
    assert len(cut._held) >= 3
    assert all(cut.held(k) == alone.held(k) and cut.unit_hashes(k) == alone.unit_hashes(k) for k in range(len(cut.heads)))
    # Names are least hashes, yet no part is crowded; a sieve by parts holds all that it was made from.
    names = np.random.default_rng(1).integers(0, 1 << 63, (4000, 26), np.int64).min(axis=1)
    assert np.bincount(linededup._parts(names, 8), minlength=8).max() < 700
    values, counts = linededup._longs(linededup._long_lists(names, np.array([0, 1000, 3000])).slice(1))
    assert values.tolist() == names.tolist() and counts.tolist() == [1000, 3000]
    told = linededup._merged(np.array([5, 7, 5]), np.ones(3, np.int64), np.array([3, 3, 1]), np.array([3, 3, 1]))
    assert sorted(zip(*(x.tolist() for x in told), strict=True)) == [(5, 2, 1, 3), (7, 1, 3, 3)]
