"""Column functions and decisions on written cases."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.functions import text as tx
from traitloom.functions import tokens as tk
from traitloom.functions import web
from traitloom.operators import concepts, graph, lattice, ledger, ranking, rights, taxonomy
from traitloom.operators import traits as tr
from traitloom.sources import records, store
from traitloom.streaming import ledger as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


VOCABULARY = tk.Vocabulary(stop=("troy",), stop_patterns=(r"\bking of\b",), synonyms={"serpent": "snake", "cow": "bull"}, supersets={"animals": {"bull": "Mammals", "snake": "Reptiles"}})


@pytest.mark.parametrize(("text", "want"), [
    (None, []), ("", []), ("Serpent, snakes;COW, troy", ["snake", "bull"]), ("god of Trees, the sea, King of X, a", ["tree", "sea"]),
    ("glass, virus, axis, chaos, bus, gods", ["glass", "virus", "axis", "chaos", "bus", "god"]), ("x" * 60 + ", ok", ["ok"]), ("the x, cow, cow", ["the x", "bull"])])
def test_tokenize(spark, text, want):
    assert one(spark, tk.tokenize(F.lit(text).cast("string"), VOCABULARY)) == want


def test_cells_and_arrays(spark):
    assert one(spark, tk.raw_tokens(F.lit(" a;b,, c "))) == ["a", "b", "c"]
    assert one(spark, tk.strip_the(F.lit("the sea, the Sun"))) == "sea, the Sun"
    assert one(spark, tk.strip_tokens(F.lit("Red, blue, old"), ["red"])) == "blue, old"
    assert one(spark, tk.remap_array(F.array(F.lit("a"), F.lit("b"), F.lit("c")), {"a": "c", "b": ""})) == ["c"]
    assert one(spark, tk.remap_value(F.lit("xy"), ["q"], {"z": ["k"]}, [("^x", ["m", "n"])])) == ["m", "n"]
    assert one(spark, tk.merge_trait(F.lit("a, B, c"), ["a", "b"], "z")) == "z, c"
    assert one(spark, tk.union_normalized(F.array(F.lit("A-b")), F.array(F.lit("ab"), F.lit("c")))) == ["A-b", "c"]


def test_texts(spark):
    assert one(spark, tx.normalize_space(F.lit("é  x﻿"))) == "é x"
    assert one(spark, tx.slug(F.lit("  Ça va — bien! "))) == "ca-va-bien" and one(spark, tx.slug(F.lit("中"))) == "unknown"
    assert one(spark, tx.strip_parens(F.lit("a (b (c)) d"))) == "a d"
    assert one(spark, tx.title_key(F.lit("The Ⅳ—Book!"))) == "the iv book"
    words = " ".join(map(str, range(500)))
    chunks = one(spark, tx.chunk_text(F.lit(f"{words}\n\nshort one")))
    assert [len(c.split()) for c in chunks] == [260, 260, 50, 2] and chunks[1].split()[0] == "225"
    assert one(spark, tx.script_language(F.lit("かな漢"))) == "ja" and one(spark, tx.script_language(F.lit("漢"))) == "zh" and one(spark, tx.script_language(F.lit("abc"))) is None
    page = "\n".join(["HEAD"] * 5 + ["12", "a hyphen-", "ated line", "goes on.", "", "Next."])
    assert one(spark, tx.cleanup_transcription(F.lit(page))) == "a hyphenated line goes on.\n\nNext."
    assert one(spark, tx.transliterate(F.lit("Æsir øð"))).lower().endswith("sir od")


def test_web(spark):
    html = "<!doctype html><title>A &amp; B</title><nav><a href='/n'>n</a></nav><p>Some <a href='/x'>x</a> <a href=\"http://o.org/\">o</a> <a href='y'>y</a></p>"
    assert one(spark, web.html_title(F.lit(html))) == "A & B"
    assert one(spark, web.content_links(F.lit(html), F.lit("http://h.org/p"))) == ["http://h.org/x", "http://h.org/y"]
    assert one(spark, web.strip_html(F.lit("&lt;b&gt;x&lt;/b&gt; y"))) == "x y"
    assert one(spark, web.looks_like_markup(F.lit(html))) and not one(spark, web.looks_like_markup(F.lit("plain")))
    assert one(spark, web.clean_wikitext(F.lit("'''A''' {{x|{{y}}}}[[b|c]]<ref>r</ref> [[d]]"))) == "A c d"
    allowed = lambda u: one(spark, web.url_allowed(F.lit(u), ["a.org"], ["/ok"]))
    assert allowed("https://x.a.org/ok/1") and not allowed("http://a.org/ok") and not allowed("https://ba.org/ok") and not allowed("::bad")


RIGHTS = [
    ("creative commons https://creativecommons.org/licenses/by-sa/4.0/", None, [], "open_license", True), ("cc by-nd 4.0 creative commons", None, [], "restricted_license", False),
    ("public domain in the united states", None, [], "public_domain_jurisdictional", False), ("posted with permission of the copyright holder. public domain in the united states", None, [], "copyrighted", False),
    ("creative commons cc by 4.0. all rights reserved", None, [], "conflicting", False), ("cc0 1.0", None, [], "public_domain", True), ("", None, [], "unknown", False), ("rightsstatements.org/vocab/inc/1.0", None, [], "copyrighted", False),
    ("", "public_domain", ["EU"], "public_domain", True), ("", "public_domain", [], "public_domain_jurisdictional", False), ("", "open_license", [], "unknown", False), ("this is protected by copyright", None, [], "copyrighted", False)]


@pytest.mark.parametrize(("text", "claim", "where", "status", "open_"), RIGHTS)
def test_rights(spark, text, claim, where, status, open_):
    v = one(spark, rights.assess(F.lit(text), F.lit(claim).cast("string"), F.array(*map(F.lit, where)).cast("array<string>"), F.lit(None).cast("int"), F.lit(None).cast("int"), rights.Policy()))
    assert (v["status"], v["publication_allowed"], v["locked"]) == (status, open_, not open_) and not (v["translation_allowed"] and not open_)


def test_rights_terms(spark):
    v = one(spark, rights.assess(F.lit(""), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(1900), F.lit(None).cast("int"), rights.Policy(unlock_likely=True)))
    assert v["status"] == "public_domain_likely" and v["publication_allowed"] and v["review_required"]


def test_edition_plan(spark):
    rows = [(1, "a", "en", "translation", "txt", True, "public_domain", True), (1, "b", "la", "original", "txt", True, "public_domain", True), (1, "c", "en", "translation", "txt", True, "public_domain", True),
            (2, "d", "fr", "translation", "txt", True, "open_license", True), (2, "e", "en", "translation", "txt", True, "copyrighted", False), (3, "f", "la", "translation", "txt", True, "unknown", False), (4, "g", "en", "original", "txt", False, "public_domain", True)]
    e = spark.createDataFrame(rows, "work_id long, edition_id string, language string, language_role string, format string, available boolean, status string, publication_allowed boolean")
    got = {r["edition_id"]: r["reason"] for r in rights.plan_editions(e, rights.Policy()).collect()}
    assert got == {"a": "preferred_open_english", "b": "preferred_open_original", "c": "not_selected", "d": "fallback_open_ai_translatable", "e": "locked_english_reference", "f": "only_authorized_candidate", "g": "not_selected"}


@pytest.fixture(scope="module")
def figures(spark):
    r = random.Random(5)
    rows = [(i, ", ".join(r.choices(["red", "blue", "Serpent", "cows", "troy", "sea"], k=3)) if i else None, r.choice(["m", "female", None]), [r.choice(["a_b", "c"])]) for i in range(40)]
    return spark.createDataFrame(rows, "id long, domain string, gender string, events array<string>")


def test_traits_against_plain_python(spark, figures):
    found = tr.figure_traits(figures, "id", {"domain": "domain", "gender": "gender"}, {"events": "events"}, VOCABULARY)
    sets = defaultdict(set)
    for r in found.collect():
        sets[r["figure_id"]].add((r["category"], r["token"]))
    assert found.count() == sum(map(len, sets.values())) and all(("events", "a b") in s or ("events", "c") in s for s in sets.values())
    for threshold in (1, 2, 3):
        want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold}
        assert {(r["src"], r["dst"]): r["weight"] for r in tr.cooccurrence(found, threshold).collect()} == want
    assert {r["figure_id"]: r["weight"] for r in tr.ego(found, 3).collect()} == {i: len(s & sets[3]) for i, s in sets.items() if i != 3 and s & sets[3]}
    mapped = tr.figure_traits(figures, "id", {"domain": "animals"}, None, VOCABULARY, supersets={"animals": "animals"})
    assert {r["token"] for r in mapped.collect()} == {"Mammals", "Reptiles", "Other animals"}


def test_concepts_against_plain_python(spark, figures):
    found = tr.figure_traits(figures, "id", {"domain": "domain", "gender": "gender"}, {"events": "events"}, VOCABULARY)
    extent = defaultdict(set)
    for r in found.collect():
        extent[f"{r['category']}::{r['token']}"].add(r["figure_id"])
    n = len({i for e in extent.values() for i in e})
    seeds = {frozenset(e) for e in extent.values() if 3 <= len(e) < n}
    every = seeds | {a & b for a in seeds for b in seeds if len(a & b) >= 3} | {frozenset(i for e in extent.values() for i in e)}
    want = {(tuple(sorted(e)), tuple(sorted(t for t, own in extent.items() if len(own) < n and e <= own))) for e in every}
    lattice = concepts.concepts(found, 3, 1000)
    by = defaultdict(set)
    for r in lattice.members().collect():
        by[r["concept"]].add(r["at"])
    assert {(tuple(sorted(by[r["concept"]])), tuple(r["intent"])) for r in lattice.found.collect()} == want
    cover = {(a, b) for a in by for b in by if by[b] < by[a] and not any(by[b] < by[c] < by[a] for c in by)}
    assert {(r["upper"], r["lower"]) for r in concepts.covers(lattice).collect()} == cover


def test_correspondence_against_numpy(spark, figures):
    found = tr.figure_traits(figures, "id", {"domain": "domain", "gender": "gender"}, {"events": "events"}, VOCABULARY)
    placed, inertia = lattice.correspondence(found, axes=3)
    rows = found.collect()
    ids, names = sorted({r["figure_id"] for r in rows}), sorted({(r["category"], r["token"]) for r in rows})
    m = np.zeros((len(ids), len(names)))
    for r in rows:
        m[ids.index(r["figure_id"]), names.index((r["category"], r["token"]))] = 1
    p = m / m.sum()
    rm, cm = p.sum(1), p.sum(0)
    u, s, _ = np.linalg.svd((p - np.outer(rm, cm)) / np.sqrt(np.outer(rm, cm)), full_matrices=False)
    assert np.allclose(inertia, s[:3] ** 2)
    got = np.array([[r[f"axis_{k}"] for k in (1, 2, 3)] for r in sorted(placed.collect(), key=lambda r: r["figure_id"])])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3] / np.sqrt(rm)[:, None]), atol=1e-8)


def test_components_and_tree(spark):
    edges = spark.createDataFrame([(i, i + 1, "x") for i in range(20)] + [(50, 40, "x"), (41, 40, "x"), (None, 3, "x")], "src long, dst long, relation string")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 40, 40: 40, 41: 40}
    tree = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "d", 3), (9, "lost", 77)], "id int, name string, parent_id int")
    assert {(r["ancestor"], r["descendant"], r["distance"]) for r in taxonomy.closure(tree).collect()} >= {(1, 4, 3), (2, 4, 2), (9, 9, 0)}
    assert {r["id"] for r in taxonomy.rooted(tree).collect()} == {1, 2, 3, 4}
    assert {r["id"]: r["sum_count"] for r in taxonomy.roll_up(tree, spark.createDataFrame([(3, 5), (4, 2)], "id int, n long")).collect()} == {1: 7, 2: 7, 3: 7, 4: 2}


def test_ledger_cases(spark):
    runs = spark.createDataFrame([("l", 1, "completed", 0.5), ("l", 2, "failed", 0.9), ("l", 3, "completed", 0.4375)], "list_name string, run_id int, status string, coverage double")
    assert [r["delta"] for r in ledger.coverage_changes(runs).orderBy("run_id").collect()] == [None, -0.062]
    now = spark.createDataFrame([(1, "A ", None, "fetched"), (2, "b", "X", "failed"), (3, "c", None, "blocked"), (4, "d", None, "skipped")], "pos int, title string, author string, status string")
    old = spark.createDataFrame([(1, "a", None, "skipped"), (2, "B", "x", "fetched"), (3, "c", None, "fetched"), (4, "c", None, "blocked")], "pos int, title string, author string, status string")
    assert {r["title"]: r["change"] for r in ledger.item_changes(now, old).collect()} == {"A ": "improved", "b": "regressed", "c": "unchanged", "d": "new"}
    done, planned = F.array(F.struct(F.lit("a").alias("title"), F.lit("fetched").alias("status"))), F.array(F.lit("a"), F.lit("b"))
    assert [tuple(x) for x in one(spark, ledger.salvage(done, planned))] == [("a", "fetched"), ("b", "skipped")]
    texts = spark.createDataFrame([(1, "river north"), (2, "north south"), (3, None)], "id long, text string")
    words = spark.createDataFrame([("N", "north"), ("S", "south")], "region string, keyword string")
    assert {r["id"]: r["region"] for r in ranking.region_of(texts, words).collect()} == {1: "N", 2: None, 3: None}


def test_matching_cases(spark):
    entities = [("Athena", "greek", ["Pallas"]), ("Ra", "egyptian", ["Re"])]
    texts = spark.createDataFrame([(1, "ATHENA and Pallas; ra, Re, Brahma"), (2, "ra"), (3, None)], "id long, text string")
    assert {(r["id"], r["name"], r["alias"]) for r in records.match_entities(texts, entities).collect()} == {(1, "Athena", "ATHENA"), (1, "Ra", "Re")}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "k": 2}\n\n{bad\n', encoding="utf-8")
    from pyspark.sql import types as T

    rows = records.read_jsonl(spark, str(tmp_path / "a.jsonl"), T.StructType([T.StructField("id", T.StringType()), T.StructField("k", T.IntegerType())])).collect()
    assert Counter(r["corrupt"] is None for r in rows) == {True: 1, False: 1}
    (tmp_path / "c.csv").write_text('Text#,Type,Title\n1,Text,"two\nlines ""q"""\n2,Sound,x\n', encoding="utf-8")
    assert [r["Title"] for r in records.read_catalog_csv(spark, str(tmp_path / "c.csv")).collect()] == ['two\nlines "q"']
    assert [(r["title"], r["author"]) for r in one(spark, records.list_rows(F.lit("# c\nA — B\n\nC - D\nE")))] == [("A", "B"), ("C", "D"), ("E", None)]
    tei = '<TEI xmlns="http://x"><text><body><p xml:id="a">One <hi>two</hi></p><ab>three</ab></body></text></TEI>'
    assert one(spark, records.tei_passages(F.lit(tei))) == ["One two", "three"]
    wiki = '{"query":{"pages":{"7":{"pageid":7,"ns":0,"title":"T","fullurl":"u"}}}}'
    assert [r["title"] for r in one(spark, records.wiki_pages(F.lit(wiki)))] == ["T"]
    iiif = records.iiif_labels(F.lit('{"id":"m","label":{"en":["L"]},"metadata":[{"label":{"en":["Date"]},"value":{"none":["1900"]}}]}'))
    assert one(spark, iiif["label"]) == "L" and [tuple(x) for x in one(spark, iiif["metadata"])] == [("Date", "1900")]
    (tmp_path / "o.xml").write_text("<r><record><header><identifier>i1</identifier></header><metadata><dc><title>A</title><title>B</title><type>Text</type></dc></metadata></record></r>")
    row = records.read_oai_records(spark, str(tmp_path / "o.xml")).first()
    assert row["identifier"] == "i1" and row["title"] == ["A", "B"]
    files, kept = spark.createDataFrame([("p", "public", "x"), ("q", "locked", "y")], "path string, partition string, content string"), store.Store(spark, f"file://{tmp_path}/corpus")
    assert [store.write_corpus(kept, files, F.current_timestamp()) for _ in range(2)] == [2, 0]
    assert kept.read("corpus").count() == 2 and kept.read("sidecars").count() == 2


def test_records(spark):
    rows = spark.createDataFrame([(0, "b", "x"), (1, "a", "x"), (2, "c", "y")], "pos long, id string, v string")
    assert sorted(r["pos"] for r in records.dedupe(rows, "pos").collect()) == [0, 2]
    assert [r["id"] for r in records.number(rows, "pos").orderBy("pos").collect()] == ["rec000000", "rec000001", "rec000002"]
    merged = records.merge([rows, rows.drop("v").withColumn("w", F.lit(1))])
    assert merged.count() == 6 and merged.columns == ["pos", "id", "v", "part", "w"]


def test_streams_equal_batches(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    for name, make in (("blockers", stream.blockers), ("once", lambda e: stream.once_per_key(e, "user_id", "60 days").select("user_id"))):
        stream.run_once(make(stream.read_events(spark, path)), str(tmp_path / name), str(tmp_path / f"{name}-c"))
        want = make(batch) if name == "blockers" else batch.select("user_id").distinct()
        assert sorted(map(str, spark.read.parquet(str(tmp_path / name)).collect())) == sorted(map(str, want.collect()))
    seen = {}
    stream.run_batches(stream.latest_states(stream.read_events(spark, path)), lambda df, _: seen.update({r["user_id"]: r["state"] for r in df.collect()}), str(tmp_path / "s-c"))
    assert seen == {r["user_id"]: r["state"] for r in stream.latest_states(batch).collect()}


def test_claims(spark, tmp_path):
    rows = [(1, 1, "a", "claim"), (1, 2, "b", "claim"), (1, 3, "b", "release"), (1, 4, "a", "release"), (1, 5, "b", "claim"), (2, 1, "c", "claim")]
    spark.createDataFrame(rows, "slot long, seq long, holder string, action string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("slot long, seq long, holder string, action string").parquet(str(tmp_path / "in"))
    stream.run_once(stream.claims(source), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {(r["slot"], r["seq"]): r["verdict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): "claimed", (1, 2): "skipped", (1, 3): "ignored", (1, 4): "released", (1, 5): "claimed", (2, 1): "claimed"}


def test_lookup_forms_take_one_pass_of_python(spark):
    """Each user function with texts of its own holds another batch of them in another worker."""
    import re
    import unicodedata

    from traitloom.functions import text as tx

    samples = ["  Ａ ́b﻿ é ", "é  ﬁ", "a﻿̣̇x", "Å  ᾿", "plain  ASCII ", "", None]
    rows = spark.createDataFrame(list(enumerate(samples)), "id int, text string").select("id", tx.normalized_lookup(F.col("text")).alias("key"))
    want = [unicodedata.normalize("NFKC", re.sub(r"[\s   -     　﻿]+", " ", unicodedata.normalize("NFC", s or "")).strip(" ")).lower() for s in samples]
    assert [r["key"] for r in rows.orderBy("id").collect()] == want
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
