"""Many copies of few kinds: kinds are matched once, and the work grows with the rows, not with their pairs."""

import random
import time
import unicodedata

from pyspark.sql import functions as F

import __spark_entry__ as entry
from traitloom.functions import archive
from traitloom.functions import text as tx
from traitloom.operators import dictionary, graph, ranking, rights
from traitloom.operators import traits as tr
from traitloom.plans import stand_in as st

FOLDER = "/root/testdata/sf0.001"


def test_notices_cut_within_a_letter(spark):
    long = "a" + "é" * 50_000
    shown = spark.range(1).select(rights.embedded_notice(F.encode(F.lit(long), "UTF-8")).alias("n")).first()["n"]
    assert shown == "a" + "é" * 32_767 + "�\n" + "é" * 32_768
    shown = spark.range(1).select(rights.embedded_notice(F.encode(F.lit("é" * 50_000 + "b"), "UTF-8")).alias("n")).first()["n"]
    assert shown == "é" * 32_768 + "\n�" + "é" * 32_767 + "b"


def test_text_lists_are_whole(spark):
    rows = entry.queries()["S19_txt_lists"](spark, FOLDER).collect()
    assert {(r["name"], r["title"], r["author"]) for r in rows} == {(f["tradition"], f["name"], f["kind"]) for f in st.figures(spark, FOLDER).collect()} and len(rows) == len(set(rows))


def test_cascade_over_many_figures_of_one_name(spark):
    n, began = 60_000, time.monotonic()
    names = spark.range(n).select("id", F.when(F.col("id") < n - 1, "Odin").otherwise("Vali").alias("name"), F.when(F.col("id") % 2 == 0, "north").otherwise("south").alias("tradition")).union(
        spark.createDataFrame([(7, "Wali", None), (8, "Odin", "south")], "id long, name string, tradition string"))
    probes = spark.range(n).select(F.col("id").alias("probe"), F.when(F.col("id") == 0, "Wali").when(F.col("id") == 1, "wali").when(F.col("id") == 2, "none").otherwise("Odin").alias("name"),
                                   F.when(F.col("id") % 3 == 0, "south").when(F.col("id") % 3 == 1, "east").otherwise(None).alias("tradition"))
    got = {r["probe"]: (r["id"], r["level"], r["ambiguous"]) for r in graph.name_cascade(probes, names).collect()}
    assert len(got) == n and [got[i] for i in range(7)] == [(7, 2, False), (None, 3, True), (None, None, False), (1, 1, False), (None, 2, True), (None, 2, True), (1, 1, False)]
    assert time.monotonic() - began < 120


def test_identification_beside_oneself(spark):
    names = [(1, "Thor", "a"), (2, "thor", "a"), (3, "Thor", "b"), (4, "Thor", "c"), (5, "Thor", "d"), (6, "Odin", "a"), (7, "Odin", "a"), (8, "Loki", None), (9, "Loki", "x"), (10, "Baldr", "a")]
    targets = [(i, t, n) for i, n, t in names] + [(3, "a", "Thor"), (20, None, "Thor"), (21, "a", "thor"), (22, "x", "Loki"), (23, "q", "no one")]

    def plain(i, wanted):
        own = [t for k, t, n in targets if (k, n) == (i, wanted)]
        met = [((0 if t is None or f is None else 1 + (t == f)), j) for t in own for j, n, f in names if n.lower() == wanted.lower() and j != i]
        return min(met)[1] if met else None

    want = {(i, n): plain(i, n) for i, _, n in targets}
    rows = graph.identification(spark.createDataFrame(targets, "id long, tradition string, target string"), spark.createDataFrame(names, "id long, name string, tradition string")).collect()
    assert {(r["id"], r["target"]): r["found"] for r in rows} == {k: v for k, v in want.items() if v is not None} and len(rows) == sum(v is not None for v in want.values())


def test_identification_reads_few_of_a_crowded_name(spark):
    n = 20_000
    names = spark.range(n).select("id", F.lit("Thor").alias("name"), F.concat(F.lit("t"), F.col("id") % 5000).alias("tradition"))
    began = time.monotonic()
    got = graph.identification(names.select("id", "tradition", F.col("name").alias("target")), names).groupBy("found").count().collect()
    assert {r["found"]: r["count"] for r in got} == {0: n - 4, 1: 4} and time.monotonic() - began < 60


def test_overlap_of_many_copies(spark):
    n, began = 60_000, time.monotonic()
    catalogue = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "red ring").when(F.col("id") % 3 == 1, "red bolt").otherwise("blue bolt").alias("title"), F.lit("Smith").alias("author"))
    queries = spark.range(3000).select(F.col("id").alias("query"), F.array(F.when(F.col("id") % 2 == 0, "red").otherwise("blue"), F.lit("bolt"), F.lit("bolt"), F.lit("")).alias("tokens"))
    got = {}
    for r in ranking.token_overlap(catalogue, queries, 3).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
    assert len(got) == 3000 and sorted(got[0]) == [(1, 1, 2), (2, 4, 2), (3, 7, 2)] and sorted(got[1]) == [(1, 2, 2), (2, 5, 2), (3, 8, 2)]
    assert time.monotonic() - began < 90


def test_distances_of_classes_hold_all_pairs(spark):
    rows = entry.queries()["U1_jaccard"](spark, FOLDER).collect()
    rep = {r["a"]: r["b"] for r in rows if r["kind"] == "member"}
    apart = {(r["a"], r["b"]): r["distance"] for r in rows if r["kind"] == "pair"}
    sets = {f["id"]: {*f["name"].split(" "), f["kind"].lower()} for f in st.figures(spark, FOLDER).collect()}
    assert rep.keys() == sets.keys()
    for a in (i for i in sets if i % 100 == 0):
        for b in sets:
            want = round(1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)
            assert a == b or want == (0 if rep[a] == rep[b] else apart.get((rep[a], rep[b]), 1))


def test_graph_of_classes_holds_all_pairs(spark):
    rows = entry.queries()["G4_cooccurrence_graph"](spark, FOLDER).collect()
    rep, own = ({r["src"]: r[c] for r in rows if r["kind"] == "member"} for c in ("dst", "weight"))
    linked = {(r["src"], r["dst"]): r["weight"] for r in rows if r["kind"] == "pair"}
    got = {(a, b): own[a] if rep[a] == rep[b] else w for a in rep for b in rep if a < b and (rep[a] == rep[b] or (w := linked.get((min(rep[a], rep[b]), max(rep[a], rep[b])))))}
    assert got == {(r["src"], r["dst"]): r["weight"] for r in tr.cooccurrence(st.traits(spark, FOLDER), 3).collect()}


def test_top_pairs_of_crowded_classes(spark):
    r = random.Random(5)
    for copies, most in ((1, 5), (4, 20), (40, 20)):
        kinds = [r.sample(range(8), r.randrange(1, 6)) for _ in range(8)]
        sets = {i: set(kinds[r.randrange(8)]) for i in range(8 * copies)}
        frame = spark.createDataFrame([(i, "c", f"t{x}") for i, s in sets.items() for x in s], "figure_id long, category string, token string")
        want = sorted((-len(sets[a] & sets[b]), a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2)[:most]
        assert [(-x["weight"], x["src"], x["dst"]) for x in tr.cooccurrence_top(frame, 2, most).collect()] == want


def test_top_pairs_without_all_pairs(spark):
    n, began = 40_000, time.monotonic()
    frame = spark.range(n).select(F.col("id").alias("figure_id"), F.lit("c").alias("category"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("d"), (F.col("id") % 2).cast("string"))).alias("token"))
    assert [(x["src"], x["dst"], x["weight"]) for x in tr.cooccurrence_top(frame, 3, 3).collect()] == [(0, 2, 4), (0, 4, 4), (0, 6, 4)]
    assert time.monotonic() - began < 90


def test_candidate_scores_of_kinds_hold_all_pairs(spark):
    rows = entry.queries()["F31_candidate_score"](spark, FOLDER).collect()
    rep, own = ({r["probe"]: r[c] for r in rows if r["row"] == "member"} for c in ("id", "score"))
    scores = {(r["probe"], r["id"]): r["score"] for r in rows if r["row"] == "pair"}
    f = st.figures(spark, FOLDER)
    a, b, word = f.where("id % 100 = 0").alias("a"), f.alias("b"), lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    item = {"title": F.concat("b.name", F.lit(" vol. "), F.col("b.n") % 4), "creator": F.col("b.kind"), "year": F.col("b.n"), "volume": F.lit(None).cast("int"), "identifier": F.lit("x")}
    score = F.round(archive.candidate_score(F.concat("a.name", F.lit(", volume II")), F.col("a.kind"), F.col("a.n"), item), 6)
    want = a.join(b, (word("a.name") == word("b.name")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("probe"), F.col("b.id").alias("id"), score.alias("s")).collect()
    assert len(rep) == f.count() and want
    assert all(x["s"] == (own[x["probe"]] if rep[x["probe"]] == rep[x["id"]] else scores[rep[x["probe"]], rep[x["id"]]]) for x in want)


def test_candidate_scores_of_all_parts(spark, tmp_path):
    """Parts of which none has an id divisible by 100, with unlike and missing titles: each is held against every other."""
    rows = [(1, "red bolt", "PROMO", 3), (2, "red ring", "PROMO", 3), (3, "blue bolt", None, 12), (4, None, "SMALL", 3), (5, "blue bolt", None, 12), (6, None, "SMALL", 3), (7, None, "SMALL", 8), (8, "old plate", "LARGE", None), (9, "red bolt", "SMALL", 2)]
    part = spark.createDataFrame([(i, name, "b", kind, n, 1.0) for i, name, kind, n in rows], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = entry.queries()["F31_candidate_score"](spark, str(tmp_path)).collect()
    rep, own = ({r["probe"]: r[c] for r in got if r["row"] == "member"} for c in ("id", "score"))
    scores = {(r["probe"], r["id"]): r["score"] for r in got if r["row"] == "pair"}
    a, b = part.alias("a"), part.alias("b")
    item = {"title": F.concat("b.p_name", F.lit(" vol. "), F.col("b.p_size") % 4), "creator": F.col("b.p_type"), "year": F.col("b.p_size"), "volume": F.lit(None).cast("int"), "identifier": F.lit("x")}
    score = F.round(archive.candidate_score(F.concat("a.p_name", F.lit(", volume II")), F.col("a.p_type"), F.col("a.p_size"), item), 6)
    want = a.crossJoin(b).where("a.p_partkey <> b.p_partkey").select(F.col("a.p_partkey").alias("probe"), F.col("b.p_partkey").alias("id"), score.alias("s")).collect()
    assert rep == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 4, 7: 7, 8: 8, 9: 9} and len(want) == 72 and len(got) == 9 + 7 * 6 == 9 + len(scores)
    assert all(x["s"] == (own[x["probe"]] if rep[x["probe"]] == rep[x["id"]] else scores[rep[x["probe"]], rep[x["id"]]]) for x in want)


def test_accepted_matches_of_many_copies(spark, tmp_path):
    n = 30_000
    part = spark.range(n).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 1000 == 0, "red bolt").otherwise("red ring").alias("p_name"), F.lit("b").alias("p_brand"), F.when(F.col("id") % 2 == 0, "PROMO").otherwise("SMALL").alias("p_type"),
                                 F.lit(3).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    began = time.monotonic()
    got = {r["probe"]: (r["id"], r["score"]) for r in entry.queries()["O9_accepted_matches"](spark, str(tmp_path)).collect()}
    assert len(got) == n and [got[i] for i in (0, 1000, 1, 2, 3, 4)] == [(1000, 1.0), (0, 1.0), (3, 1.0), (4, 1.0), (1, 1.0), (2, 1.0)]
    assert time.monotonic() - began < 90


def test_entries_looked_up_by_a_join(spark, monkeypatch):
    """Words, marks at the ends, letters beyond ASCII and more shapes than are looked up: as with one automaton."""
    r = random.Random(3)
    pieces = ["Ring", "ring", "É", "ß", "No", "7", "42", "x²"]
    made = lambda n: "".join(r.choice(pieces) + r.choice([" ", "-", ". ", "/", "  ("]) for _ in range(n)).strip(" ")
    texts = spark.createDataFrame([(i, made(12)) for i in range(60)] + [(60, None), (61, "")], "id long, text string")
    rows = {(loose, dictionary.folded(e) if loose else e) for e in [made(r.randrange(1, 4)) for _ in range(150)] + ["(", "--", ". "] for loose in (True, False)}
    entries = spark.createDataFrame(sorted(rows), "loose boolean, entry string")
    got = lambda size: sorted(tuple(x) for x in dictionary.find_entries(texts, entries, size).collect())
    want = got(1 << 20)
    assert len(want) > 100 and got(2000) == want
    monkeypatch.setattr(dictionary, "MOST_SHAPES", 2)
    assert got(2000) == want
    monkeypatch.setattr(dictionary, "MOST_SHAPES", 32)
    monkeypatch.setattr(dictionary, "_places", None)  # Words alone need no pass for each block.
    words = entries.where("entry RLIKE '^[a-zA-Z]+$'")
    assert dictionary.find_entries(texts, words, 8).count() > 20


def test_forms_of_texts(spark):
    """As Python's own; this cannot tell how much memory it took."""
    rows = ["plain", "", None, "é", "é", "ﬁ ½ Å", "가", "ạ̈b", "x²\x00y"]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        got = frame.select("i", tx.unicode_form(F.col("t"), form).alias("x")).collect()
        assert {r["i"]: r["x"] for r in got} == {i: t if t is None else unicodedata.normalize(form, t) for i, t in enumerate(rows)}
