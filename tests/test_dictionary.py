"""Dictionary matching against a regular expression of all entries, in one block and in many."""

import random
import re

import pytest
from pyspark.sql import functions as F

from traitloom.operators import dictionary, ranking
from traitloom.plans import text_queries

SMALL = "/root/testdata/sf0.1"


def brute(texts, catalog, least_long=5):
    """Each text passed over with two patterns, longest entry first, names in any case before all else."""
    loose, exact = {}, {}
    for name, tradition, aliases in catalog:
        if name:
            (loose if len(name) >= least_long else exact).setdefault(name.lower() if len(name) >= least_long else name, set()).add((name, tradition))
        for alias in aliases or ():
            if alias:
                exact.setdefault(alias, set()).add((name, tradition))
    out = {}
    for i, text in texts:
        for known, key in ((loose, str.lower), (exact, str)):
            listed = "|".join(re.escape(k) for k in sorted(known, key=lambda k: (-len(k), k)))
            for m in re.finditer(rf"(?<![^\W_])(?:{listed})(?![^\W_])", key(text or "")) if listed else ():
                for entity in known[m.group()]:
                    out.setdefault((i, *entity), text[m.start() : m.end()])
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200, 30])
def test_catalogue_against_a_pattern(spark, block_bytes):
    r = random.Random(block_bytes)
    words = ["ra", "re", "thor", "odin", "pallas", "athena", "Athena Pallas", "thor odin", "odin thor ra", "a-b", "St. Ra", "éa", "Ünder", "x_y", "中文"]
    catalog = [(" ".join(r.sample(words, r.randrange(1, 3))).title(), r.choice("gh"), r.sample(words, r.randrange(3))) for _ in range(60)] + [(None, "n", ["thor"]), ("", "e", []), ("Zeus", None, None)]
    texts = [(i, r.choice(["", " ", "_", "7"]).join(r.choice([*words, "THOR", "ATHENA PALLAS", ", ", "; "]) + r.choice(["", " ", " ", "s"]) for _ in range(r.randrange(20)))) for i in range(120)]
    texts += [(500, None), (501, ""), (502, "thor " * 30_000), (3, texts[3][1])]
    got = dictionary.match_catalog(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(catalog, "name string, tradition string, aliases array<string>"), block_bytes=block_bytes).collect()
    assert {(x["id"], x["name"], x["tradition"]): x["alias"] for x in got} == brute(texts, catalog) and len(got) == len(brute(texts, catalog))


def test_a_hundred_thousand_surfaces_in_one_pass(spark):
    """The catalogue of all parts, against a look-up of the words of each text."""
    catalog = text_queries.named_parts(spark, SMALL)
    surfaces = catalog.select(F.explode(F.array_append("aliases", F.lower("name"))).alias("s")).distinct().count()
    assert surfaces >= 90_000 and len(dictionary.blocks_of(catalog.select(F.lit(True).alias("loose"), F.lower("name").alias("entry")))) == 1
    texts = text_queries.order_texts(spark, SMALL).where("id % 50 = 0")
    got = {(r["id"], r["name"]) for r in dictionary.match_catalog(texts, catalog).collect()}
    names = {}
    for r in catalog.collect():
        for s in (r["name"].lower(), *r["aliases"]):
            names.setdefault(s, set()).add(r["name"])
    want = {(t["id"], n) for t in texts.collect() for piece in t["text"][6:-1].split("; ") for n in names.get(piece, names.get(piece.lower(), ()))}
    assert got == want and len(want) > 5000


def test_empty_dictionaries_and_texts(spark):
    texts = spark.createDataFrame([(1, "thor")], "id long, text string")
    none = spark.createDataFrame([], "name string, tradition string, aliases array<string>")
    assert dictionary.match_catalog(texts, none).collect() == []
    assert dictionary.match_catalog(texts.limit(0), spark.createDataFrame([("Thor", "x", ["thor"])], none.schema)).collect() == []
    assert dictionary.folded("İx") == "İx" and dictionary.folded("ÀB") == "àb"


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_parts_of_words(spark, block_bytes, monkeypatch):
    r = random.Random(block_bytes)
    texts = [(i, "".join(r.choice("abc ") for _ in range(r.randrange(40)))) for i in range(60)] + [(99, None)]
    entries = ["".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(30)] + [""]
    got = dictionary.held_parts(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(e,) for e in entries], "entry string"), block_bytes).collect()
    assert sorted(map(tuple, got)) == sorted((i, e) for i, t in texts for e in set(entries) if e and e in (t or ""))


def test_token_overlap_of_many_tokens(spark):
    """More tokens than a plan could list one by one."""
    catalogue = spark.range(50).select("id", F.concat(F.lit("word"), F.col("id")).alias("title"), F.lit("x").alias("author"))
    queries = spark.range(3).select(F.col("id").alias("query"), F.transform(F.sequence(F.lit(0), F.lit(14_999)), lambda k: F.concat(F.lit("word"), k * 3 + F.col("id"))).alias("tokens"))
    best = {r["query"]: r for r in ranking.token_overlap(catalogue, queries, 1).collect()}
    hits = lambda q, i: sum(f"word{k * 3 + q}" in f"word{i} x" for k in range(15_000))
    assert all(best[q]["score"] == max(hits(q, i) for i in range(50)) for q in range(3))
