"""Objects, animals, character and looks against plain Python over texts put together from the wordings."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from traitloom.functions import attributes as at
from traitloom.functions import wiki

PIECES = ["She wields a golden net of fire", "armed with the Spear, and more", "His symbols are the owl and the crown", "sacred to all is the white bull", "An owl was sacred", "He rode a ram", "a peacock and a cock stood by", "elephants pull it",
          "depicted as a winged giant", "described as tall", "had a serpent's tail of gold", "with eyes like stars and more than that in a long line of words that goes on", "known for being a wise king", "marked by her patient mind", "he was cunning and brave", "It is just",
          "was jealous of all", "The lyre", "SWORD and shield", "took the shape of a swan", "beautiful", "He was a deceitful trickster", "the dragon", "associated with bees", "mount", "feathered serpent form", "hare", "then again", "orderly", "being warlike"]


def first(pattern, text):
    m = re.search(pattern, text, re.IGNORECASE)
    return m.group(1) if m else ""


def brute(box, text):
    lower = text.lower()
    parts = [box[f] for f in at.OBJECT_FIELDS if box.get(f)]
    for p in at.OBJECT_WORDINGS:
        found = first(p, text).strip()
        if 3 <= len(found) <= 80 and found not in parts:
            parts.append(found)
    for w in dict.fromkeys(m.lower() for m in re.findall(rf"\b({at.OBJECTS})\b", text, re.IGNORECASE)):
        if not any(w in p.lower() for p in parts):
            parts.append(w)
    beasts = [box[f] for f in at.ANIMAL_FIELDS if box.get(f)]
    for w in at.ANIMALS:
        if re.search(rf"\b{w}s?\b", lower) and not any(w in p.lower() for p in beasts):
            i = lower.index(w)
            if any(s in lower for s in at.ANIMAL_SIGNS) or any(f"{a}{w}{b}" in lower for a, b in at.ANIMAL_FRAMES) or re.search(at.NEAR_ANIMAL, lower[max(0, i - 50) : i + len(w) + 50]):
                beasts.append(w)
    traits = [x for x in (first(p, text) for p in at.TRAIT_WORDINGS) if 3 <= len(x) <= 60]
    stated = re.sub("(?i)^.*(?:was|is) (?:a |an )?", "", first(f"({at.TRAIT_STATED})", text), count=1).strip()
    traits += [stated] if 3 <= len(stated) <= 60 else []
    head = lower[:2000]
    traits += [w for w in at.TRAITS if w in head and w not in traits and re.search(at.BEFORE_TRAIT, head[max(0, head.index(w) - 30) : head.index(w)])]
    seen = []
    for p in at.LOOK_WORDINGS:
        found = first(p, text).strip()
        if 5 <= len(found) <= 80 and found not in seen:
            seen.append(found)
    for w in at.LOOKS:
        if w in lower[:3000] and not any(w in p.lower() for p in seen):
            seen.append(w)
    return tuple(", ".join(x) or None for x in (parts, beasts, list(dict.fromkeys(traits))[:5], list(dict.fromkeys(seen))[:4]))


def test_attributes_against_plain_python(spark):
    r = random.Random(12)
    rows = []
    for i in range(250):
        text = "".join(r.choice(PIECES) + r.choice([". ", ", ", " "]) for _ in range(r.randrange(9)))
        if i % 40 == 7:
            text = "x " * 1500 + text
        box = {k: r.choice(["an owl", "", "Ram and bow"]) for k in r.sample([*at.OBJECT_FIELDS, *at.ANIMAL_FIELDS], r.randrange(3))}
        rows.append((i, box, text))
    frame = spark.createDataFrame([*rows, (999, {}, None)], "i int, box map<string,string>, text string")
    made = frame.select("i", at.objects(frame.box, frame.text).alias("o"), at.animals(frame.box, frame.text).alias("a"), at.character(frame.text).alias("c"), at.looks(frame.text).alias("l"))
    got = {x["i"]: tuple(x)[1:] for x in made.collect()}
    for i, box, text in rows:
        assert got[i] == brute(box, text), (text, box)
    assert got[999] == (None,) * 4 and sum(bool(x) for v in got.values() for x in v) > 400


@pytest.mark.parametrize("name", ["F27_objects_and_looks", "F28_relations", "F27_attributes", "F25_wikitext_markdown", "F26_article"])
def test_work_is_dealt_over_the_cores(spark, name):
    """The parts are one small file, which is read by one task."""
    folder = "/root/testdata/sf0.001"
    assert spark.read.parquet(f"{folder}/part.parquet").rdd.getNumPartitions() == 1
    held = entry.queries()[name](spark, folder).rdd.glom().map(len).collect()
    assert sum(n > 0 for n in held) >= spark.sparkContext.defaultParallelism


def test_an_infobox_is_read_once(spark):
    """What reads it stands once in the plan, whatever is asked of it."""
    texts = spark.createDataFrame([(1, "{{Infobox deity\n| father = [[Zeus]]\n| mother = Leto\n}}")], "id int, text string")
    kin = texts.select(wiki.relations(wiki.infobox(F.col("text"))).alias("r"))
    assert [(r["target"], r["type"]) for r in kin.first()["r"]] == [("Zeus", "child of"), ("Leto", "child of")]
    assert kin._jdf.queryExecution().optimizedPlan().toString().count("Infobox") == 1
