"""Licence notices in texts: a positional index of rare template words.

The index has postings (template, place) of each template's rarest words, by inverse document
frequency: so many that the others cannot reach the least share without one of them. A text's
words are looked up in it, each posting proposes a relative position of its template, and
positions that several words propose are one. At each position proposed all words of the
template are counted, and a template whose words agree on one is accepted if the text also
holds its mandatory key phrases.

Templates are rows, given or read from a table. Postings and templates are constants of the
plan, whose form does not depend on how many there are: the postings lie in an array by the
hash of their word, so a word costs one step. They come in blocks of bounded bytes, each
looked up by itself. Everything is DataFrame functions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.shared import let

#: Words are runs of digits, ASCII letters and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: The share of a template's weight that must agree on a place.
LEAST_SHARE = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


#: The opening notices of common licences, and short references to them.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "in compliance with the license")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
)
#: Bytes of the templates of a block, which are part of the plan; and places of the index for each word in it.
BLOCK_BYTES, ROOM = 4 << 20, 4


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()})


def read_templates(listed: DataFrame) -> tuple[Template, ...]:
    """The templates of a table (label, text, keys: array of phrases), whole licence texts as well.

    Texts and phrases are cut into words as :func:`words` does. Rows with nulls, or without
    words or phrases, are left out. A list of licences is reference data, as large as the
    licences there are; the driver holds it.
    """
    cut = lambda c: F.array_join(words(c), " ")
    rows = listed.dropna(subset=["label", "text", "keys"]).select("label", cut(F.col("text")).alias("text"), F.filter(F.transform("keys", cut), lambda k: k != "").alias("keys"))
    found = rows.where((F.col("text") != "") & (F.size("keys") > 0)).distinct().orderBy("label", "text").collect()
    return tuple(Template(r["label"], r["text"], tuple(r["keys"])) for r in found)


def blocks_of(templates: tuple[Template, ...], block_bytes: int = BLOCK_BYTES) -> Iterator[list[Template]]:
    block, size = [], 0
    for t in templates:
        if block and size + len(t.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t.text)
    if block:
        yield block


def by_hash(entries: dict[str, object], kind: str):
    """A function from a column of words to the values (of a Spark type) under them, none or one as an array: a hash table that the plan holds."""
    size = max(1, ROOM * len(entries))
    places: list[list[dict]] = [[] for _ in range(size)]
    for word, value in entries.items():
        places[xxhash.xxh64_intdigest(word.encode(), 42) % size].append({"w": word, "x": value})
    held = F.from_json(F.lit(json.dumps(places)), f"array<array<struct<w:string,x:{kind}>>>")
    # As a long the hash is less by 2^64 where it is negative.
    at = lambda w: let(F.xxhash64(w), lambda h: F.pmod(h % size + F.when(h < 0, (1 << 64) % size).otherwise(0), F.lit(size)).cast("int"))
    return lambda w: F.filter(F.get(held, at(w)), lambda e: e["w"] == w)


def words(text: Column) -> Column:
    """The words of a text, A-Z in small letters."""
    return F.filter(F.split(F.translate(text, CAPITALS, SMALL), GAP), lambda w: w != "")


def phrase_places(own: Column, phrase: str) -> Column:
    """Word positions (from 0) at which the words of a phrase stand one after another."""
    first, *rest = phrase.split()

    def here(w: Column, i: Column) -> Column:
        held = w == first
        for k, x in enumerate(rest, 1):
            held = held & F.coalesce(F.get(own, i + k) == x, F.lit(False))
        return F.when(held, i.cast("long"))

    return F.filter(F.transform(own, here), lambda x: x.isNotNull())


def frequencies(docs: DataFrame, text: Column, known: list[str]) -> dict[str, float]:
    """Inverse document frequencies of the template words, over all documents."""
    numbered = by_hash({w: i for i, w in enumerate(known)}, "int")
    held = docs.select(F.array_distinct(F.transform(F.flatten(F.transform(words(text), numbered)), lambda e: e["x"])).alias("held"))
    # A number that no word has stands for the document itself.
    counted = held.select(F.explode(F.concat("held", F.array(F.lit(-1)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    count = {r["w"]: r["n"] for r in counted.collect()}
    n = count.pop(-1, 0)
    return {w: math.log(1 + (n - count.get(i, 0) + 0.5) / (count.get(i, 0) + 0.5)) for i, w in enumerate(known)}


def rare_places(template: Template, idf: dict[str, float]) -> list[int]:
    """The places of a template's rarest words; the words elsewhere weigh less than the least share."""
    own = template.text.split()
    left, rare = sum(idf[w] for w in own), []
    most = (LEAST_SHARE - 1e-6) * left
    for i in sorted(range(len(own)), key=lambda i: (-idf[own[i]], i)):
        if left < most:
            break
        left -= idf[own[i]]
        rare.append(i)
    return sorted(rare)


def _accepted(own: Column, line: Column, templates: list[Template], idf: dict[str, float]) -> Column:
    """Label and share of each template that a text's words hold at a relative position with the least share or more, and its key phrases anywhere."""
    postings: dict[str, list[dict]] = {}
    rows = []
    for number, t in enumerate(templates):
        listed = t.text.split()
        total = sum(idf[w] for w in listed) or 1.0
        rows.append({"label": t.label, "words": listed, "weights": [idf[w] / total for w in listed], "keys": [f" {k} " for k in t.keys]})
        for place in rare_places(t, idf):
            postings.setdefault(listed[place], []).append({"t": number, "p": place})
    index = by_hash(postings, "array<struct<t:int,p:int>>")
    held = F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,words:array<string>,weights:array<double>,keys:array<string>>>")
    found = F.flatten(F.transform(own, lambda w, i: F.flatten(F.transform(index(w), lambda e: F.transform(e["x"], lambda x: F.struct(x["t"].alias("t"), (i - x["p"]).alias("d")))))))

    def share(t: Column, d: Column) -> Column:
        agreeing = F.zip_with(t["words"], F.sequence(F.lit(0), F.size(t["words"]) - 1), lambda w, k: F.coalesce(F.get(own, d + k) == w, F.lit(False)))
        return F.aggregate(F.zip_with(agreeing, t["weights"], lambda a, x: F.when(a, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)

    def judged(c: Column) -> Column:
        return let(F.get(held, c["t"]), lambda t: F.struct(t["label"].alias("label"), F.when(F.forall(t["keys"], lambda k: F.contains(line, k)), share(t, c["d"])).otherwise(0.0).alias("share")))

    return F.filter(F.transform(F.array_distinct(found), judged), lambda x: x["share"] >= LEAST_SHARE)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: the id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score`` (1 with a base phrase, else the best accepted template's share).

    A null or empty text has no words and no labels. Repeated rows and null ids are rows like
    others; columns other than the id and the text are not read, whatever their names. Of
    labels with equal shares all are given. A very long text is one row's work. No rows give
    no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    idf = frequencies(docs, text, vocabulary(templates))
    accepting = list(blocks_of(templates, block_bytes))

    def look(own: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
        accepted = let(line, lambda x: F.concat(*[_accepted(own, x, block, idf) for block in accepting])) if accepting else F.array().cast("array<struct<label:string,share:double>>")
        bases = [F.when(F.contains(line, F.lit(f" {p} ")), phrase_places(own, p)).otherwise(F.array().cast("array<bigint>")).alias(f"base_{i}") for i, (p, _) in enumerate(BASE)]
        return F.struct(F.size(own).cast("long").alias("n_words"), *bases, accepted.alias("accepted"))

    looked = docs.select(F.col(f"`{id_col}`").alias("id"), let(words(text), look).alias("got")).select("id", "got.*")
    bases = [F.when(F.size(f"base_{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]
    places = F.concat(*[F.col(f"base_{i}") for i in range(len(BASE))])
    base_labels = F.array_sort(F.array_compact(F.array(*bases)))
    found = F.transform("accepted", lambda x: x["label"])
    return looked.select(
        F.col("id").alias(id_col), "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, found))), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("accepted", lambda x: x["share"])), F.lit(0.0)))).alias("score"))
