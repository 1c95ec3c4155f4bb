"""Secrets in texts: fixed patterns, and long strings that look random.

A character Markov model of random strings, learned from what the patterns matched, and one
of ordinary words and identifiers, learned from those of a bounded sample of documents, score every long string by
their log-likelihood ratio per character. Everything is DataFrame functions.

Places are found by splitting a text with the pattern that also extracts its matches: the
lengths of the parts between and of the matches add up to the places.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.shared import let, materialise

#: The patterns of the base kinds, in the order in which kinds sort.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Strings that the model scores, their alphabet (index 0 is any other character), and the least mean ratio in bits.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
STATES = len(ALPHABET) + 1
LEAST_BITS = 0.75
#: Documents, by smallest id hash, whose words stand for ordinary strings; and smoothing counts.
SAMPLE_DOCS, SMOOTHING, FALL_BACK = 4000, 0.5, 8.0
#: What labels a string as ordinary: words in small letters, perhaps with a capital, or in capitals, and such words joined.
ORDINARY = r"^(?:[A-Z]?[a-z]+|[A-Z]+)(?:[_.=/-](?:[A-Z]?[a-z]+|[A-Z]+))*[.]?$"
#: Elements of a block of a running total, and a place beyond any text.
BLOCK, FAR = 128, (1 << 31) - 1
EMPTY = "array<struct<start:int,kind:int,end:int,value:string>>"


def running(values: Column, start, combine) -> Column:
    """The running total of an array under ``combine``, in blocks: an array grown by one costs its length each time."""
    def along(own: Column, first: Column) -> Column:
        grown = F.struct(first.alias("last"), F.array().cast("array<int>").alias("out"))

        def step(state: Column, x: Column) -> Column:
            return let(combine(state["last"], x), lambda now: F.struct(now.alias("last"), F.concat(state["out"], F.array(now)).alias("out")))

        return F.aggregate(own, grown, step, lambda state: state["out"])

    def blocks(own: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda k: F.slice(own, k * BLOCK + 1, BLOCK))
        return let(cut, lambda c: let(along(F.transform(c, lambda x: F.aggregate(x, F.lit(start), combine)), F.lit(start)), lambda ends: F.flatten(
            F.transform(c, lambda x, k: along(x, F.when(k == 0, F.lit(start)).otherwise(F.get(ends, k - 1)))))))

    return let(values, lambda own: F.when(F.size(own) > BLOCK, blocks(own)).otherwise(along(own, F.lit(start))))


def places(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """The matches of a pattern as structs (start, kind, end, value), in order."""
    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x))
        ends = running(F.zip_with(gaps, found, lambda gap, x: gap + F.length(x)), 0, lambda so_far, x: so_far + x)
        value = (lambda x: F.regexp_extract(x, pattern, group)) if group else (lambda x: x)
        return F.zip_with(ends, found, lambda end, x: F.struct((end - F.length(x)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value(x).alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(EMPTY)))


def clear_of(candidates: Column, base: Column) -> Column:
    """The candidates that overlap no base place: none before reaches into them, none after begins in them."""
    def sifted(m: Column) -> Column:
        reach = running(F.transform(m, lambda x: F.when(x["rank"] == 0, x["place"]["end"]).otherwise(0)), 0, lambda a, x: F.greatest(a, x))
        ahead = F.reverse(running(F.reverse(F.transform(m, lambda x: F.when(x["rank"] == 0, x["start"]).otherwise(FAR))), FAR, lambda a, x: F.least(a, x)))
        told = F.zip_with(F.zip_with(m, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach"))), ahead, lambda x, n: F.struct(x["x"].alias("x"), x["reach"].alias("reach"), n.alias("ahead")))
        clear = F.filter(told, lambda t: (t["x"]["rank"] == 1) & (t["reach"] <= t["x"]["start"]) & (t["ahead"] >= t["x"]["place"]["end"]))
        return F.transform(clear, lambda t: t["x"]["place"])

    ranked = lambda own, rank: F.transform(own, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x.alias("place")))
    merged = F.array_sort(F.concat(ranked(base, 0), ranked(candidates, 1)))
    return F.when((F.size(candidates) > 0) & (F.size(base) > 0), let(merged, sifted)).otherwise(candidates)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``base`` places and ``candidates`` of every row, in one reading of the texts."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    assign = F.filter(places(text, ASSIGN, 0, 1), lambda x: F.length(x["value"]) >= LEAST_ASSIGN)
    access = F.filter(places(text, ACCESS, 1), lambda x: F.length(x["value"]) >= LEAST_ACCESS)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.concat(assign, access, places(text, HEX, 2)).alias("base"),
                       places(text, CANDIDATE, 3).alias("candidates"))


def _codes(value: Column) -> Column:
    """The places of a string's characters in the alphabet. The string is cut up once: asking for one place after another walks to it from the start each time."""
    return F.transform(F.split(value, ""), lambda x: F.instr(F.lit(ALPHABET), x))


def _transitions(strings: DataFrame, label: int) -> DataFrame:
    """Counts of (label, from * STATES + to) over ``strings`` (value, n)."""
    coded = strings.where(F.length("value") >= 2).select("n", _codes(F.col("value")).alias("c"))
    cells = coded.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * STATES + F.get("c", i + 1))).alias("cell"))
    return cells.groupBy(F.lit(label).alias("label"), "cell").agg(F.sum("n").alias("n"))


def train(scanned: DataFrame, docs: DataFrame, id_col: str, text_col: str, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """The table of log-likelihood ratios in bits by (from, to); it has STATES squared entries."""
    random = scanned.select(F.explode("base.value").alias("value")).groupBy("value").agg(F.lit(1).alias("n"))
    order = F.xxhash64(F.col(f"`{id_col}`").cast("string"))
    last = docs.select(order.alias("o")).distinct().orderBy("o").limit(sample_docs).agg(F.max("o")).first()[0]
    words = docs.where(order <= F.lit(last).cast("long")).select(F.explode(F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), r"[^A-Za-z0-9+/_=.-]+")).alias("value"))
    ordinary = words.where((F.length("value") >= 4) & F.col("value").rlike(ORDINARY)).groupBy("value").agg(F.count("*").alias("n")).join(random.select("value"), "value", "left_anti")
    counts = [[0.0] * STATES**2 for _ in range(2)]
    for row in _transitions(random, 0).unionByName(_transitions(ordinary, 1)).collect():
        counts[row["label"]][row["cell"]] += row["n"]
    return _ratios(*map(_smoothed, counts))


def _smoothed(counts: list[float]) -> list[float]:
    """Transition probabilities; a rare state falls back on how common the next character is."""
    total = sum(counts)
    common = [(sum(counts[j::STATES]) + SMOOTHING) / (total + SMOOTHING * STATES) for j in range(STATES)]
    seen = [sum(counts[i * STATES : (i + 1) * STATES]) for i in range(STATES)]
    return [(n + FALL_BACK * common[k % STATES]) / (seen[k // STATES] + FALL_BACK) for k, n in enumerate(counts)]


def _ratios(random: list[float], ordinary: list[float]) -> list[float]:
    return [math.log2(a / b) for a, b in zip(random, ordinary, strict=True)]


def mean_bits(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio, random against ordinary, of the transitions of a string."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    return let(_codes(value), lambda c: F.aggregate(
        F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda total, i: total + F.get(table, F.get(c, i) * STATES + F.get(c, i + 1))) / (F.size(c) - 1))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per row: the id, ``base`` and ``found`` (arrays of start, kind, end, value), ``n_assign``,
    ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` (all, as kind:start:end).

    Places count code points and end exclusively. A string that overlaps a base place is not
    scored. A null or empty text has no places; its digest is that of the empty string. With
    nothing to learn from, all ratios are zero and nothing is added. Repeated rows and null
    ids are rows like others, and so are rows of equal ids; columns other than the id and the
    text are not read, whatever their names. No rows give no rows. A very long text is one
    row's work: its places are counted in blocks, in time proportional to their number.
    """
    scanned = materialise(scan(docs, id_col, text_col), "places")
    model = train(scanned, docs, id_col, text_col, sample_docs)
    added = F.filter(clear_of(F.col("candidates"), F.col("base")), lambda c: mean_bits(c["value"], model) >= LEAST_BITS)
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")
    return scanned.withColumn("found", added).select(
        F.col("id").alias(id_col), "base", "found", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "found")).alias("spans"))
