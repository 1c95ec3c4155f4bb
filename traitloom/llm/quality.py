"""Document quality by weak supervision.

Rules read a few measures of a text and vote good (1), vote bad (-1) or abstain (0).
Expectation-maximisation over the counted vote patterns estimates how often each rule is
right when it votes, and the share of good documents; the posterior probability of a
document then replaces an all-must-pass filter. Rules for single defects abstain where they
see none: junk of one kind is clean in every other respect, so such votes would outweigh it.
There are at most 3^rules patterns whatever the corpus size, and each step of the
estimation is one aggregation over them.

Everything is DataFrame functions: a text never leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.llm.shared import SPACE, let, materialise

#: ASCII white space, character by character.
SPACES = " \t\n\x0b\x0c\r"
#: Words of a window, for repeats within a text.
WINDOW = 8
#: A text under so many words, or with more than so many percent of repeated words, fails outright.
LEAST_WORDS, MOST_REPEATED = 20, 30
ITERATIONS = 20
#: A word as prose has it: letters, at most the first of them a capital, and perhaps a stop.
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}[\p{Ll}\p{Lo}\p{M}'’-]*[.,;:?!]?(?![^\x20\x09-\x0D])"
KEEP_FROM = 0.5


def window_hashes(hashes: Column) -> Column:
    """A hash of each window of eight consecutive elements, from those of two and of four."""
    def step(x: Column, ahead: int) -> Column:
        return F.zip_with(x, F.slice(x, F.lit(ahead + 1), F.size(x)), lambda a, b: F.xxhash64(a, b))

    return let(step(hashes, 1), lambda two: let(step(two, 2), lambda four: F.slice(step(four, 4), F.lit(1), F.size(four) - (WINDOW - 1))))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of eight that is found twice or more, the first included.

    ``words`` are the hashes of a text's words, and windows are compared by 64-bit hashes of
    these. Most texts repeat none, which one pass finds; else the windows are sorted by hash,
    and the union of the repeated ones is measured.
    """
    hashes = F.when(F.size(words) >= WINDOW, window_hashes(words)).otherwise(F.array().cast("array<bigint>"))

    def places(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return let(ranked, lambda s: F.array_sort(F.transform(F.filter(
            F.transform(s, lambda x, k: F.struct(x["at"].alias("at"), (
                F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["at"])))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get(at, k - 1))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered)))


def measures(text: Column) -> dict[str, Column]:
    """The measures of a text, by name; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    own = let(words, lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(
        F.size(h).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(h).alias("n_repeat_words"),
        F.size(F.array_distinct(h)).cast("long").alias("n_distinct_words"))))
    duplicated = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "word_measures": own, "line_measures": duplicated,
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "n_plain": F.regexp_count(text, F.lit(PLAIN)).cast("long"),
        "n_shouts": F.regexp_count(text, F.lit("!")).cast("long"),
    }


def measured(docs: DataFrame, text: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` and the measures, flattened."""
    found = docs.select(*[c.alias(n) for n, c in keep.items()], *[c.alias(n) for n, c in measures(text).items()])
    return found.select(*keep, "word_measures.*", "line_measures.*", "n_symbols", "n_capitals", "n_plain", "n_shouts")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains; SQL over the measures."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END").cast("tinyint").alias(self.name)


#: Only the first rule speaks for a text; the others report a defect or abstain.
RULES = (
    Rule("plain", "10 * n_plain < 7 * n_words", "10 * n_plain >= 8 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words", "false"),
    Rule("capitals", "10 * n_capitals > 5 * word_chars", "false"),
    Rule("shouts", "10 * n_shouts > 2 * n_words", "false"),
    Rule("repeats", "10 * n_repeat_words > 2 * n_words", "false"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "false"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "false"),
    Rule("variety", "n_words >= 50 AND 10 * n_distinct_words < n_words", "false"),
)
#: Bounds of an estimated accuracy: a rule is better than chance and never certain.
LEAST_ACCURACY, MOST_ACCURACY = 0.55, 0.99


@dataclass(frozen=True)
class Model:
    """The share of good documents and, by rule, how often it is right when it votes."""

    good: float = 0.9
    accuracy: tuple[float, ...] = (0.9,) * len(RULES)

    def posterior(self) -> Column:
        """The probability that a document with these votes is good."""
        good, bad = F.lit(self.good), F.lit(1 - self.good)
        for rule, right in zip(RULES, self.accuracy, strict=True):
            vote = F.col(rule.name)
            good = good * F.when(vote == 1, right).when(vote == -1, 1 - right).otherwise(1.0)
            bad = bad * F.when(vote == -1, right).when(vote == 1, 1 - right).otherwise(1.0)
        return good / (good + bad)


def fit(patterns: DataFrame, iterations: int = ITERATIONS) -> Model:
    """Expectation-maximisation over vote patterns with their counts ``n``; no rows give the start.

    The patterns, of which there are at most 3^rules, become one sorted array, and all steps
    run in one expression over it: a job for each step would cost far more than its sums.
    """
    start = Model()
    votes = F.array(*[F.col(r.name).cast("int") for r in RULES])
    row = patterns.agg(F.array_sort(F.collect_list(F.struct(votes.alias("votes"), F.col("n").cast("double").alias("n")))).alias("patterns"))

    def likelihood(pattern: Column, right: Column, side: int) -> Column:
        factors = F.zip_with(pattern["votes"], right, lambda vote, r: F.when(vote == side, r).when(vote == -side, 1 - r).otherwise(F.lit(1.0)))
        return F.aggregate(factors, F.lit(1.0), lambda product, x: product * x)

    def expected(model: Column) -> Column:
        """Each pattern with the weight of its documents held to be good."""
        def weigh(p: Column) -> Column:
            return let(F.struct((model["good"] * likelihood(p, model["accuracy"], 1)).alias("g"), ((1 - model["good"]) * likelihood(p, model["accuracy"], -1)).alias("b")),
                       lambda w: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * w["g"] / (w["g"] + w["b"])).alias("good")))

        return F.transform("patterns", weigh)

    def total(weighed: Column, value) -> Column:
        return F.aggregate(weighed, F.lit(0.0), lambda so_far, w: so_far + value(w))

    def accuracy(weighed: Column, i: Column) -> Column:
        right = total(weighed, lambda w: F.when(F.get(w["votes"], i) == 1, w["good"]).when(F.get(w["votes"], i) == -1, w["n"] - w["good"]).otherwise(F.lit(0.0)))
        voted = total(weighed, lambda w: F.when(F.get(w["votes"], i) != 0, w["n"]).otherwise(F.lit(0.0)))
        return F.least(F.lit(MOST_ACCURACY), F.greatest(F.lit(LEAST_ACCURACY), (right + 1) / (voted + 2)))

    def step(model: Column, _: Column) -> Column:
        return let(expected(model), lambda w: F.struct(
            ((total(w, lambda x: x["good"]) + 1) / (total(w, lambda x: x["n"]) + 2)).alias("good"),
            F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda i: accuracy(w, i)).alias("accuracy")))

    first = F.struct(F.lit(start.good).alias("good"), F.array(*[F.lit(x) for x in start.accuracy]).alias("accuracy"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), first, step)
    found = row.select(F.when(F.size("patterns") > 0, fitted).alias("model")).first()["model"]
    return Model(found["good"], tuple(found["accuracy"])) if found else start


def fit_votes(found: DataFrame) -> Model:
    """The model of a table of measures."""
    return fit(found.select(*[r.vote() for r in RULES]).groupBy(*[r.name for r in RULES]).agg(F.count("*").alias("n")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the measures, ``base_failed``, ``quality`` (posterior) and ``kept``.

    A null, empty or wordless text fails the base rule. Repeated rows are judged alike, each
    by its own text. Null ids stay null. No rows give no rows. Other columns are not read,
    whatever their names. A very long text is one row's work, and its words' hashes are held
    at once. A posterior of exactly KEEP_FROM keeps. Repeated windows are told by their hashes.
    """
    found = materialise(measured(docs, F.col(f"`{text_col}`"), {"id": F.col(f"`{id_col}`")}), "measures")
    model = fit_votes(found)
    voted = found.select("*", *[r.vote() for r in RULES]).withColumn("quality", model.posterior()).withColumn("base_failed", base_failed())
    return voted.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with the columns of ``docs``, whatever their names; rows with null ids are rows like others."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = materialise(measured(docs, F.col(f"`{text_col}`"), {"row": row}), "measured")
    model = fit_votes(found)
    voted = found.select("*", *[r.vote() for r in RULES])
    kept = voted.where(~base_failed() & (model.posterior() >= KEEP_FROM))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
