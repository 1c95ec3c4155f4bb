"""Document quality as a ranking learned from preference pairs.

A text is a vector of surface measures. Of two labelled texts the good one is preferred, and
a Bradley-Terry model explains the preferences: the score of a text is a weighted sum of its
measures, and the probability that one text is preferred to another is the logistic function
of the difference of their scores. The weights minimise the logistic loss on differences of
measures, by Newton's method. Scores alone have no zero, so the bar is a quantile of the
scores of the labelled texts: the one that parts the labels with the fewest errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.llm.shared import slices

#: Bounds of the fit: labelled texts of each kind (those of smallest id hash), and pairs.
SAMPLE_TEXTS, PAIRS = 8000, 100_000
#: The score at the bar, and the largest distance from it on the logistic scale among the labelled texts.
BAR, REACH = 0.3, 30.0
PENALTY, STEPS, CLIP = 1e-4, 50, 10.0
#: Characters of a block of a text, and how far its end may move to a white space; words of a window.
BLOCK, SLACK, WINDOW = 1 << 16, 4096, 64
SPACE = re.compile(r"\s")
#: A word as prose has it: letters, at most the first of them a capital, and perhaps a stop.
PLAIN = re.compile(r"(?<!\S)[^\W\d_][^\W\d_A-Z]*[.,;:?!]?(?!\S)")
#: Byte values counted, by measure.
SETS = {"capitals": range(65, 91), "digits": range(48, 58), "symbols": b"#*$%&|<>", "bangs": b"!", "bars": b"|", "stops": b".", "lines": b"\n", "ats": b"@", "beyond": range(128, 256)}
MEASURES = ("words", "word_bytes", *SETS, "distinct", "adjacent", "duplicates", "plain", "root_symbols", "root_capitals", "root_unlike", "root_repeated", "root_adjacent", "worst_window")


def held_out(id_col: str) -> Column:
    """Rows whose labels are kept from training: CRC-32 of the id as text is 0 modulo 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def blocks(text: str) -> Iterator[str]:
    """The text in blocks that end at a white space where one is near."""
    start = 0
    while start < len(text):
        end = start + BLOCK
        if end < len(text):
            found = SPACE.search(text, end, end + SLACK)
            end = found.start() if found else end
        yield text[start:end]
        start = end


def measured(text: str | None) -> np.ndarray:
    """The measures of a whole text, summed over its blocks."""
    n = plain = adjacent = lines = distinct_lines = windows = 0
    shares, worst, counts = 0.0, 1.0, np.zeros(256)
    for block in blocks(text or ""):
        counts += np.bincount(np.frombuffer(block.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        words = block.split()
        n += len(words)
        plain += sum(1 for _ in PLAIN.finditer(block))
        adjacent += sum(a == b for a, b in pairwise(words))
        own = [x for x in block.split("\n") if x and not x.isspace()]
        lines, distinct_lines = lines + len(own), distinct_lines + len(set(own))
        for i in range(0, len(words), WINDOW):
            window = words[i : i + WINDOW]
            share = len(set(window)) / len(window)
            shares, windows, worst = shares + share, windows + 1, min(worst, share)
    size, each = max(counts.sum(), 1.0), max(n, 1)
    of = {k: counts[list(v)].sum() for k, v in SETS.items()}
    distinct = shares / windows if windows else 1.0
    dense = {k: x / (size if k in ("capitals", "digits", "beyond") else each) for k, x in of.items()}
    rest = (distinct, adjacent / each, (lines - distinct_lines) / max(lines, 1), plain / each)
    roots = (dense["symbols"], dense["capitals"], max(1 - plain / each, 0.0), 1 - distinct, adjacent / each)
    return np.array([np.log1p(n), size / each, *dense.values(), *rest, *np.sqrt(roots), 1 - worst])


@dataclass(frozen=True)
class Ranker:
    """Weights of the scaled measures, the bar, the quantile it stands at, and the scale of the logistic."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bar: float
    quantile: float
    scale: float

    def raw(self, measures: np.ndarray) -> np.ndarray:
        return np.clip((measures - self.mean) / self.spread, -CLIP, CLIP) @ self.weights

    def score(self, measures: np.ndarray) -> np.ndarray:
        """0 to 1; ``BAR`` at the bar."""
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.raw(measures) - self.bar) + np.log(BAR / (1 - BAR)), -700, 700)))


def fit(measures: np.ndarray, good: np.ndarray, weight: np.ndarray) -> Ranker | None:
    """A ranker from labelled measures; ``weight`` is how many labelled texts each row stands for. None without both labels."""
    best, worst = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(best) or not len(worst):
        return None
    mean, spread = measures.mean(0), measures.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    scaled = np.clip((measures - mean) / spread, -CLIP, CLIP)
    draw, most = np.random.default_rng(0), max(len(best), len(worst))
    rounds = max(1, min(PAIRS // most, len(best) * len(worst) // most))
    # Every text is in as many pairs as any other of its label, or one more.
    pick = lambda own: np.concatenate([draw.permutation(np.resize(draw.permutation(own), most)) for _ in range(rounds)])
    pairs = scaled[pick(best)] - scaled[pick(worst)]
    weights = np.zeros(measures.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(pairs @ weights, -30, 30)))
        slope = pairs.T @ p - PENALTY * len(pairs) * weights
        bend = (pairs * (p * (1 - p))[:, None]).T @ pairs + PENALTY * len(pairs) * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    raw = scaled @ weights
    order = np.argsort(raw, kind="stable")
    signed = np.where(good[order], weight[order], -weight[order])
    errors = np.concatenate([[0.0], np.cumsum(signed)])  # what a bar above so many texts costs beside one below all
    errors[1:-1][raw[order][1:] == raw[order][:-1]] = np.inf
    cut = int(errors.argmin())
    ends = np.concatenate([[raw.min()], raw[order], [np.nextafter(raw.max(), np.inf)]])
    bar = (ends[cut] + ends[cut + 1]) / 2 if 0 < cut < len(order) else ends[0 if cut == 0 else -1]
    far = np.abs(raw - bar).max()
    return Ranker(mean, spread, weights, float(bar), float(weight[order][:cut].sum() / weight.sum()), float(min(1.0, REACH / far)) if far else 1.0)


def _measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([measured(t.as_py()).tolist() for t in batch.column(1)], pa.list_(pa.float64()))], names=[id_col, "measures"])

    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return picked.mapInArrow(run, T.StructType([picked.schema[0], T.StructField("measures", T.ArrayType(T.DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_texts: int = SAMPLE_TEXTS) -> Ranker | None:
    """A ranker from the labels of rows that are not held out.

    Of each label the ``sample_texts`` ids of smallest hash are used; only their number is
    bounded, and the counts that weigh them are of all labels. An id with two labels, or
    none, is not used, and of texts with one id the one of smallest measures is.
    """
    own, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    usable = labels.where(own.isNotNull() & label.isin(0, 1) & ~held_out(id_col)).groupBy(own.alias("labelled")).agg(F.min(label).alias("good"), F.max(label).alias("most")).where("good = most")
    counts = {r["good"]: r["n"] for r in usable.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = [F.xxhash64(F.col("labelled").cast("string")), F.col("labelled")]
    first, second = (usable.where(F.col("good") == k).orderBy(*order).limit(sample_texts) for k in (0, 1))
    # At most twice the bound of ids and labels are sent to all tasks.
    picked = docs.select(own, F.col(f"`{text_col}`")).join(F.broadcast(first.union(second).select("labelled", "good")), own == F.col("labelled")).select(F.struct(own.alias("id"), "good").alias("key"), F.col(f"`{text_col}`").alias("text"))
    rows = _measures(picked, "key", "text").groupBy("key").agg(F.min("measures").alias("measures")).orderBy("key.id").collect()
    good = np.array([r["key"]["good"] == 1 for r in rows], bool)
    used = {k: max(1, int((good == k).sum())) for k in (0, 1)}
    return fit(np.array([r["measures"] for r in rows]).reshape(len(rows), len(MEASURES)), good, np.array([counts[int(g)] / used[int(g)] for g in good]))


def rank(docs: DataFrame, ranker: Ranker | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``score`` (0 to 1, higher is better) and ``predicted`` (1 at the bar or above).

    Every text is read whole, block by block. Null texts count as empty ones, which have a
    score like others. Without a ranker, since there were not both labels, every score is
    0.5. Equal texts have equal scores; repeated rows and null ids are rows like others;
    columns other than the id and the text are not read. No rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            made = np.array([measured(t.as_py()) for t in batch.column(1)])
            score = ranker.score(made) if ranker else np.full(len(made), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= BAR).astype(np.int32))], names=[id_col, "score", "predicted"])

    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return picked.mapInArrow(run, T.StructType([picked.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
