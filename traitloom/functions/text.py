"""Texts: white space, Unicode forms, word counts, chunks, scripts, identifiers and dates."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from traitloom.functions.tokens import JS_SPACE

CHUNK_WORDS, OVERLAP_WORDS = 260, 35
#: Scripts and the language code each stands for, tested in this order.
SCRIPTS = (("[\\x{3040}-\\x{30ff}]", "ja"), ("[\\x{ac00}-\\x{d7af}]", "ko"), ("[\\x{0400}-\\x{04ff}]", "ru"), ("[\\x{0590}-\\x{05ff}]", "he"), ("[\\x{0600}-\\x{06ff}]", "ar"),
           ("[\\x{0370}-\\x{03ff}\\x{1f00}-\\x{1fff}]", "el"), ("[\\x{0900}-\\x{097f}]", "sa"), ("[\\x{4e00}-\\x{9fff}]", "zh"))
#: Letters that do not decompose.
LETTERS = {"æ": "ae", "œ": "oe", "ø": "o", "ß": "ss", "ð": "d", "þ": "th", "ł": "l", "đ": "d"}


#: Rows whose texts are Python objects at a time.
ROWS = 256


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, within one row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unicode_form(text: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD. Spark has none of its own; plain ASCII texts never leave the JVM.

    A user function is called for all rows whatever branch it stands in, so ASCII texts go to it as
    nulls. Arrow decomposes the column as it is, without an object for each text.
    """

    @F.arrow_udf("string")
    def convert(values: pa.Array) -> pa.Array:
        if form.endswith("D"):
            return pc.utf8_normalize(values, form)
        # Arrow's composed forms do not compose.
        parts = (values.slice(at, ROWS).to_pylist() for at in range(0, len(values), ROWS))
        made = [pa.array([None if x is None else unicodedata.normalize(form, x) for x in own], pa.string()) for own in parts]
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(convert(F.when(~plain, text)))


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(unicode_form(F.coalesce(text, F.lit("")), "NFC"), JS_SPACE + "+", " "))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), JS_SPACE + "+", " "))


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), JS_SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def normalized_lookup(text: Column) -> Column:
    """The form under which names are looked up: compatibility forms folded, small letters.

    Canonical forms are not made before: they leave runs of blanks as they are, and NFKC makes them.
    """
    return F.lower(unicode_form(collapse_space(text), "NFKC"))


def strip_diacritics(text: Column) -> Column:
    return F.regexp_replace(unicode_form(text, "NFD"), r"\p{M}+", "")


def transliterate(text: Column) -> Column:
    out = text
    for a, b in LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return strip_diacritics(out)


def slug(text: Column) -> Column:
    """Small ASCII letters and digits with hyphens between; ``unknown`` if nothing is left."""
    ascii_only = F.regexp_replace(unicode_form(F.coalesce(text, F.lit("")), "NFKD"), r"[^\x00-\x7F]", "")
    out = F.regexp_replace(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit("unknown")).otherwise(out)


def title_key(text: Column) -> Column:
    """NFKC, small letters; all but letters and digits becomes a blank."""
    return F.trim(F.regexp_replace(F.lower(unicode_form(F.coalesce(text, F.lit("")), "NFKC")), r"[^\p{L}\p{N}]+", " "))


def settled(text: Column, pattern: str, opening: str) -> Column:
    """Without the matches of a pattern, again and again until none is left.

    No nesting is deeper than there are openings; a round that changes nothing ends the work.
    """
    def step(state: Column, _: Column) -> Column:
        shorter = let(F.regexp_replace(state["text"], pattern, ""), lambda t: F.struct(t.alias("text"), (t == state["text"]).alias("done")))
        return F.when(state["done"], state).otherwise(shorter)

    def whole(text: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(text, F.lit(opening))))
        start = F.struct(text.alias("text"), F.lit(False).alias("done"))
        return F.when(text.rlike(opening), F.aggregate(rounds, start, step, lambda state: state["text"])).otherwise(text)

    return let(text, whole)


def strip_parens(text: Column) -> Column:
    """Without parentheses, however deep they are nested, and without the blanks and stops they leave behind."""
    out = settled(text, r"\s*\([^()]*\)", r"\(")
    for pattern, to in ((r"\s+", " "), (r"\s+([,;.])", "$1"), (r"\s*;\s*;\s*", "; "), (r"^[\s,;]+|[\s,;]+$", "")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def chunk_text(text: Column, words: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Paragraphs (at blank lines) in windows of words; the last window of each ends where it ends."""
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p) != "")
    step = words - overlap

    def cut(own: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(own) - words) / F.lit(step)).cast("int"))
        return F.when(F.size(own) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(own, k * step + 1, words), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(paragraphs, lambda p: let(word_list(p), cut)))


def chunk_count(text: Column, words: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """How many chunks :func:`chunk_text` makes of a text."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), r"\n\s*\n")
    each = F.transform(paragraphs, lambda p: let(word_count(p), lambda n: F.when(n > 0, 1 + F.greatest(F.lit(0), F.ceil((n - words) / F.lit(words - overlap)).cast("int"))).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda total, n: total + n)


def script_language(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, code in SCRIPTS:
        out = out.when(text.rlike(pattern), code)
    return out


def record_id(*columns: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the columns as a JSON object with sorted names."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def paragraphs_of_lines(lines: Column) -> Column:
    """Lines joined to paragraphs at blank lines, a hyphen at a line's end taken back."""
    joined = F.array_join(lines, "\n")
    parts = F.filter(F.split(joined, r"\n\s*\n"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"-\n(?=[a-z])", ""), r"\s*\n\s*", " ")))


def cleanup_transcription(text: Column, least_repeats: int = 5, most_chars: int = 60) -> Column:
    """Without page numbers and short lines found five times or more, unwrapped to paragraphs."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x))

    def often(short: Column) -> Column:
        return F.array_distinct(F.filter(short, lambda x, i: F.get(short, i + (least_repeats - 1)) == x))

    def kept(own: Column) -> Column:
        short = F.array_sort(F.filter(own, lambda x: (x != "") & (F.length(x) < most_chars)))
        return let(let(short, often), lambda o: F.filter(own, lambda x: ~x.rlike(r"^[\[(]?\d{1,4}[\])]?$") & ~F.array_contains(o, x)))

    return F.array_join(paragraphs_of_lines(let(lines, kept)), "\n\n")


def iso_format(ts: Column) -> Column:
    """UTC time with an offset; microseconds only if they are not zero."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(base, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def compact_error(text: Column, most: int = 300) -> Column:
    """One line without tags and surplus blanks, cut with an ellipsis."""
    flat = collapse_space(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def looks_wrapped(text: Column) -> Column:
    """Text of 40 lines or more of which over two fifths have 36 to 89 characters and no full stop."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.filter(lines, lambda x: F.length(x).between(36, 89) & ~x.rlike(r"[.!?:;\"')\]]$"))
    return (F.size(lines) >= 40) & (F.size(cut) > 0.4 * F.size(lines))
