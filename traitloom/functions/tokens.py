"""Trait tokens in delimited text: splitting, stop rules, synonyms and plural stems.

All are Column functions built from Spark's own, so they run inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings that are taken off a token once.
PREFIXES = ("goddess of ", "god of ", "the ", "patron of ", "patroness of ", "protector of ", "guardian of ", "personification of ", "spirit of ", "muse of ", "deity of ")
#: Words that are no names though they may have a capital.
KEEP_LOWER = ("nile",)
#: White space as JavaScript sees it; Java's own class lacks the no-break space and the byte order mark.
JS_SPACE = r"[\s\p{Z}\x{FEFF}]"


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer knows: words to drop, patterns to drop, synonyms, and super-categories.

    The lists are parameters, since they belong to a dataset.
    """

    stop: tuple[str, ...] = ()
    stop_patterns: tuple[str, ...] = ()
    synonyms: dict[str, str] = field(default_factory=dict)
    supersets: dict[str, dict[str, str]] = field(default_factory=dict)


def _map(values: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def _synonym(token: Column, vocabulary: Vocabulary) -> Column:
    return F.try_element_at(_map(vocabulary.synonyms), token)


def normalize_token(token: Column, vocabulary: Vocabulary) -> Column:
    """Synonym; else one prefix off and synonym; else a plain plural's stem, by its synonym if it has one."""
    lowered = F.lower(F.trim(token))
    shorter = F.trim(F.regexp_replace(lowered, "^(?:" + "|".join(PREFIXES) + ")", ""))
    bare = F.when(F.length(shorter) >= 2, shorter).otherwise(lowered)
    stem = F.substring(bare, 1, F.length(bare) - 1)
    plural = (F.length(bare) >= 4) & bare.rlike("s$") & ~bare.rlike("(?:ss|us|is|os|as)$")
    return F.coalesce(_synonym(lowered, vocabulary), _synonym(bare, vocabulary), F.when(plural, F.coalesce(_synonym(stem, vocabulary), stem)), bare)


def raw_tokens(text: Column) -> Column:
    """The trimmed parts between commas and semicolons, as facets use them; empty parts go."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def tokenize(text: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Normalised tokens of 2 to 59 characters in first-seen order, without stop words; null gives none."""
    lowered = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]+"), lambda x: F.lower(F.trim(x)))

    def wanted(x: Column) -> Column:
        keep = F.length(x).between(2, 59)
        if vocabulary.stop:
            keep = keep & ~x.isin(*vocabulary.stop)
        if vocabulary.stop_patterns:
            keep = keep & ~x.rlike("(?i)" + "|".join(f"(?:{p})" for p in vocabulary.stop_patterns))
        return keep

    normal = F.transform(F.filter(lowered, wanted), lambda x: normalize_token(x, vocabulary))
    return F.array_distinct(F.filter(normal, lambda x: F.length(x) > 1))


def type_label(value: Column) -> Column:
    return F.replace(value, F.lit("_"), F.lit(" "))


def superset_of(category: str, token: Column, vocabulary: Vocabulary, other: str) -> Column:
    return F.coalesce(F.try_element_at(_map(vocabulary.supersets.get(category, {})), token), F.lit(other))


def strip_the(text: Column) -> Column:
    """Takes "the" off the parts of a list, unless a name follows: a word with a capital, but for those in KEEP_LOWER."""
    return F.regexp_replace(text, rf"(^|[,;]\s*)[Tt][Hh][Ee]\s+(?=[^,;\s])(?:(?![A-Z])|(?=(?i:{'|'.join(KEEP_LOWER)})(?:[\s,;-]|$)))", "$1")


def strip_tokens(text: Column, drop: list[str]) -> Column:
    """The parts of a list but those named, whatever their case, joined by comma and blank."""
    return F.array_join(F.filter(raw_tokens(text), lambda x: ~F.lower(x).isin(*drop)), ", ")


def remap_array(values: Column, mapping: dict[str, str]) -> Column:
    """Each value mapped (unknown ones kept), empty ones dropped, first occurrences kept."""
    mapped = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.coalesce(F.try_element_at(_map(mapping), x), x))
    return F.array_distinct(F.filter(mapped, lambda x: x != ""))


def remap_value(value: Column, drop: list[str], exact: dict[str, list[str]], patterns: list[tuple[str, list[str]]]) -> Column:
    """A value's replacements: none if dropped, the exact ones, those of the first matching pattern, or itself."""
    out = F.when(value.isin(*drop), F.array().cast("array<string>")) if drop else F.when(F.lit(False), F.array().cast("array<string>"))
    for key, new in exact.items():
        out = out.when(value == key, F.array(*map(F.lit, new)))
    for pattern, new in patterns:
        out = out.when(value.rlike(pattern), F.array(*map(F.lit, new)))
    return out.otherwise(F.array(value))


def merge_trait(text: Column, old: list[str], new: str) -> Column:
    """A delimited field with the tokens ``old`` renamed to ``new``, order kept, repeats dropped."""
    renamed = F.transform(raw_tokens(text), lambda x: F.when(F.lower(x).isin(*old), F.lit(new)).otherwise(x))
    return F.array_join(F.array_distinct(renamed), ", ")


def replace_in_array(values: Column, old: str, new: str) -> Column:
    return F.transform(values, lambda x: F.when(x == old, F.lit(new)).otherwise(x))


def union_normalized(left: Column, right: Column) -> Column:
    """``left`` and those of ``right`` whose letters and digits it lacks, in order."""
    bare = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    both = F.concat(left, right)
    return F.filter(both, lambda x, i: F.array_position(F.transform(both, bare), bare(x)) == i + 1)


def normal_name(name: Column) -> Column:
    """Small letters and digits of a name."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")
