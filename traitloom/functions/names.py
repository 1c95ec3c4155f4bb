"""Names of figures and what stands about them in prose: variants, kin, events and identifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitloom.functions.text import let, unicode_form

#: Letters of two transliterations that do not decompose, or not so.
PLAIN_LETTERS = {"ð": "d", "þ": "th", "ø": "o"}
INDIC_LETTERS = {"ṣ": "sh", "ś": "sh", "ṛ": "ri"}
#: Peoples and articles that stand before a name.
EPITHETS = ("greek", "roman", "egyptian", "hindu", "chinese", "japanese", "norse", "aztec", "maya", "celtic", "sumerian", "babylonian", "canaanite", "hittite", "deified", "the")
#: Words of kinship that stand for themselves.
KIN = ("mother", "father", "sister", "brother", "son", "daughter", "husband", "wife", "spouse", "consort", "grandfather", "grandmother", "grandson", "granddaughter", "uncle", "aunt", "nephew", "niece",
       "cousin", "twin", "stepmother", "stepfather", "stepson", "stepdaughter", "stepsister", "stepbrother", "in-law", "father-in-law", "mother-in-law", "ancestor", "descendant", "progenitor", "offspring",
       "child", "half-sister", "half-brother", "half-sibling", "sibling")
#: Kin that "of" may follow.
KIN_OF = ("mother", "father", "son", "daughter", "wife", "husband", "sister", "brother", "sibling", "consort", "spouse", "twin")
#: What is too general to be someone's kin.
GENERAL = ("men", "women", "gods", "goddesses", "people", "humans", "humanity", "mankind", "mortals", "believers", "all", "all things", "everything", "world", "earth", "heaven", "sky", "sea", "sun", "moon",
           "stars", "life", "death", "day", "night", "light", "darkness", "fire", "water", "wind", "time", "souls", "spirits", "children", "sons", "daughters", "humans and gods", "gods and men")
#: Where a title that is no kinship belongs, by words in it.
TITLES = ((r"-god|-goddess|deity|lord|sovereign", "domain (or identification)"), (r"warrior|priest|king|queen|prince|princess|hero|sage|trickster", "character_trait"),
          (r"buddha|christ|messiah|emanation|aspect", "identification"))
#: Words that make an event a statement of identity.
IDENTITY = r"\b(?:deity|sovereign|supreme|lord|identified|paralleled|state-cult|state-deity|primal-being|cosmic-primal|founder|principle)\b"
#: Wordings that say that two figures are one.
IDENTIFIED = (r"\bidentified\s+with\b", r"\bequated\s+with\b", r"\bequivalent\s+(?:of|to)\b", r"\bsynonymous\s+with\b", r"\bcognate\s+(?:of|with)\b", r"\banother\s+name\s+for\b", r"\balso\s+known\s+as\b",
              r"\bsame\s+as\b", r"\bassimilated\s+(?:to|with)\b", r"\bcorresponds?\s+to\b", r"\bmerged\s+with\b", r"\bidentif(?:ied|ication)\b")


#: How a spouse field begins, what in it says that spouses are siblings, and what is no name.
SPOUSE_OF = (r"(?i)^(?:wife of |husband of |wife-sister of |husband-brother of |sister-brother to |brother-sister to )", "(?i)^(?:former wife of |former husband of )")
SIBLINGS = r"\(.*(?:sister|brother).*\)|sister-brother|brother-sister|wife-sister|husband-brother"
ASIDE = r"(?i)^(?:his|her|in homer|in hesiod|then separated|after |importing |with sons? |with daughters? |in some|popular tradition|by .* in )"


def _replaced(text: Column, letters: dict[str, str]) -> Column:
    for a, b in letters.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def bare_letters(text: Column) -> Column:
    """Small letters without marks."""
    return F.lower(F.regexp_replace(unicode_form(_replaced(text, PLAIN_LETTERS), "NFD"), r"[\x{0300}-\x{036f}]", ""))


def name_variants(name: Column) -> Column:
    """The spellings under which a name is found: without marks, as Indic letters are read, and with v and w exchanged."""
    indic = bare_letters(_replaced(F.lower(name), INDIC_LETTERS))
    return let(F.array(bare_letters(name), indic), lambda own: F.array_distinct(F.concat(own, F.flatten(F.transform(own, lambda x: F.array(F.translate(x, "v", "w"), F.translate(x, "w", "v")))))))


def plain_name(name: Column) -> Column:
    """A name without the people it belongs to, marks, capitals and all but letters, digits and blanks."""
    own = F.regexp_replace(F.coalesce(name, F.lit("")), "(?i)^(?:" + "|".join(EPITHETS) + r")\s+", "")
    marks = F.regexp_replace(unicode_form(own, "NFD"), r"[\x{0300}-\x{036f}]", "")
    return F.trim(F.lower(F.regexp_replace(marks, "[^a-zA-Z0-9 ]", "")))


def letters_and_digits(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def family_role(value: Column, fields: dict[str, Column]) -> Column:
    """What to do with a value of a family field: (action, bare, of_whom, field).

    A word of kinship is kept; "mother of X" is stripped to the word and X; a title found in
    another of ``fields``, whole or by its last one or two words, is a duplicate; any other
    is to move to the field its words suggest.
    """
    v = F.trim(value)
    lower = F.lower(v)
    relation = r"(?i)^(?:the\s+)?(" + "|".join(KIN_OF) + r")\s+(?:(?:brother|sister)\s+)?of\s+(.+)$"
    relation_of = F.lower(F.regexp_extract(v, relation, 1))
    words = F.filter(F.split(lower, r"[\s,;]+"), lambda t: F.length(t) > 2)
    tails = F.array(F.array_join(F.slice(words, -2, 2), " "), F.element_at(F.concat(F.array(F.lit("")), words), -1))
    found = F.lit(None).cast("string")
    for name, text in reversed(fields.items()):
        own = F.lower(F.coalesce(text, F.lit("")))
        inside = F.contains(own, lower) | F.exists(F.filter(tails, lambda t: F.length(t) >= 4), lambda t: F.contains(own, t))
        found = F.when((own != "") & inside, F.lit(name)).otherwise(found)
    move = F.lit("domain")
    for pattern, field in reversed(TITLES):
        move = F.when(lower.rlike(pattern), F.lit(field)).otherwise(move)
    null = F.lit(None).cast("string")
    row = lambda action, bare=null, whom=null, field=null: F.struct(F.lit(action).alias("action"), bare.alias("bare"), whom.alias("of_whom"), field.alias("field"))
    return (F.when(lower.isin(*KIN), row("KEEP")).when(v.rlike(relation), row("STRIP_TO_BARE", relation_of, F.trim(F.regexp_extract(v, relation, 2))))
            .when(found.isNotNull(), row("TITLE_DUP", field=found)).otherwise(row("TITLE_MOVE", field=move)))


def kin_targets(rest: Column) -> Column:
    """The names in "X, the Y and Z": two to sixty characters, none of them general."""
    parts = F.split(F.trim(F.regexp_replace(rest, r"\([^)]*\)", "")), r"\s+and\s+|,|;")
    named = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"(?i)^\s*(?:the|a|an)\s+", "")))
    return F.filter(named, lambda x: F.length(x).between(2, 60) & ~F.lower(x).isin(*GENERAL))


def spouse_hints(raw: Column) -> Column:
    """(hints, also_sibling): the names a spouse field holds, and whether it says that they are siblings too."""
    lower = F.lower(F.trim(raw))
    sibling = lower.rlike(SIBLINGS)
    times = F.regexp_extract(raw, r"(?i)married\s+\w+\s+times?\s*\(([^)]+)\)", 1)
    listed = F.filter(F.transform(F.split(times, r",|;|\sand\s"), lambda x: F.trim(x)), lambda x: x != "")
    body = F.regexp_replace(F.regexp_replace(raw, SPOUSE_OF[0], ""), SPOUSE_OF[1], "")
    parts = F.split(F.trim(F.regexp_replace(body, r"\([^)]*\)", " ")), r"\s+and\s+|,|;|\s*/\s*")
    clean = F.transform(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.trim(F.regexp_replace(x, r"(?i)^the\s+", "")))
    hints = F.filter(clean, lambda x: ((F.length(x) > 1) & ~x.rlike(ASIDE)) | x.rlike(r"^[A-ZÀ-Ÿ]"))
    return F.when(times != "", F.struct(listed.alias("hints"), F.lit(False).alias("also_sibling"))).otherwise(F.struct(hints.alias("hints"), sibling.alias("also_sibling")))


def event_type(value: Column) -> Column:
    """(action, bucket) of an event's wording, by its beginning, its words and its hyphens."""
    v = F.trim(value)
    hyphens = F.length(v) - F.length(F.replace(v, F.lit("-"), F.lit("")))
    row = lambda action, bucket: F.struct(F.lit(action).alias("action"), F.lit(bucket).alias("bucket"))
    return (F.when(v.rlike("(?i)^the-"), row("REJECT", "the-prefix")).when(F.lower(v).rlike(IDENTITY), row("REJECT", "identity-keyword")).when(hyphens >= 4, row("REJECT", "4+ hyphens"))
            .when(hyphens == 3, row("REVIEW", "3 hyphens")).otherwise(row("KEEP", "1-2 hyphens")))


def says_identified(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(IDENTIFIED))
