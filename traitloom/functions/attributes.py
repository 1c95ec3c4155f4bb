"""What an article says of a figure's objects, animals, character and looks.

Infobox fields come first, then wordings, then words of fixed lists in their order; a word
that something found before already holds is left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitloom.functions.text import let

#: The infobox fields, wordings and words by which objects are told.
OBJECT_FIELDS = ("symbol", "symbols", "weapons", "weapon", "attributes")
OBJECT_WORDINGS = (
    r"(?:symbol(?:s|ized)?|attribute(?:s)?|emblem(?:s)?) (?:include|are|is|were|was|:) ([^.]{5,100})",
    r"(?:wield(?:s|ed)?|carri(?:es|ed)|bore|bears|brandish(?:es|ed)) (?:a |an |the )?([^.,]{3,60})",
    r"(?:armed with|equipped with) ([^.,]{3,60})",
    r"(?:sacred|holy) (?:to .+? )?(?:are|is|were|was) ([^.,]{3,60})",
)
OBJECTS = "thunderbolt|trident|spear|sword|shield|bow|arrows?|hammer|aegis|scepter|staff|crown|helmet|chariot|lyre|caduceus|cornucopia|torch|mirror|flail|ankh|conch|discus|mace|net"
#: The infobox fields and words by which animals are told, what anywhere in a text lets an animal count, and what near it does.
ANIMAL_FIELDS = ("mount", "animal", "animals")
ANIMALS = (
    "eagle", "owl", "serpent", "snake", "bull", "horse", "lion", "deer", "stag", "dove", "swan", "raven", "crow", "hawk", "falcon", "vulture", "peacock", "dolphin", "fish", "whale", "ram", "goat", "pig", "boar",
    "wolf", "dog", "cat", "jaguar", "panther", "bear", "hare", "rabbit", "tortoise", "turtle", "scorpion", "spider", "bee", "ant", "butterfly", "rooster", "cock", "hen", "sparrow", "crane", "heron", "ibis", "scarab",
    "jackal", "crocodile", "hippopotamus", "cow", "ox", "donkey", "monkey", "elephant", "tiger", "dragon", "phoenix", "griffin", "sphinx", "centaur", "minotaur", "pegasus", "unicorn", "chimera", "hydra", "cerberus",
    "feathered serpent", "quetzal",
)
ANIMAL_SIGNS = ("symbol", "depicted as", "transformed into", "accompanied by", "mount")
ANIMAL_FRAMES = (("sacred ", ""), ("", " was sacred"), ("associated with ", ""), ("rode a ", ""), ("", " form"))
NEAR_ANIMAL = "sacred|symbol|attribute|associated|depicted|transform|shape|form|accompan|mount|rode|chariot|pull"
#: Wordings and words of character, and what stands before such a word.
TRAIT_WORDINGS = (r"(?:known|renowned|famous|noted|celebrated) (?:for |as )(?:being |having )?(?:a |an |the )?([^.,]{3,60})", r"(?:characterized|distinguished|marked) by (?:his |her |their )?([^.,]{3,60})")
TRAIT_STATED = r"(?:was|is) (?:a |an )?(?:wise|cunning|brave|fierce|beautiful|just|merciful|wrathful|jealous|loyal|treacherous|proud|humble|patient|compassionate|deceitful|trickster|shapeshifter)[^.,]*"
TRAITS = (
    "wise", "cunning", "brave", "fierce", "beautiful", "just", "merciful", "wrathful", "jealous", "loyal", "treacherous", "proud", "humble", "patient", "compassionate", "deceitful", "trickster", "shapeshifter",
    "benevolent", "malevolent", "protective", "nurturing", "warlike", "peaceful", "strategic", "intelligent", "creative", "prophetic", "healing", "vengeful", "seductive", "virginal", "chaste", "civilizing",
    "destructive", "chaotic", "orderly",
)
BEFORE_TRAIT = r"\b(was|is|being|known|described|considered|regarded|depicted|portrayed)\b"
#: Wordings and words of looks.
LOOK_WORDINGS = (
    r"depicted (?:as|with) ([^.]{5,80})", r"portrayed (?:as|with) ([^.]{5,80})", r"described as ([^.]{5,80})", r"represented (?:as|with) ([^.]{5,80})", r"appears? (?:as|in the form of) ([^.]{5,80})",
    r"(?:took|takes|assumed) the (?:form|shape) of ([^.]{5,60})", r"(?:had|has|with) (?:a |an )?([^.]*?(?:head|body|wings?|tail|eyes?|arms?|hands?|skin|hair|beard)[^.]{0,40})",
)
LOOKS = (
    "blue-skinned", "four-armed", "three-eyed", "one-eyed", "winged", "horned", "bearded", "helmeted", "armored", "crowned", "veiled", "beautiful", "monstrous", "giant", "dwarf", "serpentine", "radiant", "luminous",
    "golden", "green-skinned", "half-human", "animal-headed", "hawk-headed", "jackal-headed", "ibis-headed", "lion-headed", "ram-headed", "cobra", "feathered",
)


def _listed(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def _fields(box: Column, names: tuple[str, ...]) -> Column:
    return F.filter(F.transform(_listed(names), lambda n: F.coalesce(F.try_element_at(box, n), F.lit(""))), lambda x: x != "")


def _said(text: Column, patterns: tuple[str, ...], least: int, most: int, trimmed: bool = True) -> Column:
    """The first find of each wording, if its length is within bounds."""
    found = F.array(*[F.regexp_extract(text, f"(?i){p}", 1) for p in patterns])
    return F.filter(F.transform(found, lambda x: F.btrim(x, F.lit(" \t\n\r\f\v "))) if trimmed else found, lambda x: F.length(x).between(least, most))


def _with_new(parts: Column, words: Column, counts) -> Column:
    """``parts`` and behind them each word that counts and that none so far holds."""
    return F.aggregate(words, parts, lambda held, w: F.when(counts(w) & ~F.exists(held, lambda p: F.contains(F.lower(p), w)), F.concat(held, F.array(w))).otherwise(held))


def _joined(parts: Column) -> Column:
    return F.nullif(F.array_join(parts, ", "), F.lit(""))


def _around(text: Column, word: Column, before: int, after: int) -> Column:
    """What stands around the first place of a word: so many characters before it, and from it on its length and ``after`` more."""
    return let(F.instr(text, word), lambda at: F.substr(text, F.greatest(F.lit(1), at - before), F.least(at - 1, F.lit(before)) + (F.length(word) + after if after else F.lit(0))))


def _with_lower(text: Column, most: int) -> Column:
    """A text, and its first letters in small ones: what many words are looked for in is made once."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(whole.alias("text"), F.substring(F.lower(whole), 1, most).alias("lower"))


def objects(box: Column, text: Column) -> Column:
    own = _fields(box, OBJECT_FIELDS)

    def found(text: Column) -> Column:
        parts = F.concat(own, F.array_except(_said(text, OBJECT_WORDINGS, 3, 80), own))
        weapons = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b({OBJECTS})\b"), F.lit(1)), F.lower))
        return _with_new(parts, weapons, lambda w: F.lit(True))

    return _joined(let(F.coalesce(text, F.lit("")), found))


def animals(box: Column, text: Column) -> Column:
    """Animals that an article names where something tells that they belong to the figure."""
    def found(lower: Column) -> Column:
        anywhere = F.exists(_listed(ANIMAL_SIGNS), lambda s: F.contains(lower, s))

        def counts(w: Column) -> Column:
            framed = F.exists(F.array(*[F.concat(F.lit(a), w, F.lit(b)) for a, b in ANIMAL_FRAMES]), lambda f: F.contains(lower, f))
            return F.contains(lower, w) & F.regexp_like(lower, F.concat(F.lit(r"\b"), w, F.lit(r"s?\b"))) & (anywhere | framed | _around(lower, w, 50, 50).rlike(NEAR_ANIMAL))

        return _with_new(_fields(box, ANIMAL_FIELDS), _listed(ANIMALS), counts)

    return _joined(let(F.lower(F.coalesce(text, F.lit(""))), found))


def character(text: Column) -> Column:
    """Up to five traits of character: wordings first, then words that something said of the figure leads to, in the first 2000 letters."""
    def found(k: Column) -> Column:
        text, lower = k["text"], k["lower"]
        stated = F.btrim(F.regexp_replace(F.regexp_extract(text, f"(?i)({TRAIT_STATED})", 1), "(?i)^.*(?:was|is) (?:a |an )?", ""), F.lit(" \t\n\r\f\v "))
        said = F.concat(_said(text, TRAIT_WORDINGS, 3, 60, trimmed=False), F.filter(F.array(stated), lambda x: F.length(x).between(3, 60)))
        told = F.filter(_listed(TRAITS), lambda w: F.contains(lower, w) & _around(lower, w, 30, 0).rlike(BEFORE_TRAIT))
        return F.slice(F.array_distinct(F.concat(said, told)), 1, 5)

    return _joined(let(_with_lower(text, 2000), found))


def looks(text: Column) -> Column:
    """Up to four words on a figure's looks: wordings first, then words of the first 3000 letters."""
    def found(k: Column) -> Column:
        return F.slice(_with_new(F.array_distinct(_said(k["text"], LOOK_WORDINGS, 5, 80)), _listed(LOOKS), lambda w: F.contains(k["lower"], w)), 1, 4)

    return _joined(let(_with_lower(text, 3000), found))
