"""Wiki text and pages as Markdown, and what an encyclopedia's article holds: infobox, sections, kin, tradition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitloom.functions.markup import to_markdown
from traitloom.functions.text import let, settled
from traitloom.functions.web import COMMENT, clean_wikitext, strip_boilerplate, unescape_html

#: Sections with which an article's body ends.
LAST_SECTIONS = ("See also", "References", "External", "Notes", "Sources", "Bibliography", "Further")
#: Traditions and the words of an article's beginning that tell them, in this order.
TRADITIONS = (("Norse", ("norse mythology", "norse god", "old norse", "edda", "asgard")), ("Egyptian", ("egyptian mythology", "egyptian god", "ancient egypt")),
              ("Hindu", ("hindu mythology", "hinduism", "vedic", "mahabharata", "ramayana")), ("Shinto", ("shinto", "japanese mythology", "kami")),
              ("Sumerian", ("sumerian", "mesopotamian", "babylonian", "akkadian")), ("Aztec", ("aztec", "nahua", "mesoamerican")), ("Celtic", ("celtic mythology", "irish mythology", "welsh mythology")),
              ("Roman", ("roman mythology", "roman god", "roman religion")), ("Chinese", ("chinese mythology", "chinese legend")), ("Slavic", ("slavic mythology",)),
              ("Finnish", ("finnish mythology", "kalevala")), ("Arthurian", ("arthurian", "king arthur", "camelot")))
#: Infobox fields of kin and the relation of the figure to those named.
KIN_FIELDS = (("parents", "child of"), ("father", "child of"), ("mother", "child of"), ("consort", "married to"), ("spouse", "married to"), ("siblings", "sibling of"), ("children", "parent of"), ("offspring", "parent of"))


#: Infobox fields and wordings that tell a figure's domain, and words that are none.
DOMAIN_FIELDS = ("god_of", "godof", "role", "sphere", "domain")
DOMAIN_WORDINGS = (r"(?:god(?:dess)?|deity|personification|patron|guardian|spirit|titan) (?:of|associated with) ([^.]{3,80})", r"(?:god|goddess) of ([^.,]{3,60})", r"the (?:god|goddess) of ([^.,]{3,60})",
                   r"personification of ([^.,]{3,60})", r"(?:patron(?:ess)?|protector|guardian) of ([^.,]{3,60})", r"(?:muse|nymph|spirit) of ([^.,]{3,60})", r"presided over ([^.,]{3,60})", r"associated with ([^.,]{3,60})", r"represented ([^.,]{3,60})")
LITTLE_WORDS = ("the", "a", "an", "and", "or", "in", "to", "of", "for", "with", "by", "as", "is", "was", "were", "are", "has", "had", "have", "being", "who", "which", "that")
#: Wordings of births, deaths, fame and deeds, and the sections that tell a myth.
BORN = r"born (?:of|from|to)|(?:son|daughter|child|offspring) of|born when|sprang from|emerged from|created from|arose from|hatched from"
DIED = r"killed by|slain by|murdered by|struck down by|died (?:of|when|after|during|in)|put to death|executed|sacrificed|perished"
KNOWN_FOR = (r"(?:best )?known for", r"famous for", r"noted for", r"most (?:notable|important|significant) (?:act|deed|feat|role|myth) (?:was|is|involves?)")
DEEDS = r"slew|killed|defeated|conquered|overthrew|rescued|freed|created|founded|built|discovered|stole|retrieved|journeyed to|descended to|ascended to|transformed|cursed|punished|tricked"
MYTH_SECTIONS = ("mythology", "myth", "legend", "story", "role")


#: The marks of wiki text and what stands for each in Markdown, in the order in which they are read.
HIDDEN = [(COMMENT, " "), (r"(?i)<ref[^>]*/>", " "), (r"(?is)<ref\b[^>]*>.*?</ref>", " "), (r"(?is)<(noinclude|includeonly|gallery|timeline|score|syntaxhighlight|source)\b[^>]*>.*?</\1>", " ")]
MARKS = [(r"(?ms)^\{\|.*?^\|\}", " "), (r"(?i)\[\[(?:File|Image|Category)[^\]]*(?:\[\[[^\]]*\]\][^\]]*)*\]\]", " "), (r"\[\[[^\]|]*\|([^\]]+)\]\]", "$1"), (r"\[\[([^\]]+)\]\]", "$1"),
         (r"\[https?://[^\s\]]+\s+([^\]]+)\]", "$1"), (r"\[https?://[^\s\]]+\]", " ")]
HEADINGS = [(rf"(?m)^={{{level}}}[ \t]*(?!=)(.*?)[ \t]*={{{level}}}[ \t]*$", "#" * level + " $1") for level in range(6, 1, -1)]
EMPHASIS = [("(?s)\x27{5}(.*?)\x27{5}", "***$1***"), ("(?s)\x27{3}(.*?)\x27{3}", "**$1**"), ("(?s)\x27{2}(.*?)\x27{2}", "*$1*")]
LEFT_OVER = [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</?[a-z][^>]*>", " ")]
TIDY = [(r"(?m)[ \t]+$", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]


def _all(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def wikitext_to_markdown(text: Column) -> Column:
    """Wiki text as Markdown: headings, emphasis and link texts stay; templates, tables, references and files go."""
    out = settled(_all(F.coalesce(text, F.lit("")), HIDDEN), r"\{\{[^{}]*\}\}", r"\{\{")
    out = _all(out, [*MARKS, *HEADINGS, *EMPHASIS, *LEFT_OVER])
    return _all(unescape_html(out), TIDY)


def html_to_markdown(html: Column) -> Column:
    """A page's prose as Markdown: headings, emphasis, lists within lists, quotes and outward links stay.

    Images and navigation go; of links within the site the text stays.
    """
    return to_markdown(F.regexp_replace(strip_boilerplate(html), r"(?is)<head\b.*?</head>", " "))


def infobox(text: Column) -> Column:
    """The fields of an article's infobox with a value, by name in small letters; the last of repeated ones."""
    box = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)(\{\{Infobox.*?\n\}\})", 1)
    lines = F.filter(F.split(box, "\n"), lambda x: x.rlike(r"^\s*\|\s*[^=]+?\s*=\s*.*"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_replace(F.lower(F.trim(F.regexp_extract(x, r"^\s*\|\s*([^=]+?)\s*=", 1))), r"\s+", "_").alias("key"),
                                                  F.trim(F.regexp_replace(clean_wikitext(F.regexp_extract(x, r"^\s*\|\s*[^=]+?\s*=\s*(.*)", 1)), r"\s+", " ")).alias("value")))
    filled = F.filter(pairs, lambda p: p["value"] != "")
    last = let(filled, lambda f: F.filter(f, lambda p, i: ~F.exists(F.slice(f, i + 2, F.size(f)), lambda q: q["key"] == p["key"])))
    return F.map_from_entries(last)


def sections(text: Column) -> Column:
    """(title, text) of an article's sections, ``_intro`` first, with its lines of more than twenty letters that are prose."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n(?===+\s*\S.*?\s*==)")

    def section(part: Column, i: Column) -> Column:
        lines = F.split(part, "\n")
        body = F.when(i == 0, lines).otherwise(F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1)))
        prose = F.filter(F.transform(body, lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & ~x.rlike(r"^(?:\{\{|\||\[\[Category|\[\[File)"))
        title = F.when(i == 0, F.lit("_intro")).otherwise(F.lower(F.regexp_extract(F.get(lines, F.lit(0)), r"^==+\s*(.+?)\s*==+", 1)))
        return F.struct(title.alias("title"), F.trim(F.regexp_replace(clean_wikitext(F.array_join(prose, " ")), r"\s+", " ")).alias("text"))

    return F.filter(F.transform(parts, section), lambda s: s["text"] != "")


def body_text(text: Column) -> Column:
    """The prose of an article without its infobox, up to its closing sections, in one line."""
    closing = r"(?s)\n[^\n]*== (?:" + "|".join(LAST_SECTIONS) + r").*$"
    open_text = F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), closing, "")
    without = F.regexp_replace(open_text, r"(?is)\{\{Infobox(?:[^{}]|\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\})*\}\}", "")
    lines = F.filter(F.transform(F.split(without, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 30) & ~x.rlike(r"^(?:\{\{|\||!|\{\||\[\[(?:Category|File|Image)|\*|#)"))
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(clean_wikitext(x), r"\s+", " ")))
    return F.array_join(F.filter(clean, lambda x: F.length(x) > 25), " ")


def tradition(text: Column, default: str) -> Column:
    """The tradition that the first 3000 characters of an article tell."""
    def told(start: Column) -> Column:
        out = F.lit(default)
        for name, words in reversed(TRADITIONS):
            out = F.when(start.rlike("|".join(words)), F.lit(name)).otherwise(out)
        return out

    return let(F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, 3000), told)


def gender(box: Column, text: Column) -> Column:
    """What the infobox says, else what the wording or the pronouns of its beginning tell; null if none does."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    start = lambda n: F.substring(lower, 1, n)
    count = lambda words: F.regexp_count(start(500), F.lit(rf"\b(?:{words})\b"))
    he, she = count("he|his"), count("she|her")
    told = (F.when(lower.rlike(r"\bgoddess\b"), "Female").when(start(200).rlike(r"\bgod\b") & ~start(200).rlike(r"\bgods\b"), "Male").when(lower.rlike(r"\b(?:heroine|priestess|nymph|princess)\b"), "Female")
            .when(start(300).rlike(r"\b(?:hero|priest)\b"), "Male").when((he > she) & (he >= 2), "Male").when((she > he) & (she >= 2), "Female"))
    return F.coalesce(_field(box, ("gender", "sex")), told)


def _field(box: Column, keys: tuple[str, ...]) -> Column:
    """The first of an infobox's fields that it has."""
    return F.coalesce(*[F.try_element_at(box, F.lit(k)) for k in keys])


def _sentence(text: Column, most: int, pattern: str) -> Column:
    """The first sentence that holds a wording, if it has fewer than 200 letters, from a text's beginning."""
    found = F.trim(F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, most), rf"(?i)([^.]*(?:{pattern})[^.]*\.)", 1))
    return F.when((found != "") & (F.length(found) < 200), found)


def domain(box: Column, text: Column) -> Column:
    """What a figure is said to be god, patron or spirit of: the infobox, else the first wording with words of its own."""
    def said(pattern: str) -> Column:
        own = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, rf"(?i)\b(?:{'|'.join(LITTLE_WORDS)})\b", " "), r"\s+", " "))
        found = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i){pattern}", 1))
        return let(found, lambda x: let(F.length(own(x)), lambda n: F.when((n >= 3) & (n <= 80), x)))

    return F.coalesce(_field(box, DOMAIN_FIELDS), *[said(p) for p in DOMAIN_WORDINGS])


def birth(box: Column, text: Column) -> Column:
    """The sentence that tells of a figure's birth, else the parents that the infobox names."""
    parents = F.array_join(F.array_compact(F.array(*[F.when(F.try_element_at(box, F.lit(k)).isNotNull(), F.concat(F.lit(f"{k}: "), F.try_element_at(box, F.lit(k)))) for k in ("parents", "father", "mother")])), "; ")
    return F.coalesce(_sentence(text, 2000, BORN), F.nullif(parents, F.lit("")))


def death(text: Column) -> Column:
    return _sentence(text, 3000, DIED)


def _section(parts: Column, title: str) -> Column:
    return F.get(F.filter(parts, lambda s: s["title"] == title), F.lit(0))["text"]


def deed(text: Column, parts: Column) -> Column:
    """What a figure is known for: a wording, else a sentence of a deed, in the section of its myth if there is one."""
    own = F.coalesce(*[_section(parts, t) for t in MYTH_SECTIONS], F.substring(F.coalesce(text, F.lit("")), 1, 2000))
    known = [F.nullif(F.trim(F.regexp_extract(own, rf"(?i){p} ([^.]{{10,120}})\.", 1)), F.lit("")) for p in KNOWN_FOR]
    done = F.trim(F.regexp_extract(own, rf"(?i)([^.]*(?:{DEEDS})[^.]*\.)", 1))
    return F.coalesce(*known, F.when(F.length(done).between(21, 199), done))


def relations(box: Column) -> Column:
    """(target, type) of the kin that an infobox names."""
    def named(box: Column, key: str, kind: str) -> Column:
        parts = F.transform(F.split(F.coalesce(F.try_element_at(box, F.lit(key)), F.lit("")), r"[,\n]+"), lambda x: F.trim(x))
        return F.transform(F.filter(parts, lambda x: (F.length(x) > 1) & (F.length(x) < 50)), lambda x: F.struct(x.alias("target"), F.lit(kind).alias("type")))

    return let(box, lambda b: F.concat(*[named(b, key, kind) for key, kind in KIN_FIELDS]))
