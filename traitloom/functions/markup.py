"""Marked-up texts read tag by tag, with a stack of the elements that are open.

A pattern cuts a text into tags and what stands between; an element's content is gathered
while it is open and given to the one around it when it closes, so elements may nest in
elements of their own name. One pass, in time proportional to the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = re.compile(r"""<!--.*?-->|<!\[CDATA\[(?P<raw>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z_][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPACES = re.compile(r"[ \t\r\n\f]+")
#: Fixed values of HTML: elements without an end, elements that stand by themselves, and what a start tag closes if it is open.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noframes ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Texts of links that lead through a site.
NAVIGATION = re.compile(r"(?:next|previous|prev|index|contents|up|top|home|back)(?: page| chapter)?\W*$|(?:next|previous|prev)\s*[:.]", re.IGNORECASE)
#: What Markdown would read as marks, and how it is written to be read as text.
ESCAPES = ((re.compile(r"\\"), r"\\\\"), (re.compile(r"\*"), r"\\*"), (re.compile(r"^-"), r"\\-"), (re.compile(r"^\+ "), r"\\+ "), (re.compile(r"^(=+)"), r"\\\1"), (re.compile(r"^(#{1,6}) "), r"\\\1 "), (re.compile("`"), r"\\`"),
           (re.compile("^~~~"), r"\\~~~"), (re.compile(r"\["), r"\\["), (re.compile(r"\]"), r"\\]"), (re.compile("^>"), r"\\>"), (re.compile("_"), r"\\_"), (re.compile(r"^(\d+)\. "), r"\1\\. "))


def tokens(text: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """(kind, value, attributes): ``text``, ``start`` with attributes, ``empty`` for a start that is its own end, and ``end``."""
    at = 0
    for m in TAG.finditer(text):
        if m.start() > at:
            yield "text", unescape(text[at : m.start()]), None
        at = m.end()
        if m["raw"] is not None:
            yield "text", m["raw"], None
        elif m["name"]:
            if m["end"]:
                yield "end", m["name"], None
            else:
                found = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m["rest"])}
                yield "empty" if m["rest"].endswith("/") else "start", m["name"], found
    if at < len(text):
        yield "text", unescape(text[at:]), None


class Element:
    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes = name, attributes or {}
        self.parts: list[str] = []
        self.items = 0

    def add(self, made: str) -> None:
        """Put content behind what is there; of line ends that meet the longer run stays, two at most."""
        if not self.parts or not made.startswith("\n") and not self.parts[-1].endswith("\n"):
            self.parts.append(made)
            return
        before = self.parts[-1]
        left, right = before.rstrip("\n"), made.lstrip("\n")
        gap = min(2, max(len(before) - len(left), len(made) - len(right)))
        self.parts[-1] = left
        self.parts.append("\n" * gap + right)

    def content(self) -> str:
        return "".join(self.parts)


def _escaped(text: str) -> str:
    for pattern, written in ESCAPES:
        text = pattern.sub(written, text)
    return text


def _written(e: Element, parent: Element, last_in_item: bool) -> str:
    """An element in Markdown."""
    inner, name = e.content(), e.name
    if name == "a":
        plain, target = SPACES.sub(" ", inner).strip(), e.attributes.get("href", "")
        if NAVIGATION.match(re.sub("[«»‹›]", " ", plain).strip()):
            return ""
        if not re.match("https?://", target, re.IGNORECASE):
            return inner
        return f"[{plain}]({target})" if plain else ""
    if name == "pre":
        return f"\n\n```\n{inner.strip(chr(10))}\n```\n\n"
    if not inner.strip():
        return "\n\n" if name in BLOCK else inner[:1]
    if name in ("em", "i", "strong", "b"):
        mark = "_" if name in ("em", "i") else "**"
        bare = inner.strip()
        return inner[: len(inner) - len(inner.lstrip())] + mark + bare + mark + inner[len(inner.rstrip()) :]
    if name == "code":
        return f"`{inner}`"
    if len(name) == 2 and name[0] == "h" and name[1] in "123456":
        return f"\n\n{'#' * int(name[1])} {inner.strip()}\n\n"
    if name == "blockquote":
        return "\n\n" + re.sub("(?m)^", "> ", inner.strip("\n")) + "\n\n"
    if name == "li":
        mark = f"{parent.items}. " if parent.name == "ol" else "- "
        return mark + inner.strip("\n").strip(" ").replace("\n", "\n" + " " * len(mark)) + "\n"
    if name in ("ul", "ol"):
        return "\n" + inner if last_in_item else "\n\n" + inner + "\n\n"
    return f"\n\n{inner.strip(' ')}\n\n" if name in BLOCK else inner


def markdown(html: str) -> str:
    """A page in Markdown: headings, emphasis, lists within lists, quotes, code and outward links; images go.

    An element whose end is missing ends with the one around it, or where HTML ends it; an
    end without a start is passed over.
    """
    stack, held = [Element("")], Counter()

    def close() -> None:
        e = stack.pop()
        held[e.name] -= 1
        stack[-1].add(_written(e, stack[-1], stack[-1].name == "li"))

    def close_open(names: set[str], within: set[str]) -> None:
        if not any(held[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in within:
                return
            if stack[k].name in names:
                while len(stack) > k:
                    close()
                return

    for kind, value, attributes in tokens(html):
        name, top = value.lower(), stack[-1]
        if kind == "text":
            if held["pre"]:
                top.parts.append(value)
                continue
            flat = SPACES.sub(" ", value)
            if flat.startswith(" ") and (not top.parts and top.name in BLOCK | {""} or "".join(top.parts[-1:]).endswith((" ", "\n"))):
                flat = flat[1:]
            if flat:
                top.parts.append(_escaped(flat) if top.name != "code" else flat)
        elif kind == "end":
            if held[name]:
                while stack[-1].name != name:
                    close()
                close()
        elif name in VOID:
            if name == "br":
                top.parts.append("  \n")
            elif name == "hr":
                top.add("\n\n---\n\n")
        else:
            if name in BLOCK:
                close_open({"p"}, {"li", "blockquote", "td", "th", "div"})
            if name in CLOSES:
                close_open(*CLOSES[name])
            if name == "li":
                stack[-1].items += 1
            stack.append(Element(name, attributes))
            held[name] += 1
            if kind == "empty" and name not in BLOCK:
                close()
    while len(stack) > 1:
        close()
    lines = re.sub(r"[ \t]+\n(?=\n)|(?<=\n)[ \t]+(?=\n)", "\n", stack[0].content())
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def element_texts(xml: str, name: str) -> list[str]:
    """The texts of a document's elements of a local name, in the order in which they begin, white space made single; those that nest have one each."""
    out: list[list[str]] = []
    stack: list[tuple[str, int | None]] = []
    for kind, value, _ in tokens(xml):
        if kind == "text":
            for _, own in stack:
                if own is not None:
                    out[own].append(value)
        elif kind == "end":
            if any(n == value for n, _ in stack):
                while stack.pop()[0] != value:
                    pass
        else:
            wanted = value.rpartition(":")[2] == name
            if wanted:
                out.append([])
            if kind == "start":
                stack.append((value, len(out) - 1 if wanted else None))
    return [" ".join("".join(parts).split()) for parts in out]


@F.arrow_udf(T.StringType())
def _markdown(pages: pa.Array) -> pa.Array:
    return pa.array([None if p is None else markdown(p) for p in pages.to_pylist()], pa.string())


def to_markdown(html: Column) -> Column:
    """:func:`markdown` of a column; null stays null."""
    return _markdown(html)


def texts_of(xml: Column, name: str) -> Column:
    """:func:`element_texts` of a column; null has none."""
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def found(documents: pa.Array) -> pa.Array:
        return pa.array([element_texts(d or "", name) for d in documents.to_pylist()], pa.list_(pa.string()))

    return found(xml)
