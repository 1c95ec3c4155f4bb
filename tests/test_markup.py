"""Marks that nest, against the library's own parsers."""

import random
import re
import time
from html.parser import HTMLParser
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from traitloom.functions import markup, web, wiki

FOLDER = "/root/testdata/sf0.01"


class Items(HTMLParser):
    """The items of a page's lists: how deep they stand, and their own words."""

    def __init__(self):
        super().__init__()
        self.depth, self.open, self.found, self.links, self.text = 0, [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("ul", "ol"):
            self.depth += 1
        elif tag == "li":
            if self.open and self.open[-1][0] == self.depth:
                self.open.pop()
            self.found.append((self.depth, []))
            self.open.append(self.found[-1])

    def handle_endtag(self, tag):
        if tag in ("ul", "ol"):
            while self.open and self.open[-1][0] == self.depth:
                self.open.pop()
            self.depth -= 1
        elif tag == "li" and self.open:
            self.open.pop()

    def handle_data(self, data):
        self.text.append(data)
        if self.open:
            self.open[-1][1].append(data)


def parsed(html):
    p = Items()
    p.feed(html)
    p.close()
    return p


def listed(markdown):
    """Depth and words of the items of a list in Markdown, by their indents."""
    out, indents = [], []
    for line in markdown.split("\n"):
        m = re.match(r"( *)(- |\d+\. )(.*)", line)
        if m:
            while indents and indents[-1] >= len(m[1]):
                indents.pop()
            indents.append(len(m[1]))
            out.append((len(indents), m[3].strip()))
    return out


@pytest.mark.parametrize("closed", [True, False])
def test_lists_within_lists(closed):
    r = random.Random(closed)

    def made(depth):
        kind, items = r.choice(["ul", "ol"]), []
        for _ in range(r.randrange(1, 4)):
            inner = made(depth + 1) if depth < 4 and r.random() < 0.5 else ""
            items.append(f"<li> w{r.randrange(1000)} x {inner}" + ("</li>" if closed or inner else ""))
        return f"<{kind}>{''.join(items)}</{kind}>"

    for _ in range(60):
        html = made(1)
        want = [(d, " ".join("".join(t).split())) for d, t in parsed(html).found]
        assert listed(markup.markdown(html)) == want, html


def test_pages_keep_their_words(spark):
    """Over all pages: the words of what is left are those that the library's parser finds, in order, and no tag is."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    body = F.regexp_replace(web.strip_boilerplate(F.col("html")), r"(?is)<head\b.*?</head>", " ")
    n = 0
    for r in pages.select(body.alias("body"), wiki.html_to_markdown(F.col("html")).alias("markdown")).collect():
        plain = re.sub(r"\\([\\*\-+=#`~\[\]>_.])", r"\1", r["markdown"])
        words = lambda t: re.findall(r"[^\W\d_]+", t)
        found = parsed(re.sub(r"<!\[CDATA\[.*?\]\]>", " ", r["body"], flags=re.DOTALL))
        rest, own = iter(words(" ".join(found.text))), words(re.sub(r"\]\(https?:[^)]*\)", "", plain))
        assert all(any(w == x for x in rest) for w in own)  # in order; navigation is left out
        assert not re.search(r"(?i)</?(?:p|div|ul|li|script|style|b|a)\b[^>]*>", r["markdown"])
        n += len(own)
    assert n > 10_000


def test_elements_that_nest_in_their_own_name(spark):
    r = random.Random(3)

    def made(depth):
        name = r.choice(["n", "q:n", "m"])
        inner = "".join(made(depth + 1) if depth < 5 and r.random() < 0.5 else f" t{r.randrange(99)} &amp; " for _ in range(r.randrange(4)))
        return f"<{name} k='a>b'>{inner}</{name}>" if r.random() < 0.9 else f"<{name}/>"

    documents = [f'<a xmlns:q="u">{made(0)}{made(0)}</a>' for _ in range(80)]
    got = {x["i"]: x["t"] for x in spark.createDataFrame(list(enumerate(documents)), "i int, x string").select("i", web.xml_texts(F.col("x"), "n").alias("t")).collect()}
    for i, d in enumerate(documents):
        assert got[i] == [" ".join("".join(e.itertext()).split()) for e in ElementTree.fromstring(d).iter() if e.tag.rpartition("}")[2] == "n"]
    one = spark.createDataFrame([(None,), ("<n>open <n>deep",), ("</n>x",)], "x string").select(web.xml_texts(F.col("x"), "n").alias("t")).collect()
    assert [r["t"] for r in one] == [[], ["open deep", "deep"], []]


def test_marks_of_text_and_odd_pages():
    m = markup.markdown
    assert m("<p>2 * 3 [x] a_b</p><p>1. one</p><p># no</p>") == "2 \\* 3 \\[x\\] a\\_b\n\n1\\. one\n\n\\# no"
    assert m("<ol><li>a</li><li><p>b</p><p>c</p></li></ol>") == "1. a\n2. b\n\n   c"
    assert m("<pre>  a\n  <b>b</b>_</pre>") == "```\n  a\n  **b**_\n```"
    assert m("<blockquote><p>a</p><blockquote>b</blockquote></blockquote>") == "> a\n> \n> > b"
    assert m("a<br>b<hr/>c</div></p>d") == "a  \nb\n\n---\n\ncd"
    assert m("") == "" and m("<") == "<" and m("<p") == "<p" and m("<ul></ul>") == ""
    began = time.time()
    m("<div>" * 50_000 + "x" + "<p>a " * 50_000)
    assert time.time() - began < 20
