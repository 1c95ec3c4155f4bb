"""Repair of conversations and fill-in-the-middle against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from traitloom.llm import conversations, fillmiddle, queries

TURNS = "conv_id long, turn long, role string, text string"
SMALL = "/root/testdata/sf0.001"


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[conv] += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest())) for c, r in out.items()}


def brute_repair(rows):
    """All edits by a table of the cheapest audits for each number of rows used and last role."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    best = {"": (0, "", ())}

    def insert(table):
        for _ in range(3):
            for last, (cost, audit, kept) in list(table.items()):
                for r in "ua":
                    if (last, r) in legal:
                        made = (cost + 5, audit + "I", (*kept, ({"u": "user", "a": "assistant"}[r], "")))
                        if r not in table or made[:2] < table[r][:2]:
                            table[r] = made

    insert(best)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for last, (cost, audit, kept) in best.items():
            options = [(last, cost + 2, "D", ())]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                options += [(role[:1], cost + extra, "K", ((role, text),))] + [(r[0], cost + 1 + extra, "R", ((r, text),)) for r in ("user", "assistant")]
            for r, c, e, own in options:
                if e == "D" or (last, r) in legal:
                    made = (c, audit + e, kept + own)
                    if r not in after or made[:2] < after[r][:2]:
                        after[r] = made
        insert(after)
        best = after
    cost, audit, kept = min((best[r] for r in ("", "a") if r in best), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()}


def repaired(turns):
    damaged = conversations.damaged(turns)
    found = conversations.whole_digests(conversations.repair(damaged, copies=F.col("copies"))).collect()
    got = {r["conv"]: {k: r[k] for k in (*conversations.REPORT, "audit", "repaired_sha256")} for r in found}
    assert len(got) == len(found)
    return got


def made_turns(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, t if r.random() < 0.95 else None, role if r.random() < 0.98 else None, r.choice(["Yes.", "No", "Why?", "  ", f"Word {t}.", f"Cut {t}", None, f"{c}-{t}!"])))
    return rows


def test_conversations_query_against_brute_force(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    got = {x["conv_id"]: x.asDict() for x in queries.op12_conversations(spark, SMALL).collect()}
    want = brute_damage(rows)
    assert set(got) == {x[0] for x in rows}
    for c in got:
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == brute_repair(want.get(c, []))


@pytest.mark.parametrize(("block", "seed"), [(4096, 1), (3, 2), (1, 3)])
def test_conversations_whole_and_in_blocks(spark, monkeypatch, block, seed):
    """Roles out of order, null turns, ties, repeated rows; blocks of few rows carry roles, prices, turns and duplicates over their ends."""
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    rows = made_turns(seed, 40, 14)
    rows += rows[:9] + [(None, 1, "user", "A."), (None, None, None, None), (77, 5, "tool", "x"), (77, 5, "tool", "x")]
    got, want = repaired(spark.createDataFrame(rows, TURNS).repartition(3)), brute_damage(rows)
    assert set(got) == {x[0] for x in rows}
    for c in got:
        assert got[c] == brute_repair(want[c]), c


@pytest.fixture
def dealt(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_conversation_over_many_tasks(spark, dealt):
    """One conversation holds nearly all rows, with one text in two thirds of them: each task has its share of it."""
    r = random.Random(5)
    rows = [(1, t, ("user", "assistant")[(t + (r.random() < 0.1)) % 2], "The same." if t % 3 else f"Text {t}{r.choice('.?x')}") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    turns = conversations.damaged(spark.createDataFrame(rows, TURNS))
    pieces = conversations.repair(turns, copies=F.col("copies")).where("conv = 1").cache()
    assert pieces.count() >= 4 and pieces.select("part").distinct().count() >= 4
    got = repaired(spark.createDataFrame(rows, TURNS))
    assert got[1] == brute_repair(brute_damage(rows)[1])


def test_conversations_odd_tables(spark):
    assert repaired(spark.createDataFrame([], TURNS)) == {}
    dropped = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    whole = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    long = "word " * 400_000 + "end."
    rows = [(dropped, 0, "user", "Gone."), (whole, 0, "user", long), (-1, -(2**63), "user", "A."), (-1, 2**63 - 1, "assistant", "B.")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("rows", F.lit(1)).withColumn("mark", F.lit("x")).withColumn("part", F.lit(2))
    got, none = repaired(turns), hashlib.sha256(b"").hexdigest()
    assert got[dropped] == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": none}
    assert got[whole]["audit"] == "D" and got[whole]["cost"] == 2
    assert got[-1]["gaps"] == 2**63 - 1
    named = conversations.repair(spark.createDataFrame([("a", 0, "user", "Q?"), ("a", 1, "assistant", "A."), (None, 0, "user", "x")], "id string, at int, who string, said string"), "id", "at", "who", "said")
    assert {(r["conv"], r["audit"], r["repaired"]) for r in named.collect()} == {("a", "KK", "user:Q?\nassistant:A."), (None, "D", "")}


def brute_middle(key, text, rate=100, spm=50):
    h = [int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    return (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 10), (0, 100)])
def test_fill_in_middle_odd_rows(spark, rate, spm):
    """Nulls, empty and very long texts, marks and their halves beside the cuts, repeated rows, clashing names."""
    r = random.Random(rate)
    texts = [None, "", "\n", "a", "a\nb", "\n\n\n", "x<P>y", "<S", "ends <\n<P", "<M\n<S\n<", "é\n☃\U0001f600\n中", "\r\n\x0b\x85 \n", "line\n" * 200_000, "z" * 1_000_000]
    texts += ["".join(r.choice("ab<PSM>\n") for _ in range(r.randrange(60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (None, "a\nb\n"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("output", F.lit("x")).withColumn("fim_key", F.lit(0))
    got = fillmiddle.fill_in_middle(docs, rate=rate, suffix_first=spm).withColumn("back", fillmiddle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: repr(x)
    assert sorted((tuple(x)[:-1] for x in got), key=key) == sorted(((i, *brute_middle("" if i is None else i, t or "", rate, spm)) for i, t in rows), key=key)
    assert sorted((x["doc_id"], x["back"]) for x in got if x["doc_id"] is not None) == sorted((i, t or "") for i, t in rows if i is not None)


def test_fill_in_middle_of_other_units_and_no_rows(spark):
    assert fillmiddle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    words = spark.createDataFrame([(f"d{i}", "one two three four") for i in range(30)], "name string, body string")
    got = fillmiddle.fill_in_middle(words, "name", "body", unit=r"\S+\s*", marks=("[pre]", "[suf]", "[mid]"), seed=3)
    marks = ("[pre]", "[suf]", "[mid]")
    rows = got.withColumn("back", fillmiddle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r["n"] == 4 and r["back"] == "one two three four" for r in rows) and {r["form"] for r in rows} == {"psm", "spm"} and len({r["output"] for r in rows}) > 10


def test_the_matcher_stops_at_the_second_rank():
    """The second pass asks for no match beyond the higher rank."""
    class Counted:
        asked = 0

        def finditer(self, text):
            for m in re.finditer(fillmiddle.LINES, text):
                self.asked += 1
                yield m

    unit = Counted()
    assert fillmiddle.places(unit, "a\nb\nc\nd\n", 1, 3) == (2, 6) and unit.asked == 3
