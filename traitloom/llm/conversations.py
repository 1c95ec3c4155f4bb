"""Repair of conversations by the cheapest edits.

A conversation is well formed if it may begin with a system turn and then goes user,
assistant, user, assistant to its end, or is empty. Rows are kept, given another role or
deleted, and empty turns inserted, at the least total price; among equally cheap repairs the
one whose edits' initials come first in ASCII is taken.

The search goes over retained rows alone. A retained row is a row and the role it ends up
with; what lies between two of them is priced by a difference of two prefix sums of
deletions and by the inserts that the pair of roles calls for, so one running minimum for
each role holds the best continuation, and a row costs a few comparisons. The scan runs from
the last row to the first, since then ties fall to what stands at one place: deleting on
comes before any other edit, an insert before a row that stays, keeping before a new role.

Rows are dealt out by ranges of conversation and turn, so one conversation may fill any
number of tasks. Those that lie within a task are repaired there. The others are cut into
blocks; a block's prices from each role before it to each role at its end are a matrix,
matrices compose by (min, +), and once they have been composed over a conversation's blocks
each block is repaired by itself, knowing the role before it and the prices after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.llm.shared import materialise, slices

#: Prices of the edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: The last retained role: none yet, system, user, assistant; and the role that an insert or a new role gives after it.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
AFTER = (USER, USER, ASSISTANT, USER)
#: Inserts that a pair of retained roles calls for, and those at the end.
INSERTS = {(a, b): int(AFTER[a] != b) for a in range(4) for b in (USER, ASSISTANT)} | {(NONE, SYSTEM): 0}
AT_END = (0, 2, 1, 0)
ENDED = tuple(INSERT * n for n in AT_END)
NEVER = 1 << 60
#: Rows and characters of a block; a conversation beyond them, or on the edge of a task, is repaired in blocks.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20


@dataclass
class Turn:
    turn: int | None
    role: str
    text: str
    mark: str
    fault: str = ""

    def states(self) -> list[tuple[int, int]]:
        """The roles that the row may be retained in, each with its price."""
        if self.fault in ("blank", "duplicate"):
            return []
        extra, own = TRUNCATED * (self.fault == "truncated"), self.role[:1]
        kept = [(SYSTEM, extra)] if own == "s" else []
        return [*kept, *((r, extra + REROLE * (own != initial)) for r, initial in ((USER, "u"), (ASSISTANT, "a")))]


def find_faults(rows: list[Turn], earlier: set[tuple[str, str]] = frozenset()) -> None:
    """Set each row's first fault; ``earlier`` are the role and text of rows before these."""
    seen = set()
    for row in rows:
        bare, key = row.text.rstrip(SPACES), (row.role, row.mark)
        row.fault = "blank" if not bare else "duplicate" if key in seen or key in earlier else "" if bare[-1] in ".!?" else "truncated"
        seen.add(key)


class Search:
    """The cheapest edits from each role before the rows, given the price from each role after them."""

    def __init__(self, rows: list[Turn], after: tuple[int, ...]):
        n = len(rows)
        self.rows, self.n, self.after = rows, n, after
        # Running minima by role: (price, row); prices count the deletions from the first row on.
        best: list[tuple[int, int] | None] = [None] * 4
        self.next: list[dict[int, tuple[int, int] | None]] = [{} for _ in range(n)]
        for i in range(n - 1, -1, -1):
            found = []
            for role, price in rows[i].states():
                cost, self.next[i][role] = self._choice(role, best, i + 1)
                found.append((role, DELETE * i + price + cost))
            for role, cost in found:
                if cost < NEVER and (best[role] is None or cost < best[role][0]):
                    best[role] = (cost, i)
        self.first = [self._choice(role, best, 0) for role in range(4)]

    def _choice(self, role: int, best: list[tuple[int, int] | None], at: int) -> tuple[int, tuple[int, int] | None]:
        """Price from row ``at`` on after ``role``, and the next retained row and role (none: all that follow are deleted)."""
        end = min(NEVER, self.after[role] + DELETE * (self.n - at))
        # A later row deletes more before any other edit; of one row, an insert comes first, then a kept role.
        options = [(end, -self.n, 0, None)]
        for q in (SYSTEM, USER, ASSISTANT):
            inserts = INSERTS.get((role, q))
            if best[q] is not None and inserts is not None:
                cost, j = best[q]
                options.append((cost - DELETE * at + INSERT * inserts, -j, -inserts, (j, q)))
        cost, _, _, chosen = min(options, key=lambda x: x[:3])
        return cost, chosen

    def cost(self, role: int) -> int:
        return self.first[role][0]

    def path(self, role: int) -> tuple[str, int, list[tuple[str, str]]]:
        """Initials of the edits, the last retained role and the rows that stay, from ``role`` before the rows."""
        audit, out, at, chosen = [], [], 0, self.first[role][1]
        while chosen:
            j, q = chosen
            audit.append("D" * (j - at))
            if INSERTS[role, q]:
                audit.append("I")
                out.append((NAMES[AFTER[role]], ""))
            row = self.rows[j]
            keeps = row.role[:1] == NAMES[q][0]
            audit.append("K" if keeps else "R")
            out.append((row.role if keeps else NAMES[q], row.text))
            role, at, chosen = q, j + 1, self.next[j][q]
        audit.append("D" * (self.n - at))
        return "".join(audit), role, out


def closing(role: int) -> tuple[str, list[tuple[str, str]]]:
    """The inserts after the last row."""
    out = []
    for _ in range(AT_END[role]):
        role = AFTER[role]
        out.append((NAMES[role], ""))
    return "I" * len(out), out


def as_text(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def counted(rows: list[Turn]) -> dict[str, int | None]:
    """Counts of a run of rows, and what is needed to join them with those of its neighbours."""
    turns = [r.turn for r in rows if r.turn is not None]
    faults = [r.fault for r in rows]
    illegal = sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    return {"first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "illegal": illegal,
            "first_role": rows[0].role[:1] if rows else None, "last_role": rows[-1].role[:1] if rows else None, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}}


def gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else min(2**63 - 1, last - first + 1 - turns)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TURN = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("mark", T.StringType())])
ARROW_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("mark", pa.string())])
COUNTS = ("first_turn", "last_turn", "turns", "illegal", "first_role", "last_role", "blank", "duplicate", "truncated")


def repair_whole(rows: list[Turn]) -> dict[str, object]:
    """A conversation's report, audit and repaired text, of all its rows."""
    find_faults(rows)
    search, c = Search(rows, ENDED), counted(rows)
    audit, role, out = search.path(NONE)
    last, inserted = closing(role)
    return {"gaps": gaps(c["first_turn"], c["last_turn"], c["turns"]), "cost": search.cost(NONE), "audit": audit + last, "repaired": as_text(out + inserted), **{k: c[k] for k in REPORT[1:5]}}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _repair_task(kind: pa.DataType):
    """The first pass: whole conversations are repaired, the others written in blocks."""
    schema = pa.schema([("conv", kind), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), *[(k, pa.int64()) for k in REPORT], ("audit", pa.string()), ("repaired", pa.string()), ("rows", pa.list_(ARROW_TURN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
        conv, rows, chars, cut = None, None, 0, True  # the first conversation of a task may have begun in the one before

        def block() -> dict:
            return {"conv": conv, "part": part, "seq": seq, "whole": False, "rows": [{"turn": r.turn, "role": r.role, "text": r.text, "mark": r.mark} for r in rows]}

        for batch in slices(batches):
            for key, turn, role, text, mark, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows is not None and (key != conv or len(rows) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                    cut = cut or key == conv
                    made = block() if cut else {"conv": conv, "part": part, "seq": seq, "whole": True, **repair_whole(rows)}
                    out.append(made)
                    held, seq, cut = held + chars, seq + 1, key == conv
                    if len(out) >= 1024 or held >= BLOCK_CHARS:
                        yield _batch(out, schema)
                        out, held = [], 0
                    rows = None
                if rows is None:
                    conv, rows, chars = key, [], 0
                for _ in range(copies):
                    rows.append(Turn(turn, role, text, mark))
                    chars += len(text) + len(role)
        if rows is not None:
            out.append(block())
        if out:
            yield _batch(out, schema)

    return run, schema


def _seen_before(blocks: DataFrame) -> DataFrame:
    """Role and text (as hash) of each block that an earlier block of its conversation holds too.

    A block names each pair once, so one text that fills a conversation has a row a block.
    """
    at = F.struct("part", "seq")
    keys = blocks.select("conv", "part", "seq", F.explode(F.array_distinct(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["mark"].alias("mark"))))).alias("key"))
    first = keys.groupBy("conv", "key").agg(F.min(at).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select(F.col("conv").alias("c"), F.col("key").alias("k"), "first")
    later = keys.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where(at > F.col("first"))
    return later.groupBy("part", "seq").agg(F.collect_list("key").alias("earlier"))


def _turns(values: list[dict], earlier: list[dict] | None) -> list[Turn]:
    rows = [Turn(**v) for v in values]
    find_faults(rows, {(e["role"], e["mark"]) for e in earlier or ()})
    return rows


def _prices(rows: list[Turn]) -> tuple[list[int], list[int]]:
    """Price from each role before the rows to each after them, and the order of their audits among those of one role before."""
    cost, rank = [NEVER] * 16, [0] * 16
    audits: dict[tuple[int, int], str] = {}
    for end in range(4):
        search = Search(rows, tuple(0 if q == end else NEVER for q in range(4)))
        for start in range(4):
            if search.cost(start) < NEVER:
                cost[4 * start + end], audits[start, end] = search.cost(start), search.path(start)[0]
    for start in range(4):
        for k, (_, end) in enumerate(sorted((a, e) for (s, e), a in audits.items() if s == start)):
            rank[4 * start + end] = k
    return cost, rank


def _composed(conv: object, blocks: list[dict]) -> list[dict]:
    """Of a conversation's blocks in order: the report, and for each block the role before it and the prices after it."""
    after = [ENDED]
    for b in reversed(blocks):
        after.append(tuple(min(NEVER, *(b["price"][4 * r + q] + after[-1][q] for q in range(4))) for r in range(4)))
    after.reverse()
    role, out = NONE, []
    for k, b in enumerate(blocks):
        out.append({"part": b["part"], "seq": b["seq"], "before": role, "prices": list(after[k + 1]), "last": k + 1 == len(blocks)})
        role = min(range(4), key=lambda q: (b["price"][4 * role + q] + after[k + 1][q], b["order"][4 * role + q]))
    held = [b for b in blocks if b["first_role"] is not None]
    dated = [b for b in held if b["first_turn"] is not None]
    again = sum(a["last_turn"] == b["first_turn"] for a, b in pairwise(dated))
    illegal = sum(a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in pairwise(held))
    report = {"gaps": gaps(dated[0]["first_turn"], dated[-1]["last_turn"], sum(b["turns"] for b in dated) - again) if dated else 0,
              "illegal": sum(b["illegal"] for b in blocks) + illegal, "cost": after[0][NONE], **{k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated")}}
    return [{"conv": conv, "n_pieces": len(blocks), **report, **o} for o in out]


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """The repaired conversations, in pieces: ``conv``, ``piece`` (part, seq), ``n_pieces``, the report, ``audit`` and ``repaired``.

    Rows go by turn, nulls first, equal turns by role and then by the SHA-256 of the text.
    The report (``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``) stands
    beside every piece and is the whole conversation's; ``audit`` and ``repaired`` (lines
    ``role:text``) are the piece's own, and joined in order they are the whole. Most
    conversations are one piece. ``copies`` says how often a row counts; with 0 it does not,
    but its conversation is returned.

    A null role or text is one space, so such a text is blank; a null id is a conversation of
    its own. Repeated rows are duplicates like any other. A text is held whole, a very long
    one in a block of its own. Duplicates far apart in one conversation are told by SHA-256.
    Columns that are not named are not read. No rows give no rows.
    """
    key, role, text = F.col(f"`{conv_col}`"), F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")), F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    picked = turns.select(key.alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("mark"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    # Equal rows may fall on either side of a bound, so no row is too common to be dealt out.
    dealt = picked.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("conv", "turn", "role", "mark", "salt").sortWithinPartitions("conv", "turn", "role", "mark").drop("salt")
    kind = picked.schema["conv"].dataType
    arrow_kind = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
    if arrow_kind == pa.string():
        dealt = dealt.withColumn("conv", F.col("conv").cast("string"))
        kind = T.StringType()
    head = [T.StructField("conv", kind), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType())]
    report = [T.StructField(k, T.LongType()) for k in REPORT]
    texts = [T.StructField("audit", T.StringType()), T.StructField("repaired", T.StringType())]
    run, _ = _repair_task(arrow_kind)
    first = materialise(dealt.mapInArrow(run, T.StructType([*head, T.StructField("whole", T.BooleanType()), *report, *texts, T.StructField("rows", T.ArrayType(TURN))])), "repair")
    whole = first.where("whole").select("conv", "part", "seq", F.lit(1).cast("long").alias("n_pieces"), *REPORT, "audit", "repaired")
    cut = first.where("NOT whole").select("conv", "part", "seq", "rows")
    blocks = cut.join(_seen_before(cut), ["part", "seq"], "left").select("conv", "part", "seq", "rows", "earlier")

    counts = [T.StructField(k, T.StringType() if k.endswith("role") else T.LongType()) for k in COUNTS]
    priced = T.StructType([*head, *counts, T.StructField("price", T.ArrayType(T.LongType())), T.StructField("order", T.ArrayType(T.LongType()))])
    chained = T.StructType([*head, T.StructField("n_pieces", T.LongType()), *report, T.StructField("before", T.IntegerType()), T.StructField("prices", T.ArrayType(T.LongType())), T.StructField("last", T.BooleanType())])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            (b,) = batch.to_pylist()
            rows = _turns(b["rows"], b["earlier"])
            cost, order = _prices(rows)
            yield _batch([{"conv": b["conv"], "part": b["part"], "seq": b["seq"], "price": cost, "order": order, **counted(rows)}], pa.schema(
                [("conv", arrow_kind), ("part", pa.int32()), ("seq", pa.int32()), *[(f.name, pa.string() if f.name.endswith("role") else pa.int64()) for f in counts], ("price", pa.list_(pa.int64())), ("order", pa.list_(pa.int64()))]))

    def compose(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda b: (b["part"], b["seq"]))
        return pa.Table.from_pylist(_composed(found[0]["conv"], found), pa.schema(
            [("conv", arrow_kind), ("part", pa.int32()), ("seq", pa.int32()), ("n_pieces", pa.int64()), *[(k, pa.int64()) for k in REPORT], ("before", pa.int32()), ("prices", pa.list_(pa.int64())), ("last", pa.bool_())]))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", arrow_kind), ("part", pa.int32()), ("seq", pa.int32()), ("n_pieces", pa.int64()), *[(k, pa.int64()) for k in REPORT], ("audit", pa.string()), ("repaired", pa.string())])
        for batch in slices(batches, 1):
            (b,) = batch.to_pylist()
            audit, role, out = Search(_turns(b["rows"], b["earlier"]), tuple(b["prices"])).path(b["before"])
            last, inserted = closing(role) if b["last"] else ("", [])
            yield _batch([{**b, "audit": audit + last, "repaired": as_text(out + inserted)}], schema)

    # Blocks are few and small here: one row for each, without its texts.
    chain = blocks.mapInArrow(price, priced).groupBy("conv").applyInArrow(compose, chained).drop("conv")
    mended = blocks.join(chain, ["part", "seq"]).mapInArrow(mend, T.StructType([*head, T.StructField("n_pieces", T.LongType()), *report, *texts]))
    return whole.unionByName(mended)


def whole_digests(pieces: DataFrame) -> DataFrame:
    """Per conversation: the report, the whole ``audit`` and the SHA-256 of the whole repaired text.

    A digest is taken in order, so the pieces of one conversation are read one after another
    by one task, none held longer than it takes; a single piece needs no shuffle.
    """
    import hashlib

    single = pieces.where("n_pieces = 1").select("conv", *REPORT, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    out = T.StructType([pieces.schema["conv"], *[T.StructField(k, T.LongType()) for k in REPORT], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, hashed, audit, empty = 0, None, [], True
        for batch in slices(batches, 1):
            (b,) = batch.to_pylist()
            if not left:
                left, hashed, audit, empty = b["n_pieces"], hashlib.sha256(), [], True
            if b["repaired"]:
                hashed.update(f"{'' if empty else '\n'}{b['repaired']}".encode())
                empty = False
            audit.append(b["audit"])
            left -= 1
            if not left:
                made = {**b, "audit": "".join(audit), "repaired_sha256": hashed.hexdigest()}
                yield pa.RecordBatch.from_arrays([pa.array([made[f.name]], batch.schema.field(f.name).type if f.name in batch.schema.names else pa.string()) for f in out], names=out.names)

    ordered = pieces.where("n_pieces > 1").select("conv", "part", "seq", "n_pieces", *REPORT, "audit", "repaired").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return single.unionByName(ordered.mapInArrow(run, out))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults that follow from their ids, and ``copies``, how often each counts.

    By CRC-32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes the
    stops out of it, 3 repeats it, 4 makes it the user's. A null in any column is one space.
    """
    own = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    code = F.crc32(F.concat(own(conv_col), F.lit(":"), own(turn_col)).cast("binary")) % 20
    text = F.when(code <= 1, "").when(code == 2, F.translate(own(text_col), ".!?", "")).otherwise(own(text_col))
    return turns.select(F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`"), F.when(code == 4, "user").otherwise(own(role_col)).alias(role_col), text.alias(text_col),
                        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))
