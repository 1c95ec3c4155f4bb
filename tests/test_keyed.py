"""Caches and claims with a lifetime: verdicts over several runs, and the state that is left."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from traitloom.streaming import keyed, ledger

T0 = 1_700_000_000


@pytest.fixture(autouse=True)
def provider(spark):
    keyed.with_timers(spark)
    yield
    spark.conf.unset(keyed.PROVIDER_KEY)


def fed(spark, folder, number, rows, schema):
    frame = spark.createDataFrame([(*r[:-1], T0 + r[-1]) for r in rows], schema)
    frame.withColumn("ts", frame["at"].cast("timestamp")).drop("at").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def state_rows(spark, checkpoint):
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "value").load()
    return {r["key"][0] for r in held.collect()}


def test_a_cache_entry_leaves_when_its_age_has_passed(spark, tmp_path):
    folder, age, model, want = str(tmp_path), 100, {}, {}
    batches = [[(1, 1, 0), (2, 2, 10), (1, 3, 90)], [(1, 4, 101), (2, 5, 105)], [(3, 6, 5000)], [(3, 7, 5001), (1, 8, 5002)], [(9, 9, 20_000)], [(9, 10, 20_001)]]
    for n, rows in enumerate(batches):
        fed(spark, folder, n, rows, "key long, seq long, at long")
        ledger.run_once(keyed.cached(stream(spark, folder), age, "1 second"), f"{folder}/out", f"{folder}/checkpoint")  # each run restarts from the checkpoint
        for key, seq, at in rows:
            want[seq] = "hit" if key in model and at - model[key] <= age else "miss"
            model[key] = at if want[seq] == "miss" else model[key]
        if n == 1:
            assert state_rows(spark, f"{folder}/checkpoint") == {1, 2}
    assert {r["seq"]: r["verdict"] for r in spark.read.parquet(f"{folder}/out").collect()} == want
    assert state_rows(spark, f"{folder}/checkpoint") == {9}  # of nine thousand seconds ago nothing is left


def test_a_claim_whose_holder_has_gone_is_freed(spark, tmp_path):
    folder = str(tmp_path)
    claim, release = "claim", "release"
    batches = [[(1, 1, "a", claim, 0), (1, 2, "b", claim, 10), (2, 3, "c", claim, 20)], [(1, 4, "a", release, 30), (1, 5, "b", claim, 40), (2, 6, "d", claim, 200)], [(7, 7, "z", claim, 9000)], [(7, 8, "z", release, 9010), (8, 9, "y", claim, 9020)]]
    for n, rows in enumerate(batches):
        fed(spark, folder, n, rows, "slot long, seq long, holder string, action string, at long")
        ledger.run_once(keyed.leased(stream(spark, folder), 100, "1 second"), f"{folder}/out", f"{folder}/checkpoint")
    got = sorted((r["slot"], r["seq"] or 0, r["holder"], r["verdict"]) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == sorted([(1, 1, "a", "claimed"), (1, 2, "b", "skipped"), (1, 4, "a", "released"), (1, 5, "b", "claimed"), (1, 0, "b", "expired"), (2, 3, "c", "claimed"), (2, 0, "c", "expired"),
                          (2, 6, "d", "claimed"), (2, 0, "d", "expired"), (7, 7, "z", "claimed"), (7, 8, "z", "released"), (8, 9, "y", "claimed")])
    assert state_rows(spark, f"{folder}/checkpoint") == {8}


def test_resolutions_come_once_late_or_never(spark, tmp_path):
    """Blockers and resolutions in files out of step with each other, over restarts: as the join of the whole tables, and an empty state in the end."""
    r, folder = random.Random(9), str(tmp_path)
    blockers = [(i, r.randrange(6), T0 + 40 * i) for i in range(60)] + [(999, 77, T0 + 90_000)]
    resolved = [(1000 + i, r.randrange(6), T0 + 55 * i) for i in range(40)] + [(1999, 78, T0 + 90_000)]
    made = lambda rows, names: spark.createDataFrame(rows, f"{names[0]} long, source_id long, at long").select(names[0], "source_id", F.col("at").cast("timestamp").alias(names[1]))
    left, right = ("blocker_id", "ts"), ("resolution_id", "resolved_at")
    # The n-th files of the two streams are some minutes apart, within the delay.
    parts = [(blockers[:20], resolved[:5]), (blockers[20:40], resolved[5:30]), (blockers[40:60], resolved[30:40]), (blockers[60:], resolved[40:]), ([(1000, 77, T0 + 90_001)], [(2000, 78, T0 + 90_001)])]
    for own, other in parts:
        made(own, left).coalesce(1).write.mode("append").parquet(f"{folder}/b")
        made(other, right).coalesce(1).write.mode("append").parquet(f"{folder}/r")
        read = lambda n: spark.readStream.schema(spark.read.parquet(f"{folder}/{n}").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{n}")
        ledger.run_once(ledger.resolutions(read("b"), read("r"), "300 seconds", "2000 seconds"), f"{folder}/out", f"{folder}/checkpoint")
    rows = lambda df: sorted((x["blocker_id"], x["source_id"], x["resolution_id"] or 0) for x in df.where("blocker_id < 900").collect())
    whole = ledger.resolutions(made(blockers, left), made(resolved, right), "300 seconds")
    got = rows(spark.read.parquet(f"{folder}/out"))
    assert got == rows(whole) and len(got) > 60 and any(not x[2] for x in got)
    plain = sorted((i, s, k) for i, s, t in blockers[:60] for k in ([k for k, o, u in resolved if o == s and t <= u <= t + 300] or [0]))
    assert got == plain


def test_claims_of_a_large_slot_come_in_bounded_tables():
    """All rows of a slot reach one call; they are never objects all at once, and come in the order of their numbers."""
    class Held:
        exists, value = False, None

        def update(self, value):
            self.value = value

    rng, n = random.Random(5), 3 * ledger.ROWS + 7
    rows = [(7, seq, f"u{rng.randrange(9)}", rng.choice(["claim", "claim", "release"])) for seq in range(n)]
    want, active = [], None
    for _, seq, holder, action in rows:
        verdict = ("skipped" if active else "claimed") if action == "claim" else "released" if active == holder else "ignored"
        active = {"claimed": holder, "released": None}.get(verdict, active)
        want.append((7, seq, holder, verdict))
    rng.shuffle(rows)
    state, tables = Held(), pd.DataFrame(rows, columns=["slot", "seq", "holder", "action"])
    found = list(ledger.settle_claims((7,), (tables[at : at + 1000] for at in range(0, n, 1000)), state))
    assert [t for f in found for t in f.itertuples(index=False, name=None)] == want
    assert max(map(len, found)) <= ledger.ROWS and state.value == (active,)
