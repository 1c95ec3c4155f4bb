"""Versioned tables: interleaved writers, changes as large as themselves, ranges opened, and compaction."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from traitloom.sources import store
from traitloom.sources.versioned import ConflictError, Store

ROWS = "id long, name string, size int"


@pytest.fixture
def kept(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def rows(df):
    return {r["id"]: tuple(r)[1:] for r in df.collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


@pytest.fixture
def apart(spark):
    """Ranges stay as many as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_the_second_of_two_writers_is_told(spark, kept):
    base = spark.createDataFrame([(1, "a", 1)], ROWS)
    kept.commit({"t": base, "u": base})
    a, b, c = kept.begin(), kept.begin(), kept.begin()
    a.insert("t", base)
    b.insert("t", base)
    c.insert("u", base)
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()
    assert set(rows(kept.read("t"))) == {1, 2} and set(rows(kept.read("u"))) == {1}
    c.commit()  # another table: carried on over the other's version
    assert set(rows(kept.read("t"))) == {1, 2} and set(rows(kept.read("u"))) == {1, 2}
    # What was only read counts too.
    d, e = kept.begin(), kept.begin()
    d.read("t")
    d.insert("u", base)
    e.delete("t", spark.createDataFrame([(1,)], "id long"))
    e.commit()
    with pytest.raises(ConflictError):
        d.commit()


def test_writers_at_the_same_time_lose_no_row(spark, kept):
    kept.commit({"t": spark.createDataFrame([], ROWS)})

    def write(k):
        for i in range(3):
            kept.transact(lambda change: change.insert("t", spark.createDataFrame([(None, f"{k}-{i}", k)], ROWS)), attempts=100)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    got = rows(kept.read("t"))
    assert sorted(got) == list(range(1, 13)) and {n for n, _ in got.values()} == {f"{k}-{i}" for k in range(4) for i in range(3)}
    assert kept.latest() == 13


def test_a_failed_transaction_leaves_nothing(spark, kept):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], ROWS)
    kept.commit({"t": base})
    with pytest.raises(ZeroDivisionError):
        kept.transact(lambda change: (change.delete("t", base), 1 // 0))
    assert kept.latest() == 1 and len(rows(kept.read("t"))) == 2
    with pytest.raises(ValueError):
        kept.update("t", base, ("name",))
    with pytest.raises(KeyError):
        kept.begin().read("none")


def test_changes_against_a_plain_dictionary(spark, kept, apart):
    """Random inserts, updates, deletions, additions under old keys, compactions; old versions stay readable."""
    r, model, history = random.Random(4), {i: (f"n{i}", i) for i in range(1, 41)}, []
    kept.commit({"t": spark.createDataFrame([(i, *v) for i, v in model.items()], ROWS)})
    last = 40
    for step in range(14):
        keys = r.sample(range(1, last + 5), 6)
        match step % 5:
            case 0:
                changes = [(k, r.choice([None, f"s{step}"]), r.choice([None, step])) for k in keys]
                kept.update("t", spark.createDataFrame(changes, ROWS), ("name", "size"))
                model |= {k: (n if n is not None else model[k][0], s if s is not None else model[k][1]) for k, n, s in changes if k in model}
            case 1:
                kept.delete("t", spark.createDataFrame([(k,) for k in [*keys, keys[0]]], "id long"))
                model = {k: v for k, v in model.items() if k not in keys}
            case 2:
                kept.insert("t", spark.createDataFrame([(None, f"new{step}", step)], ROWS))
                last += 1
                model[last] = (f"new{step}", step)
            case 3:
                gone = [k for k in keys if k <= last and k not in model]
                kept.transact(lambda change, gone=gone, step=step: change.add("t", spark.createDataFrame([(k, f"again{step}", None) for k in gone], ROWS)))
                model |= {k: (f"again{step}", None) for k in gone}
            case 4:
                kept.compact("t", small_rows=5)
                assert all(s.kind == "rows" for s in kept.state(kept.latest())[1]["t"].segments)
        history.append((kept.latest(), dict(model)))
        assert rows(kept.read("t")) == model, step
    assert all(rows(kept.read("t", version)) == then for version, then in history[::4])
    assert rows(kept.lookup("t", [1, 7, 41, 999])) == {k: v for k, v in model.items() if k in (1, 7, 41)}
    before = rows(kept.read("t"))
    assert kept.expire(keep=2) > 0 and rows(kept.read("t")) == before


def test_bytes_written_grow_with_the_change(spark, kept, apart, tmp_path):
    base = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(1).alias("size"))
    kept.commit({"t": base})
    whole = size(tmp_path)
    kept.update("t", spark.range(10).select((F.col("id") * 19_999).alias("id"), F.lit("x").alias("name")), ("name",))
    small = size(tmp_path) - whole
    kept.update("t", spark.range(20_000).select((F.col("id") * 10).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name")), ("name",))
    large = size(tmp_path) - whole - small
    assert small < whole / 500 and small * 20 < large < whole / 5
    assert kept.read("t").where("name = 'x'").count() == 9  # key 0 has the later value
    assert kept.read("t").count() == 200_000


def test_compaction_rewrites_only_touched_ranges(spark, kept, apart):
    kept.commit({"t": spark.range(40_000).select("id", F.lit("a").alias("name"))})
    (base,) = kept.state(kept.latest())[1]["t"].segments
    assert len(base.ranges) == 4
    kept.update("t", spark.range(5).select("id", F.lit("b").alias("name")), ("name",))
    written = kept.compact("t", small_rows=10)
    segments = kept.state(kept.latest())[1]["t"].segments
    assert written == base.ranges["0"][2] < 20_000 and [s.path == base.path for s in segments] == [True, False] and "0" not in segments[0].ranges
    assert kept.read("t").where("name = 'b'").count() == 5 and kept.read("t").count() == 40_000
    assert kept.compact("t", small_rows=10) == 0


def test_lookup_opens_few_files(spark, kept, apart):
    """The plan's own counts: files of other ranges are not opened, and of the row groups only some rows come out."""
    kept.commit({"t": spark.range(40_000).select("id", F.col("id").cast("string").alias("name"))})

    def scanned(df):
        df.collect()
        plan, todo, files = df._jdf.queryExecution().executedPlan(), [], 0
        todo.append(plan.executedPlan() if hasattr(plan, "executedPlan") and "AdaptiveSparkPlan" in plan.nodeName() else plan)
        while todo:
            node = todo.pop()
            if "Scan parquet" in node.nodeName():
                files += node.metrics().get("numFiles").get().value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return files

    assert scanned(kept.read("t")) == 4
    one = kept.lookup("t", [17])
    assert scanned(one) == 1 and [tuple(r) for r in one.collect()] == [(17, "17")]
    assert scanned(kept.lookup("t", [17, 39_999])) == 2


def test_a_corpus_holds_a_content_once(spark, kept):
    """Two writers of overlapping files, of which the second is told and looks again; null contents, equal contents under two paths, and sidecars."""
    at = F.lit("2024-01-01").cast("timestamp")
    files = spark.createDataFrame([("p/1", "p", "one"), ("p/2", "p", "two"), ("p/3", "p", "one"), ("q/1", "q", "one"), ("q/2", "q", None)], "path string, partition string, content string")
    assert store.write_corpus(kept, files.where("path < 'p/2'"), at) == 1
    between = [True]

    def racing(work, attempts=8, own=kept.transact):
        def slow(change):
            made = work(change)
            if between.pop():
                between.append(False)
                own(lambda other: other.add("corpus", spark.createDataFrame([("x", "z/9", "z", "nine")], store.CORPUS["corpus"])))
            else:
                between.append(False)
            return made
        return own(slow, attempts)

    kept.transact = racing
    assert store.write_corpus(kept, files, at) == 3
    assert store.write_corpus(kept, files, at) == 0
    held = sorted((r["path"], r["content"]) for r in kept.read("corpus").collect())
    assert held == [("p/1", "one"), ("p/2", "two"), ("q/1", "one"), ("q/2", None), ("z/9", "nine")]
    assert sorted((r["path"], r["content_bytes"]) for r in kept.read("sidecars").collect()) == [("p/1", 3), ("p/2", 3), ("q/1", 3), ("q/2", None)]
