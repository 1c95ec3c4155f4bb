"""Versioned tables on shared storage: optimistic transactions, changes merged when read.

A table is a list of segments: rows, written in ranges of the key, and behind them changes of
fields and deletions by key. A change writes a segment as large as itself; a read lays the
changes over the rows, and compaction rewrites only the ranges that changes touch. The list
of all tables' segments is one small file for each version. A transaction works on the
version it began with and publishes the next one under a name that only one writer can take:
whoever comes second is told so, and may carry on only if the first changed other tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import reduce
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.sources.records import number_rows

Result = TypeVar("Result")
#: Segments of fewer rows are rewritten as a whole by compaction.
SMALL_ROWS = 100_000


class ConflictError(RuntimeError):
    """Another writer changed what this transaction read or wrote."""


@dataclass(frozen=True)
class Segment:
    """``ranges``: of rows, each live range's least and greatest key and number of rows; of changes, one such entry."""

    path: str
    kind: str
    ranges: dict[str, list]

    @property
    def rows(self) -> int:
        return sum(r[2] for r in self.ranges.values())


@dataclass(frozen=True)
class Table:
    """``last`` is the greatest key of any row so far, rows that are gone included."""

    key: str | None
    schema: str
    last: object = None
    segments: tuple[Segment, ...] = ()

    def of(self, *kinds: str) -> list[tuple[int, Segment]]:
        return [(i, s) for i, s in enumerate(self.segments) if s.kind in kinds]


class Transaction:
    """Reads and changes on one version; nothing is seen by others until ``commit``."""

    def __init__(self, store: Store, version: int, tables: dict[str, Table]):
        self.store, self.version, self.tables = store, version, dict(tables)
        self.read_names: set[str] = set()
        self.changed: set[str] = set()

    def table(self, name: str) -> Table:
        self.read_names.add(name)
        if name not in self.tables:
            raise KeyError(f"no table {name!r}")
        return self.tables[name]

    def read(self, name: str) -> DataFrame:
        """The table's rows with all changes of this transaction."""
        return self.store.merged(self.table(name))

    def _append(self, name: str, kind: str, rows: DataFrame) -> None:
        held, made = self.tables[name], self.store.write_segment(name, kind, rows, self.tables[name].key)
        known = [held.last, *(r[1] for r in made.ranges.values() if kind == "rows")]
        self.tables[name] = replace(held, segments=(*held.segments, made), last=max((k for k in known if k is not None), default=None))
        self.changed.add(name)

    def write(self, name: str, rows: DataFrame, key: str | None = "id") -> None:
        """Replace a table, or make a new one; ``key`` may be absent from tables that are only replaced and read."""
        self.tables[name] = Table(key if key in rows.columns else None, rows.schema.json())
        self._append(name, "rows", rows)

    def add(self, name: str, rows: DataFrame) -> None:
        """Rows with keys of their own, which must be new."""
        self._append(name, "rows", rows.select(*T.StructType.fromJson(json.loads(self.table(name).schema)).names))

    def insert(self, name: str, rows: DataFrame) -> int:
        """Rows with the next keys, in the order of their columns; gives the greatest key before. Keys are never used twice."""
        held = self.table(name)
        last = max(0, held.last or 0)
        self.add(name, number_rows(rows.drop(held.key), held.key, last))
        return last

    def update(self, name: str, changes: DataFrame, allowed: tuple[str, ...] | None = None) -> None:
        """Set fields by key; null means unchanged, unknown keys change nothing, of two changes to one field the greater value holds.

        Only keys and the fields named are written, however large the table.
        """
        held = self.table(name)
        unknown = set(changes.columns) - {held.key, *(allowed if allowed is not None else T.StructType.fromJson(json.loads(held.schema)).names)}
        if unknown:
            raise ValueError(f"fields that may not be set: {sorted(unknown)}")
        self._append(name, "patch", changes.groupBy(held.key).agg(*[F.max(c).alias(c) for c in changes.columns if c != held.key]))

    def delete(self, name: str, keys: DataFrame) -> None:
        """Rows by key; a row added later under the same key stays."""
        self._append(name, "gone", keys.select(self.table(name).key).distinct())

    def compact(self, name: str, small_rows: int = SMALL_ROWS) -> int:
        """Lay all changes over the ranges that they touch and rewrite these alone; gives the number of rows written.

        Small segments of rows are joined up on the way.
        """
        held, store = self.table(name), self.store
        net = store.net_changes(held)
        kept, taken = [], []
        for i, s in held.of("rows"):
            touched = set(s.ranges)
            if s.rows >= small_rows:
                hit = store.scan(held, s).join(net.select(held.key), held.key, "left_semi").select("__range").distinct().collect() if net is not None else []
                touched = {str(r["__range"]) for r in hit}
            if len(touched) < len(s.ranges):
                kept.append(replace(s, ranges={k: v for k, v in s.ranges.items() if k not in touched}))
            if touched:
                taken.append((i, replace(s, ranges={k: v for k, v in s.ranges.items() if k in touched})))
        if net is None and len(taken) < 2:
            return 0
        self.tables[name], written = replace(held, segments=tuple(kept)), 0
        if taken:
            self._append(name, "rows", store.laid_over(held, taken, net))
            written = self.tables[name].segments[-1].rows
        self.changed.add(name)
        return written

    def commit(self) -> int:
        """Publish all changes as one version.

        If another version came first, this fails when that changed a table which this one read
        or changed; otherwise its tables are taken over and the next name is tried.
        """
        if not self.changed:
            return self.version
        used, version, tables = self.read_names | self.changed, self.version, self.tables
        while not self.store.publish(version + 1, tables, self.changed):
            for newer in range(version + 1, self.store.latest() + 1):
                meanwhile, theirs = self.store.state(newer)
                if used & set(meanwhile):
                    raise ConflictError(f"version {newer} changed {sorted(used & set(meanwhile))}")
                tables = theirs | {n: self.tables[n] for n in self.changed}
                version = newer
        self.version = version + 1
        return self.version


class Store:
    """Named tables under a folder that all executors share.

    The file system must rename a file to a name only if it is free, at once, as HDFS does; on
    a local disk a hard link does the same.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.folder).getFileSystem(self._conf)

    # Versions.

    def _log(self, version: int):
        return self._path(f"{self.folder}/_log/{version:012d}.json")

    def latest(self) -> int:
        log = self._path(f"{self.folder}/_log")
        if not self._files.exists(log):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(log)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def state(self, version: int) -> tuple[list[str], dict[str, Table]]:
        """Names of the tables that a version changed, and all its tables."""
        if not version:
            return [], {}
        stream = self._files.open(self._log(version))
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return held["changed"], {n: Table(t["key"], t["schema"], t["last"], tuple(Segment(**s) for s in t["segments"])) for n, t in held["tables"].items()}

    def publish(self, version: int, tables: dict[str, Table], changed: set[str]) -> bool:
        """Make a version known, whole and only if there is none of that number yet."""
        draft = self._path(f"{self.folder}/_drafts/{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"changed": sorted(changed), "tables": {n: asdict(t) for n, t in tables.items()}}).encode()))
        finally:
            out.close()
        self._files.mkdirs(self._path(f"{self.folder}/_log"))
        try:
            if self._files.getScheme() == "file":
                local = lambda p: self._jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
                self._jvm.java.nio.file.Files.createLink(local(self._log(version)), local(draft))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
                context.rename(draft, self._log(version), self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._files.delete(draft, False)
        return True

    def begin(self) -> Transaction:
        version = self.latest()
        return Transaction(self, version, self.state(version)[1])

    def transact(self, work: Callable[[Transaction], Result], attempts: int = 8) -> Result:
        """Run ``work`` in a transaction, anew on the newest version while others come first."""
        for left in range(attempts - 1, -1, -1):
            change = self.begin()
            result = work(change)
            try:
                change.commit()
                return result
            except ConflictError:
                if not left:
                    raise
        raise ValueError("no attempt allowed")

    # Segments.

    def write_segment(self, name: str, kind: str, rows: DataFrame, key: str | None) -> Segment:
        """Rows go into a folder for each range of the key, each range in the key's order; changes are one range."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        if kind == "rows" and key:
            ranged = rows.repartitionByRange(F.col(key)).withColumn("__range", F.spark_partition_id()).sortWithinPartitions("__range", key)
        else:
            ranged = rows.withColumn("__range", F.lit(0))
        ranged.write.partitionBy("__range").parquet(path)
        written = self.spark.read.schema(T.StructType([*([ranged.schema[key]] if key else []), T.StructField("__range", T.IntegerType())])).parquet(path)
        least, most = (F.min(key), F.max(key)) if key else (F.lit(None), F.lit(None))
        stats = written.groupBy("__range").agg(least.alias("least"), most.alias("most"), F.count("*").alias("rows")).collect()
        return Segment(path, kind, {str(r["__range"]): [r["least"], r["most"], r["rows"]] for r in stats})

    def scan(self, table: Table, segment: Segment) -> DataFrame:
        """A segment's live ranges, with ``__range``; other ranges' files are not opened."""
        schema = T.StructType.fromJson(json.loads(table.schema)).add("__range", T.IntegerType())
        rows = self.spark.read.schema(schema).parquet(segment.path) if segment.kind == "rows" else self.spark.read.parquet(segment.path)
        return rows.where(F.col("__range").isin([int(r) for r in segment.ranges])) if segment.ranges else rows.limit(0)

    def net_changes(self, table: Table) -> DataFrame | None:
        """Per key its last value of each changed field and where it was set, and where the key was deleted; None if nothing changed.

        Places are the segments' numbers, so that rows added later are not touched.
        """
        fields, parts = T.StructType.fromJson(json.loads(table.schema)), []
        changed = [(i, s, self.scan(table, s).drop("__range")) for i, s in table.of("patch", "gone") if s.ranges]
        if not changed:
            return None
        named = [f for f in fields if f.name != table.key and any(f.name in rows.columns for _, _, rows in changed)]
        for i, s, rows in changed:
            own = [F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in named]
            parts.append(rows.select(table.key, *own, F.lit(i).alias("__at"), F.lit(s.kind == "gone").alias("__gone")))
        set_at = lambda f: F.when(F.col(f"`{f.name}`").isNotNull(), F.col("__at"))
        return reduce(DataFrame.unionByName, parts).groupBy(table.key).agg(
            F.max(F.when(F.col("__gone"), F.col("__at"))).alias("__gone"),
            *[c for f in named for c in (F.max_by(F.col(f"`{f.name}`"), set_at(f)).alias(f"__new_{f.name}"), F.max(set_at(f)).alias(f"__set_{f.name}"))])

    def laid_over(self, table: Table, segments: list[tuple[int, Segment]], net: DataFrame | None) -> DataFrame:
        """Rows of the segments as the changes leave them; without changes nothing is joined."""
        names = T.StructType.fromJson(json.loads(table.schema)).names
        rows = reduce(DataFrame.unionByName, [self.scan(table, s).drop("__range").withColumn("__seq", F.lit(i)) for i, s in segments])
        if net is None:
            return rows.select(*names)
        both = rows.join(net, table.key, "left").where(F.coalesce(F.col("__gone") < F.col("__seq"), F.lit(True)))

        def value(c: str) -> Column:
            return F.when(F.col(f"__set_{c}") > F.col("__seq"), F.col(f"__new_{c}")).otherwise(F.col(f"`{c}`")).alias(c) if f"__new_{c}" in net.columns else F.col(f"`{c}`")

        return both.select(*map(value, names))

    def merged(self, table: Table, keys: list | None = None) -> DataFrame:
        """The table's present rows, or those of some keys, for which only ranges that may hold them are opened."""
        segments = table.of("rows")
        if keys is not None:
            wanted = sorted(keys)
            holds = lambda r: r[0] is not None and any(r[0] <= k <= r[1] for k in wanted)
            segments = [(i, replace(s, ranges=own)) for i, s in segments if (own := {n: r for n, r in s.ranges.items() if holds(r)})] or segments[:1]
        net = self.net_changes(table)
        if keys is not None:
            net = net.where(F.col(table.key).isin(wanted)) if net is not None else None
            return self.laid_over(table, segments, net).where(F.col(table.key).isin(wanted))
        return self.laid_over(table, segments, net)

    # One change at a time.

    def read(self, name: str, version: int | None = None) -> DataFrame:
        tables = self.state(self.latest() if version is None else version)[1]
        return self.merged(tables[name])

    def lookup(self, name: str, keys: list) -> DataFrame:
        return self.merged(self.state(self.latest())[1][name], keys)

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Replace tables, all at once, on the version that is there now."""
        change = self.begin()
        for name, rows in tables.items():
            change.write(name, rows)
        return change.commit()

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows with the next keys and give them back."""
        last = self.transact(lambda change: change.insert(name, rows))
        held = self.state(self.latest())[1][name]
        return self.merged(held).where(F.col(held.key) > last)

    def update(self, name: str, changes: DataFrame, allowed: tuple[str, ...]) -> None:
        self.transact(lambda change: change.update(name, changes, allowed))

    def delete(self, name: str, keys: DataFrame) -> None:
        self.transact(lambda change: change.delete(name, keys))

    def compact(self, name: str, small_rows: int = SMALL_ROWS) -> int:
        return self.transact(lambda change: change.compact(name, small_rows))

    def expire(self, keep: int = 10) -> int:
        """Forget all versions but the newest ``keep`` and delete segments that only they name; gives the number of segments deleted.

        A segment that no version names may belong to a transaction under way and is left alone.
        """
        newest = self.latest()
        numbers = [n for n in range(max(1, newest - keep + 1), newest + 1)]
        old = sorted(n for f in self._files.listStatus(self._path(f"{self.folder}/_log")) if (t := f.getPath().getName()).endswith(".json") and not t.startswith(".") and (n := int(t.removesuffix(".json"))) < numbers[0])
        named = lambda versions: {s.path for v in versions for t in self.state(v)[1].values() for s in t.segments}
        gone = named(old) - named(numbers)
        for v in old:
            self._files.delete(self._log(v), False)
        for path in gone:
            self._files.delete(self._path(path), True)
        return len(gone)
