"""Scratch tables in the folder that all executors share, and a few column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The session setting that names the folder shared by the driver and all executors.
SHARED_DIR_KEY = "spark.checkpoint.dir"

#: ASCII white space as a character class, for Java and RE2 patterns alike.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder is set; on a
    cluster an absent setting is an error, since executors could not see each other's files.
    """
    base = spark.conf.get(SHARED_DIR_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="traitloom-")
        spark.conf.set(SHARED_DIR_KEY, base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks of later stages. The
    folder of an application may be deleted once the application has ended.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, within one row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_hash(row: str, schema: T.StructType) -> Column:
    """A hash of all fields of a struct; maps, which Spark does not hash, as JSON."""
    own = [F.col(f"{row}.`{f.name}`") for f in schema]
    return F.xxhash64(*[F.to_json(c) if "map<" in f.dataType.simpleString() else c for c, f in zip(own, schema, strict=True)])


def words_of(text: Column) -> Column:
    """The runs of non-white-space (ASCII white space only) of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
