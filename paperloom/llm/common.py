"""What the training-data operators share: readers, scratch tables, Arrow loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The contracts' white space, for Java, DuckDB and Python patterns alike.
WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"

#: Texts turned into Python strings at a time, so that a worker never holds a
#: whole Arrow batch twice.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir, which a cluster
    sets. Where it is unset a folder of our own, on one machine only: elsewhere
    executors would write to disks that others don't see."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later
    stages neither repeat its work nor depend on the executor that did it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores if df has such a column."""
    while name in df.columns:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_rows(df: DataFrame, inputs: list[str], schema: str | T.StructType, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row for each row of df[inputs]. make() is called once in each
    task and returns the function of a row, so that what is dear to build
    (vocabularies, weights) is built there once. A function with an attribute
    `many` set returns a list of rows instead."""
    shape = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        many = getattr(each, "many", False)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows = zip(*(part.column(i).to_pylist() for i in range(len(inputs))))
                out = [y for x in rows for y in each(*x)] if many else [each(*x) for x in rows]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return df.select(*inputs).mapInArrow(run, shape)


def forget(*dfs: DataFrame) -> None:
    """Deletes scratch tables that nothing will read again."""
    for df in dfs:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends (its results are written
    by then), instead of when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
