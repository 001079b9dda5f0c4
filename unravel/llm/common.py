"""Shared plumbing of the text operators: shared tables, Arrow passes, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..plans.derive import shared_path

#: Rows that a Python pass unpacks at a time; an Arrow batch may hold more.
SLICE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only a local session without one (tests) gets
    a temporary folder of its own.
    """
    return shared_path(spark)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage
    that outlives any executor. Files stay until ``release``. The result's
    ``staged_rows`` is its number of rows, counted as they are written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/unravel-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_rows, out.staged_path = rows.get.get("n") or 0, path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``staged`` that nothing will read any more."""
    for df in tables:
        if path := df.__dict__.get("staged_path"):
            spark = df.sparkSession
            jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def binary(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """``fn`` turns each slice of rows into the columns of ``schema``."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = fn(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


#: Rows up to which a narrow staged table is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000

#: Narrow rows worth a task of their own.
TASK_ROWS = 20_000


def near(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a table of a few numbers a row, marked for broadcast if it has at most
    BROADCAST_ROWS rows. ``rows``: its rows or a bound on them, where known."""
    known = getattr(df, "staged_rows", None) if rows is None else rows
    small = bounded(df, BROADCAST_ROWS) if known is None else known <= BROADCAST_ROWS
    return F.broadcast(df) if small else df


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` narrow rows, in no more tasks than TASK_ROWS a task
    need. The number of tasks grows with the rows; nearly empty tasks and files go."""
    return df.coalesce(rows // TASK_ROWS + 1)
