"""What the training-data operators share: the shared scratch folder and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch. Texts may be long, so batches stay small enough for a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: ASCII white space; a word is a longest run of other characters.
SPACE = " \t\n\x0b\x0c\r"


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, which hold whole texts; tighter bounds that are set stay.

    The settings are read when a plan runs, so they can't be taken back before a lazy result is used.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local session (tests) gets a temporary one; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"


#: Tables that this process wrote and hasn't deleted, in order.
_written: list[str] = []


def mark() -> int:
    """A point in the order of written tables, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables written since a mark, but for ``keep``: for a caller whose result is written and that alone works in this process."""
    for path in _written[since:]:
        if path != keep._written_to:
            _delete(spark, path)
    _written[since:] = [keep._written_to]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing will read again."""
    _delete(df.sparkSession, df._written_to)
    _written.remove(df._written_to)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def strings(batch: pa.RecordBatch, column: str) -> list:
    """A text column as Python strings; null and unreadable values are None."""
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def arrow_schema(columns: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(name, kind) for name, kind in columns])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_added(df: DataFrame, text_col: str, added: list[tuple[str, pa.DataType, T.DataType]], compute) -> DataFrame:
    """``df`` with columns computed by ``compute(list of texts) -> list of arrays`` in Arrow batches.

    All other columns pass through as Arrow arrays, never as Python objects; those that have the name of an added one
    (case does not count) are replaced, as ``withColumn`` does.
    """
    text_at = [c.lower() for c in df.columns].index(text_col.lower())
    new = {n.lower() for n, _, _ in added}
    keep = [k for k, c in enumerate(df.columns) if c.lower() not in new]
    schema = T.StructType([*(df.schema.fields[k] for k in keep), *(T.StructField(n, k) for n, _, k in added)])
    kinds = [(n, k) for n, k, _ in added]

    def run(batches):
        for batch in batches:
            more = compute(batch.column(text_at).to_pylist())
            arrays = [*(batch.column(k) for k in keep), *(pa.array(v, type=k) for v, (_, k) in zip(more, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(batch.schema.names[k] for k in keep), *(n for n, _ in kinds)])

    return df.mapInArrow(run, schema)


def crc32_of_id(column) -> F.Column:
    """crc32 of a whole-number id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
