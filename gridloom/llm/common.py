"""Shared plumbing of the training-data operators.

Every operator reads only the columns that it needs, so further columns of an input, whatever their
names, cannot clash with the columns that it makes.  A null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, through Spark's own reader, so that any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts empty; all other columns are left out of the scan."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


#: Spark's limit of an Arrow batch in bytes, and what is set where the session leaves it open.
BATCH_BYTES, BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds by bytes the batches that Python gets: ten thousand rows of long texts would not fit into a worker.

    A session that sets a limit keeps it; a single row may exceed any limit.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH_LIMIT)


def map_rows(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function from (iterator of column dicts) to column dicts.

    ``fn(batches)`` gets an iterator of ``{column: list}`` and yields ``{column: list or array}``.
    """
    bounded_batches(df.sparkSession)
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns():
            for b in batches:
                yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        for out in fn(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def blocks(ids: list, texts: list, chars: int = 2_000_000) -> Iterator[tuple[list, list]]:
    """Cuts a batch into blocks of about so many characters; a longer text is a block of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield ids[start:], texts[start:]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only where that is unset and the master is local (tests, one machine) is a local one chosen.  A cluster without
    the setting is an error, since its executors could not read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


SPILLABLE = StorageLevel.MEMORY_AND_DISK


_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What a worker process keeps across tasks: one thing at a time, so that memories do not add up over operators."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]
