"""Session helpers of the text operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "word_bpe_49k.json"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that the session names; a folder of our own only where none is named and all
    tasks run on this machine."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/chronolink-{uuid.uuid4().hex}")
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def release() -> None:
    """Give memory that is free in this Python worker back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """run, after which the worker's free memory is given back."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names a result is about to take (case does not count)."""
    taken = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def extend(df: DataFrame, fields: list[T.StructField], function: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow that keeps df's columns and adds ``fields``."""
    return df.mapInArrow(function, T.StructType([*df.schema.fields, *fields]))


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
