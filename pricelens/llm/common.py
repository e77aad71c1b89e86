"""Helpers of the text operators: the shared folder, tables written there, Arrow batches in bounded slices."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a task works on at once; a longer text is worked on alone.
SLICE = 4 << 20

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; in local mode a new one of its own where it
    is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _own[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so that a lost executor costs no more than a read."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: str, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in order, in parts of at most `most` bytes of the column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def append(
    df: DataFrame,
    column: str,
    fields: Iterable[StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    most: int = SLICE,
) -> DataFrame:
    """Adds columns computed per slice of rows. `make` runs once per task and returns the function from a slice to
    the new columns. An input column with the name of a new one is replaced."""
    fields = list(fields)
    new = [f.name for f in fields]
    kept = [c for c in df.columns if c not in new]
    schema = StructType([df.schema[c] for c in kept] + fields)

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, column, most):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *work(part)], names=[*kept, *new])

    return df.mapInArrow(run, schema)


def by_row(starts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values between starts; n rows, an empty one gives 0."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[np.append(starts[1:], len(values))] - sums[starts] if n else np.zeros(0)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, *, doc_id: str, text: str, remainders: tuple[int, ...], most: int
) -> DataFrame:
    """(label as long, text) of at most `most` labelled documents of each label 0 and 1, one row for equal texts.

    Ids are taken whose crc32 modulo 5 is among `remainders`, by the order of their hash. An id labelled twice has the
    larger label. Rows with a null id, label or text are left out. The ids are bounded by `most`, so they are sent to
    the scan of the documents, and the texts of other documents do not move."""
    marks = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("long").alias("label"))
        .dropna()
        .where(remainder("_id").isin(*remainders))
        .groupBy("_id")
        .agg(F.max("label").alias("label"))
    )
    ids = [marks.where(F.col("label") == v).orderBy(F.xxhash64("_id"), "_id").limit(most) for v in (0, 1)]
    return (
        docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
        .where(F.col("text").isNotNull())
        .join(F.broadcast(ids[0].union(ids[1])), F.col("doc") == F.col("_id"))
        .groupBy(F.sha2("text", 256).alias("digest"))
        .agg(F.max(F.struct("label", "text")).alias("x"))
        .select("x.label", "x.text")
    )
