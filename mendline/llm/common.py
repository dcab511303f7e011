"""What several operators share: reading, batches of texts in and columns out."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: The white space of the contracts, as a class for regular expressions.
SPACE = r"[\x20\x09-\x0D]"
#: Texts of at most this many characters go through a step together; longer ones go alone.
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal digits modulo `folds`; a null id counts as one without digits."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def fold_of(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut batches so that the texts held at once as Python strings stay bounded, whatever the batch size."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, size = 0, 0
        for i, row in enumerate(column):
            size += row.as_buffer().size if row.is_valid else 0
            if size >= CHUNK_CHARS or i + 1 == len(column):
                part = batch.slice(start, i + 1 - start)
                yield part, column.slice(start, i + 1 - start).to_pylist()
                start, size = i + 1, 0


def map_chunks(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable], text: str = "text") -> DataFrame:
    """`make()` runs once per task and returns step(batch, texts) -> iterator of record batches."""

    def run(batches):
        step = make()
        for batch, texts in chunks(batches, text):
            yield from step(batch, texts)

    return df.mapInArrow(run, schema)


def with_arrays(batch: pa.RecordBatch, names: list[str], arrays: list) -> pa.RecordBatch:
    """The batch with columns added at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the input doesn't have, compared as Spark does."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
