"""What operators on documents share: columns, folds and bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds, F.lit(0))


def whole_texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows (doc_id, text, ...) at most, chosen by a hash.

    Where there are more, a threshold on the hash leaves about ``n`` before they are sorted, so that all
    tasks together, and not each, send that many to the driver.
    """
    order = F.xxhash64("doc_id", "text", F.lit(seed))
    total = rows.count()
    if total > n:
        rows = rows.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * n / total) + 1)
    return rows.orderBy(order, "doc_id").limit(n)


def mapped(docs: DataFrame, id_col: str, text_col: str, run: Callable, schema: str, keep_row: bool = False) -> DataFrame:
    """What ``run`` gives for batches of (doc_id, text); with ``keep_row``, the columns of ``docs`` and then it as one struct, the last column.

    ``run`` gives a row for each row, in order, and keeps nothing between batches. A row's own columns pass through as they came,
    so that its text is in memory once.
    """
    if not keep_row:
        return whole_texts(docs, id_col, text_col).mapInArrow(run, schema)
    name = "found"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pa.record_batch([batch.column(id_col).cast(pa.int64()), batch.column(text_col).cast(pa.string())], ["doc_id", "text"])
            at = 0
            for out in run(iter([some])):
                part = batch.slice(at, out.num_rows)
                yield pa.record_batch([*part.columns, pa.StructArray.from_arrays(out.columns, out.schema.names)], [*part.schema.names, name])
                at += out.num_rows

    return docs.mapInArrow(both, StructType([*docs.schema.fields, StructField(name, StructType.fromDDL(schema))]))
