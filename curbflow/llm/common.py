"""Helpers that the operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A slice of an Arrow batch holds at most about this many bytes of text, so
#: that what a task builds beside its input stays bounded (one longer text is
#: a slice of its own).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batch: pa.RecordBatch, text_at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut where the texts reach ``most`` bytes."""
    texts = batch.column(text_at)
    if batch.num_rows == 0:
        return
    if texts.nbytes <= most:
        yield batch
        return
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = 0 if not text.is_valid else text.as_buffer().size
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


#: Keys that rows repeat most, at most so many and each so often at least, are looked up in a broadcast table.
HEAVY_KEYS, HEAVY_FROM = 1000, 256


def looked_up(
    rows: DataFrame, values: DataFrame, key: str, spread: str, counts: DataFrame | None = None
) -> DataFrame:
    """rows with the other columns of values, which has one row for each key; rows with a null key have no value.

    The most frequent keys of rows, HEAVY_KEYS at most, are looked up in a
    broadcast table, and their rows and those with a null key are dealt out by
    the column ``spread``, so that a key with a third of all rows isn't one
    task's; the others meet by key.  ``counts`` (key, n) are the rows by key, if
    known.
    """
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.where(F.col(key).isNotNull() & (F.col("n") >= HEAVY_FROM)).orderBy(F.desc("n"), key)
    top = frequent.limit(HEAVY_KEYS).select(key).collect()
    others = [c for c in values.columns if c != key]
    marked, apart = rows, F.col(key).isNull()
    if top:
        spark = rows.sparkSession
        keys = F.broadcast(spark.createDataFrame(top, values.select(key).schema))
        held = {r[key]: r for r in values.join(keys, key, "left_semi").collect()}
        table = [(r[key], r[key] in held, *(held[r[key]][c] if r[key] in held else None for c in others)) for r in top]
        fields = [
            values.schema[key],
            T.StructField("__has", T.BooleanType()),
            *[T.StructField(f"__of_{c}", values.schema[c].dataType) for c in others],
        ]
        heavy = spark.createDataFrame(table, T.StructType(fields))
        marked = rows.join(F.broadcast(heavy), key, "left")
        apart = apart | F.col("__has").isNotNull()
    salt = F.when(apart, 1 + F.pmod(F.xxhash64(spread), F.lit(4096))).otherwise(0)
    marked = marked.withColumns({"__key": F.when(~apart, F.col(key)), "__salt": salt})
    found = values.select(
        F.col(key).alias("__key"), F.lit(0).cast("long").alias("__salt"), *[F.col(c).alias(f"__{c}") for c in others]
    )
    both = marked.join(found, ["__key", "__salt"], "left")
    of = {c: F.when(F.col("__has"), F.col(f"__of_{c}")).otherwise(F.col(f"__{c}")) if top else F.col(f"__{c}") for c in others}
    return both.select(key, *[c for c in rows.columns if c != key], *[v.alias(c) for c, v in of.items()])


def give_back() -> None:
    """Frees what a task leaves behind: its worker serves other tasks, and stages with memory of their own."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def with_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    compute: Callable[[list], list[pa.Array]],
    finish: Callable[[], None] = lambda: None,
) -> DataFrame:
    """df with the columns that ``compute`` derives from its texts.

    ``finish`` is called at the end of a task, to forget what it gathered.

    ``compute`` gets the texts of some rows (str or None) and returns one array
    for each field.  All other columns pass through; an old column of the same
    name as a new one gives way to it.
    """
    new = {f.name.lower() for f in fields}
    if text_col.lower() in new:
        raise ValueError(f"the text column {text_col!r} would be replaced by a result")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    at = [c.lower() for c in kept.columns].index(text_col.lower())
    schema = T.StructType([*kept.schema.fields, *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                got = compute(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *got], names=names)
        finish()
        give_back()

    return kept.mapInArrow(run, schema)
