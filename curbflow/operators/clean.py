"""Filters, coercions, de-duplication and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import exact_quantiles


def between_dates(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from the start date to the last second of the end date; the bounds are literals, so scans can use them."""
    low = F.lit(start).cast("timestamp_ntz")
    high = F.lit(f"{end} 23:59:59").cast("timestamp_ntz")
    return df.where((F.col(ts) >= low) & (F.col(ts) <= high))


def up_to(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    return df.where(F.col(ts) <= F.lit(cutoff).cast("timestamp_ntz"))


def coerced(c: Column, kind: str = "double") -> Column:
    """c as a number, null where it isn't one."""
    return c.try_cast(kind)


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def fill_median(df: DataFrame, column: str, kind: str = "int") -> DataFrame:
    """Nulls of a column become its exact median, cast to a type; one row is broadcast."""
    middle = exact_quantiles(df, column, [0.5]).select(F.col("quantiles")[0].alias("__median"))
    filled = df.crossJoin(F.broadcast(middle))
    return filled.withColumn(column, F.coalesce(column, "__median").cast(kind)).drop("__median")


def coded(c: Column, codes: dict[str, int], default: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def labelled(c: Column, labels: dict[int, str]) -> Column:
    """The label of a code, or `Unknown (code)`."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    other = F.concat(F.lit("Unknown ("), F.coalesce(c.cast("string"), F.lit("null")), F.lit(")"))
    return F.coalesce(F.try_element_at(table, c), other)


def outside(c: Column, domain: list) -> Column:
    """Whether a value is null or not of the domain."""
    return ~F.coalesce(c.isin(domain), F.lit(False))


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one distinct value, found in one pass over the minimum and maximum."""
    row = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]["a"] is not None and row[c]["a"] != row[c]["b"]]


def stitched(df: DataFrame, order: str, head: str, body: str) -> DataFrame:
    """A record with only its head joins the next one if that has only a body; complete ones pass, others go.

    The order is a position in one landed file, so its records make one window.
    """
    w = Window.partitionBy("file").orderBy(order)
    nxt_head, nxt_body = F.lead(head).over(w), F.lead(body).over(w)
    whole = F.col(head).isNotNull() & F.col(body).isNotNull()
    opens = F.col(head).isNotNull() & F.col(body).isNull() & nxt_head.isNull() & nxt_body.isNotNull()
    out = df.withColumns({"__whole": whole, "__opens": opens, "__next": nxt_body}).where("__whole or __opens")
    return out.withColumn(body, F.coalesce(body, "__next")).drop("__whole", "__opens", "__next")


def unique_key(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate column whose values are all different and present."""
    row = df.agg(F.count("*").alias("__n"), *[F.count_distinct(c).alias(c) for c in candidates]).first()
    return next((c for c in candidates if row[c] == row["__n"]), None)


def with_row_key(df: DataFrame, columns: list[str], name: str = "row_key") -> DataFrame:
    """A stable surrogate key: the hash of a natural key."""
    return df.withColumn(name, F.xxhash64(*columns))
