"""Point and batch access, log scans, canonical forms and the dispatch of search modes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lexical import alpha_blend

# --- lookups --------------------------------------------------------------------------------------------------------


def batch_get(table: DataFrame, asked: DataFrame, key: str, position: str = "position") -> DataFrame:
    """One row per request in ``asked`` (``position``, key): the table's columns, null where nothing has the key.

    Of rows that share a key any one is taken. Requests may repeat; a null key finds nothing.
    """
    columns = [c for c in table.columns if c != key]
    one = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*columns)).alias("_row"))
    joined = asked.select(position, key).join(one, F.col(key) == F.col("_k"), "left")
    return joined.select(position, key, F.col("_k").isNotNull().alias("found"), "_row.*")


def page(table: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next ``size`` rows after a row's values of ``order``, which must be total: pages by key, not by offset.

    The filter reaches the scan, so later pages cost no more than the first.
    """
    rows = table
    if after is not None:
        beyond = F.lit(False)
        for i in reversed(range(len(order))):
            c, v = F.col(order[i]), F.lit(after[i])
            beyond = (c > v) | ((c == v) & beyond)
        rows = table.where(beyond)
    return rows.orderBy(*order).limit(size)


def since(log: DataFrame, at: str, instant: datetime, upto: datetime | None = None) -> DataFrame:
    """Rows of a log from an instant (inclusive) to another (exclusive); a filter that reaches the scan."""
    rows = log.where(F.col(at) >= F.lit(instant).cast("timestamp_ntz"))
    return rows if upto is None else rows.where(F.col(at) < F.lit(upto).cast("timestamp_ntz"))


def truncated(log: DataFrame, at: str, checkpoint: datetime, key: str | None = None) -> DataFrame:
    """What a log keeps after a checkpoint: rows after it and, with ``key``, the last earlier row of each key.

    The last rows are pre-aggregated. Rows without a time are kept: nothing says that the checkpoint holds them.
    """
    kept = log.where(F.col(at).isNull() | (F.col(at) > F.lit(checkpoint).cast("timestamp_ntz")))
    if key is None:
        return kept
    old = log.where(F.col(at) <= F.lit(checkpoint).cast("timestamp_ntz"))
    rest = [c for c in log.columns if c not in (key, at)]
    last = old.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_row"))
    return kept.unionByName(last.select(key, "_row.*"))


def best_of_each(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The ``n`` rows of each group that come last by ``order``, newest first in ``position``.

    The limit on the position is applied to every task's sorted rows before they are shuffled too, so a group of any size
    sends ``n`` rows a task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return rows.withColumn("position", place).where(F.col("position") <= n).withColumn("position", F.col("position") - 1)


# --- canonical forms ------------------------------------------------------------------------------------------------


def canonical_time(at: Column) -> Column:
    """An instant as UTC text with microseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parsed_time(text: Column) -> Column:
    """The UTC instant (without zone) of an ISO-8601 text that names its offset; null for anything else.

    Fractions beyond microseconds are cut.
    """
    whole = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    part = lambda i: F.regexp_extract(text, whole, i)
    digits = F.rpad(F.substring(F.replace(part(3), F.lit(".")), 1, 6), 6, "0")
    local = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    sign = F.when(F.substring(part(4), 1, 1) == "-", -1).otherwise(1)
    minutes = F.when(part(4) == "Z", 0).otherwise(sign * (F.substring(part(4), 2, 2).try_cast("int") * 60 + F.substring(part(4), 5, 2).try_cast("int")))
    micros = F.unix_micros(local.cast("timestamp")) + digits.try_cast("bigint") - minutes.cast("bigint") * 60_000_000
    return F.when(text.rlike(whole), F.timestamp_micros(micros).cast("timestamp_ntz"))


def identifier(text: Column) -> Column:
    """An identifier without outer white space; null for an empty one."""
    clean = F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")
    return F.when(clean != "", clean)


# --- search modes ---------------------------------------------------------------------------------------------------


def dispatched(mode: str, dense: DataFrame, sparse: DataFrame, key: str, alpha: float = 0.7) -> DataFrame:
    """(key, score): the hits of a search mode: ``dense``, ``sparse`` or ``hybrid``, their blend; others are refused."""
    if mode == "dense":
        return dense.select(key, "score")
    if mode == "sparse":
        return sparse.select(key, "score")
    if mode == "hybrid":
        return alpha_blend(dense, sparse, key, alpha).select(key, F.col("blend").alias("score"))
    raise ValueError(f"unknown mode: {mode}")
