"""Running sums and as-of lookups over ordered rows, by ranges of the order and not by key.

A plain window takes all rows of a key into one task. Here rows are dealt to ranges of (key, order), and written, so that
a key with a third of all rows fills as many ranges as it needs. Windows then run inside a range, and what a key's earlier
ranges come to is carried in: only keys that cross a border need that, at most two for each range, so the carries are small
whatever the input, and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.scratch import stored

#: monotonically_increasing_id() has the partition above these bits.
PLACE_BITS = 33
PART, PLACE = "_part", "_place"


def in_ranges(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows as a stored table with _part, the range, and _place, which rises with (by, order) over all of the table."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn(PLACE, F.monotonically_increasing_id())
    return stored(dealt.withColumn(PART, F.shiftright(PLACE, PLACE_BITS).cast("int")), "ranges")


def _inside(by: list[str]):
    return Window.partitionBy(PART, *by).orderBy(PLACE)


def _carried(ranged: DataFrame, by: list[str], value: Column, over) -> DataFrame:
    """_part, by, carry: over(the values of the key's earlier parts), for the keys that are in several parts."""
    sums = ranged.groupBy(PART, *by).agg(value.alias("own"))
    parts = Window.partitionBy(*by)
    carry = over(F.col("own")).over(parts.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(PART, *by, carry.alias("carry"), F.count("*").over(parts).alias("n")).filter("n > 1").drop("n")


def _joined(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    same = F.col(f"r.{PART}") == F.col(f"c.{PART}")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    return rows.alias("r").join(F.broadcast(carried).alias("c"), same, "left").select("r.*", "c.carry")


def running_sum(ranged: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """in_ranges() rows with name: the sum of value over the rows of the key before this one; nulls count as 0."""
    inside = F.sum(value).over(_inside(by).rowsBetween(Window.unboundedPreceding, -1))
    rows = _joined(ranged.withColumn(name, inside), _carried(ranged, by, F.sum(value), F.sum), by)
    zero = F.lit(0).cast("long")
    return rows.withColumn(name, F.coalesce(name, zero) + F.coalesce("carry", zero)).drop("carry")


def last_known(ranged: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """in_ranges() rows with name: the last value that is not null up to this row, in the key."""
    inside = F.last(value, ignorenulls=True).over(_inside(by).rowsBetween(Window.unboundedPreceding, 0))
    known = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(PLACE)))
    rows = _joined(ranged.withColumn(name, inside), _carried(ranged, by, known, lambda c: F.last(c, ignorenulls=True)), by)
    return rows.withColumn(name, F.coalesce(name, "carry")).drop("carry")
