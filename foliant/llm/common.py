"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.scratch import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(names: Iterable[str], wish: str) -> str:
    """wish, or wish with underscores before it, whichever no name of names is, in any case of letters."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


#: The column that with_row_key() adds.
ROW = "_row_key"


def with_row_key(df: DataFrame) -> DataFrame:
    """df, whose columns are the library's own, with ROW: a key for each row, written once so that every read sees the same."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """ROW and the columns of a user's table in one struct, `kept`, so that no name can clash; written once, as above."""
    return stored(docs.select(F.monotonically_increasing_id().alias(ROW), packed(docs).alias("kept")), "rows")


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct; unpacked() takes it apart again."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)) if df.columns else F.struct(F.lit(None).alias("_"))


def unpacked(df: DataFrame, names: list[str], column: str = "kept") -> DataFrame:
    return df.select(*(F.col(column).getField(c).alias(c) for c in names))


def give_back() -> None:
    """Returns freed memory to the machine, at the end of a task: Spark keeps a Python worker for later tasks, beside whose JVM it would stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


#: Rows that a Python worker works on at once, of a larger batch.
SLICE_ROWS = 1000


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, without a copy: what is made of one slice is handed on before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def id_crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


#: Of a broadcast side: the most rows of a few numbers each, about 100 bytes a row when hashed.
BROADCAST_ROWS = 250_000
#: A key is heavy with over HEAVY_LEAST rows that are over 1 / HEAVY_PART of all; so there are fewer than HEAVY_PART.
HEAVY_LEAST = 1000
HEAVY_PART = 1000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table of slim rows may be broadcast."""
    return df.count() <= rows


def without_rows(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """df without the keys of dropped, a stored table of one number column: broadcast if there are few, else by shuffle."""
    return df.join(F.broadcast(dropped) if small(dropped) else dropped, key, "left_anti")


def join_salted(left: DataFrame, right: DataFrame, key: str, by: str, counted: DataFrame | None = None) -> DataFrame:
    """left joined (inner) to right on one key, where right has few rows for a key, each too large to broadcast.

    by: a column that differs among left's rows of a key. counted: a stored table with left's keys, left itself if not given.

    Of a heavy key, one of under HEAVY_PART that have over a HEAVY_PART-th of left's rows, left's rows are dealt to parts of about
    that size and right's are copied to each part: fewer than 2 * HEAVY_PART copies in all.
    """
    counted = left if counted is None else counted
    total = counted.count()
    if total <= HEAVY_LEAST:
        return left.join(right, key)
    heavy = counted.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > HEAVY_LEAST) & (F.col("n") * HEAVY_PART > total))
    found = heavy.select(key, F.ceil(F.col("n") * HEAVY_PART / F.lit(total)).cast("int").alias("salts"))
    rows = found.collect()  # fewer than HEAVY_PART
    if not rows:
        return left.join(right, key)
    heavy = left.sparkSession.createDataFrame(rows, found.schema)
    salts = F.coalesce("salts", F.lit(1))
    dealt = left.join(F.broadcast(heavy), key, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts")
    copied = right.join(F.broadcast(heavy), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copied, [key, "salt"]).drop("salt")


def join_weighted(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "left") -> DataFrame:
    """left joined to right, a stored slim table with one row for each key and the number of left's rows that have it.

    A small right is broadcast. Otherwise the heavy keys, fewer than HEAVY_PART, are split off and broadcast, and
    the rest is shuffled, so no task gets over a thousandth of left's rows for one key. how: left, inner or left_semi.
    """
    if small(right):
        return left.join(F.broadcast(right), on, how)
    total = right.agg(F.sum(weight)).first()[0]
    is_heavy = F.coalesce((F.col(weight) > HEAVY_LEAST) & (F.col(weight) * HEAVY_PART > F.lit(total)), F.lit(False))
    heavy, light = F.broadcast(right.filter(is_heavy)), right.filter(~is_heavy)
    hot = left.join(heavy, on, "left_semi" if how == "left_semi" else "inner")
    return hot.unionByName(left.join(heavy.select(*on), on, "left_anti").join(light, on, how))
