"""Which unit a place in a text belongs to: ranges by running sums of slots, and an interval lookup of many places at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.operators import ranges
from foliant.operators.segment import inlined, slot_array, struct, unit_array
from foliant.plans.scratch import stored


def unit_slots(docs: DataFrame, preset: str) -> DataFrame:
    """doc_id and a row for each slot: slot_order, n_chars (with its separator), unit_id and unit_order, null where no unit has it.

    All in the row, and linear in its slots.
    """
    made = docs.select("doc_id", slot_array(F.col("text")).alias("slots"))
    made = made.withColumn("units", unit_array(F.transform("slots", lambda s: s.withField("slot_id", s["slot_order"].cast("string"))), preset))
    return inlined(made.select("doc_id", let(F.col("slots"), lambda s: let(F.col("units"), lambda u: _owned(s, u))).alias("slots")))


def _owned(slots: Column, units: Column) -> Column:
    """Array of slots with their units, whose slot_ids here are places of slots: first those that a unit has, then the others."""

    def row(place: Column, unit_id: Column, unit_order: Column) -> Column:
        return let(F.get(slots, place), lambda s: struct(slot_order=place, n_chars=(F.length(s["text"]) + F.length(s["separator_after"])).cast("long"), unit_id=unit_id, unit_order=unit_order))

    own = F.flatten(F.transform(units, lambda u: F.transform(u["slot_ids"], lambda p: row(p.cast("int"), u["unit_id"], u["unit_order"]))))
    every = F.transform(slots, lambda s: s["slot_order"])
    free = F.array_except(every, F.flatten(F.transform(units, lambda u: F.transform(u["slot_ids"], lambda p: p.cast("int")))))
    return F.concat(own, F.transform(free, lambda p: row(p, F.lit(None).cast("string"), F.lit(None).cast("int"))))


def slot_ranges(slots: DataFrame) -> DataFrame:
    """slots (doc_id, slot_order, n_chars and more) with start and end, code points from 0, end exclusive."""
    # stored first, as finding the ranges would make the slots once more
    placed = ranges.running_sum(ranges.in_ranges(stored(slots, "slots"), ["doc_id"], ["slot_order"]), ["doc_id"], "n_chars", "start")
    return placed.select(*slots.columns, "start", (F.col("start") + F.col("n_chars")).alias("end"))


def owners_at(points: DataFrame, spans: DataFrame, values: list[str]) -> DataFrame:
    """points (doc_id, offset and more) with the values of the span that holds the offset, null where none does.

    spans: doc_id, start, end and values; those of a document do not overlap. Spans and points are put in one order and each
    point takes the span begun last: no pairs are made, and no document is one group. Empty spans hold nothing.
    """
    own = [c for c in points.columns if c not in ("doc_id", "offset")]
    begun = spans.filter(F.col("end") > F.col("start")).select(
        "doc_id", F.col("start").alias("offset"), F.lit(0).alias("kind"), F.struct("end", *values).alias("span"), F.lit(None).cast(points.select(F.struct(*own) if own else F.struct("offset")).schema[0].dataType).alias("row")
    )
    asked = points.select("doc_id", "offset", F.lit(1).alias("kind"), F.lit(None).cast(begun.schema["span"].dataType).alias("span"), (F.struct(*own) if own else F.struct("offset")).alias("row"))
    found = ranges.last_known(ranges.in_ranges(begun.unionByName(asked), ["doc_id"], ["offset", "kind"]), ["doc_id"], "span", "held").filter("kind = 1")
    inside = F.col("offset") < F.col("held.end")
    return found.select("doc_id", "offset", *(F.col("row").getField(c).alias(c) for c in own), *(F.when(inside, F.col("held").getField(v)).alias(v) for v in values))


def marks(docs: DataFrame, marks: str) -> DataFrame:
    """doc_id, offset, mark of every character of each text that is one of marks; by running sums over the pieces up to a mark."""
    # held to the end of the last piece, as the text after the last mark would be tried from each of its characters
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s)\G[^{marks}]*+[{marks}]"), F.lit(0))
    cut = docs.select("doc_id", F.posexplode_outer(F.transform(pieces, lambda p: struct(n=F.length(p).cast("long"), mark=F.right(p, F.lit(1))))).alias("place", "piece"))
    cut = cut.filter("place IS NOT NULL").select("doc_id", "place", "piece.n", "piece.mark")
    placed = ranges.running_sum(ranges.in_ranges(stored(cut, "marks"), ["doc_id"], ["place"]), ["doc_id"], "n", "before")
    return placed.select("doc_id", (F.col("before") + F.col("n") - 1).alias("offset"), "mark")


