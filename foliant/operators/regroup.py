"""Slots back to regions: neighbours with one anchor are one region, by the places where the anchor changes; linear, in the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.operators.page_chunks import region_of
from foliant.operators.segment import struct


def anchor_of(slot: Column) -> Column:
    """The region a slot's id names, else the id itself."""
    return F.coalesce(region_of(slot["slot_id"]), slot["slot_id"])


def regions_of(slots: Column, anchor: Callable[[Column], Column] = anchor_of) -> Column:
    """Array of regions: anchor, text (of the slots, with their separators), editable (if any slot is), role, n_slots.

    An editable region's role is editableText, another's that of its first slot; a paragraph break is lockedText. An anchor that
    comes again after another one begins a region of its own. No slots, no regions.
    """

    def runs(s: Column, names: Column) -> Column:
        starts = F.filter(F.transform(names, lambda a, i: F.when((i == 0) | (a != F.get(names, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: one(s, names, i, F.coalesce(F.get(at, k + 1), F.size(s)))))

    def one(s: Column, names: Column, start: Column, end: Column) -> Column:
        return let(F.slice(s, start + 1, end - start), lambda own: region(own, F.get(names, start)))

    def region(own: Column, name: Column) -> Column:
        role = F.get(own, F.lit(0))["role"]
        editable = F.exists(own, lambda x: x["editable"])
        kept = F.when(editable, "editableText").when(role.isin("inlineObject", "syntaxToken"), role).otherwise("lockedText")
        return struct(anchor=name, text=F.array_join(F.transform(own, lambda x: F.concat(x["text"], x["separator_after"])), ""), editable=editable, role=kept, n_slots=F.size(own))

    kind = "array<struct<anchor:string,text:string,editable:boolean,role:string,n_slots:int>>"
    made = let(slots, lambda s: let(F.transform(s, anchor), lambda names: runs(s, names)))
    return F.when(F.size(slots) > 0, made).otherwise(F.array()).cast(kind)


def regions(slots: DataFrame) -> DataFrame:
    """doc_id, region_order and one row for each region, from doc_id and an array slots."""
    return slots.select("doc_id", F.posexplode(regions_of(F.col("slots"))).alias("region_order", "r")).select("doc_id", "region_order", "r.*")
