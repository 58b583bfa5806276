"""Writing back: structure signatures, and texts rebuilt from slots in the source's layout."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t


def structure_signature(slots: DataFrame) -> DataFrame:
    """doc_id, signature: over order, editable, role, id and separator of the slots, not over their texts."""
    part = F.to_json(F.struct("slot_order", "editable", "role", "slot_id", "separator_after"), {"ignoreNullFields": "false"})
    ordered = F.array_sort(F.collect_list(F.struct("slot_order", part.alias("part"))))
    return slots.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda s: s["part"]), ","), 256).alias("signature"))


def snapshot(content: Column) -> Column:
    return F.sha2(content, 256)


def snapshot_error(expected: Column, found: Column) -> Column:
    return F.when(expected.isNull(), "missing_snapshot").when(expected != found, "source_changed")


def signature_error(expected: Column, found: Column) -> Column:
    """missing_signature or structure_changed; null where they match."""
    return F.when(expected.isNull(), "missing_signature").when(~expected.eqNullSafe(found), "structure_changed")


def slots_signature(slots: Column) -> Column:
    """The signature of an array of slots: order, editable, role, id and separator, not the texts."""
    part = lambda s: F.to_json(F.struct(s["slot_order"].alias("o"), s["editable"].alias("e"), s["role"].alias("r"), s["slot_id"].alias("i"), s["separator_after"].alias("s")))
    return F.sha2(F.array_join(F.transform(slots, part), ","), 256)


def template_signature(kind: Column, regions: Column) -> Column:
    """The signature of a template: its format and all of its regions."""
    return F.sha2(F.to_json(F.struct(kind.alias("kind"), regions.alias("regions")), {"ignoreNullFields": "false"}), 256)


def order_error(slots: Column, anchors: Column) -> Column:
    """anchor_order where the slots' regions do not follow the template's anchors in order; null where they do."""
    places = F.transform(slots, lambda s: F.array_position(anchors, F.regexp_extract(s["slot_id"], r"(?s)^(.*):s[0-9]+\z", 1)))
    falls = F.exists(F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.coalesce(b < a, F.lit(False))), lambda x: x)
    return F.when(F.exists(places, lambda p: p == 0) | falls, "anchor_order")


def gated(rows: DataFrame) -> DataFrame:
    """rows with text and error: what may be written back, or the first reason against it.

    rows: source_text, snapshot and found_snapshot, template_signature and found_template, structure_signature (known,
    and as found), anchors (of the template, in order), slots (with their new texts). No shuffle.
    """
    error = F.coalesce(
        snapshot_error(F.col("snapshot"), F.col("found_snapshot")), signature_error(F.col("template_signature"), F.col("found_template")),
        signature_error(F.col("structure_signature"), slots_signature(F.col("slots"))), order_error(F.col("slots"), F.col("anchors")),
    )
    text = F.array_join(F.transform("slots", lambda s: F.concat(s["text"], s["separator_after"])), "")
    return rows.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), t.match_layout(text, F.col("source_text"))))


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        errors = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
            try:
                with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as file:
                    file.write(text.encode())
                    file.flush()
                    os.fsync(file.fileno())
                os.replace(file.name, path)
                errors.append(None)
            except OSError as error:
                errors.append(type(error).__name__)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(errors, pa.string())], ["path", "error"])


def write_in_place(rows: DataFrame) -> DataFrame:
    """Replaces files on a file system that all executors mount: path, error of every row with a text.

    Each file is written beside its place and renamed, so a reader sees the old or the new one, and a task that runs
    twice writes the same. Elsewhere write gated() as a table.
    """
    return rows.filter("text IS NOT NULL").select("path", "text").mapInArrow(_replaced, "path string, error string")


def written_texts(slots: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, text, error: slots joined in order, in the layout of the source, if no slot has an error.

    slots: as of review.projected_slots(); sources: doc_id, text.
    """
    rows = F.array_sort(F.collect_list(F.struct("slot_order", F.concat("text", "separator_after").alias("piece"))))
    joined = slots.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda s: s["piece"]), "").alias("new_text"), F.min("error").alias("error"))
    both = joined.join(sources.select("doc_id", F.col("text").alias("source_text")), "doc_id")
    laid_out = t.match_layout(F.col("new_text"), F.col("source_text"))
    return both.select("doc_id", F.when(F.col("error").isNull(), laid_out).alias("text"), "error")
