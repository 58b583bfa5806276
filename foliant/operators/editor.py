"""The editor's side: texts with overrides, edits of slots, hunks by slot and by unit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import diff
from foliant.operators.segment import struct


def slot_text(slot: Column, overrides: Column) -> Column:
    """A slot's text with the overrides, a map from slot id to text."""
    return F.coalesce(F.try_element_at(overrides, slot["slot_id"]), slot["text"])


def editor_text(slots: Column, overrides: Column) -> Column:
    return F.array_join(F.transform(slots, lambda s: F.concat(slot_text(s, overrides), s["separator_after"])), "")


def slot_edits(slots: Column, overrides: Column) -> Column:
    """Array of (slot_id, text) of all editable slots."""
    return F.transform(F.filter(slots, lambda s: s["editable"]), lambda s: struct(slot_id=s["slot_id"], text=slot_text(s, overrides)))


def overridden(overrides: Column, slot: Column, text: Column) -> Column:
    """overrides after an edit of a slot: none for a locked one, and none where the text is the slot's own again."""
    others = F.map_filter(overrides, lambda k, _: k != slot["slot_id"])
    return F.when(~slot["editable"], overrides).when(text == slot["text"], others).otherwise(F.map_concat(others, F.create_map(slot["slot_id"], text)))


def edits_error(slots: Column, edits: Column) -> Column:
    """Why edits cannot be saved: they must name every editable slot once, and no other."""
    able = F.transform(F.filter(slots, lambda s: s["editable"]), lambda s: s["slot_id"])
    named = F.transform(edits, lambda e: e["slot_id"])
    return (
        F.when(F.size(named) != F.size(able), "count").when(F.size(F.array_except(named, able)) > 0, "unknown_or_locked_slot")
        .when(F.size(F.array_distinct(named)) != F.size(named), "repeated_slot")
    )


def edited_slots(slots: Column, edits: Column) -> Column:
    """Struct (slots, error): the slots with the edits' texts."""
    error = edits_error(slots, edits)
    new = F.map_from_entries(F.transform(edits, lambda e: F.struct(e["slot_id"], e["text"])))
    return struct(slots=F.when(error.isNull(), F.transform(slots, lambda s: s.withField("text", F.coalesce(F.try_element_at(new, s["slot_id"]), s["text"])))), error=error)


def text_writeback(mode: Column, source: Column, entry: Column, source_text: Column, text: Column) -> Column:
    """Struct (text, error): a whole text in the source's layout. mode: the editor's; source and entry: gates."""
    error = F.when(t.is_blank(text), "empty").when(~source["allowed"], source["reason"]).when(~entry["allowed"], entry["reason"]).when(mode == "slotBased", "slots_only").when(mode == "none", "no_editor")
    return struct(text=F.when(error.isNull(), t.match_layout(text, source_text)), error=error)


def slot_writeback(mode: Column, source: Column, entry: Column, slots: Column, edits: Column) -> Column:
    """Struct (slots, error) of edits by slot."""
    error = F.when(~source["allowed"], source["reason"]).when(~entry["allowed"], entry["reason"]).when(mode != "slotBased", "no_slots")
    made = edited_slots(slots, edits)
    return struct(slots=F.when(error.isNull(), made["slots"]), error=F.coalesce(error, made["error"]))


def slot_hunks(sessions: DataFrame) -> DataFrame:
    """doc_id, hunk_id, sequence, before, after, spans, inserted, deleted of every changed editable slot.

    sessions: doc_id, slots, overrides. Line ends do not count as changes. No shuffle.
    """
    changed = F.filter(
        F.transform(F.filter("slots", lambda s: s["editable"]), lambda s: struct(hunk_id=F.concat(F.lit("slot-"), s["slot_id"]), before=t.to_lf(s["text"]), after=t.to_lf(slot_text(s, F.col("overrides"))))),
        lambda h: h["before"] != h["after"],
    )
    rows = sessions.select("doc_id", F.posexplode(changed).alias("at", "h")).select("doc_id", "h.hunk_id", (F.col("at") + 1).alias("sequence"), "h.before", "h.after")
    return _with_stats(diff.with_diffs(rows))


def _with_stats(rows: DataFrame) -> DataFrame:
    stats = diff.diff_stats(F.col("spans"))
    return rows.select("doc_id", "hunk_id", "sequence", "before", "after", "spans", stats["inserted"].alias("inserted"), stats["deleted"].alias("deleted"))


def hunk_totals(hunks: DataFrame) -> DataFrame:
    return hunks.groupBy("doc_id").agg(F.sum("inserted").alias("inserted"), F.sum("deleted").alias("deleted"))


def dealt(units: list[str], spans: list[tuple[str, str]]) -> list[str]:
    """The new text of each unit, from the spans of a diff of their joined texts.

    What is inserted where two units meet goes to the second, but white space with a line break in front of it to the first.
    """
    out, k, at = [""] * len(units), 0, 0

    def forward() -> None:
        nonlocal k, at
        while k < len(units) and at == len(units[k]):
            k, at = k + 1, 0

    for kind, text in spans:
        forward()
        if kind != diff.INSERT:
            while text and k < len(units):
                piece = text[: len(units[k]) - at]
                if kind == diff.EQUAL:
                    out[k] += piece
                at, text = at + len(piece), text[len(piece) :]
                forward()
            if kind == diff.EQUAL and units:
                out[-1] += text
        elif k == len(units):
            out[-1] += text
        else:
            lead = text[: len(text) - len(text.lstrip(" \t\r\n"))] if at == 0 and k else ""
            lead = lead if "\n" in lead or "\r" in lead else ""
            if lead:
                out[k - 1] += lead
            out[k] += text[len(lead) :]
    return out


def _edit(before: str, after: str) -> list[tuple[str, str]]:
    """Spans of an edit of a whole text. Last lines that both have are kept first, so that of lines alike the edited one changes."""
    a, b = diff.lines_of(before), diff.lines_of(after)
    start = diff.common(a, b)
    end = diff.common(a[start:][::-1], b[start:][::-1])
    spans, _ = diff.diff_texts("".join(a[: len(a) - end]), "".join(b[: len(b) - end]))
    return [(kind, text) for kind, text in spans] + [(diff.EQUAL, "".join(a[len(a) - end :]))]


def _unit_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("unit_id", pa.string()), ("before", pa.string()), ("after", pa.string())]))
    for batch in batches:
        rows = []
        for units, text in zip(batch.column("units").to_pylist(), batch.column("text").to_pylist(), strict=True):
            before = [u["text"] for u in units]
            after = dealt(before, _edit("".join(before), text or "")) if units else []
            rows.append([{"unit_id": u["unit_id"], "before": b, "after": a} for u, b, a in zip(units, before, after, strict=True) if a != b])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "changes"])


def unit_hunks(sessions: DataFrame) -> DataFrame:
    """doc_id, hunk_id, sequence, before, after, spans, inserted, deleted of every unit that an edit of the whole text changes.

    sessions: doc_id, units (array of unit_id, text, in order), text (the edited one). Line ends do not count.
    """
    id_kind = sessions.schema["doc_id"].dataType.simpleString()
    slim = sessions.select("doc_id", F.transform("units", lambda u: struct(unit_id=u["unit_id"], text=t.to_lf(u["text"]))).alias("units"), t.to_lf(F.col("text")).alias("text"))
    slim = slim.filter(F.array_join(F.transform("units", lambda u: u["text"]), "") != F.col("text"))
    found = slim.mapInArrow(_unit_changes, f"doc_id {id_kind}, changes array<struct<unit_id:string,before:string,after:string>>")
    rows = found.select("doc_id", F.posexplode("changes").alias("at", "c"))
    return _with_stats(diff.with_diffs(rows.select("doc_id", F.concat(F.lit("rewrite-unit-"), "c.unit_id").alias("hunk_id"), (F.col("at") + 1).alias("sequence"), "c.before", "c.after")))
