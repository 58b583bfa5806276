"""Committing a batch of answers: checks, suggestions with sequence numbers, unit states. All in the session's row.

A row has slots (array as of segment.slot_array), units (array of unit_id, slot_ids, status), and a batch: batch_id,
unit_ids, response (JSON), next_sequence. A batch is committed whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.functions.text import let
from foliant.operators import targets
from foliant.operators.segment import struct
from foliant.plans import protocol


def _ids(slots: Column) -> Column:
    return F.transform(slots, lambda s: s["slot_id"])


def _own(slots: Column, ids: Column, slot_ids: Column) -> Column:
    """The slots with one of slot_ids, in order; ids: those of slots. Places are looked up natively, a lambda over all slots costs far more."""
    places = F.array_distinct(F.filter(F.transform(slot_ids, lambda x: F.array_position(ids, x).cast("int")), lambda p: p > 0))
    return F.transform(F.array_sort(places), lambda p: F.get(slots, p - 1))


def unit_text(slots: Column, slot_ids: Column, updates: Column | None = None) -> Column:
    """The text of a unit, its slots with the updates (a map from slot id to text). Null if a slot is missing."""
    return let(slots, lambda all_slots: let(_ids(all_slots), lambda ids: let(_own(all_slots, ids, slot_ids), lambda own: _text_of(own, slot_ids, updates))))


def _text_of(own: Column, slot_ids: Column, updates: Column | None = None) -> Column:
    def text(s: Column) -> Column:
        return s["text"] if updates is None else F.coalesce(F.try_element_at(updates, s["slot_id"]), s["text"])

    return F.when(F.size(own) == F.size(slot_ids), F.array_join(F.transform(own, lambda s: F.concat(text(s), s["separator_after"])), ""))


def batch_problem(batch_id: Column, unit_ids: Column, slots: Column, units: Column, response: Column) -> Column:
    """Why a batch cannot be committed; null for a good one."""
    # bound to names: what a lambda takes from outside may be worked out again at each of its calls
    return let(slots, lambda s: let(_ids(s), lambda ids: let(units, lambda u: let(unit_ids, lambda wanted: _problem(batch_id, wanted, s, ids, u, response)))))


def _problem(batch_id: Column, unit_ids: Column, slots: Column, ids: Column, units: Column, response: Column) -> Column:
    able = lambda u: F.filter(_own(slots, ids, u["slot_ids"]), lambda s: s["editable"])
    locked = F.exists(units, lambda u: (u["status"] == "done") & F.array_contains(unit_ids, u["unit_id"]) & (F.size(able(u)) == 0))
    unknown = F.size(F.array_except(unit_ids, targets.ids_of(units))) > 0
    # map from a unit's id to the ids of its editable slots
    editable = F.map_from_entries(F.transform(units, lambda u: F.struct(u["unit_id"], _ids(able(u)))))
    answer = protocol.response_problem(batch_id, unit_ids, editable, response)
    return F.when(unknown, "unknown_unit").otherwise(F.coalesce(answer, F.when(locked, "protected_unit")))


def _suggestions(row: dict[str, Column], decision: str) -> Column:
    """Array of suggestions of a good batch; texts get the layout of their slots."""
    results = F.from_json(row["response"], protocol.RESPONSE)["results"]

    def made(results: Column, slots: Column, ids: Column, units: Column, unit_ids: Column) -> Column:
        def suggestion(r: Column, k: Column) -> Column:
            laid = F.transform(r["updates"], lambda u: let(F.get(slots, F.array_position(ids, u["slotId"]).cast("int") - 1)["text"], lambda x: struct(slot_id=u["slotId"], text=t.match_layout(u["text"], x))))
            own_ids = F.get(units, F.array_position(unit_ids, r["rewriteUnitId"]).cast("int") - 1)["slot_ids"]
            return let(laid, lambda updates: let(own_ids, lambda own: let(_own(slots, ids, own), lambda x: described(r, k, updates, own, x))))

        def described(r: Column, k: Column, updates: Column, own_ids: Column, own: Column) -> Column:
            new = F.map_from_entries(F.transform(updates, lambda u: F.struct(u["slot_id"], u["text"])))
            sequence = row["next_sequence"] + k
            return struct(
                suggestion_id=F.concat(row["batch_id"], F.lit("#"), sequence.cast("string")), sequence=sequence.cast("long"), unit_id=r["rewriteUnitId"],
                before_text=_text_of(own, own_ids), after_text=let(new, lambda n: _text_of(own, own_ids, n)), decision=F.lit(decision), slot_updates=updates,
            )

        return F.transform(results, suggestion)

    return let(results, lambda r: let(row["slots"], lambda s: let(_ids(s), lambda ids: let(row["units"], lambda u: let(targets.ids_of(u), lambda unit_ids: made(r, s, ids, u, unit_ids))))))


def committed(batches: DataFrame, auto: bool = False) -> DataFrame:
    """batches with problem, suggestions, units (with their new states) and next_sequence.

    auto: the suggestions are applied at once, else proposed. A good batch's units are done; of a bad one they fail,
    all other running units are idle again, and there are no suggestions.
    """
    row = {c: F.col(c) for c in ("batch_id", "unit_ids", "slots", "units", "response", "next_sequence")}
    problem = batch_problem(row["batch_id"], row["unit_ids"], row["slots"], row["units"], row["response"])
    out = batches.withColumn("problem", t.let(problem, lambda p: p))
    good = F.col("problem").isNull()
    made = F.when(good, _suggestions(row, "applied" if auto else "proposed"))
    units = F.when(good, targets.with_status(row["units"], row["unit_ids"], "done")["units"]).otherwise(targets.failed(row["units"], row["unit_ids"])["units"])
    out = out.withColumns({"suggestions": made, "units": units})
    return out.withColumn("next_sequence", F.col("next_sequence") + F.coalesce(F.size("suggestions"), F.lit(0)))


def completed_events(done: DataFrame) -> DataFrame:
    """doc_id, unit_id, suggestion_id, sequence of every suggestion that a committed batch has made."""
    return suggestions(done).select("doc_id", "unit_id", "suggestion_id", "sequence")


def suggestions(done: DataFrame) -> DataFrame:
    """doc_id and one row for each suggestion of committed().

    An outer inline: a plain one would have every suggestion worked out once more, for a filter on their number.
    """
    return done.select("doc_id", F.inline_outer("suggestions")).filter("suggestion_id IS NOT NULL")


def run_rewrite(batches: DataFrame, rewriter, auto: bool = False) -> DataFrame:
    """The rewriter is a function from a frame with a column request to the same frame with a column response."""
    return committed(rewriter(batches), auto)
