"""Preview of a batch before it is committed: what the document would be, judged by the write-back gates. Nothing is written.

A row is a session with a batch, as for commit.committed(), and with its log: suggestions (array of sequence, unit_id, decision,
slot_updates). The log's applied suggestions and the batch's answers are laid over the slots together. One fault, anywhere, and the
whole batch has no preview.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.functions.text import let
from foliant.operators import commit, writeback
from foliant.operators.segment import struct
from foliant.plans import protocol

ROW = ("slots", "units", "batch_id", "unit_ids", "response", "suggestions")


def applied_updates(suggestions: Column, replaced: Column) -> Column:
    """Map from slot id to text of the applied suggestions, but for units in replaced; of two for one slot, the one of the later sequence."""
    own = F.filter(suggestions, lambda s: (s["decision"] == "applied") & ~F.array_contains(replaced, s["unit_id"]))
    every = F.flatten(F.transform(own, lambda s: F.transform(s["slot_updates"], lambda u: struct(slot_id=u["slot_id"], order=-s["sequence"], text=u["text"]))))

    def latest(entries: Column) -> Column:
        first = F.filter(F.transform(entries, lambda e, i: F.when((i == 0) | (F.get(entries, i - 1)["slot_id"] != e["slot_id"]), e)), lambda e: e.isNotNull())
        return F.map_from_entries(F.transform(first, lambda e: F.struct(e["slot_id"], e["text"])))

    return let(F.array_sort(every), latest)


def _answers(slots: Column, response: Column) -> Column:
    """Map from slot id to text of a batch's answers, in the layout of their slots."""
    sources = F.map_from_entries(F.transform(slots, lambda s: F.struct(s["slot_id"], s["text"])))
    updates = F.flatten(F.transform(F.from_json(response, protocol.RESPONSE)["results"], lambda r: r["updates"]))
    return let(sources, lambda m: F.map_from_entries(F.transform(updates, lambda u: F.struct(u["slotId"], t.match_layout(u["text"], F.try_element_at(m, u["slotId"]))))))


def _log_problem(slots: Column, log: Column) -> Column:
    """unknown_slot or locked_slot, if an applied suggestion of the log updates such a one."""
    ids = lambda some: F.transform(some, lambda s: s["slot_id"])
    keys = F.map_keys(log)
    return F.when(F.size(F.array_except(keys, ids(slots))) > 0, "unknown_slot").when(F.arrays_overlap(keys, ids(F.filter(slots, lambda s: ~s["editable"]))), "locked_slot")


def previewed(batches: DataFrame) -> DataFrame:
    """batches with problem, text and changed (ids of the slots that would change); text and changed are null if there is a problem.

    batches: the columns of ROW, and those that writeback.gated() asks for besides slots. The problem is the batch's own (as
    commit.batch_problem() tells), else the log's, else the gates'. No shuffle.
    """
    own = commit.batch_problem(F.col("batch_id"), F.col("unit_ids"), F.col("slots"), F.col("units"), F.col("response"))
    rows = batches.withColumn("_own", t.let(own, lambda p: p)).withColumn("_log", applied_updates(F.col("suggestions"), F.col("unit_ids")))
    rows = rows.withColumn("_batch", F.when(F.col("_own").isNull(), _answers(F.col("slots"), F.col("response"))))
    new = lambda s: F.coalesce(F.try_element_at("_batch", s["slot_id"]), F.try_element_at("_log", s["slot_id"]), s["text"])
    rows = rows.withColumn("_before", F.col("slots")).withColumn("slots", F.transform("slots", lambda s: s.withField("text", new(s))))
    judged = writeback.gated(rows)
    problem = F.coalesce("_own", _log_problem(F.col("_before"), F.col("_log")), "error")
    differ = F.filter(F.zip_with("_before", "slots", lambda a, b: F.when(a["text"] != b["text"], a["slot_id"])), lambda x: x.isNotNull())
    judged = judged.withColumn("problem", problem).withColumn("changed", F.when(problem.isNull(), differ)).withColumn("text", F.when(problem.isNull(), F.col("text")))
    return judged.withColumn("slots", F.col("_before")).drop("_own", "_log", "_batch", "_before", "error")
