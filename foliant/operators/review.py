"""Review of rewrites: the decision log, its replay, and what it says about units and sessions.

Tables, all keyed by doc_id: suggestions (sequence, unit_id, decision), units (unit_id, status), commands
(sequence, unit_id, action). Counts and maxima are grouped aggregates, combined map-side. Where rows meet a value of
their unit, units with much of the table are split off and joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is heavy with over HEAVY_LEAST dismissed rows that are over 1 / HEAVY_PART of all; so there are at most HEAVY_PART.
HEAVY_LEAST = 1000
HEAVY_PART = 1000


def decided(log: DataFrame) -> DataFrame:
    """log (doc_id, unit_id, sequence, action of propose, apply, dismiss) as suggestions with their decisions.

    Applying one dismisses those applied before in its unit, so the last applied one of a unit stays.
    """
    last = log.filter("action = 'apply'").groupBy("doc_id", "unit_id").agg(F.max("sequence").alias("applied_at"))
    decision = (
        F.when(F.col("sequence") == F.col("applied_at"), "applied")
        .when(F.col("action").isin("apply", "dismiss"), "dismissed").otherwise("proposed")
    )
    return log.join(last, ["doc_id", "unit_id"], "left").select("doc_id", "unit_id", "sequence", decision.alias("decision"))


def replayed(log: DataFrame) -> DataFrame:
    """The suggestions that a log of actions by suggestion leaves: doc_id, unit_id, suggestion_id, sequence, decision.

    log: doc_id, unit_id, suggestion_id, at (the order of the actions), action. A suggestion lives from its first
    propose to its first delete after that; actions outside its life are left out (action_errors() tells them).
    Applying one dismisses the unit's others that are applied then; dismissing and deleting touch no other. The sequence
    is that of its propose. All are grouped aggregates and a join of one row for each suggestion with one for each unit.
    """
    lives = _lives(log)
    last = lambda a: F.max(F.when(F.col("action") == a, F.col("at")))
    key = ["doc_id", "unit_id", "suggestion_id"]
    acted = log.join(lives, key).filter((F.col("at") >= F.col("born")) & (F.col("died").isNull() | (F.col("at") < F.col("died"))))
    own = acted.groupBy(*key).agg(F.min("born").alias("sequence"), last("apply").alias("applied_at"), last("dismiss").alias("dismissed_at"), F.max("died").alias("died"))
    latest = own.groupBy("doc_id", "unit_id").agg(F.max("applied_at").alias("unit_applied_at"))
    both = own.filter("died IS NULL").join(latest, ["doc_id", "unit_id"])
    decision = (
        F.when(F.greatest("applied_at", "dismissed_at").isNull(), "proposed")
        .when((F.col("applied_at") == F.col("unit_applied_at")) & (F.col("dismissed_at").isNull() | (F.col("dismissed_at") < F.col("applied_at"))), "applied").otherwise("dismissed")
    )
    return both.select(*key, "sequence", decision.alias("decision"))


def _lives(log: DataFrame) -> DataFrame:
    """When each suggestion was proposed first and deleted first after that."""
    key = ["doc_id", "unit_id", "suggestion_id"]
    born = log.filter("action = 'propose'").groupBy(*key).agg(F.min("at").alias("born"))
    gone = log.filter("action = 'delete'").select(*key, "at").join(born, key).filter("at > born").groupBy(*key).agg(F.min("at").alias("died"))
    return born.join(gone, key, "left")


def action_errors(log: DataFrame) -> DataFrame:
    """The actions on suggestions that are not there: before their propose, or after their delete."""
    key = ["doc_id", "unit_id", "suggestion_id"]
    both = log.join(_lives(log), key, "left")
    lost = F.col("born").isNull() | (F.col("at") < F.col("born")) | F.coalesce(F.col("at") > F.col("died"), F.lit(False))
    return both.filter(lost).select(*key, "at", "action", F.lit("unknown_suggestion").alias("error"))


def reset_units(units: DataFrame, log: DataFrame) -> DataFrame:
    """units (doc_id, unit_id, status) after the log: a done unit whose last suggestion was deleted is idle again."""
    deleted = _lives(log).groupBy("doc_id", "unit_id").agg(F.count_if(F.col("died").isNotNull()).alias("n_deleted"), F.count_if(F.col("died").isNull()).alias("n_left"))
    bare = deleted.filter("n_deleted > 0 AND n_left = 0").select("doc_id", "unit_id", F.lit(True).alias("bare"))
    status = F.when((F.col("status") == "done") & F.col("bare"), "idle").otherwise(F.col("status"))
    return units.join(bare, ["doc_id", "unit_id"], "left").withColumn("status", status).drop("bare")


def unit_summary(suggestions: DataFrame) -> DataFrame:
    """doc_id, unit_id, n_suggestions, latest, latest_applied, latest_proposed, n_dismissed.

    n_dismissed counts from the newest one back to where both an applied and a proposed one have been seen; all of
    them if either is missing.
    """
    seq = F.col("sequence")
    of = lambda d: F.max(F.when(F.col("decision") == d, seq))
    key = ["doc_id", "unit_id"]
    units = suggestions.groupBy(*key).agg(
        F.count("*").alias("n_suggestions"), F.max(seq).alias("latest"), of("applied").alias("latest_applied"), of("proposed").alias("latest_proposed"),
        F.count_if(F.col("decision") == "dismissed").alias("n_gone"),
    )
    since = F.when(F.col("latest_applied").isNotNull() & F.col("latest_proposed").isNotNull(), F.least("latest_applied", "latest_proposed"))
    cuts = units.select(F.col("doc_id").alias("_doc"), F.col("unit_id").alias("_unit"), "n_gone", since.alias("since")).filter("since IS NOT NULL AND n_gone > 0")
    cuts = cuts.crossJoin(F.broadcast(cuts.agg(F.sum("n_gone").alias("every"))))
    heavy = (F.col("n_gone") > HEAVY_LEAST) & (F.col("n_gone") * HEAVY_PART > F.col("every"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("unit_id").eqNullSafe(F.col("_unit"))
    counted = lambda rows: rows.groupBy(*key).agg(F.count_if(seq >= F.col("since")).alias("n_since"))
    gone = suggestions.filter("decision = 'dismissed'").select(*key, "sequence")
    few = F.broadcast(cuts.filter(heavy).select("_doc", "_unit", "since"))
    light = gone.join(few, same, "left_anti").join(cuts.filter(~heavy).select("_doc", "_unit", "since"), same)
    n = counted(gone.join(few, same)).unionByName(counted(light)).select(F.col("doc_id").alias("_doc"), F.col("unit_id").alias("_unit"), "n_since")
    n_dismissed = F.when(since.isNull(), F.col("n_gone")).otherwise(F.coalesce("n_since", F.lit(0)))
    return units.join(n, same, "left").select(*key, "n_suggestions", "latest", "latest_applied", "latest_proposed", n_dismissed.cast("long").alias("n_dismissed"))


def session_stats(units: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row for each document with units: thirteen counters."""
    status = lambda s: F.count_if(F.col("status") == s)
    per_unit = units.groupBy("doc_id").agg(
        F.count("*").alias("total"), status("idle").alias("idle"), status("running").alias("running"), status("done").alias("done"), status("failed").alias("failed")
    )
    decision = lambda d: F.count_if(F.col("decision") == d)
    touched = suggestions.groupBy("doc_id", "unit_id").agg(F.count("*").alias("n"), *(decision(d).alias(d) for d in ("proposed", "applied", "dismissed")))
    per_log = touched.groupBy("doc_id").agg(
        F.sum("n").alias("suggestions_total"), F.sum("proposed").alias("suggestions_proposed"), F.sum("applied").alias("suggestions_applied"),
        F.sum("dismissed").alias("suggestions_dismissed"), F.count("*").alias("units_touched"), F.count_if(F.col("applied") > 0).alias("units_applied"),
        F.count_if((F.col("applied") == 0) & (F.col("proposed") > 0)).alias("units_proposed"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in per_log.columns[1:]]
    return per_unit.join(per_log, "doc_id", "left").select("doc_id", "total", "idle", "running", "done", "failed", (F.col("idle") + F.col("failed")).alias("pending_generation"), *zero)


def unit_display_status(status: Column, editable: Column, applied: Column, proposed: Column, n_suggestions: Column) -> Column:
    return (
        F.when(status == "running", "running").when(status == "failed", "failed").when(~editable, "skip")
        .when(applied.isNotNull(), "applied").when(proposed.isNotNull(), "proposed")
        .when((status == "done") & (n_suggestions > 0), "kept").otherwise("pending")
    )


def session_state(units: DataFrame) -> DataFrame:
    """doc_id, state: failed if any unit is, completed if all are done, else idle."""
    failed, done = F.bool_or(F.col("status") == "failed"), F.bool_and(F.col("status") == "done")
    return units.groupBy("doc_id").agg(F.when(failed, "failed").when(F.coalesce(done, F.lit(True)), "completed").otherwise("idle").alias("state"))


def pending_batches(units: DataFrame, size: int, statuses: tuple[str, ...] = ("idle", "failed")) -> DataFrame:
    """Pending units with their batch, in document order; a document's batches have size units each."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_order")) - 1
    return units.filter(F.col("status").isin(*statuses)).select("doc_id", "unit_id", "unit_order", F.floor(number / F.lit(max(size, 1))).cast("long").alias("batch"))


def projected_slots(slots: DataFrame, updates: DataFrame) -> DataFrame:
    """slots with the text of the latest applied update and an error code for unknown or locked slots.

    updates: doc_id, slot_id, sequence, text.
    """
    latest = updates.groupBy("doc_id", "slot_id").agg(F.max_by("text", "sequence").alias("new_text"))
    both = slots.join(latest, ["doc_id", "slot_id"], "full_outer")
    error = F.when(F.col("slot_order").isNull(), "unknown_slot").when(~F.col("editable") & F.col("new_text").isNotNull(), "locked_slot")
    text = F.when(error.isNull(), F.coalesce("new_text", "text")).otherwise(F.col("text"))
    return both.select("doc_id", "slot_id", "slot_order", text.alias("text"), "separator_after", "editable", "role", error.alias("error"))


def capabilities(sessions: DataFrame) -> DataFrame:
    """Adds clean: an idle session without suggestions whose units are all idle or done."""
    clean = (F.col("state") == "idle") & (F.col("n_suggestions") == 0) & (F.col("n_open_units") == 0)
    return sessions.withColumn("clean", clean)


def refresh_decision(stored_hash: Column, found_hash: Column, stored_structure: Column, found_structure: Column, clean: Column) -> Column:
    """keep where nothing changed, rebuild where a clean session's source or structure did, else block."""
    same = stored_hash.eqNullSafe(found_hash) & stored_structure.eqNullSafe(found_structure)
    return F.when(same, "keep").when(clean, "rebuild").otherwise("block")
