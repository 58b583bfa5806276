"""Which units a job works on: targets, queues, running units, selections. All are expressions over a session's row.

units: an array of structs (unit_id, unit_order, status, editable) in order; ids: an array of unit ids or null for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING = ("idle", "failed")


def ids_of(units: Column) -> Column:
    return F.transform(units, lambda u: u["unit_id"])


def is_target(unit_id: Column, ids: Column) -> Column:
    return ids.isNull() | F.coalesce(F.array_contains(ids, unit_id), F.lit(False))


def resolved(units: Column, ids: Column) -> Column:
    """Struct (ids, error): the wanted units that are not done, in document order; null ids stay null.

    error: unknown_unit where an id is no unit, nothing_to_do where all are done.
    """
    left = ids_of(F.filter(units, lambda u: F.array_contains(ids, u["unit_id"]) & (u["status"] != "done")))
    unknown = F.size(F.array_except(ids, ids_of(units))) > 0
    error = F.when(ids.isNull(), None).when(unknown, "unknown_unit").when(F.size(left) == 0, "nothing_to_do")
    return F.named_struct(F.lit("ids"), F.when(ids.isNotNull() & error.isNull(), left), F.lit("error"), error)


def manual_batch(units: Column, ids: Column, size: int) -> Column:
    """The first size (at least 1) pending target units."""
    return F.slice(ids_of(F.filter(units, lambda u: is_target(u["unit_id"], ids) & u["status"].isin(*PENDING))), F.lit(1), F.lit(max(size, 1)))


def auto_queue(units: Column, ids: Column) -> Column:
    """All target units that are not done."""
    return ids_of(F.filter(units, lambda u: is_target(u["unit_id"], ids) & (u["status"] != "done")))


def batches(queue: Column, size: int) -> Column:
    """A queue cut into batches of size (at least 1)."""
    size = max(size, 1)
    starts = F.sequence(F.lit(0), F.floor((F.size(queue) - 1) / size).cast("int"))
    return F.when(F.size(queue) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda k: F.slice(queue, k * size + 1, F.lit(size))))


def running_ids(in_flight: Column) -> Column:
    """The units of all batches in flight, each once, in string order."""
    return F.array_sort(F.array_distinct(F.flatten(in_flight)))


def counts(units: Column, ids: Column) -> Column:
    """Struct (total, completed) of the target units."""
    mine = F.filter(units, lambda u: is_target(u["unit_id"], ids))
    return F.named_struct(F.lit("total"), F.size(mine), F.lit("completed"), F.size(F.filter(mine, lambda u: u["status"] == "done")))


def available_error(queue: Column, ids: Column) -> Column:
    """Why there is nothing to do; null if there is something."""
    return F.when(F.size(queue) > 0, None).when(ids.isNotNull(), "targets_done").otherwise("all_done")


def is_active(state: Column) -> Column:
    return state.isin("running", "paused")


def with_status(units: Column, ids: Column, status: str, others: dict[str, str] | None = None) -> Column:
    """Struct (units, error): the units of ids get the status; others maps statuses of all other units.

    An id that is no unit is an error, and then nothing changes.
    """
    def changed(u: Column) -> Column:
        other = u["status"]
        for old, new in (others or {}).items():
            other = F.when(u["status"] == old, new).otherwise(other)
        return u.withField("status", F.when(F.array_contains(ids, u["unit_id"]), status).otherwise(other))

    unknown = F.size(F.array_except(ids, ids_of(units))) > 0
    return F.named_struct(F.lit("units"), F.when(unknown, units).otherwise(F.transform(units, changed)), F.lit("error"), F.when(unknown, "unknown_unit"))


def started(units: Column, ids: Column) -> Column:
    return with_status(units, ids, "running")


def failed(units: Column, ids: Column) -> Column:
    """The units of ids fail, all other running ones are idle again."""
    return with_status(units, ids, "failed", {"running": "idle"})


def selectable(units: Column) -> Column:
    return ids_of(F.filter(units, lambda u: u["editable"]))


def in_order(units: Column, ids: Column) -> Column:
    """Selected ids, each once, in document order; ids that are no unit come first, as they were."""
    chosen = F.array_distinct(ids)
    return F.concat(F.array_except(chosen, ids_of(units)), ids_of(F.filter(units, lambda u: F.array_contains(chosen, u["unit_id"]))))


def toggled(units: Column, selected: Column, wanted: Column) -> Column:
    """selected without wanted if all of those are in it, else with them; only units with an editable slot count."""
    able = F.filter(wanted, lambda x: F.array_contains(selectable(units), x))
    every = (F.size(able) > 0) & F.forall(able, lambda x: F.array_contains(selected, x))
    return in_order(units, F.when(every, F.array_except(selected, able)).otherwise(F.array_union(selected, able)))


def normalized(units: Column, selected: Column) -> Column:
    """selected without ids that are no units or have no editable slot."""
    return in_order(units, F.array_intersect(selected, selectable(units)))


def next_manual(units: Column, selected: Column) -> Column:
    """The first pending unit that can be rewritten, of the selected ones if there are any."""
    mine = lambda u: u["editable"] & ((F.size(selected) == 0) | F.array_contains(selected, u["unit_id"]))
    return F.get(ids_of(F.filter(units, lambda u: mine(u) & u["status"].isin(*PENDING))), F.lit(0))


def auto_pending(units: Column, selected: Column) -> Column:
    mine = lambda u: u["editable"] & ((F.size(selected) == 0) | F.array_contains(selected, u["unit_id"]))
    return ids_of(F.filter(units, lambda u: mine(u) & (u["status"] != "done")))


def default_unit(units: Column, latest: Column) -> Column:
    """The unit to show: that of the latest suggestion, else the first failed, running, idle, or the first at all."""
    first = lambda s: F.get(ids_of(F.filter(units, lambda u: u["status"] == s)), F.lit(0))
    return F.coalesce(latest, first("failed"), first("running"), first("idle"), F.get(ids_of(units), F.lit(0)))


def newest(records: DataFrame, key: str, at: str, n: int = 30) -> DataFrame:
    """The newest n records of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return records.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def settings_error(timeout_ms: Column, temperature: Column, concurrency: Column, units_per_batch: Column) -> Column:
    """The first numeric setting that is out of range."""
    return (
        F.when(timeout_ms < 1000, "timeout").when(~temperature.between(0.0, 2.0), "temperature")
        .when(~concurrency.between(1, 8), "concurrency").when(units_per_batch < 1, "units_per_batch")
    )
