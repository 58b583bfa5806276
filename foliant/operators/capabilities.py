"""What a session allows: gates derived from the source's policy, the backend and the state. Expressions over a row.

A gate is a struct (allowed, reason); reason is null where it is open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gate(allowed: Column, reason: Column) -> Column:
    """An open gate, or a closed one with its reason (no_reason if none is given)."""
    return F.named_struct(F.lit("allowed"), F.coalesce(allowed, F.lit(False)), F.lit("reason"), F.when(F.coalesce(allowed, F.lit(False)), None).otherwise(F.coalesce(reason, F.lit("no_reason"))))


def policy_gate(stored: Column) -> Column:
    """A stored gate; one that is closed without a reason was never set and is open."""
    unset = stored.isNull() | (~stored["allowed"] & stored["reason"].isNull())
    return F.when(unset, gate(F.lit(True), F.lit(None))).otherwise(gate(stored["allowed"], stored["reason"]))


def migrated_gate(stored: Column, legacy_allowed: Column, legacy_reason: Column) -> Column:
    """A stored gate, or where it was never set, that of an older file's flag and reason."""
    unset = stored.isNull() | (~stored["allowed"] & stored["reason"].isNull())
    return F.when(unset, gate(F.coalesce(legacy_allowed, F.lit(True)), legacy_reason)).otherwise(gate(stored["allowed"], stored["reason"]))


def editor_mode(backend: Column, template_kind: Column, editor_allowed: Column) -> Column:
    slots = backend.isin("docx", "pdf") | F.coalesce(template_kind.isin("markdown", "tex"), F.lit(False))
    return F.when(~editor_allowed, "none").when(slots, "slotBased").otherwise("fullText")


def ai_rewrite(source: Column) -> Column:
    """Rewriting is allowed where writing back is."""
    return gate(source["allowed"], source["reason"])


def editor_entry(mode: Column, clean: Column, editor: Column) -> Column:
    closed = (mode == "none") | ~editor["allowed"]
    return F.when(closed, gate(F.lit(False), F.coalesce(editor["reason"], F.lit("no_editor")))).when(~clean, gate(F.lit(False), F.lit("dirty_session"))).otherwise(gate(F.lit(True), F.lit(None)))


def is_clean(state: Column, n_suggestions: Column, units: Column) -> Column:
    """An idle session without suggestions whose units are all idle or done."""
    return (state == "idle") & (n_suggestions == 0) & F.forall(units, lambda u: u["status"].isin("idle", "done"))


def derived(backend: Column, template_kind: Column, source: Column, editor: Column, clean: Column) -> Column:
    """Struct of all capabilities; source and editor are stored gates."""
    s, e = policy_gate(source), policy_gate(editor)
    mode = editor_mode(backend, template_kind, e["allowed"])
    return F.named_struct(
        F.lit("editor_mode"), mode, F.lit("clean"), clean, F.lit("source_writeback"), s, F.lit("ai_rewrite"), ai_rewrite(s),
        F.lit("editor_writeback"), e, F.lit("editor_entry"), editor_entry(mode, clean, e),
    )


def policy_changed(stored_source: Column, stored_editor: Column, source: Column, editor: Column) -> Column:
    """Whether a loaded source's policy differs from the stored gates."""
    return ~(stored_source.eqNullSafe(source) & stored_editor.eqNullSafe(editor))


def blocked_reason(rewrite: Column) -> Column:
    return F.when(~rewrite["allowed"], F.coalesce(rewrite["reason"], F.lit("no_reason")))


def unit_error(units: Column, slots: Column, unit_id: Column) -> Column:
    """Why a unit must not be rewritten: unknown_unit, or protected_unit if it is done and has no editable slot."""
    unit = F.get(F.filter(units, lambda u: u["unit_id"] == unit_id), F.lit(0))
    able = F.transform(F.filter(slots, lambda s: s["editable"]), lambda s: s["slot_id"])
    return F.when(unit.isNull(), "unknown_unit").when((unit["status"] == "done") & ~F.arrays_overlap(unit["slot_ids"], able), "protected_unit")
