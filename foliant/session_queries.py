"""Queries over sessions: targets, selections, capabilities, commits, logs, editor, replies, names, formats, and their SQL.

A session here is a document: its lines are slots and units at once, so all of a session is one row, and a state, a
selection or an edit follows from the line's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import names
from foliant.functions import text as t
from foliant.functions.text import let
from foliant.operators import capabilities as caps
from foliant.operators import commit, editor, review, targets, template, writeback
from foliant.operators.segment import struct
from foliant.plans import protocol
from foliant.queries import query, spread, table, texts
from foliant.sources import sessions

LINES = """l AS (SELECT doc_id, text, i - 1 AS i, len(s) AS n, s[i] AS line, CASE (doc_id + i - 1) % 4 WHEN 0 THEN 'idle' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
  length(s[i]) % 5 <> 0 AS editable, 'unit-' || (i - 1) AS unit_id
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i))"""


def _lines() -> Column:
    return F.split(F.col("text"), "\n")


def _units(lines: Column) -> Column:
    def unit(line: Column, i: Column) -> Column:
        state = F.get(F.array(*(F.lit(x) for x in ("idle", "running", "done", "failed"))), ((F.col("doc_id") + i) % 4).cast("int"))
        return struct(
            unit_id=F.concat(F.lit("unit-"), i.cast("string")), unit_order=i, status=state, editable=F.length(line) % 5 != 0, slot_ids=F.array(F.concat(F.lit("s"), i.cast("string")))
        )

    return F.transform(lines, unit)


def _slots(lines: Column) -> Column:
    def slot(x: Column, line: Column, i: Column) -> Column:
        last = i == F.size(x) - 1
        return struct(slot_order=i, slot_id=F.concat(F.lit("s"), i.cast("string")), text=line, separator_after=F.when(last, "").otherwise("\n"), editable=F.length(line) % 5 != 0, role=F.lit("editableText"))

    # bound to a name, so that the lines are not split again for each of them where a filter is pushed below this
    return let(lines, lambda x: F.transform(x, lambda line, i: slot(x, line, i)))


def session_rows(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    made = (texts(spark, sf_dir) if docs is None else docs).withColumn("lines", _lines())
    return made.select("doc_id", "text", "lines", _units(F.col("lines")).alias("units"), _slots(F.col("lines")).alias("slots"))


def _every(k: int, units: str = "units") -> Column:
    return targets.ids_of(F.filter(units, lambda u: u["unit_order"] % k == 0))


@query(f"""
WITH {LINES}
SELECT doc_id, count(*) FILTER (WHERE i % 3 = 0) AS total, count(*) FILTER (WHERE i % 3 = 0 AND status = 'done') AS completed,
  coalesce(string_agg(unit_id, ',' ORDER BY i) FILTER (WHERE i % 3 = 0 AND status IN ('idle', 'failed') AND p <= 2), '') AS manual,
  CAST(ceil(count(*) FILTER (WHERE i % 3 = 0 AND status <> 'done') / 3) AS BIGINT) AS n_batches,
  CASE WHEN count(*) FILTER (WHERE i % 3 = 0 AND status <> 'done') = 0 THEN 'nothing_to_do' END AS error
FROM (SELECT *, sum(CASE WHEN i % 3 = 0 AND status IN ('idle', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l) GROUP BY doc_id""")
def job_targets(spark, sf_dir):
    d = session_rows(spark, sf_dir).withColumn("ids", _every(3))
    units, ids = F.col("units"), F.col("ids")
    counts, found = targets.counts(units, ids), targets.resolved(units, ids)
    return d.select(
        "doc_id", counts["total"].cast("long").alias("total"), counts["completed"].cast("long").alias("completed"), F.array_join(targets.manual_batch(units, ids, 2), ",").alias("manual"),
        F.size(targets.batches(targets.auto_queue(units, ids), 3)).cast("long").alias("n_batches"), found["error"].alias("error"),
    )


@query(f"""
WITH {LINES}
SELECT doc_id, string_agg(CASE WHEN i % 3 = 0 THEN 'failed' WHEN status = 'running' THEN 'idle' ELSE status END, ',' ORDER BY i) AS failed,
  string_agg(CASE WHEN i % 2 = 0 THEN 'running' ELSE status END, ',' ORDER BY i) AS started FROM l GROUP BY doc_id""")
def unit_states(spark, sf_dir):
    shown = lambda made: F.array_join(F.transform(made["units"], lambda u: u["status"]), ",")
    d = session_rows(spark, sf_dir)
    return d.select("doc_id", shown(targets.failed(F.col("units"), _every(3))).alias("failed"), shown(targets.started(F.col("units"), _every(2))).alias("started"))


@query(f"""
WITH {LINES}, g AS (SELECT *, bool_and(i % 2 = 0) FILTER (WHERE i % 3 = 0 AND editable) OVER (PARTITION BY doc_id) AS every FROM l)
SELECT doc_id,
  coalesce(string_agg(unit_id, ',' ORDER BY i) FILTER (WHERE CASE WHEN every THEN i % 2 = 0 AND NOT (i % 3 = 0 AND editable) ELSE i % 2 = 0 OR (i % 3 = 0 AND editable) END), '') AS toggled,
  coalesce(string_agg(unit_id, ',' ORDER BY i) FILTER (WHERE i % 2 = 0 AND editable), '') AS normalized,
  arg_min(unit_id, i) FILTER (WHERE i % 2 = 0 AND editable AND status IN ('idle', 'failed')) AS next_manual,
  coalesce(string_agg(unit_id, ',' ORDER BY i) FILTER (WHERE i % 2 = 0 AND editable AND status <> 'done'), '') AS auto_pending,
  coalesce(arg_min(unit_id, i) FILTER (WHERE status = 'failed'), arg_min(unit_id, i) FILTER (WHERE status = 'running'), arg_min(unit_id, i) FILTER (WHERE status = 'idle'), arg_min(unit_id, i)) AS shown
FROM g GROUP BY doc_id""")
def selections(spark, sf_dir):
    d = session_rows(spark, sf_dir).withColumn("selected", _every(2))
    units, selected = F.col("units"), F.col("selected")
    joined = lambda c, name: F.array_join(c, ",").alias(name)
    return d.select(
        "doc_id", joined(targets.toggled(units, selected, _every(3)), "toggled"), joined(targets.normalized(units, selected), "normalized"),
        targets.next_manual(units, selected).alias("next_manual"), joined(targets.auto_pending(units, selected), "auto_pending"),
        targets.default_unit(units, F.lit(None).cast("string")).alias("shown"),
    )


@query(f"""
WITH {LINES}, d AS (SELECT doc_id, bool_and(status IN ('idle', 'done')) AS quiet, doc_id % 2 = 0 AS source, doc_id % 3 <> 0 AS editor,
  CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' ELSE 'textual' END AS backend, CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'tex' END AS kind FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN NOT editor THEN 'none' WHEN backend <> 'textual' OR kind IS NOT NULL THEN 'slotBased' ELSE 'fullText' END AS editor_mode, quiet AS clean,
  source AS ai_allowed, CASE WHEN NOT source THEN 'closed' END AS ai_reason, editor AND quiet AS entry_allowed,
  CASE WHEN NOT editor THEN 'no_reason' WHEN NOT quiet THEN 'dirty_session' END AS entry_reason FROM d""")
def session_capabilities(spark, sf_dir):
    d = session_rows(spark, sf_dir)
    k = F.col("doc_id")
    backend = F.when(k % 4 == 0, "docx").when(k % 4 == 1, "pdf").otherwise("textual")
    kind = F.when(k % 5 == 0, "markdown").when(k % 5 == 1, "tex")
    clean = caps.is_clean(F.lit("idle"), F.lit(0), F.col("units"))
    found = caps.derived(backend, kind, caps.gate(k % 2 == 0, F.lit("closed")), caps.gate(k % 3 != 0, F.lit(None)), clean)
    c = d.select("doc_id", found.alias("c"))
    return c.select(
        "doc_id", "c.editor_mode", "c.clean", F.col("c.ai_rewrite.allowed").alias("ai_allowed"), F.col("c.ai_rewrite.reason").alias("ai_reason"),
        F.col("c.editor_entry.allowed").alias("entry_allowed"), F.col("c.editor_entry.reason").alias("entry_reason"),
    )


def _batches(spark, sf_dir: str) -> DataFrame:
    """A batch for every document: each editable line gets an X in front; some answers are spoilt."""
    d = session_rows(spark, sf_dir, spread(texts(spark, sf_dir))).withColumn("unit_ids", targets.ids_of(F.filter("units", lambda u: u["editable"])))
    changed = F.filter("slots", lambda s: s["editable"])
    results = F.transform(changed, lambda s: F.struct(F.concat(F.lit("unit-"), s["slot_order"].cast("string")).alias("rewriteUnitId"), F.array(F.struct(F.when(F.col("doc_id") % 7 == 1, "s0").otherwise(s["slot_id"]).alias("slotId"), F.concat(F.lit("X"), s["text"]).alias("text"))).alias("updates")))
    asked = F.when(F.col("doc_id") % 7 == 2, F.slice(results, F.lit(2), F.size(results))).otherwise(results)
    response = F.to_json(F.struct(F.lit("b").alias("batchId"), asked.alias("results")))
    return d.select("doc_id", F.lit("b").alias("batch_id"), "unit_ids", "slots", "units", response.alias("response"), F.lit(5).cast("long").alias("next_sequence"))


_GOOD = "CASE WHEN e > 0 AND doc_id % 7 = 2 THEN 'length' WHEN doc_id % 7 = 1 AND e > 1 THEN 'repeated_in_batch' WHEN doc_id % 7 = 1 AND e = 1 AND NOT first THEN 'unknown_or_locked_slot' END"
_COMMIT = f"""{LINES}, c AS (SELECT *, CAST(sum(CASE WHEN editable THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS BIGINT) AS e, bool_or(i = 0 AND editable) OVER (PARTITION BY doc_id) AS first,
  row_number() OVER (PARTITION BY doc_id, editable ORDER BY i) AS k FROM l), p AS (SELECT *, {_GOOD} AS problem, line || CASE WHEN i < n - 1 THEN chr(10) ELSE '' END AS shown FROM c)"""


@query(f"""WITH {_COMMIT}
SELECT doc_id, unit_id, 'b#' || (4 + k) AS suggestion_id, CAST(4 + k AS BIGINT) AS sequence, shown AS before_text, 'X' || shown AS after_text, 'proposed' AS decision
FROM p WHERE problem IS NULL AND editable""")
def committed_suggestions(spark, sf_dir):
    return commit.suggestions(commit.committed(_batches(spark, sf_dir))).drop("slot_updates")


@query(f"""WITH {_COMMIT}
SELECT doc_id, any_value(problem) AS problem, CAST(5 + CASE WHEN any_value(problem) IS NULL THEN any_value(e) ELSE 0 END AS BIGINT) AS next_sequence,
  string_agg(CASE WHEN editable THEN CASE WHEN problem IS NULL THEN 'done' ELSE 'failed' END WHEN problem IS NOT NULL AND status = 'running' THEN 'idle' ELSE status END, ',' ORDER BY i) AS states
FROM p GROUP BY doc_id""")
def batch_outcomes(spark, sf_dir):
    done = commit.committed(_batches(spark, sf_dir), auto=True)
    return done.select("doc_id", "problem", "next_sequence", F.array_join(F.transform("units", lambda u: u["status"]), ",").alias("states"))


ACTIONS = "CASE event_type WHEN 'purchase' THEN 'apply' WHEN 'error' THEN 'dismiss' WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'delete' ELSE 'apply' END ELSE 'propose' END"
_LOG = f"""SELECT user_id AS doc_id, 'unit-' || (event_id % 3) AS unit_id, 's' || (event_id % 15) AS suggestion_id, event_id AS "at", {ACTIONS} AS action FROM events"""
_LIVES = f"""g AS ({_LOG}), b AS (SELECT doc_id, unit_id, suggestion_id, min("at") AS born FROM g WHERE action = 'propose' GROUP BY ALL),
v AS (SELECT b.*, (SELECT min("at") FROM g WHERE g.doc_id = b.doc_id AND g.unit_id = b.unit_id AND g.suggestion_id = b.suggestion_id AND action = 'delete' AND "at" > born) AS died FROM b)"""


def actions(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "concat('unit-', event_id % 3) AS unit_id", "concat('s', event_id % 15) AS suggestion_id", "event_id AS at", f"{ACTIONS} AS action")


REPLAYED = f"""
WITH {_LIVES}, a AS (SELECT g.*, born, died FROM g JOIN v USING (doc_id, unit_id, suggestion_id) WHERE "at" >= born AND (died IS NULL OR "at" < died) AND action IN ('apply', 'dismiss')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit_id, suggestion_id ORDER BY "at" DESC) AS own FROM a),
w AS (SELECT doc_id, unit_id, max("at") AS unit_at FROM a WHERE action = 'apply' GROUP BY ALL)
SELECT v.doc_id, v.unit_id, v.suggestion_id, born AS sequence,
  CASE WHEN r."at" IS NULL THEN 'proposed' WHEN r.action = 'apply' AND r."at" = unit_at THEN 'applied' ELSE 'dismissed' END AS decision
FROM v LEFT JOIN (SELECT doc_id, unit_id, suggestion_id, "at", action FROM r WHERE own = 1) r USING (doc_id, unit_id, suggestion_id) LEFT JOIN w USING (doc_id, unit_id) WHERE died IS NULL"""


@query(REPLAYED)
def replayed_suggestions(spark, sf_dir):
    return review.replayed(actions(spark, sf_dir))


@query(f"""WITH {_LIVES} SELECT g.doc_id, g.unit_id, g.suggestion_id, "at", action, 'unknown_suggestion' AS error FROM g LEFT JOIN v USING (doc_id, unit_id, suggestion_id)
WHERE born IS NULL OR "at" < born OR coalesce("at" > died, false)""")
def log_errors(spark, sf_dir):
    return review.action_errors(actions(spark, sf_dir))


_UNIT = "CASE event_id % 2 WHEN 0 THEN 'done' ELSE 'failed' END"


@query(f"""WITH {_LIVES}, x AS (SELECT doc_id, unit_id FROM v GROUP BY ALL HAVING count(died) > 0 AND count(died) = count(*)),
u AS (SELECT DISTINCT user_id AS doc_id, 'unit-' || (event_id % 3) AS unit_id, CASE (user_id + event_id % 3) % 2 WHEN 0 THEN 'done' ELSE 'failed' END AS status FROM events)
SELECT u.doc_id, u.unit_id, CASE WHEN status = 'done' AND x.doc_id IS NOT NULL THEN 'idle' ELSE status END AS status FROM u LEFT JOIN x USING (doc_id, unit_id)""")
def reset_units(spark, sf_dir):
    units = table(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "concat('unit-', event_id % 3) AS unit_id", "CASE (user_id + event_id % 3) % 2 WHEN 0 THEN 'done' ELSE 'failed' END AS status").distinct()
    return review.reset_units(units, actions(spark, sf_dir))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 30")
def newest_records(spark, sf_dir):
    return targets.newest(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query(f"""WITH {LINES}
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'missing_snapshot' WHEN 1 THEN 'source_changed' WHEN 2 THEN 'missing_signature' WHEN 3 THEN 'structure_changed' WHEN 4 THEN CASE WHEN any_value(n) > 1 THEN 'anchor_order' END END AS error,
  CASE WHEN doc_id % 6 = 5 OR (doc_id % 6 = 4 AND any_value(n) = 1) THEN string_agg('X' || line, chr(10) ORDER BY i) END AS text FROM l GROUP BY doc_id""")
def gated_writeback(spark, sf_dir):
    d = session_rows(spark, sf_dir).withColumn("anchored", F.transform("slots", lambda s: s.withField("slot_id", F.concat(F.lit("txt:p"), s["slot_order"].cast("string"), F.lit(":r0:s0")))))
    k, now = F.col("doc_id") % 6, F.sha2("text", 256)
    anchors = F.transform("slots", lambda s: F.concat(F.lit("txt:p"), s["slot_order"].cast("string"), F.lit(":r0")))
    rows = d.select(
        "doc_id", F.col("text").alias("source_text"), F.when(k == 0, None).when(k == 1, F.sha2(F.lit("old"), 256)).otherwise(now).alias("snapshot"), now.alias("found_snapshot"),
        F.when(k == 2, None).otherwise(F.lit("t")).alias("template_signature"), F.lit("t").alias("found_template"),
        F.when(k == 3, "other").otherwise(writeback.slots_signature(F.col("anchored"))).alias("structure_signature"),
        F.when(k == 4, F.reverse(anchors)).otherwise(anchors).alias("anchors"), F.transform("anchored", lambda s: s.withField("text", F.concat(F.lit("X"), s["text"]))).alias("slots"),
    )
    return writeback.gated(rows).select("doc_id", "error", "text")


def _overrides() -> Column:
    """Every third line gets a word at its end."""
    return F.map_from_entries(F.transform(F.filter("slots", lambda s: s["slot_order"] % 3 == 0), lambda s: F.struct(s["slot_id"], F.concat(s["text"], F.lit(" new")))))


@query(f"""WITH {LINES}
SELECT doc_id, string_agg(CASE WHEN i % 3 = 0 THEN line || ' new' ELSE line END, chr(10) ORDER BY i) AS text, count(*) FILTER (WHERE editable) AS n_edits,
  CASE WHEN doc_id % 3 = 0 AND count(*) FILTER (WHERE editable) > 0 THEN 'count' END AS error,
  CASE WHEN NOT (doc_id % 3 = 0 AND count(*) FILTER (WHERE editable) > 0) THEN string_agg(CASE WHEN i % 3 = 0 AND editable THEN line || ' new' ELSE line END, chr(10) ORDER BY i) END AS saved FROM l GROUP BY doc_id""")
def editor_edits(spark, sf_dir):
    d = session_rows(spark, sf_dir).withColumn("overrides", _overrides())
    edits = editor.slot_edits(F.col("slots"), F.col("overrides"))
    d = d.withColumn("edits", edits)
    given = F.when(F.col("doc_id") % 3 == 0, F.slice("edits", F.lit(2), F.size("edits"))).otherwise(F.col("edits"))
    d = d.withColumn("made", editor.edited_slots(F.col("slots"), given))
    saved = F.when(F.col("made.error").isNull(), F.array_join(F.transform("made.slots", lambda s: F.concat(s["text"], s["separator_after"])), ""))
    return d.select("doc_id", editor.editor_text(F.col("slots"), F.col("overrides")).alias("text"), F.size("edits").cast("long").alias("n_edits"), F.col("made.error").alias("error"), saved.alias("saved"))


@query(f"""WITH {LINES}
SELECT doc_id, 'slot-s' || i AS hunk_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS sequence, line AS before, line || ' new' AS after,
  CASE WHEN 2 * length(line) + 4 > 8000 THEN length(regexp_replace(line, '\\s', '', 'g')) + 3 ELSE 3 END::INT AS inserted,
  CASE WHEN 2 * length(line) + 4 > 8000 THEN length(regexp_replace(line, '\\s', '', 'g')) ELSE 0 END::INT AS deleted,
  CASE WHEN 2 * length(line) + 4 > 8000 THEN 'delete:' || line || '|insert:' || line || ' new' WHEN line = '' THEN 'insert: new' ELSE 'unchanged:' || line || '|insert: new' END AS spans FROM l WHERE editable AND i % 3 = 0""")
def slot_hunks(spark, sf_dir):
    found = editor.slot_hunks(session_rows(spark, sf_dir).withColumn("overrides", _overrides()).select("doc_id", "slots", "overrides"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat(s["type"], F.lit(":"), s["text"])), "|"))


@query(f"""WITH {LINES}, f AS (SELECT *, line || CASE WHEN i < n - 1 THEN chr(10) ELSE '' END AS t, length(regexp_replace(line, '\\s', '', 'g')) AS k FROM l WHERE i < 2),
h AS (SELECT doc_id, any_value(n) AS n, max(t) FILTER (WHERE i = 0) AS t0, max(t) FILTER (WHERE i = 1) AS t1, max(k) FILTER (WHERE i = 0) AS k0, 2 * length(max(t) FILTER (WHERE i = 0)) + 7 > 8000 AS long FROM f GROUP BY doc_id)
SELECT doc_id, 'rewrite-unit-unit-0' AS hunk_id, 1 AS sequence, t0 AS before, CASE WHEN long AND n > 1 THEN '' ELSE '<<new>>' || t0 END AS after,
  CASE WHEN long AND n > 1 THEN 0 WHEN long THEN k0 + 7 ELSE 7 END::INT AS inserted, CASE WHEN long THEN k0 ELSE 0 END::INT AS deleted FROM h
UNION ALL SELECT doc_id, 'rewrite-unit-unit-1', 2, t1, '<<new>>' || t0 || t1, (k0 + 7)::INT, 0 FROM h WHERE long AND n > 1""")
def unit_hunks(spark, sf_dir):
    d = session_rows(spark, sf_dir)
    units = F.transform("slots", lambda s: struct(unit_id=F.concat(F.lit("unit-"), s["slot_order"].cast("string")), text=F.concat(s["text"], s["separator_after"])))
    found = editor.unit_hunks(d.select("doc_id", units.alias("units"), F.concat(F.lit("<<new>>"), "text").alias("text")))
    return found.drop("spans")


#: Every ninth text is empty, every ninth blank; a reply to every ninth other one is none.
_REPLY = "CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) ELSE text END"


@query(f"""WITH d AS (SELECT doc_id, {_REPLY} AS text FROM documents), r AS (SELECT *, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS words FROM d),
e AS (SELECT *, CASE WHEN doc_id % 9 = 2 THEN CASE WHEN doc_id % 4 IN (0, 3) THEN 'not_json' ELSE 'no_data' END WHEN doc_id % 4 = 3 AND text = '' THEN 'no_text' WHEN words = '' THEN 'empty' END AS error FROM r)
SELECT doc_id, CASE WHEN error IS NULL THEN words END AS text, error, CASE doc_id % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'events' WHEN 2 THEN 'lines' ELSE 'parts' END AS shape FROM e""")
def model_replies(spark, sf_dir):
    d = texts(spark, sf_dir, _REPLY)
    k = F.col("doc_id") % 4
    choice = lambda body: F.to_json(F.struct(F.array(body).alias("choices")))
    halves = F.array(F.substr("text", F.lit(1), (F.length("text") / 2).cast("int")), F.substr("text", (F.length("text") / 2).cast("int") + 1))
    delta = lambda x: choice(F.struct(F.struct(x.alias("content")).alias("delta")))
    events = F.concat(F.array_join(F.transform(halves, lambda x: F.concat(F.lit("data: "), delta(x), F.lit("\n\n"))), ""), F.lit(": note\ndata: [DONE]\n"))
    rows = F.array_join(F.transform(halves, delta), "\n")
    whole = choice(F.struct(F.struct(F.col("text").alias("content")).alias("message")))
    parts = choice(F.struct(F.struct(F.transform(halves, lambda x: F.struct(x.alias("text"))).alias("content")).alias("message")))
    d = d.select("doc_id", F.when(F.col("doc_id") % 9 == 2, F.concat(F.lit("no reply: "), "text")).when(k == 0, whole).when(k == 1, events).when(k == 2, rows).otherwise(parts).alias("body"), k.alias("k"))
    found = F.when(k.isin(0, 3), protocol.reply(F.col("body"))).otherwise(protocol.stream(F.col("body")))
    shape = F.when(k == 0, "whole").when(k == 1, "events").when(k == 2, "lines").otherwise("parts")
    return d.select("doc_id", found.alias("r"), shape.alias("shape")).select("doc_id", "r.text", "r.error", "shape")


@query("""WITH c AS (SELECT doc_id, text, CAST(pow(length(text), doc_id % 5) AS DOUBLE) AS n FROM documents),
k AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM c), v AS (SELECT *, n / pow(1024, k) AS v FROM k)
SELECT doc_id, coalesce(nullif(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), ''), 'result') AS file_name,
  CASE WHEN n <= 0 THEN '0 B' ELSE CASE WHEN v >= 100 OR k = 0 THEN format('{:.0f}', round(v)) WHEN v >= 10 THEN format('{:.1f}', round(v, 1)) ELSE format('{:.2f}', round(v, 2)) END || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][k + 1] END AS size,
  lower(hex(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END))) AS hash
FROM (SELECT *, coalesce(list_reduce(list_transform(string_split(text, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296), 0) AS h FROM v)""")
def names_and_sizes(spark, sf_dir):
    d = texts(spark, sf_dir).withColumn("n", F.pow(F.length("text"), F.col("doc_id") % 5))
    return d.select("doc_id", names.file_name(F.col("text")).alias("file_name"), names.byte_size(F.col("n")).alias("size"), names.short_hash(F.col("text")).alias("hash"))


NAMESPACE = bytes(range(16))
_PATHS = "'/d/' || source || CASE doc_id % 3 WHEN 0 THEN '/a.b.docx' WHEN 1 THEN '/n.PDF' ELSE '/plain' END"


@query(f"""WITH p AS (SELECT doc_id, {_PATHS} AS path FROM documents), h AS (SELECT *, sha1(unhex('{NAMESPACE.hex()}') || encode(path)) AS h FROM p)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
  WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS session_id,
  CASE doc_id % 3 WHEN 0 THEN 'a.b' WHEN 1 THEN 'n' ELSE 'plain' END AS title, CASE doc_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' ELSE 'text' END AS kind FROM h""")
def session_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATHS).alias("path"))
    c = F.col("path")
    return d.select("doc_id", names.session_id(c, NAMESPACE).alias("session_id"), names.session_title(c).alias("title"), names.document_kind(c).alias("kind"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, text AS source_text, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS allowed, CASE doc_id % 3 WHEN 1 THEN 'old reason' END AS reason,
  doc_id % 2 = 0 AS editor_allowed, text AS diff_text FROM documents""")
def migrated_sessions(spark, sf_dir):
    k = F.col("doc_id")
    old = F.struct(F.lit("unchanged").alias("type"), F.col("text").alias("text"))
    suggestion = F.struct(F.lit("x").alias("id"), F.when(k % 2 == 0, F.array(old)).alias("diffSpans"), F.when(k % 2 == 1, F.struct(F.array(old).alias("spans"))).alias("diff"))
    gate = F.struct(F.lit(False).alias("allowed"), F.when(k % 2 == 1, "closed").alias("blockReason"))
    made = F.struct(
        k.cast("string").alias("id"), F.col("text").alias("sourceText"), F.when(k % 3 < 2, k % 3 == 0).alias("writeBackSupported"), F.when(k % 3 == 1, "old reason").alias("writeBackBlockReason"),
        F.struct(gate.alias("editorWriteback")).alias("capabilities"), F.array(suggestion).alias("suggestions"),
    )
    found = sessions.parsed(texts(spark, sf_dir).select(F.to_json(made).alias("text")))
    return found.select(
        "id", F.col("sourceText").alias("source_text"), "source_gate.allowed", "source_gate.reason", F.col("editor_gate.allowed").alias("editor_allowed"),
        F.col("suggestions")[0]["diff"]["spans"][0]["text"].alias("diff_text"),
    )


# Texts of lines with known markup around each line's own letters.
_WORDS = "trim(regexp_replace(line, '[^A-Za-z]+', ' ', 'g'))"
_CLEAN = f"{LINES}, w AS (SELECT doc_id, {_WORDS} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM l WHERE {_WORDS} <> '')"


def _marked(spark, sf_dir: str, before: str, after: str, kind: str) -> DataFrame:
    words = F.filter(F.transform(_lines(), lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z]+", " "))), lambda x: x != "")
    made = F.array_join(F.transform(words, lambda x: F.concat(F.lit(before), x, F.lit(after))), "")
    return spread(texts(spark, sf_dir)).select("doc_id", made.alias("text"), F.lit(kind).alias("format"))


def _expected(pieces: list[tuple[str, str, str, bool, str]]) -> str:
    """SQL of the slots of every line: id, text, separator, editable, role; ids and texts are SQL."""
    n = len(pieces)
    rows = " UNION ALL ".join(
        f"SELECT doc_id, CAST(j * {n} + {k} AS INT) AS slot_order, {slot_id} AS slot_id, {text} AS text, {sep} AS separator_after, {'true' if edit else 'false'} AS editable, '{role}' AS role FROM w"
        for k, (slot_id, text, sep, edit, role) in enumerate(pieces)
    )
    return f"WITH {_CLEAN} {rows}"


def _md(r: int) -> str:
    return f"'md:b' || j || ':r{r}:s0'"


@query(_expected([
    (_md(0), "'- **'", "''", False, "syntaxToken"), (_md(1), "w", "''", True, "editableText"), (_md(2), "'**'", "' '", False, "syntaxToken"),
    (_md(4), "'['", "''", False, "syntaxToken"), (_md(5), "'en'", "''", True, "editableText"), (_md(6), "']('", "''", False, "syntaxToken"),
    (_md(7), "'http://e.org/3'", "''", False, "inlineObject"), (_md(8), "')'", "chr(10)", False, "syntaxToken"),
]))
def markdown_slots(spark, sf_dir):
    return template.slots(_marked(spark, sf_dir, "- **", "** [en](http://e.org/3)\n", "markdown"))


def _tex(r: int) -> str:
    return f"'tex:b0:r' || (j * 8 + {r}) || ':s0'"


@query(_expected([
    (_tex(0), "'\\textbf{'", "''", False, "syntaxToken"), (_tex(1), "w", "''", True, "editableText"), (_tex(2), "'}'", "' '", False, "syntaxToken"),
    (_tex(4), "'$x$'", "' '", False, "inlineObject"), (_tex(6), "'\\cite{en}'", "chr(10)", False, "lockedText"),
]))
def tex_slots(spark, sf_dir):
    return template.slots(_marked(spark, sf_dir, "\\textbf{", "} $x$ \\cite{en}\n", "tex"))


@query(f"""WITH {_CLEAN} SELECT doc_id, coalesce(sum(5), 0)::BIGINT AS n_regions, coalesce(count(*), 0) AS n_editable, coalesce(string_agg('- ' || w || ' <b> `x`' || chr(10), '' ORDER BY j), '') AS text FROM w GROUP BY doc_id""")
def markdown_regions(spark, sf_dir):
    found = template.region_arrays(_marked(spark, sf_dir, "- ", " <b> `x`\n", "markdown")).filter("size(regions) > 0")
    whole = F.array_join(F.transform("regions", lambda r: F.concat(r["text"], r["separator_after"])), "")
    words = F.filter("regions", lambda r: r["editable"] & (r["text"] != ""))
    return found.select("doc_id", F.size("regions").cast("long").alias("n_regions"), F.size(words).cast("long").alias("n_editable"), whole.alias("text"))
