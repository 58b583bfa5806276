"""Queries over finalizing, previews, page chunks and regions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import display, finalize, page_chunks, preview, regroup, segment, template, writeback
from foliant.operators.segment import struct
from foliant.plans.scratch import scratch_path
from foliant.queries import PARAGRAPHS, query, slots_sql, texts
from foliant.session_queries import LINES, session_rows

_REFUSED = "CASE doc_id % 6 WHEN 0 THEN 'missing_snapshot' WHEN 1 THEN 'source_changed' WHEN 2 THEN 'active_job' END"


def _gates(k: Column) -> list[Column]:
    """What the gates are asked: the known and the found snapshot and signatures; 0 has no snapshot, 1 another one."""
    now = F.sha2("text", 256)
    anchors = F.transform("slots", lambda s: F.concat(F.lit("txt:p"), s["slot_order"].cast("string"), F.lit(":r0")))
    return [
        F.col("text").alias("source_text"), F.when(k == 0, None).when(k == 1, F.sha2(F.lit("old"), 256)).otherwise(now).alias("snapshot"), now.alias("found_snapshot"),
        F.lit("t").alias("template_signature"), F.lit("t").alias("found_template"), writeback.slots_signature(F.col("slots")).alias("structure_signature"), anchors.alias("anchors"),
    ]


def _anchored(spark, sf_dir: str) -> DataFrame:
    return session_rows(spark, sf_dir).withColumn("slots", F.transform("slots", lambda s: s.withField("slot_id", F.concat(F.lit("txt:p"), s["slot_order"].cast("string"), F.lit(":r0:s0")))))


@query(f"""WITH {LINES}
SELECT doc_id, '/d/' || doc_id AS path, CASE WHEN {_REFUSED} IS NULL THEN 'finalized' ELSE 'refused' END AS state, {_REFUSED} AS error,
  CASE WHEN {_REFUSED} IS NULL THEN string_agg('X' || line, chr(10) ORDER BY i) END AS text, {_REFUSED} IS NOT NULL AS session_left FROM l GROUP BY doc_id""")
def finalized_documents(spark, sf_dir):
    """Every document is finalized in one run, to a table; the states are those of its journal."""
    d = _anchored(spark, sf_dir)
    k, path = F.col("doc_id") % 6, scratch_path(spark, "finalize")
    new = F.transform("slots", lambda s: s.withField("text", F.concat(F.lit("X"), s["text"])))
    rows = d.select("doc_id", F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("path"), (k == 2).alias("active"), *_gates(k), new.alias("slots"))
    left = finalize.finalize(rows, d.select("doc_id"), f"{path}/journal", finalize.to_table(f"{path}/texts"))
    written = spark.read.parquet(f"{path}/texts").select("doc_id", "text")
    told = finalize.states(spark, f"{path}/journal").join(written, "doc_id", "left").join(left.withColumn("session_left", F.lit(True)), "doc_id", "left")
    return told.fillna(False, ["session_left"])


_ASKED = "editable AND i % 2 = 1"
_PREVIEW = f"""{LINES}, c AS (SELECT *, count(*) FILTER (WHERE {_ASKED}) OVER (PARTITION BY doc_id) AS asked, doc_id % 7 AS k FROM l),
p AS (SELECT *, CASE WHEN k = 2 AND asked > 0 THEN 'length' WHEN k = 3 AND asked > 1 THEN 'repeated_in_batch' WHEN k = 3 AND asked = 1 THEN 'unknown_or_locked_slot' WHEN k = 4 THEN CASE WHEN bool_or(i = 0) OVER (PARTITION BY doc_id) THEN 'unknown_slot' END
  WHEN k = 0 THEN 'missing_snapshot' WHEN k = 1 THEN 'source_changed' END AS problem,
  CASE WHEN {_ASKED} THEN 'X' WHEN editable AND i % 4 = 2 THEN 'L' ELSE '' END AS mark FROM c)"""


@query(f"""WITH {_PREVIEW}
SELECT doc_id, problem, CASE WHEN problem IS NULL THEN string_agg(mark || line, chr(10) ORDER BY i) END AS text,
  CASE WHEN problem IS NULL THEN CAST(count(*) FILTER (WHERE mark <> '') AS INT) END AS n_changed FROM p GROUP BY doc_id, problem""")
def previewed_batches(spark, sf_dir):
    """Batches for the editable odd lines, over a log that has applied every fourth line and, vainly, the lines the batch asks for."""
    d, k = _anchored(spark, sf_dir), F.col("doc_id") % 7
    id_of = lambda s: F.concat(F.lit("unit-"), s["slot_order"].cast("string"))
    units = F.transform("slots", lambda s: struct(unit_id=id_of(s), unit_order=s["slot_order"], status=F.lit("running"), slot_ids=F.array(s["slot_id"])))
    asked = F.filter("slots", lambda s: s["editable"] & (s["slot_order"] % 2 == 1))

    def answer(s: Column) -> Column:
        slot = F.when(k == 3, "no slot").otherwise(s["slot_id"])
        return F.struct(id_of(s).alias("rewriteUnitId"), F.array(F.struct(slot.alias("slotId"), F.concat(F.lit("X"), s["text"]).alias("text"))).alias("updates"))

    results = F.when(k == 2, F.slice(F.transform(asked, answer), F.lit(2), F.size(asked))).otherwise(F.transform(asked, answer))

    def logged(s: Column) -> Column:
        slot = F.when((k == 4) & (s["slot_order"] == 0), "no slot").otherwise(s["slot_id"])
        decision = F.when((s["slot_order"] % 4 == 2) | (s["slot_order"] % 2 == 1) | ((k == 4) & (s["slot_order"] == 0)), "applied").otherwise("dismissed")
        return struct(sequence=s["slot_order"].cast("long"), unit_id=id_of(s), decision=decision, slot_updates=F.array(struct(slot_id=slot, text=F.concat(F.lit("L"), s["text"]))))

    log = F.transform(F.filter("slots", lambda s: s["editable"] | ((k == 4) & (s["slot_order"] == 0))), logged)
    rows = d.select(
        "doc_id", *_gates(k), "slots", units.alias("units"), F.lit("b").alias("batch_id"), F.transform(asked, id_of).alias("unit_ids"),
        F.to_json(F.struct(F.lit("b").alias("batchId"), results.alias("results"))).alias("response"), log.alias("suggestions"),
    )
    return preview.previewed(rows).select("doc_id", "problem", "text", F.size("changed").alias("n_changed"))


# Every line is a chunk, four to a page; some are blank, some end in line ends, some cannot be read, some come twice.
_RAW = r"""CASE WHEN (doc_id + i) % 11 = 3 THEN NULL WHEN (doc_id + i) % 5 = 0 THEN '  ' || chr(10) WHEN (doc_id + i) % 5 = 1 THEN line || '  ' || chr(13) || chr(10)
  WHEN (doc_id + i) % 5 = 2 THEN line || chr(10) || chr(10) WHEN (doc_id + i) % 5 = 3 AND doc_id % 6 = 0 THEN 'twice' || chr(10) ELSE line END"""
_CHUNKS = rf"""{LINES}, r AS (SELECT doc_id, i // 4 AS page, i % 4 AS place, {_RAW} AS raw, (n - 1) // 4 AS last_page FROM l),
x AS (SELECT *, regexp_replace(regexp_replace(replace(coalesce(raw, ''), chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '[ \t]+$', '') AS t FROM r),
y AS (SELECT *, regexp_replace(t, '\s+$', '') AS text, CASE WHEN raw IS NULL THEN chr(10) ELSE regexp_extract(t, '\s*$') END AS sep,
  CASE WHEN raw IS NULL THEN 'locked' WHEN regexp_replace(t, '\s+$', '') = '' THEN 'blank' ELSE 'chunk' END AS kind FROM x),
z AS (SELECT *, count(*) FILTER (WHERE kind = 'chunk') OVER w AS c, count(*) FILTER (WHERE kind = 'locked') OVER w AS k, count(*) FILTER (WHERE kind = 'chunk') OVER p AS cs, count(*) FILTER (WHERE kind = 'locked') OVER p AS ks
  FROM y WINDOW w AS (PARTITION BY doc_id, page ORDER BY place ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY doc_id, page)),
o AS (SELECT *, CASE kind WHEN 'chunk' THEN c WHEN 'locked' THEN cs + k ELSE CASE WHEN cs > 0 THEN least(c + 1, cs) WHEN ks > 0 THEN ks END END AS e FROM z),
entry AS (SELECT doc_id, page, CAST(e - 1 AS INT) AS entry, max(kind) FILTER (WHERE kind <> 'blank') AS kind, max(raw) FILTER (WHERE kind <> 'blank') AS raw, max(text) FILTER (WHERE kind <> 'blank') AS body,
  max(CASE WHEN kind = 'locked' THEN 'pdf:p' || page || ':o' || (c + k - 1) ELSE 'pdf:p' || page || ':b' || (c - 1) END) FILTER (WHERE kind <> 'blank') || ':r0' AS anchor,
  string_agg(sep, '' ORDER BY CASE WHEN cs = 0 AND kind = 'blank' THEN 1 ELSE 0 END, place) || CASE WHEN e = max(cs + ks) AND page < max(last_page) THEN chr(10) || chr(10) ELSE '' END AS separator_after
  FROM o WHERE e IS NOT NULL GROUP BY doc_id, page, e)"""


def _chunks(spark, sf_dir: str) -> DataFrame:
    rows = session_rows(spark, sf_dir).select("doc_id", F.posexplode("slots").alias("i", "s")).select("doc_id", "i", F.col("s.text").alias("line"))
    return rows.select("doc_id", F.floor(F.col("i") / 4).cast("int").alias("page"), (F.col("i") % 4).alias("place"), F.expr(_RAW).alias("raw"))


@query(f"""WITH {_CHUNKS} SELECT doc_id, CAST(page AS INT) AS page, entry, anchor, kind, raw, CASE WHEN kind = 'locked' THEN '[对象]' ELSE body END AS text, separator_after,
  kind = 'chunk' AS editable, CASE WHEN kind = 'chunk' THEN 'editableText' ELSE 'inlineObject' END AS role FROM entry""")
def page_entries(spark, sf_dir):
    return page_chunks.entries(_chunks(spark, sf_dir))


@query(f"""WITH {_CHUNKS}, same AS (SELECT doc_id, max(m) AS m FROM (SELECT doc_id, count(*) AS m FROM entry WHERE kind = 'chunk' GROUP BY doc_id, page, raw) GROUP BY doc_id),
whole AS (SELECT doc_id, string_agg(CASE WHEN kind = 'locked' THEN '[对象]' ELSE body END || separator_after, '' ORDER BY page, entry) AS text FROM entry GROUP BY doc_id)
SELECT doc_id, CASE WHEN m > 1 THEN 'duplicate_chunk' WHEN m IS NULL THEN 'no_chunk' END AS reason, text FROM whole LEFT JOIN same USING (doc_id)""")
def page_documents(spark, sf_dir):
    made = page_chunks.entries(_chunks(spark, sf_dir))
    return page_chunks.block_reasons(made).join(page_chunks.templates(made).select("doc_id", "text"), "doc_id")


@query(f"""WITH {_CHUNKS} SELECT doc_id, CAST(page AS INT) AS page, entry, anchor, regexp_replace(raw, '[\\r\\n]+$', '') AS search,
  CASE WHEN regexp_matches(raw, '[ \\t](\\r?\\n|$)') THEN regexp_replace(raw, '\\s+$', '') ELSE body END AS replacement, CAST(NULL AS VARCHAR) AS error FROM entry WHERE kind = 'chunk'""")
def page_replacements(spark, sf_dir):
    """Slots that nobody changed, back to what each chunk is replaced by."""
    made = page_chunks.entries(_chunks(spark, sf_dir))
    slots = page_chunks.templates(made).select("doc_id", F.inline(template.region_slots(F.col("regions"))))
    return page_chunks.replacements(made, slots)


@query(f"""WITH {slots_sql()}, g AS (SELECT *, regexp_replace(slot_id, ':s[0-9]+$', '') AS anchor FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(slot_order)) - 1 AS INT) AS region_order, anchor, string_agg(text || sep, '' ORDER BY slot_order) AS text, bool_or(editable) AS editable,
  CASE WHEN bool_or(editable) THEN 'editableText' ELSE 'lockedText' END AS role, CAST(count(*) AS INT) AS n_slots FROM g GROUP BY doc_id, anchor""")
def regrouped_regions(spark, sf_dir):
    return regroup.regions(texts(spark, sf_dir, PARAGRAPHS).select("doc_id", segment.slot_array(F.col("text")).alias("slots")))


# Every line of a text in one of ten kinds of markup; characters that are markup themselves are changed first.
_PLAIN = "replace(replace(translate(line, '`[]<$' || chr(92) || chr(13), '____S//'), 'http', 'hxxp'), 'www.', 'vvv.')"
_MARKS = [
    [("", "'a '"), ("code", "'`' || x || 'x`'"), ("", "' b'")],
    [("", "'see '"), ("link", "'[' || x || '](x(y)z)'"), ("", "' end'")],
    [("link", "'![' || x || '] [ref]'")],
    [("", "'q'"), ("footnote", "'[^' || x || ']'")],
    [("citation", "'[@' || x || ']'")],
    [("autolink", "'<https://e.org/' || i || '>'"), ("", "x")],
    [("html-tag", "'<b>'"), ("", "x"), ("html-tag", "'</b>'")],
    [("", "x || ' '"), ("url", "'https://e.org/a?b=1'"), ("", "'.'")],
    [("math-block", "'$$' || chr(10) || x || chr(10) || '$$'")],
    [("", "x || ' '"), ("math", "'$a' || chr(92) || '$b$'"), ("", "' '"), ("html-comment", "'<!-- ' || i || ' -->'")],
]
_MARKED_LINE = "CASE (doc_id + i) % 10 " + " ".join(f"WHEN {k} THEN {' || '.join(x for _, x in parts)}" for k, parts in enumerate(_MARKS)) + " END"
_MARK_ROWS = " UNION ALL ".join(f"SELECT doc_id, i, {o} AS o, '{kind}' AS k, {x} AS t FROM x WHERE (doc_id + i) % 10 = {m}" for m, parts in enumerate(_MARKS) for o, (kind, x) in enumerate(parts))


@query(f"""WITH {LINES}, x AS (SELECT doc_id, i, n, {_PLAIN} AS x FROM l), y AS ({_MARK_ROWS}),
e AS (SELECT doc_id, i, 9 AS o, CASE WHEN (doc_id + i) % 10 = 8 THEN 'math-block' ELSE '' END AS k, chr(10) AS t FROM x WHERE i < n - 1),
z AS (SELECT * FROM (SELECT * FROM y UNION ALL SELECT * FROM e) WHERE t <> ''),
g AS (SELECT *, sum(CASE WHEN k = before AND (k = '' OR (k = 'math-block' AND o = 9)) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i, o) AS run FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY i, o) AS before FROM z))
SELECT doc_id, CAST(run - 1 AS INT) AS segment, CASE WHEN any_value(k) = '' THEN 'text' ELSE 'protected' END AS kind, string_agg(t, '' ORDER BY i, o) AS text, nullif(any_value(k), '') AS protect_kind FROM g GROUP BY doc_id, run""")
def display_segments(spark, sf_dir):
    """Every text with all of its lines, marked up line by line, cut into what is shown as text and as protected."""
    lines = session_rows(spark, sf_dir).select("doc_id", F.posexplode("slots").alias("i", "s")).select("doc_id", "i", F.col("s.text").alias("line")).withColumn("x", F.expr(_PLAIN))
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.expr(_MARKED_LINE).alias("m")))), lambda r: r["m"]), "\n").alias("text"))
    return display.segments(whole).drop("label")


_TEX_PLAIN = "translate(line, '%$[]{}|' || chr(92) || chr(13), '_________') || 'x'"
_TEX_MARKS = [
    [("", "'a '"), ("tex-comment", "'% ' || x")],
    [("tex-command", "'@emph{'"), ("", "x"), ("tex-command", "'}'")],
    [("tex-math", "'$a$'"), ("", "' ' || x")],
    [("tex-raw-env", "'@begin{verbatim}' || x || '@end{verbatim}'"), ("", "'.'")],
    [("tex-math-block", "'$$' || x || '$$'"), ("", "' t'")],
    [("tex-verbatim", "'@verb|' || x || '|'"), ("", "'.'")],
    [("tex-command", "'@cite{' || x || '}'"), ("", "'. ' || x")],
]
_SLASHED = lambda x: f"replace({x}, '@', chr(92))" if "'@" in x else x
_TEX_LINE = f"CASE (doc_id + i) % {len(_TEX_MARKS)} " + " ".join(f"WHEN {k} THEN {' || '.join(_SLASHED(x) for _, x in parts)}" for k, parts in enumerate(_TEX_MARKS)) + " END"
_TEX_ROWS = " UNION ALL ".join(f"SELECT doc_id, i, {o} AS o, '{kind}' AS k, {_SLASHED(x)} AS t FROM x WHERE (doc_id + i) % {len(_TEX_MARKS)} = {m}" for m, parts in enumerate(_TEX_MARKS) for o, (kind, x) in enumerate(parts))


@query(f"""WITH {LINES}, x AS (SELECT doc_id, i, n, replace({_TEX_PLAIN}, '@', '_') AS x FROM l), z AS ({_TEX_ROWS} UNION ALL SELECT doc_id, i, 9, '', chr(10) FROM x WHERE i < n - 1),
g AS (SELECT *, sum(CASE WHEN k = '' AND before = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i, o) AS run FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY i, o) AS before FROM z))
SELECT doc_id, CAST(run - 1 AS INT) AS segment, CASE WHEN any_value(k) = '' THEN 'text' ELSE 'protected' END AS kind, string_agg(t, '' ORDER BY i, o) AS text, nullif(any_value(k), '') AS protect_kind FROM g GROUP BY doc_id, run""")
def display_segments_tex(spark, sf_dir):
    """As display_segments, in TeX."""
    lines = session_rows(spark, sf_dir).select("doc_id", F.posexplode("slots").alias("i", "s")).select("doc_id", "i", F.col("s.text").alias("line")).withColumn("x", F.expr(f"replace({_TEX_PLAIN}, '@', '_')"))
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.expr(_TEX_LINE).alias("m")))), lambda r: r["m"]), "\n").alias("text"))
    return display.segments(whole, "tex").drop("label")
