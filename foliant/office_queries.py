"""Queries over office documents made of the supplied texts, and their SQL.

Every line is a paragraph whose style follows from the document and the line's number: list, heading, bold, table or plain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import office as slots_of
from foliant.operators.segment import struct
from foliant.queries import query, texts
from foliant.sources import office

STYLES = ("list", "heading", "bold", "table", "plain")
#: Blocks as the file shows them: text with its list marker, whether it is a heading, whether it may be rewritten.
BLOCKS = """b AS (SELECT doc_id, i - 1 AS i, k, CASE k WHEN 0 THEN CASE WHEN blank THEN '' ELSE n || '. ' END || line WHEN 3 THEN '[表格]' ELSE line END AS text, line, k = 1 AS heading,
    k IN (0, 2, 4) AND NOT blank AS editable, CASE WHEN k = 0 AND NOT blank THEN n || '. ' ELSE '' END AS marker
  FROM (SELECT *, sum(CASE WHEN k = 0 AND NOT blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n
    FROM (SELECT doc_id, i, s[i] AS line, (doc_id + i - 1) % 5 AS k, trim(s[i], ' ' || chr(9)) = '' AS blank
      FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i))))"""


def files(spark, sf_dir: str) -> DataFrame:
    style = lambda i: F.get(F.array(*(F.lit(x) for x in STYLES)), ((F.col("doc_id") + i) % len(STYLES)).cast("int"))
    lines = F.transform(F.split("text", "\n"), lambda line, i: struct(text=line, style=style(i)))
    return office.export(texts(spark, sf_dir).select("doc_id", lines.alias("paragraphs")))


@query(f"""
WITH {BLOCKS}
SELECT doc_id, CAST(i AS BIGINT) AS block, CASE WHEN k = 3 THEN 'block' ELSE 'p' END AS kind, heading, text, CASE WHEN k = 3 THEN false ELSE line <> '' AND trim(line, ' ' || chr(9)) <> '' END AS editable,
  CASE WHEN k = 3 THEN 'table' WHEN marker <> '' THEN 'list-marker' END AS protect FROM b
WHERE doc_id IN (SELECT doc_id FROM b GROUP BY doc_id HAVING bool_or(trim(text, ' ' || chr(9)) <> ''))""")
def office_blocks(spark, sf_dir):
    made = office.read(files(spark, sf_dir)).filter("error IS NULL").select("doc_id", F.posexplode("blocks").alias("block", "b"))
    regions = F.col("b.regions")
    return made.select(
        "doc_id", F.col("block").cast("long").alias("block"), "b.kind", "b.heading", F.array_join(F.transform(regions, lambda r: r["text"]), "").alias("text"),
        F.exists(regions, lambda r: r["editable"]).alias("editable"), F.get(F.filter(F.transform(regions, lambda r: r["protect"]), lambda p: p.isNotNull()), F.lit(0)).alias("protect"),
    )


@query(f"""
WITH {BLOCKS}
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, coalesce(string_agg(line, '' ORDER BY i) FILTER (WHERE editable), '') AS editable_text,
  CASE WHEN bool_or(trim(text, ' ' || chr(9)) <> '') THEN NULL ELSE 'no_visible_text' END AS error FROM b GROUP BY doc_id HAVING bool_or(trim(text, ' ' || chr(9)) <> '')""")
def office_slots(spark, sf_dir):
    made = slots_of.slot_arrays(files(spark, sf_dir)).filter("error IS NULL")
    free = F.transform(F.filter("slots", lambda s: s["editable"]), lambda s: s["text"])
    return made.select("doc_id", slots_of.source_text(F.col("slots")).alias("text"), F.array_join(free, "").alias("editable_text"), "error")


@query(f"""
WITH {BLOCKS}
SELECT doc_id, string_agg(CASE WHEN editable THEN marker || replace(line, 'e', '<É&') ELSE text END, chr(10) || chr(10) ORDER BY i) AS text
FROM b GROUP BY doc_id HAVING bool_or(trim(text, ' ' || chr(9)) <> '')""")
def office_rewritten(spark, sf_dir):
    made = slots_of.slot_arrays(files(spark, sf_dir))
    drifted = lambda s: F.when(s["text"] == "", "").otherwise(F.concat(s["text"], F.lit("drift")))
    new = F.transform("slots", lambda s: s.withField("text", F.when(s["editable"], F.replace(s["text"], F.lit("e"), F.lit("<É&"))).otherwise(drifted(s))))
    written = office.rewrite(made.filter("error IS NULL").withColumn("slots", new))
    return slots_of.slot_arrays(written).filter("error IS NULL").select("doc_id", slots_of.source_text(F.col("slots")).alias("text"))


@query(f"""
WITH {BLOCKS}
SELECT doc_id, string_agg(CASE WHEN k = 3 THEN text ELSE marker || replace(line, 'a', 'aA') END, chr(10) || chr(10) ORDER BY i) AS text
FROM b GROUP BY doc_id HAVING bool_or(trim(text, ' ' || chr(9)) <> '')""")
def office_edited(spark, sf_dir):
    made = slots_of.slot_arrays(files(spark, sf_dir)).filter("error IS NULL")
    typed = made.withColumn("text", F.replace(slots_of.source_text(F.col("slots")), F.lit("a"), F.lit("aA")))
    return slots_of.slot_arrays(office.edit(typed)).filter("error IS NULL").select("doc_id", slots_of.source_text(F.col("slots")).alias("text"))
