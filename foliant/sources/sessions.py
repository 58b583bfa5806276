"""Sessions as JSON: reading with the migration of older files, saving, deleting. Finalizing is in operators.finalize."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import capabilities as caps

_GATE = "struct<allowed:boolean,blockReason:string>"
_SPANS = "array<struct<type:string,text:string,degradedReason:string>>"
SCHEMA = f"""
id string, title string, documentPath string, sourceText string, normalizedText string, sourceSnapshot struct<sha256:string>,
templateKind string, templateSignature string, slotStructureSignature string,
capabilities struct<sourceWriteback:{_GATE},editorWriteback:{_GATE}>,
writeBackSupported boolean, writeBackBlockReason string, editorWritebackSafe boolean, editorWritebackBlockReason string,
plainTextEditorSafe boolean, plainTextEditorBlockReason string, segmentationPreset string, rewriteHeadings boolean,
writebackSlots array<struct<id:string,order:int,text:string,editable:boolean,role:string,anchor:string,separatorAfter:string>>,
rewriteUnits array<struct<id:string,order:int,slotIds:array<string>,displayText:string,segmentationPreset:string,status:string,errorMessage:string>>,
suggestions array<struct<id:string,sequence:bigint,rewriteUnitId:string,beforeText:string,afterText:string,
  diff:struct<spans:{_SPANS},degradedReason:string>,diffSpans:{_SPANS},decision:string,slotUpdates:array<struct<slotId:string,text:string>>,createdAt:timestamp,updatedAt:timestamp>>,
nextSuggestionSequence bigint, status string, createdAt timestamp, updatedAt timestamp
"""


def migrated(sessions: DataFrame) -> DataFrame:
    """sessions of SCHEMA in today's form: gates from older flags, spans of older suggestions in diff."""
    gate = lambda name: F.struct(F.col(f"capabilities.{name}.allowed").alias("allowed"), F.col(f"capabilities.{name}.blockReason").alias("reason"))
    set_ = lambda name: F.when(F.col(f"capabilities.{name}").isNotNull(), gate(name))
    editor_safe = F.coalesce("editorWritebackSafe", "plainTextEditorSafe")
    editor_reason = F.coalesce("editorWritebackBlockReason", "plainTextEditorBlockReason")
    whole = F.transform("suggestions", lambda s: s.withField("diff", F.coalesce(s["diff"], F.struct(s["diffSpans"].alias("spans"), F.lit(None).cast("string").alias("degradedReason")))).dropFields("diffSpans"))
    out = sessions.withColumns(
        {
            "source_gate": caps.migrated_gate(set_("sourceWriteback"), F.col("writeBackSupported"), F.col("writeBackBlockReason")),
            "editor_gate": caps.migrated_gate(set_("editorWriteback"), editor_safe, editor_reason),
            "suggestions": whole,
        }
    )
    old = ["capabilities", "writeBackSupported", "writeBackBlockReason", "editorWritebackSafe", "editorWritebackBlockReason", "plainTextEditorSafe", "plainTextEditorBlockReason"]
    return out.drop(*old)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The sessions of a folder of JSON files, one object each; files that are none have only an error."""
    rows = spark.read.schema(f"{SCHEMA}, _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return migrated(rows).withColumn("error", F.when(F.col("_corrupt").isNotNull() | F.col("id").isNull(), "not_a_session")).drop("_corrupt")


def parsed(lines: DataFrame, text: str = "text") -> DataFrame:
    """The sessions of a column of JSON texts."""
    return migrated(lines.select(F.from_json(text, SCHEMA).alias("s")).select("s.*"))


def save(sessions: DataFrame, path: str) -> None:
    """Writes migrated sessions as JSON lines, with their gates where load() finds them."""
    gate = lambda name: F.struct(F.col(f"{name}.allowed").alias("allowed"), F.col(f"{name}.reason").alias("blockReason"))
    nested = F.struct(gate("source_gate").alias("sourceWriteback"), gate("editor_gate").alias("editorWriteback"))
    sessions.withColumn("capabilities", nested).drop("source_gate", "editor_gate", "error").write.json(path)


def without(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """sessions but for those to delete."""
    return sessions.join(ids.select("id"), "id", "left_anti")


def open_sessions(slots: DataFrame, sources: DataFrame, namespace: bytes) -> DataFrame:
    """Clean sessions of loaded documents: slots (doc_id, slots), sources (doc_id, path, text). Blank texts are refused."""
    from foliant.functions import names
    from foliant.functions import text as t

    both = sources.join(slots, "doc_id")
    return both.select(
        names.session_id(F.col("path"), namespace).alias("id"), names.session_title(F.col("path")).alias("title"), F.col("path").alias("documentPath"),
        F.col("text").alias("sourceText"), t.normalize(F.col("text")).alias("normalizedText"), "slots", F.lit(1).cast("long").alias("nextSuggestionSequence"),
        F.lit("idle").alias("status"), F.when(t.is_blank(F.col("text")), "empty_document").alias("error"),
    )
