"""Finalizing documents: the texts are written back first, and only then their sessions go; exporting writes and keeps them.

A run has a name and a folder of its own, its journal. Three tables are written there in this order, each seen whole or not at all,
because Spark marks a finished table: plan (what is written, or why not), written (what has been), sessions (those that are
left). A run that is cut off anywhere is run again under its name: finished tables are read, not made anew. So the plan is
judged once, by the sources as they were, though half of them may be overwritten by then; texts are written again only where
their table is unfinished, with the same content; and a session is only gone where its text is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import writeback

PLAN, WRITTEN, SESSIONS = "plan", "written", "sessions"
#: Of a document in a run.
STATES = ("refused", "planned", "failed", "written", "finalized")


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a table there is finished, on whatever file system it is."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _once(path: str, spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written if it is not whole."""
    if not _whole(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def to_table(path: str) -> Callable[[DataFrame], DataFrame]:
    """A writer that makes a table of the texts; run again, it overwrites its own."""

    def write(texts: DataFrame) -> DataFrame:
        texts.select("doc_id", "path", "text").write.mode("overwrite").parquet(path)
        return texts.select("path", F.lit(None).cast("string").alias("error"))

    return write


def finalize(rows: DataFrame, sessions: DataFrame, journal: str, write: Callable[[DataFrame], DataFrame] = writeback.write_in_place) -> DataFrame:
    """Runs or resumes the run whose journal is that folder; returns the sessions that are left.

    rows: doc_id, path, and what writeback.gated() asks for, or already text and error; active (boolean), if there, refuses documents with
    a running job. write: from (doc_id, path, text) to (path, error). sessions: doc_id and more; those without a row in rows, or whose
    text was refused or not written, stay. Two rows with one path are refused, as one would overwrite the other.
    """
    spark = rows.sparkSession

    def planned() -> DataFrame:
        gated = rows if {"text", "error"} <= set(rows.columns) else writeback.gated(rows)
        twice = gated.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select("path", F.lit(True).alias("twice"))
        active = F.col("active") if "active" in gated.columns else F.lit(False)
        both = gated.join(twice, "path", "left")
        error = F.when(F.coalesce(active, F.lit(False)), "active_job").when(F.col("path").isNull(), "missing_path").when(F.col("twice"), "shared_path").otherwise(F.coalesce("error", F.when(F.col("text").isNull(), "missing_text")))
        return both.select("doc_id", "path", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))

    plan = _once(f"{journal}/{PLAN}", spark, planned)
    good = plan.filter("error IS NULL").select("doc_id", "path", "text")
    written = _once(f"{journal}/{WRITTEN}", spark, lambda: write(good))
    done = good.join(written.filter("error IS NULL").select("path"), "path", "left_semi").select("doc_id")
    return _once(f"{journal}/{SESSIONS}", spark, lambda: sessions.join(done, "doc_id", "left_anti"))


def states(spark: SparkSession, journal: str) -> DataFrame:
    """doc_id, path, state, error of every document of a run, from its journal, wherever it was cut off. No plan yet: no rows."""
    if not _whole(spark, f"{journal}/{PLAN}"):
        return spark.createDataFrame([], "doc_id long, path string, state string, error string")
    plan = spark.read.parquet(f"{journal}/{PLAN}")
    if not _whole(spark, f"{journal}/{WRITTEN}"):
        return plan.select("doc_id", "path", F.when(F.col("error").isNotNull(), "refused").otherwise("planned").alias("state"), "error")
    written = spark.read.parquet(f"{journal}/{WRITTEN}").select("path", F.lit(True).alias("tried"), F.col("error").alias("why"))
    over = F.lit(_whole(spark, f"{journal}/{SESSIONS}"))
    return plan.join(written, "path", "left").select("doc_id", "path", _state(over).alias("state"), F.coalesce("error", "why").alias("error"))


def _state(over: Column) -> Column:
    lost = F.col("why").isNotNull() | F.col("tried").isNull()
    return F.when(F.col("error").isNotNull(), "refused").when(lost, "failed").when(over, "finalized").otherwise("written")


def export(rows: DataFrame, path: str) -> DataFrame:
    """Writes the texts of rows (doc_id, text, error) without an error as a new table; returns doc_id, exported, error. Nothing else changes."""
    rows.filter("error IS NULL AND text IS NOT NULL").select("doc_id", "text").write.mode("overwrite").parquet(path)
    exported = F.col("error").isNull() & F.col("text").isNotNull()
    return rows.select("doc_id", exported.alias("exported"), F.when(~exported, F.coalesce("error", F.lit("missing_text"))).alias("error"))
