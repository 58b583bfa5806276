"""Document files: listing, format, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each extension is.
FORMATS = {"md": "markdown", "markdown": "markdown", "tex": "tex", "latex": "tex", "docx": "docx", "pdf": "pdf"}
TEXTUAL = ["", "txt", "md", "markdown", "tex", "latex"]


def extension(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)\z", 1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1))


def document_format(path: Column) -> Column:
    ext = extension(path)
    out = F.lit("plainText")
    for name, kind in FORMATS.items():
        out = F.when(ext == name, kind).otherwise(out)
    return out


def backend(path: Column) -> Column:
    kind = document_format(path)
    return F.when(kind.isin("docx", "pdf"), kind).otherwise("textual")


def load_error(path: Column) -> Column:
    """Why a file of this name is not loaded; null if it is."""
    ext = extension(path)
    return F.when(ext == "doc", "legacy_word").when(~ext.isin(*TEXTUAL, "docx", "pdf"), "unsupported_extension")


def _utf16_ok(content: Column, high: int) -> Column:
    """Whole code units, and every surrogate in a pair. high: where in a unit the high byte is."""
    units = F.regexp_replace(F.hex(content), "(....)", "$1 ")
    low = "[0-9A-F]{2}"
    lead, trail = (f"D[89AB]{low}", f"D[C-F]{low}") if high == 0 else (f"{low}D[89AB]", f"{low}D[C-F]")
    lone = units.rlike(rf"{lead} (?!{trail})|(?<!{lead} )\b{trail}")
    return (F.length(content) % 2 == 0) & ~lone


def decoded(content: Column) -> Column:
    """Struct (text, encoding, error): UTF-8 with or without mark, or UTF-16 with a mark."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substr(content, F.lit(n + 1))
    kind = F.when(head == "EFBBBF", "utf8-bom").when(F.startswith(head, F.lit("FFFE")), "utf16le").when(F.startswith(head, F.lit("FEFF")), "utf16be").otherwise("utf8")
    body = F.when(kind == "utf8-bom", rest(3)).when(kind.isin("utf16le", "utf16be"), rest(2)).otherwise(content)
    utf8 = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
    text = (
        F.when((kind == "utf16le") & _utf16_ok(body, 1), F.decode(body, "UTF-16LE"))
        .when((kind == "utf16be") & _utf16_ok(body, 0), F.decode(body, "UTF-16BE"))
        .when(kind.isin("utf8", "utf8-bom"), utf8)
    )
    return F.named_struct(F.lit("text"), text, F.lit("encoding"), kind, F.lit("error"), F.when(text.isNull(), "invalid_encoding"))


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, format, sha256, text, encoding, error of the files under a folder; binary formats have no text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    out = files.select("path", document_format(F.col("path")).alias("format"), F.sha2("content", 256).alias("sha256"), load_error(F.col("path")).alias("refused"), decoded(F.col("content")).alias("d"))
    readable = F.col("refused").isNull() & ~F.col("format").isin("docx", "pdf")
    return out.select("path", "format", "sha256", F.when(readable, F.col("d.text")).alias("text"), F.when(readable, F.col("d.encoding")).alias("encoding"), F.coalesce("refused", F.when(readable, F.col("d.error"))).alias("error"))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """The files whose (path, sha256) is not known: all that an incremental run has to read."""
    return found.join(known.select("path", "sha256"), ["path", "sha256"], "left_anti")
