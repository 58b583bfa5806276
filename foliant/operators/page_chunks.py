"""Texts that come as chunks of pages: what an extractor of pages gives, made into regions, and regions made into replacements.

A table of chunks has doc_id, page (from 0), place (the order in the page) and raw, null for a chunk that could not be read. All
is windows and groups over (doc_id, page), so a task holds pages and no documents. Extracting the chunks is left to others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import boundaries as b
from foliant.functions import text as t
from foliant.functions.text import let
from foliant.operators.segment import struct

# What stands for a chunk that could not be read, and how regions are named.
UNREADABLE = "[对象]"
PREFIX = "pdf"


def chunk_text(raw: Column) -> Column:
    """raw with line feeds, without byte order marks at its ends and blanks at the ends of its lines."""
    return t.strip_line_tails(F.regexp_replace(t.to_lf(raw), r"^\x{FEFF}++|\x{FEFF}++\z", ""))


def parted(text: Column) -> Column:
    """Struct (text, separator): a paragraph break if the text's first one ends it, else its last white space."""
    upto = F.regexp_extract(text, rf"(?s)^.*?{b.SEPARATOR}", 0)
    whole = (upto != "") & (F.length(upto) == F.length(text))
    body = F.when(whole, F.substr(text, F.lit(1), F.length(text) - F.length(b.separator_of(text)))).otherwise(t.rtrim(text))
    return let(body, lambda x: struct(text=x, separator=F.substr(text, F.length(x) + 1)))


def entries(chunks: DataFrame) -> DataFrame:
    """doc_id, page, entry (the order in the page), anchor, kind, raw, text, separator_after, editable, role.

    A page has its chunks in order, then its unreadable ones (kind locked). A chunk of white space only is none: its separator goes to the
    next chunk of the page, else to the last, else to the last locked one. After every page but a document's last comes an empty
    line. Rows of a page that share a place come in the order of their texts.
    """
    made = chunks.select("doc_id", "page", "place", "raw", parted(chunk_text(F.coalesce("raw", F.lit("")))).alias("p"))
    kind = F.when(F.col("raw").isNull(), "locked").when(F.col("p.text") == "", "blank").otherwise("chunk")
    made = made.select("doc_id", "page", "place", "raw", "p.text", F.when(kind == "locked", "\n").otherwise(F.col("p.separator")).alias("sep"), kind.alias("kind"))
    page = Window.partitionBy("doc_id", "page")
    so_far = page.orderBy("place", "raw").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda k: F.count_if(F.col("kind") == k)
    made = made.select(
        "*", F.row_number().over(page.orderBy("place", "raw")).alias("row"), is_("chunk").over(so_far).alias("chunks"), is_("locked").over(so_far).alias("locks"),
        is_("chunk").over(page).alias("all_chunks"), is_("locked").over(page).alias("all_locks"),
    )
    # the entry of the page that a row is part of: chunks are counted from 1, locked ones after them
    blank = F.when(F.col("all_chunks") > 0, F.least(F.col("chunks") + 1, F.col("all_chunks"))).when(F.col("all_locks") > 0, F.col("all_locks"))
    entry = F.when(F.col("kind") == "chunk", F.col("chunks")).when(F.col("kind") == "locked", F.col("all_chunks") + F.col("locks")).otherwise(blank)
    offset = F.when(F.col("kind") == "locked", F.col("chunks") + F.col("locks") - 1).otherwise(F.col("chunks") - 1)
    own = F.max(F.when(F.col("kind") != "blank", F.struct("kind", "raw", "text", offset.alias("offset"))))
    grouped = made.withColumn("entry", entry).filter("entry IS NOT NULL").groupBy("doc_id", "page", "entry", (F.col("all_chunks") + F.col("all_locks")).alias("n_entries")).agg(
        own.alias("own"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("kind") == "blank").cast("int").alias("blank_after"), "row", "sep"))), lambda s: s["sep"]), "").alias("after"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "sep"))), lambda s: s["sep"]), "").alias("in_order"),
    )
    last = chunks.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    both = grouped.join(last, "doc_id")
    locked = F.col("own.kind") == "locked"
    ending = F.when((F.col("entry") == F.col("n_entries")) & (F.col("page") < F.col("last_page")), "\n\n").otherwise("")
    name = F.concat(F.lit(f"{PREFIX}:p"), F.col("page").cast("string"), F.when(locked, ":o").otherwise(":b"), F.col("own.offset").cast("string"), F.lit(":r0"))
    return both.select(
        "doc_id", "page", (F.col("entry") - 1).cast("int").alias("entry"), name.alias("anchor"), F.col("own.kind").alias("kind"), F.col("own.raw").alias("raw"),
        F.when(locked, UNREADABLE).otherwise(F.col("own.text")).alias("text"), F.concat(F.when(locked, F.col("after")).otherwise(F.col("in_order")), ending).alias("separator_after"),
        (~locked).alias("editable"), F.when(locked, "inlineObject").otherwise("editableText").alias("role"),
    )


def block_reasons(entries: DataFrame) -> DataFrame:
    """doc_id, reason why a document cannot be written back: duplicate_chunk (two of a page have one raw text), no_chunk, or null."""
    same = entries.filter("kind = 'chunk'").groupBy("doc_id", "page", "raw").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("most"))
    every = entries.select("doc_id").distinct().join(same, "doc_id", "left")
    return every.select("doc_id", F.when(F.col("most") > 1, "duplicate_chunk").when(F.col("most").isNull(), "no_chunk").alias("reason"))


def templates(entries: DataFrame) -> DataFrame:
    """doc_id, text and regions (as template.region_slots() takes them) of the entries, in order."""
    region = F.struct(
        "page", "entry", "anchor", F.when(F.col("kind") == "chunk", "chunk").otherwise("locked").alias("block_kind"), "text", "separator_after", "editable", "role",
        F.when(F.col("editable"), "boundaryAware").otherwise("atomic").alias("split_mode"),
    )
    made = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    text = F.array_join(F.transform("regions", lambda r: F.concat(r["text"], r["separator_after"])), "")
    return made.select("doc_id", text.alias("text"), F.transform("regions", lambda r: r.dropFields("page", "entry")).alias("regions"))


def fallback_regions(text: Column) -> Column:
    """Regions of a text without pages: one for each paragraph."""

    def region(p: Column, i: Column) -> Column:
        anchor = F.concat(F.lit(f"{PREFIX}:fallback:p"), i.cast("string"), F.lit(":r0"))
        return let(parted(p), lambda x: struct(anchor=anchor, block_kind=F.lit("fallback"), text=x["text"], separator_after=x["separator"], editable=F.lit(True), role=F.lit("editableText"), split_mode=F.lit("boundaryAware")))

    kind = "array<struct<anchor:string,block_kind:string,text:string,separator_after:string,editable:boolean,role:string,split_mode:string>>"
    return F.when(text == "", F.array()).otherwise(F.transform(b.paragraphs(text), region)).cast(kind)


def joined_pages(chunks: DataFrame) -> DataFrame:
    """doc_id, text, error: the plain text of pages where chunks are no use: one chunk a page, an empty line between them."""
    rows = F.array_sort(F.collect_list(F.struct("page", "place", chunk_text(F.coalesce("raw", F.lit(""))).alias("text"))))
    text = F.regexp_replace(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n"), r"^\x{FEFF}++|\x{FEFF}++\z", "")
    return chunks.groupBy("doc_id").agg(text.alias("text")).select("doc_id", "text", F.when(t.is_blank(F.col("text")), "no_visible_text").alias("error"))


def region_of(slot_id: Column) -> Column:
    """The region that a slot's id names; null if it names none."""
    return F.nullif(F.regexp_extract(slot_id, r"(?s)^(.*):s[0-9]+\z", 1), F.lit(""))


def replacements(entries: DataFrame, slots: DataFrame) -> DataFrame:
    """doc_id, page, entry, anchor, search, replacement, error of every chunk, from slots (doc_id, slot_order, slot_id, text, separator_after).

    search: the raw text without line ends at its end. replacement: the region's slots joined, without the entry's separator at the end, in
    the raw text's layout. missing_region where no slot is left of a chunk.
    """
    rows = slots.withColumn("anchor", region_of(F.col("slot_id"))).groupBy("doc_id", "anchor").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot_order", F.concat("text", "separator_after").alias("piece")))), lambda s: s["piece"]), "").alias("whole")
    )
    both = entries.filter("kind = 'chunk'").join(rows, ["doc_id", "anchor"], "left")
    cut = F.when((F.col("separator_after") != "") & F.endswith("whole", "separator_after"), F.substr("whole", F.lit(1), F.length("whole") - F.length("separator_after"))).otherwise(F.col("whole"))
    laid = t.match_layout(F.col("cut"), F.col("raw"))
    error = F.when(F.col("whole").isNull(), "missing_region")
    return both.withColumn("cut", cut).select("doc_id", "page", "entry", "anchor", F.regexp_replace("raw", r"[\r\n]++\z", "").alias("search"), laid.alias("replacement"), error.alias("error"))
