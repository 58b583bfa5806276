"""One way from the texts of every textual format to slots: blocks, regions, slots.

Blocks of Markdown texts are native expressions; inline markup of Markdown, and TeX texts, are scanned into regions in Arrow
batches; plain texts have one region for each paragraph. Slots are made from the regions by expressions inside the row, for all
formats alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import boundaries as b
from foliant.functions import text as t
from foliant.functions.text import let
from foliant.operators import markdown_blocks, markdown_regions, tex_blocks, tex_regions
from foliant.operators.regions import KINDS, parted
from foliant.operators.segment import SLOT, inlined, paragraph_pieces, slot_array, struct

REGION = "struct<anchor:string,block_kind:string,text:string,separator_after:string,editable:boolean,role:string,split_mode:string>"


def _blocks(text: str, blocks: list[dict] | None, headings: bool):
    """(anchor, kind, regions) of each block: those that are given, of Markdown, or those of a TeX text."""
    if blocks is not None:
        for i, b in enumerate(blocks):
            yield f"md:b{i}", b["kind"], markdown_regions.regions_of(b["text"], b["kind"], headings)
    else:
        for i, (block, x) in enumerate(tex_blocks.blocks_of(text)):
            yield f"tex:b{i}", block, tex_regions.regions_of(x, headings)


def _scan(headings: bool):
    names = ["anchor", "block_kind", "text", "separator_after", "editable", "role", "split_mode"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            ends = [0]
            for text, blocks in zip(batch.column("text").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                for anchor, block, regions in _blocks(text or "", blocks, headings):
                    for j, (code, body) in enumerate(regions):
                        role, editable, split = KINDS[code]
                        for column, value in zip(columns, (f"{anchor}:r{j}", block, *parted(body), editable, role, split), strict=True):
                            column.append(value)
                ends.append(len(columns[0]))
            found = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], ["doc_id", "regions"])

    return run


def region_arrays(docs: DataFrame, headings: bool = False) -> DataFrame:
    """doc_id, regions of Markdown and TeX texts. docs: doc_id, text, format (markdown or tex). No shuffle."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    is_markdown = F.col("format") == "markdown"
    blocks = F.when(is_markdown, markdown_blocks.block_array(F.col("text")))
    return docs.select("doc_id", F.when(~is_markdown, F.col("text")).alias("text"), blocks.alias("blocks")).mapInArrow(_scan(headings), f"doc_id {id_kind}, regions array<{REGION}>")


def regions(docs: DataFrame, headings: bool = False) -> DataFrame:
    """doc_id, region_order and one row for each region."""
    return region_arrays(docs, headings).select("doc_id", F.posexplode("regions").alias("region_order", "r")).select("doc_id", "region_order", "r.*")


def _chunks(region: Column) -> Column:
    """Array of (text, separator_after): the pieces of a region."""
    whole = F.concat(region["text"], region["separator_after"])
    alone = F.array(struct(text=region["text"], separator_after=region["separator_after"]))
    paragraphs = F.transform(b.paragraphs(whole), lambda p: let(b.separator_of(p), lambda s: _body(p, s)))
    clauses = F.flatten(F.transform(b.paragraphs(whole), paragraph_pieces))
    split = F.when(region["editable"] & (region["split_mode"] == "boundaryAware"), clauses).when(region["editable"], alone).otherwise(paragraphs)
    return F.when(whole == "", F.array().cast("array<struct<text:string,separator_after:string>>")).otherwise(split)


def _body(paragraph: Column, separator: Column) -> Column:
    body = F.when(separator != "", F.substr(paragraph, F.lit(1), F.length(paragraph) - F.length(separator))).otherwise(t.rtrim(paragraph))
    return let(body, lambda x: struct(text=x, separator_after=F.substr(paragraph, F.length(x) + 1)))


def region_slots(regions: Column) -> Column:
    """Array of slots of an array of regions. A piece without text hands its separator to the slot before it."""

    def of_region(r: Column) -> Column:
        return F.transform(
            _chunks(r),
            lambda c, k: struct(
                slot_id=F.concat(r["anchor"], F.lit(":s"), k.cast("string")), text=c["text"], separator_after=c["separator_after"], editable=r["editable"], role=r["role"]
            ),
        )

    def kept(flat: Column) -> Column:
        return let(F.filter(F.transform(flat, lambda s, i: F.when((i == 0) | (s["text"] != "") | (s["separator_after"] == ""), i)), lambda i: i.isNotNull()), lambda at: made(flat, at))

    def made(flat: Column, at: Column) -> Column:
        def slot(i: Column, k: Column) -> Column:
            after = F.coalesce(F.get(at, k + 1), F.size(flat))
            loose = F.array_join(F.transform(F.slice(flat, i + 2, after - i - 1), lambda s: s["separator_after"]), "")
            return let(F.get(flat, i), lambda s: let(F.concat(s["separator_after"], loose), lambda sep: finished(s, sep, k)))

        return F.transform(at, slot)

    def finished(s: Column, separator: Column, order: Column) -> Column:
        editable = s["editable"] & ~t.is_blank(s["text"])
        role = (
            F.when(editable, s["role"]).when(b.has_paragraph_break(separator), "paragraphBreak")
            .when((s["role"] == "editableText") & (s["text"] != ""), "lockedText").otherwise(s["role"])
        )
        return struct(slot_order=order, slot_id=s["slot_id"], text=s["text"], separator_after=separator, editable=editable, role=role)

    return F.when(F.size(regions) == 0, F.array().cast(f"array<{SLOT}>")).otherwise(let(F.flatten(F.transform(regions, of_region)), kept))


def slot_arrays(docs: DataFrame, headings: bool = False) -> DataFrame:
    """doc_id, slots of texts of any format. docs: doc_id, text, format (plainText, markdown or tex). No shuffle."""
    marked = F.col("format").isin("markdown", "tex")
    plain = docs.filter(~marked).select("doc_id", slot_array(F.col("text")).alias("slots"))
    return plain.unionByName(region_arrays(docs.filter(marked), headings).select("doc_id", region_slots(F.col("regions")).alias("slots")))


def slots(docs: DataFrame, headings: bool = False) -> DataFrame:
    """doc_id and one row for each slot."""
    return inlined(slot_arrays(docs, headings))
