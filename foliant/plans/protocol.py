"""Requests to a rewriter and checks of its answers, as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import segment

UPDATE = "struct<slotId:string,text:string>"
RESULT = f"struct<rewriteUnitId:string,updates:array<{UPDATE}>>"
RESPONSE = f"struct<batchId:string,results:array<{RESULT}>>"


def unit_requests(units: DataFrame, slots: DataFrame) -> DataFrame:
    """doc_id, unit_id, unit_order, request, error: the unit with its slots, as JSON.

    error: missing_slot where an id of the unit is no slot, protected_unit where no slot is editable.
    """
    wanted = units.select("doc_id", "unit_id", "unit_order", "display_text", F.posexplode("slot_ids").alias("pos", "slot_id"))
    both = wanted.join(slots.select("doc_id", "slot_id", "text", "editable", "role"), ["doc_id", "slot_id"], "left")
    own = F.array_sort(F.collect_list(F.struct("pos", F.col("slot_id").alias("slotId"), "text", "editable", "role")))
    missing = F.when(F.bool_or(F.col("editable").isNull()), "missing_slot").when(~F.bool_or("editable"), "protected_unit")
    grouped = both.groupBy("doc_id", "unit_id", "unit_order", "display_text").agg(own.alias("s"), missing.alias("error"))
    listed = F.transform("s", lambda x: F.struct(x["slotId"].alias("slotId"), x["text"].alias("text"), x["editable"].alias("editable"), x["role"].alias("role")))
    request = F.to_json(F.struct(F.col("unit_id").alias("rewriteUnitId"), F.col("display_text").alias("displayText"), listed.alias("slots")))
    return grouped.select("doc_id", "unit_id", "unit_order", F.when(F.col("error").isNull(), request).alias("request"), "error")


def requests(slots: Column, preset: str) -> Column:
    """Array of (unit_id, unit_order, request, error) of the units of an array of slots: as unit_requests(), in the row, without a shuffle."""

    def made(slots: Column) -> Column:
        # units of slots that are named by their places, which finds them again
        placed = F.transform(slots, lambda s, i: s.withField("slot_id", i.cast("string")))
        return F.transform(segment.unit_array(placed, preset), lambda u: t.let(F.transform(u["slot_ids"], lambda p: F.get(slots, p.cast("int"))), lambda own: request(u, own)))

    def request(u: Column, own: Column) -> Column:
        listed = F.transform(own, lambda s: segment.struct(slotId=s["slot_id"], text=s["text"], editable=s["editable"], role=s["role"]))
        body = F.to_json(segment.struct(rewriteUnitId=u["unit_id"], displayText=u["display_text"], slots=listed))
        error = F.when(~F.exists(own, lambda s: s["editable"]), "protected_unit")
        return segment.struct(unit_id=u["unit_id"], unit_order=u["unit_order"], request=F.when(error.isNull(), body), error=error)

    return t.let(slots, made)


def response_problem(batch_id: Column, unit_ids: Column, editable: Column, response: Column) -> Column:
    """Why a batch's answer cannot be used; null for a good one.

    unit_ids: array of the requested ids in order; editable: map from a unit's id to the ids of its editable slots.
    """
    # bound to names, as the parsed answer is used at every check
    return t.let(F.from_json(response, RESPONSE), lambda r: t.let(editable, lambda e: _response_problem(batch_id, unit_ids, e, r)))


def _response_problem(batch_id: Column, unit_ids: Column, editable: Column, r: Column) -> Column:
    results = r["results"]
    ids = F.transform(results, lambda x: x["rewriteUnitId"])
    bad = lambda test: F.exists(results, test)
    slots = lambda x: F.transform(x["updates"], lambda u: u["slotId"])
    every = F.flatten(F.transform(results, slots))
    return (
        F.when(r.isNull() | results.isNull() | r["batchId"].isNull(), "not_json")
        .when(r["batchId"] != batch_id, "batch_id")
        .when(F.size(results) != F.size(unit_ids), "length")
        .when(~ids.eqNullSafe(unit_ids), "order")
        .when(bad(lambda x: x["updates"].isNull() | F.exists(x["updates"], lambda u: u["slotId"].isNull() | u["text"].isNull())), "fields")
        .when(bad(lambda x: F.size(F.array_distinct(slots(x))) != F.size(x["updates"])), "repeated_slot")
        .when(F.size(F.array_distinct(every)) != F.size(every), "repeated_in_batch")
        .when(bad(lambda x: F.size(F.array_except(slots(x), F.coalesce(F.try_element_at(editable, x["rewriteUnitId"]), F.array().cast("array<string>")))) > 0), "unknown_or_locked_slot")
    )


#: Where the text of a reply stands, in the order in which it is looked for; in a stream and in a whole reply.
REPLY_PATHS = ["$.choices[0].message.content", "$.choices[0].delta.content", "$.choices[0].text"]
STREAM_PATHS = ["$.choices[0].delta.content", "$.choices[0].delta.text", "$.choices[0].message.content", "$.choices[0].text"]
_PARTS = "array<struct<text:string,content:string,value:string>>"


def content(body: Column, paths: list[str]) -> Column:
    """The first text that a reply has at one of the paths; the texts of a list of parts are joined."""

    def text(path: str) -> Column:
        found = F.get_json_object(body, path)
        parts = F.filter(F.transform(F.from_json(found, _PARTS), lambda p: F.coalesce(p["text"], p["content"], p["value"])), lambda x: x.isNotNull())
        joined = F.array_join(parts, "")
        # a text that looks like a list is told from a list by the shape of what holds it
        listed = F.startswith(found, F.lit("[")) & F.from_json(F.get_json_object(body, path.rsplit(".", 1)[0]), f"struct<{path.rsplit('.', 1)[1]}:{_PARTS}>")[path.rsplit(".", 1)[1]].isNotNull()
        return F.when(~listed, found).when(joined != "", joined)

    return F.coalesce(*(text(p) for p in paths))


def _answer(text: Column, error: Column) -> Column:
    trimmed = t.trim(text)
    why = F.coalesce(error, F.when(text.isNull(), "no_text").when(trimmed == "", "empty"))
    return F.named_struct(F.lit("text"), F.when(why.isNull(), trimmed), F.lit("error"), why)


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def reply(body: Column) -> Column:
    """Struct (text, error) of a whole reply. error: empty, not_json or no_text."""
    trimmed = t.trim(body)
    error = F.when(trimmed == "", "empty").when(~_is_json(trimmed), "not_json")
    return _answer(content(trimmed, REPLY_PATHS), error)


def is_ndjson(body: Column) -> Column:
    """Whether a body's first two lines with words are JSON objects, so that it is no event stream."""
    lines = _lines(body)
    whole = lambda x: F.startswith(x, F.lit("{")) & F.endswith(x, F.lit("}"))
    return (F.size(lines) >= 2) & F.coalesce(whole(F.get(lines, F.lit(0))) & whole(F.get(lines, F.lit(1))), F.lit(False))


def _lines(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\r?\n"), t.trim), lambda x: x != "")


def stream(body: Column) -> Column:
    """Struct (text, error) of a streamed reply: JSON lines, or the data lines of an event stream.

    error: empty, not_json, no_data (a line that is neither data nor a comment or event) or no_text.
    """
    lines = _lines(body)
    events = F.filter(lines, lambda x: ~F.startswith(x, F.lit(":")) & ~F.startswith(x, F.lit("event:")))
    stray = F.exists(events, lambda x: ~F.startswith(x, F.lit("data:"))) | (F.size(events) == 0)
    data = F.filter(F.transform(events, lambda x: t.trim(F.substr(x, F.lit(6)))), lambda x: ~x.isin("", "[DONE]"))
    merged = lambda rows: F.array_join(F.filter(F.transform(rows, lambda x: content(x, STREAM_PATHS)), lambda x: x.isNotNull()), "")
    plain = F.when(F.exists(lines, lambda x: ~F.startswith(x, F.lit("{")) | ~_is_json(x)), "not_json")
    error = F.when(F.size(lines) == 0, "empty").when(is_ndjson(body), plain).when(stray, "no_data").when(F.exists(data, lambda x: ~_is_json(x)), "not_json")
    return _answer(F.when(is_ndjson(body), merged(lines)).otherwise(merged(data)), error)


def api_error(status: Column, body: Column) -> Column:
    """status and what the service says: its error's message, else its message, else the body."""
    message = F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.message"))
    detail = F.coalesce(F.nullif(t.trim(message), F.lit("")), F.nullif(t.trim(body), F.lit("")))
    return F.concat_ws(" ", status.cast("string"), detail)


def batch_request(batch_id: Column, kind: Column, requests: Column) -> Column:
    """Struct (request, error): a batch's JSON from an array of (rewriteUnitId, displayText, slots) in order.

    error: empty_batch, or protected_unit where a unit has no editable slot.
    """
    locked = F.exists(requests, lambda u: ~F.exists(u["slots"], lambda s: s["editable"]))
    error = F.when(F.size(requests) == 0, "empty_batch").when(locked, "protected_unit")
    body = F.to_json(F.named_struct(F.lit("batchId"), batch_id, F.lit("format"), kind, F.lit("units"), requests))
    return F.named_struct(F.lit("request"), F.when(error.isNull(), body), F.lit("error"), error)
