"""Finalizing that is cut off, previews, page chunks and regions."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import finalize

ROWS = "doc_id long, path string, text string, error string"


def test_finalize_resumes(spark, tmp_path):
    """Cut off before, in and after the write: run again, it ends in one state, judged by the sources as they first were."""
    for n in (1, 2, 3):
        (tmp_path / f"{n}.txt").write_text("old")
    rows = [(1, f"{tmp_path}/1.txt", "new 1", None), (2, f"{tmp_path}/2.txt", "new 2", None), (3, f"{tmp_path}/3.txt", None, "source_changed"), (4, f"{tmp_path}/no/4.txt", "new 4", None), (5, f"{tmp_path}/5.txt", "a", None), (6, f"{tmp_path}/5.txt", "b", None)]
    plan, sessions = spark.createDataFrame(rows, ROWS), spark.range(1, 8).withColumnRenamed("id", "doc_id")
    journal, calls = str(tmp_path / "journal"), []
    state = lambda: {r["doc_id"]: (r["state"], r["error"]) for r in finalize.states(spark, journal).collect()}
    assert state() == {}

    def cut_off(texts):
        calls.append("cut")
        finalize.writeback.write_in_place(texts.filter("doc_id = 1")).collect()
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        finalize.finalize(plan, sessions, journal, cut_off)
    refused = {3: ("refused", "source_changed"), 5: ("refused", "shared_path"), 6: ("refused", "shared_path")}
    assert state() == refused | {k: ("planned", None) for k in (1, 2, 4)}
    assert (tmp_path / "1.txt").read_text() == "new 1" and (tmp_path / "2.txt").read_text() == "old"
    # by now the gates would refuse the first document, as its source has changed: the plan is not judged again
    judged_anew = plan.withColumn("error", F.lit("source_changed"))

    def write(texts):
        calls.append("write")
        return finalize.writeback.write_in_place(texts)

    class CutSessions:
        def join(self, *_):
            raise RuntimeError("lost again")

    with pytest.raises(RuntimeError):
        finalize.finalize(judged_anew, CutSessions(), journal, write)
    assert state() == refused | {1: ("written", None), 2: ("written", None), 4: ("failed", "FileNotFoundError")}
    left = finalize.finalize(judged_anew, sessions, journal, write)
    assert sorted(r[0] for r in left.collect()) == [3, 4, 5, 6, 7]
    assert state() == refused | {1: ("finalized", None), 2: ("finalized", None), 4: ("failed", "FileNotFoundError")}
    assert calls == ["cut", "write"] and [(tmp_path / f"{n}.txt").read_text() for n in (1, 2, 3)] == ["new 1", "new 2", "old"]
    finalize.finalize(plan, sessions, journal, write)
    assert calls == ["cut", "write"]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", "a", None), (2, "p", None, "locked_slot"), (3, "p", None, None)], ROWS)
    told = finalize.export(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, told.collect())) == [(1, True, None), (2, False, "locked_slot"), (3, False, "missing_text")]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "a")]


def test_preview_is_all_or_nothing(spark):
    import json

    from foliant.operators import preview, writeback
    from foliant.operators.segment import slot_array, unit_array

    text = "Ones! Two is here! Three is here!"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string").select("*", slot_array(F.col("text")).alias("slots")).withColumn("units", unit_array(F.col("slots"), "clause"))
    update = lambda k, x, slot=None: {"rewriteUnitId": f"unit-{k}", "updates": [{"slotId": slot or f"txt:p0:r0:s{k}", "text": x}]}
    kind = "array<struct<sequence:long,unit_id:string,decision:string,slot_updates:array<struct<slot_id:string,text:string>>>>"

    def run(answers, log=(), snapshot=None):
        rows = d.select(
            "doc_id", "slots", "units", F.lit("b").alias("batch_id"), F.array(*(F.lit(a["rewriteUnitId"]) for a in answers)).alias("unit_ids"), F.lit(json.dumps({"batchId": "b", "results": answers})).alias("response"),
            F.from_json(F.lit(json.dumps([{"sequence": s, "unit_id": f"unit-{k}", "decision": x, "slot_updates": [{"slot_id": slot, "text": y}]} for s, k, x, slot, y in log])), kind).alias("suggestions"),
            F.col("text").alias("source_text"), F.sha2("text", 256).alias("found_snapshot"), (F.lit(snapshot) if snapshot else F.sha2("text", 256)).alias("snapshot"), F.lit("t").alias("template_signature"), F.lit("t").alias("found_template"),
            writeback.slots_signature(F.col("slots")).alias("structure_signature"), F.array(F.lit("txt:p0:r0")).alias("anchors"),
        )
        r = preview.previewed(rows).first()
        assert [s["text"] for s in r["slots"]] == ["Ones!", "Two is here!", "Three is here!"]
        return r["problem"], r["text"], r["changed"]

    s = [f"txt:p0:r0:s{k}" for k in range(3)]
    log = [(1, 0, "applied", s[0], "Old."), (2, 0, "applied", s[0], "Uno!"), (3, 1, "dismissed", s[1], "No."), (4, 2, "applied", s[2], "No.")]
    assert run([update(2, "Drei!")], log) == (None, "Uno! Two is here! Drei!", [s[0], s[2]])
    assert run([update(2, "Three is here!")]) == (None, text, [])
    assert run([update(1, "Zwei."), update(2, "Drei!", s[1])])[0] is not None
    assert run([update(1, "Zwei."), update(9, "x", s[2])])[:2] == ("unknown_unit", None)
    assert run([update(1, "Zwei.")], [(1, 0, "applied", "gone", "x")])[:2] == ("unknown_slot", None)
    assert run([update(1, "Zwei.")], snapshot="other")[:2] == ("source_changed", None)


def plain_entries(chunks):
    """One pass over each page with a pending separator."""
    out = []
    pages = sorted({p for p, *_ in chunks})
    for page in pages:
        seen, locked, pending = [], [], ""
        for _, _, raw in sorted((c for c in chunks if c[0] == page), key=lambda c: c[1]):
            if raw is None:
                locked.append([f"pdf:p{page}:o{len(seen) + len(locked)}:r0", "[对象]", "\n"])
                continue
            text = "\n".join(x.rstrip(" \t") for x in raw.replace("\r\n", "\n").replace("\r", "\n").strip("﻿").split("\n"))
            body = text.rstrip()
            if not body:
                pending += text
                continue
            seen.append([f"pdf:p{page}:b{len(seen)}:r0", body, pending + text[len(body) :]])
            pending = ""
        if seen:
            seen[-1][2] += pending
        elif locked:
            locked[-1][2] += pending
        if page < pages[-1] and (seen or locked):
            (locked or seen)[-1][2] += "\n\n"
        out += [(page, k, *x) for k, x in enumerate(seen + locked)]
    return out


def test_page_entries(spark):
    import random

    from foliant.operators import page_chunks, regroup, template

    rng, docs = random.Random(6), {}
    for d in range(60):
        docs[d] = [(p, k, rng.choice([None, "\n", " \r\n", "", "a b. c", "x \n", "﻿y\n\n", "same", "same", "p\n\nq\n\n", "p\n\nq  \r\n\r\n"])) for p in range(rng.randint(1, 3)) for k in range(rng.randint(1, 5))]
    rows = [(d, *c) for d, cs in docs.items() for c in cs]
    chunks = spark.createDataFrame(rows, "doc_id long, page int, place int, raw string")
    made = page_chunks.entries(chunks)
    got = {}
    for r in made.orderBy("doc_id", "page", "entry").collect():
        got.setdefault(r["doc_id"], []).append((r["page"], r["entry"], r["anchor"], r["text"], r["separator_after"]))
    assert got == {d: plain_entries(c) for d, c in docs.items() if plain_entries(c)}
    reasons = {r["doc_id"]: r["reason"] for r in page_chunks.block_reasons(made).collect()}
    for d, es in got.items():
        raws = [(p, x) for p, _, x in docs[d] if x and x.strip("﻿ \r\n")]
        assert reasons[d] == ("duplicate_chunk" if len(raws) > len(set(raws)) else None if raws else "no_chunk")
    # slots of the regions, and back: every chunk is replaced by what it is
    done = page_chunks.templates(made).select("doc_id", "text", template.region_slots(F.col("regions")).alias("slots"), "regions")
    for r in done.select("doc_id", "text", regroup.regions_of(F.col("slots")).alias("back")).collect():
        assert "".join(x["text"] for x in r["back"]) == r["text"] == "".join(e[3] + e[4] for e in got[r["doc_id"]])
    slots = done.select("doc_id", F.inline("slots"))
    back = page_chunks.replacements(made, slots).collect()
    assert all(r["error"] is None for r in back) and len(back) == made.filter("kind = 'chunk'").count()
    lost = page_chunks.replacements(made, slots.filter("slot_id NOT LIKE '%b0:r0:s%'")).filter("error = 'missing_region'").count()
    assert lost == sum(e[2].endswith("b0:r0") for es in got.values() for e in es)
    texts = spark.createDataFrame([(1, "a. b\n\n \n\nc \n"), (2, ""), (3, "\n\n")], "doc_id long, text string")
    fall = {r["doc_id"]: [(x["anchor"], x["text"], x["separator_after"]) for x in r["f"]] for r in texts.select("doc_id", page_chunks.fallback_regions(F.col("text")).alias("f")).collect()}
    assert fall == {1: [("pdf:fallback:p0:r0", "a. b", "\n\n \n\n"), ("pdf:fallback:p1:r0", "c", " \n")], 2: [], 3: [("pdf:fallback:p0:r0", "", "\n\n")]}


def test_regions_again(spark):
    from foliant.operators import regroup

    kind = "slots array<struct<slot_id:string,text:string,separator_after:string,editable:boolean,role:string>>"
    slots = [("a:s0", "1", " ", False, "syntaxToken"), ("a:s1", "2", "", True, "editableText"), ("b:s0", "3", "\n", False, "inlineObject"), ("a:s2", "4", "", False, "paragraphBreak"), ("odd", "5", "", False, "syntaxToken"), ("odd", "6", "", False, "lockedText")]
    df = spark.createDataFrame([(1, slots), (2, []), (3, None)], f"doc_id long, {kind}")
    assert [tuple(r) for r in regroup.regions(df).orderBy("region_order").collect()] == [
        (1, 0, "a", "1 2", True, "editableText", 2), (1, 1, "b", "3\n", False, "inlineObject", 1), (1, 2, "a", "4", False, "lockedText", 1), (1, 3, "odd", "56", False, "syntaxToken", 2),
    ]
