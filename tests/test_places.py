"""Running sums and lookups by ranges, hunks and structures against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import offsets, ranges, segment


def test_running_sum_and_last_known(spark):
    """One key has half of all rows and crosses many ranges; some keys are null."""
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice([None, 1, 2, 5]), rng.choice([None, None, None, f"v{i}"])) for i in range(800)]
    df = spark.createDataFrame(rows, "k long, o long, n long, v string")
    for parts in (1, 7, 60):
        ranged = ranges.in_ranges(df, ["k"], ["o"], parts)
        sums = {(r["k"], r["o"]): r["s"] for r in ranges.running_sum(ranged, ["k"], "n", "s").collect()}
        last = {(r["k"], r["o"]): r["w"] for r in ranges.last_known(ranged, ["k"], "v", "w").collect()}
        total, seen = {}, {}
        for k, o, n, v in rows:
            assert sums[k, o] == total.get(k, 0)
            total[k] = total.get(k, 0) + (n or 0)
            seen[k] = v or seen.get(k)
            assert last[k, o] == seen[k]


def test_owners(spark):
    texts = [(1, "First one. Second, two.\n\n  \n\nThird; x. y."), (2, ""), (3, None), (4, "no marks"), (5, "ab. " * 500), (6, "\n\nA. \n\n")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spans = offsets.slot_ranges(offsets.unit_slots(docs, "sentence"))
    units = {(r["doc_id"], r["unit_id"]): r["display_text"] for r in segment.units(docs, "sentence").collect()}
    held = {}
    for r in spans.collect():
        text = dict(texts)[r["doc_id"]]
        if r["unit_id"]:
            held.setdefault((r["doc_id"], r["unit_id"]), []).append((r["start"], text[r["start"] : r["end"]]))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in held.items()} == units
    points = docs.select("doc_id", F.explode(F.sequence(F.lit(-1).cast("long"), F.coalesce(F.length("text"), F.lit(0)).cast("long"))).alias("offset"), F.lit("x").alias("tag"))
    found = offsets.owners_at(points, spans, ["unit_id"]).collect()
    assert len(found) == points.count()
    want = {(d, s + i): u for (d, u), v in held.items() for s, t in v for i in range(len(t))}
    assert {(r["doc_id"], r["offset"]): r["unit_id"] for r in found} == {(r["doc_id"], r["offset"]): want.get((r["doc_id"], r["offset"])) for r in found}
    marks = offsets.marks(docs, ".;,").collect()
    assert sorted((r["doc_id"], r["offset"], r["mark"]) for r in marks) == [(d, i, c) for d, t in texts for i, c in enumerate(t or "") if c in ".;,"]


def plain_hunks(spans, context=80, most=120):
    """One pass with a list of hunks, the open one and the text before it."""
    head = lambda s: s[: s.index("\n") + 1] if 0 <= s.find("\n") < context else s[:context]
    tail = lambda s: s.rsplit("\n", 1)[-1][-context:] if context else ""
    out, open_, before = [], None, ""
    for k, (kind, text) in enumerate(spans):
        if kind != "unchanged":
            if open_ is None:
                open_ = [("unchanged", tail(before))] if tail(before) else []
            open_.append((kind, text))
        elif open_ is None:
            before = text
        elif k == len(spans) - 1 or len(text) > 2 * context:
            out.append([*open_, *([("unchanged", head(text))] if head(text) else [])])
            open_, before = None, text[len(head(text)) :]
        else:
            open_.append((kind, text))
    return (out + ([open_] if open_ else []))[:most]


@pytest.mark.parametrize("context, most", [(80, 120), (3, 4), (0, 120)])
def test_hunks(spark, context, most):
    from foliant.operators import hunks

    rng, rows = random.Random(4), [(-1, []), (-2, [("unchanged", "only")]), (-3, None)]
    for i in range(200):
        spans = []
        for _ in range(rng.randint(1, 14)):
            kind = rng.choice([k for k in ("unchanged", "insert", "delete") if not spans or k != spans[-1][0]])
            spans.append((kind, "".join(rng.choice("ab \n\U0001f600") for _ in range(rng.choice([1, 3, 7, 100, 200])))))
        rows.append((i, spans))
    df = spark.createDataFrame(rows, "hunk long, spans array<struct<type:string,text:string>>")
    got = {}
    for r in hunks.hunks(df, context, most).orderBy("hunk", "sequence").collect():
        own = [(s["type"], s["text"]) for s in r["spans"]]
        assert r["before"] == "".join(t for k, t in own if k != "insert") and r["after"] == "".join(t for k, t in own if k != "delete")
        assert r["inserted"] == sum(len("".join(t.split())) for k, t in own if k == "insert") and r["hunk_id"] == f"hunk-{r['sequence']}"
        got.setdefault(r["hunk"], []).append(own)
    assert got == {k: plain_hunks(s, context, most) for k, s in rows if s and plain_hunks(s, context, most)}


def test_refresh(spark):
    from foliant.operators import refresh

    text = "One, two. Three!\n\nFour."
    docs = [(k, text, f"h{k}") for k in range(8)]
    now = spark.createDataFrame(docs, "doc_id long, text string, h string").drop("h").withColumns({c: F.lit("x") for c in ("template_kind", "template_signature", "structure_signature")})
    slots, units = segment.slots(now), segment.units(now, "clause")
    sessions = now.select(
        "doc_id", F.when(F.col("doc_id") == 1, "other").otherwise(F.sha2("text", 256)).alias("snapshot"), (F.col("doc_id") % 2 == 1).alias("clean"), F.lit("clause").alias("preset"),
        F.when(F.col("doc_id") == 6, None).otherwise(F.lit(False)).alias("rewrite_headings"), "template_kind", F.when(F.col("doc_id") == 7, "y").otherwise(F.col("template_signature")).alias("template_signature"), "structure_signature",
    )
    slots = slots.withColumn("separator_after", F.when((F.col("doc_id") == 2) & (F.col("slot_order") >= 1), "?").otherwise(F.col("separator_after"))).filter("doc_id <> 3 OR slot_order > 0")
    units = units.withColumn("status", F.lit("done")).unionByName(units.filter("doc_id = 4 AND unit_order = 0").withColumn("unit_order", F.lit(99)))
    suggestions = spark.createDataFrame([(k, "s") for k in (0, 2, 3)], "doc_id long, suggestion_id string")
    done = refresh.refresh(sessions, slots, units, suggestions, now.filter("doc_id <> 5"), "clause")
    assert {r["doc_id"]: (r["decision"], r["difference"]) for r in done.decisions.collect()} == {
        0: ("keep", None), 1: ("rebuild", "source"), 2: ("block", "slot 1: separator_after"), 3: ("rebuild", "slot 0: added"), 4: ("block", "unit 99: gone"), 5: ("missing", "document"),
        6: ("block", "rewrite_headings"), 7: ("rebuild", "template_signature"),
    }
    count = lambda df: {r[0]: r[1] for r in df.groupBy("doc_id").count().collect()}
    n_slots, n_units = count(segment.slots(now))[0], count(segment.units(now, "clause"))[0]
    assert count(done.slots) == dict.fromkeys(range(8), n_slots) and count(done.units) == dict.fromkeys(range(8), n_units) | {4: n_units + 1}
    assert {r["doc_id"] for r in done.units.filter("status = 'idle'").collect()} == {1, 3, 4, 7} and count(done.suggestions) == {0: 1, 2: 1}
    assert done.slots.filter("doc_id = 2 AND separator_after = '?'").count() == n_slots - 1
