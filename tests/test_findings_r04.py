"""Queries over texts that the supplied tables lack: empty ones, blank lines at the start, first lines that repeat."""

import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant import place_queries, queries, session_queries  # noqa: F401
from foliant.operators import diff, editor, markdown_regions, offsets, refresh, segment, tex_regions
from foliant.operators.regions import LOCKED, OBJECT, SYNTAX, TEXT
from foliant.plans import protocol
from foliant.streaming import suggestions
from tests.oracle import TABLES, check
from tests.test_queries import SF

ODD = [
    "", None, "\n", "\n\n", "\n\n\nx", " \n \n", "a\na\nb", "same.\nsame.\nsame.\nother", "a\n<<new>>a\nb", "<<new>>\n<<new>>\n<<new>>", "a.\n\nb.\n",
    "x" * 4100, "x" * 4100 + "\n" + "x" * 4100 + "\nb", "foo\n\n\nbar\n",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    rows = [(i, x, "en", "s", len(x or "")) for i, x in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["paragraphs", "unit_hunks", "slot_hunks"])
def test_odd_texts(spark, odd, name):
    check(spark, odd, queries.QUERIES[name], queries.ORACLES[name])


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    """A text of 2,000 lines, in lengths that make two in three units editable or not, at a doc_id whose batch is good."""
    path = tmp_path_factory.mktemp("long")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    rows = [(i, "\n".join("word " * (k % 7) + str(k) for k in range(2000)), "en", "s", 0) for i in (0, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["committed_suggestions", "batch_outcomes"])
def test_batches_of_long_sessions(spark, long, name):
    began = time.perf_counter()
    check(spark, long, queries.QUERIES[name], queries.ORACLES[name])
    assert time.perf_counter() - began < 40


def test_edits_by_bits_are_those_by_rounds():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert diff._by_bits(a, b, 4, diff.TRACE_BYTES) == diff._by_rounds(a, b, 4, diff.TRACE_BYTES)


def test_diffs_of_texts_without_common_parts_are_quick():
    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdefghij ") for _ in range(3000)) for _ in range(21)]
    began = time.perf_counter()
    for a, b in zip(lines, lines[1:], strict=False):
        diff.diff_texts(a, b)
    assert time.perf_counter() - began < 5  # half a minute by rounds


def test_of_lines_alike_the_edited_one_changes():
    assert editor.dealt(["a\n", "a\n", "b"], editor._edit("a\na\nb", "Xa\na\nb")) == ["Xa\n", "a\n", "b"]
    assert editor.dealt(["a\n", "a\n", "b"], editor._edit("a\na\nb", "a\na\nXb")) == ["a\n", "a\n", "Xb"]


def test_scans_of_long_lines_are_quick():
    words = "\\textbf{" + "word and word " * 30_000 + "} $x$ \\cite{en} " + "more words " * 30_000
    began = time.perf_counter()
    assert [r for r, _ in tex_regions.regions_of(words)] == [SYNTAX, TEXT + 1, SYNTAX, TEXT, OBJECT, TEXT, LOCKED, TEXT]
    assert time.perf_counter() - began < 2  # 13 s where the whole expression is tried at every character
    began = time.perf_counter()
    found = markdown_regions.regions_of("- **" + "word and word " * 60_000 + "x** [en](http://e.org/3) " + "more words " * 60_000, "list_item")
    assert [r for r, _ in found] == [SYNTAX, TEXT, SYNTAX, TEXT, SYNTAX, TEXT + 1, SYNTAX, OBJECT, SYNTAX, TEXT]
    assert time.perf_counter() - began < 2


def test_marks_before_a_long_end_without_any(spark):
    docs = spark.createDataFrame([(1, "One. Two, " + "word " * 80_000), (2, "none " * 80_000), (3, ""), (4, None)], "doc_id long, text string")
    offsets.marks(docs.filter("doc_id = 3"), "。.,").collect()
    began = time.perf_counter()
    assert sorted(map(tuple, offsets.marks(docs, "。.,").collect())) == [(1, 3, "."), (1, 8, ",")]
    assert time.perf_counter() - began < 40  # minutes where the end is tried from each of its characters


def test_slots_between_units_have_none(spark):
    text = "One. \n\n \n\n. \n\nTwo words, three. \n\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted(map(tuple, offsets.unit_slots(docs, "paragraph").collect()))
    own = {(x, u["unit_id"]) for u in segment.units(docs, "paragraph").collect() for x in u["slot_ids"]}
    slots = segment.slots(docs).orderBy("slot_order").collect()
    owner = dict(own)
    assert [(r[1], r[2], r[3]) for r in rows] == [(s["slot_order"], len(s["text"] + s["separator_after"]), owner.get(s["slot_id"])) for s in slots]


def test_requests_are_made_in_the_row(spark, odd):
    made = queries.QUERIES["unit_requests"](spark, odd)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*ODD, "One. \n\n \n\n. \n\nTwo words, three. \n\n"])], "doc_id long, text string")
    for preset in segment.PRESETS:
        rows = docs.select("doc_id", protocol.requests(segment.slot_array(F.col("text")), preset).alias("r")).select("doc_id", F.inline("r")).collect()
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, protocol.unit_requests(segment.units(docs, preset), segment.slots(docs)).collect()), key=repr)


def test_refresh_shuffles_and_stores_no_texts_twice(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    known = set(os.listdir(folder))
    queries.QUERIES["refreshed_sessions"](spark, SF)
    (state,) = (x for x in set(os.listdir(folder)) - known if x.startswith("refresh-"))
    assert "units" not in spark.read.parquet(f"{folder}/{state}").columns  # they are made of the slots
    rows = spark.createDataFrame([(1, 0, "a long text"), (1, 1, None), (2, 0, "same")], "doc_id long, slot_order int, text string")
    other = spark.createDataFrame([(1, 0, "a long text"), (1, 1, ""), (2, 0, "same")], "doc_id long, slot_order int, text string")
    found = refresh.first_differences(rows, other, "slot_order", ["text"], "slot")
    assert "xxhash64" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 1, "slot 1: text")]


def test_a_batch_asks_the_store_once_for_each_suggestion():
    class Store(dict):
        calls = 0

        def __getattr__(self, name):
            def call(*args):
                Store.calls += 1
                if name == "exists":
                    return bool(self)
                if name in ("update", "updateValue"):
                    self[args[0] if len(args) > 1 else 0] = args[-1]
                return {"containsKey": args[0] in self, "getValue": self.get(args[0])}[name] if args and name in ("containsKey", "getValue") else self.get(0)

            return call

    class Value(Store):
        def get(self):
            Store.calls += 1
            return self[0]

        def update(self, value):
            Store.calls += 1
            self[0] = value

    unit = suggestions.Decisions()
    unit.held, unit.applied, unit.last = Store(), Value(), Value()
    rows = pd.DataFrame({"suggestion_id": ["a", "b"] * 200, "at": range(400), "action": ["propose"] * 2 + ["apply"] * 398})
    (made,) = unit.handleInputRows(("u",), iter([rows]), None)
    assert unit.held == {("a",): (0, "dismissed"), ("b",): (1, "applied")} and unit.applied[0] == ("b",) and len(made) == 2 + 398 + 397
    assert Store.calls < 20
