"""Lines of a megabyte through every expression over texts: no regular expression may recurse, or go over a line again and again."""

import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import boundaries, markdown, names, validate
from foliant.functions import text as t
from foliant.operators import segment

N = 1_000_000
LONG = {
    "letters": "a" * N, "rule": "* " * (N // 2), "broken rule": "* " * (N // 2) + "x", "dashes": "-" * N, "bracket": "[" + "a" * N, "brackets": "[a] " * (N // 4), "definition": "[" + "a" * N + "]: x",
    "backticks": "`" * N, "blanks": " " * N, "tabs": "\t" * N + "x", "blanks inside": "a" + " " * N + "b", "digits": "1" * N, "points": "1." * (N // 2), "parens": "(" * N, "quotes": ">" * N,
    "table": "|-" * (N // 2), "equals": "=" * N, "chinese": "汉" * N, "line ends": "\n" * N, "carriage returns": "\r" * N, "both": "\r\n" * (N // 2), "loose ends": " \n" * (N // 2), "stops": ". " * (N // 2),
    "commas": "a," * (N // 2), "closers": ")" * N, "hashes": "#" * N, "marker": "@@@1@@@" * (N // 7), "path": "a/" * (N // 2), "emoji": "\U0001f600" * (N // 2), "tag": "<" * N,
}
OF_ONE = [
    *(getattr(markdown, n) for n in dir(markdown) if n.startswith("is_")), markdown.fence_marker, markdown.line_kind,
    boundaries.has_paragraph_break, boundaries.paragraphs, boundaries.separator_of, boundaries.clauses, boundaries.ends_at_boundary,
    t.trim, t.ltrim, t.rtrim, t.trim_blanks, t.is_blank, t.to_lf, t.line_ending, t.normalize, t.strip_line_tails, t.has_line_tails, t.collapse_lines, t.line_prefix, t.line_suffix, t.line_core,
    t.count_characters, t.preview, t.split_lines, lambda c: t.mostly(c, "cjk"), lambda c: t.mostly(c, "latin"),
    validate.opening, validate.meta_phrase, lambda c: validate.numbered_lines(c, F.lit(2)), names.file_name, names.display_path, names.session_title, names.document_kind, names.is_long,
]
OF_TWO = [t.without_prefix, t.with_line_skeleton, t.match_layout, validate.rewrite_problem, validate.finalize]


@pytest.fixture(scope="module")
def long(spark):
    df = spark.createDataFrame(list(LONG.items()), "name string, x string").repartition(8).cache()
    df.count()
    yield df
    df.unpersist()


@pytest.mark.parametrize("make", OF_ONE + OF_TWO, ids=lambda f: getattr(f, "__name__", "f"))
def test_expression(long, make):
    began = time.perf_counter()
    made = make(F.col("x")) if make in OF_ONE else make(F.col("x"), F.reverse("x"))
    rows = long.select("name", F.hash(F.to_json(F.struct(made.alias("v")))).alias("h")).collect()
    assert len(rows) == len(LONG) and time.perf_counter() - began < 60


def test_rules(spark):
    rows = spark.createDataFrame([("* * *",), ("***",), (" - - -- ",), ("_ _",), ("* - *",), ("***x",), ("　*　*　*　",)], "x string")
    assert [r[0] for r in rows.select(markdown.is_rule(F.col("x"))).collect()] == [True, True, True, False, False, False, True]


def test_units_are_linear(spark):
    docs = spark.createDataFrame([(1, "ab, cd. e, " * 33_333), (2, "."), (3, "a" * N), (4, "。" * 100_000)], "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    units = segment.units(docs, "clause").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("display_text")).alias("chars")).collect()
    assert time.perf_counter() - began < 60
    assert {r["doc_id"]: (r["n"], r["chars"]) for r in units} == {1: (33_333, 366_663), 2: (1, 1), 3: (1, N), 4: (25_000, 100_000)}
