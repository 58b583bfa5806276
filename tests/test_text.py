import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.functions import validate
from foliant.operators import diff
from foliant.sources import documents


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, text, want",
    [
        (t.normalize, " 第一段 \r\n\r\n\r\n 第二段\t\r\n", "第一段\n\n第二段"),
        (t.line_ending, "a\r\nb\r\nc\n", "crlf"),
        (t.line_ending, "a\rb", "cr"),
        (t.line_ending, "a\r\nb\n", "crlf"),
        (t.line_ending, "", "none"),
        (t.strip_line_tails, "甲  \r\n乙\t\t\n丙", "甲\r\n乙\n丙"),
        (t.collapse_lines, "a\n \nb", "a  b"),
        (t.collapse_lines, " a ", " a "),
        (t.line_prefix, "  - x  ", "  - "),
        (t.line_prefix, "12．  x", "12．  "),
        (t.line_prefix, "(abcdefghijkl) x", ""),
        (t.line_core, "> 你好  ", "你好"),
        (t.trim, "　\xa0a ", "a"),
        (t.count_characters, "a b　c", 3),
    ],
)
def test_functions(spark, function, text, want):
    assert one(spark, function(F.col("x")), x=text) == want


@pytest.mark.parametrize(
    "source, candidate, want",
    [
        ("正文", " \n", "empty"), ("正文", "```x", "fence"), ("你好，世界", "您好，世界", None), ("正文", "你好！正文", "greeting"),
        ("- 正文", "- 你好！正文", "greeting"), ("1. 正文", "1. 当然可以，正文", "preface"), ("正文", "改写后：正文", "label"), ("正文", "下面是改写后的版本：正文", "lead"),
        ("body", "I AM Claude", "meta"), ("正文", "作为一个AI助手", None), ("汉" * 20, "latin words only in this text", "script"), ("body", "hello. body", "greeting"), ("body", "hellos body", None),
    ],
)
def test_problems(spark, source, candidate, want):
    assert one(spark, validate.rewrite_problem(F.col("s"), F.col("c")), s=source, c=candidate) == want


@pytest.mark.parametrize(
    "source, candidate, text, problem",
    [
        ("- a b  ", "- new\nwords", "- new words  ", None), ("# a\n\n- b", "x\n\ny", "# x\n\n- y", None), ("a\nb", "x", None, "lines"),
        ("a\n\nb", "@@@1@@@x\n@@@3@@@z\n@@@2@@@", "x\n\nz", None), ("a\nb", "@@@1@@@x\n@@@2@@@ ", None, "blanks"), ("a\nb", "@@@1@@@x\n@@@1@@@y", None, "lines"), (" \n ", "x", " \n ", "empty"),
    ],
)
def test_finalize(spark, source, candidate, text, problem):
    got = one(spark, validate.finalize(F.col("s"), F.col("c")), s=source, c=candidate)
    assert (got["text"], got["problem"]) == (None if problem else text, problem)


@pytest.mark.parametrize(
    "content, text, error",
    [
        (b"\xef\xbb\xbfa", "a", None), (b"\xff\xfe" + "aé😀".encode("utf-16-le"), "aé😀", None), (b"\xfe\xff" + "b".encode("utf-16-be"), "b", None),
        (b"\xff\xfea", None, "invalid_encoding"), (b"\xff\xfe\x00\xd8a\x00", None, "invalid_encoding"), (b"\xfe\xff\xdc\x00", None, "invalid_encoding"), (b"\xc3(", None, "invalid_encoding"), (b"", "", None),
    ],
)
def test_decode(spark, content, text, error):
    got = one(spark, documents.decoded(F.col("x")), x=content)
    assert (got["text"], got["error"]) == (text, error)


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# x")
    (tmp_path / "b.doc").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"\xff")
    rows = {r["path"].rsplit("/")[-1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert (rows["a.md"]["text"], rows["a.md"]["format"]) == ("# x", "markdown")
    assert (rows["b.doc"]["error"], rows["c.txt"]["error"]) == ("legacy_word", "invalid_encoding")


def test_diffs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 12)))
    rows = [(i, word(), word()) for i in range(300)] + [(999, "same", "same"), (1000, None, "x")]
    df = spark.createDataFrame(rows, "id int, before string, after string")
    found = diff.with_diffs(df).collect()
    assert len(found) == len(rows)
    side = lambda r, skip: "".join(s["text"] for s in r["spans"] if s["type"] != skip)
    assert all(side(r, "delete") == (r["after"] or "") and side(r, "insert") == (r["before"] or "") for r in found)
    affix = df.na.fill("").select("before", "after", diff.affix_spans(F.col("before"), F.col("after")).alias("spans")).collect()
    for r in affix:
        plain = diff.by_affixes(r["before"], r["after"])
        assert [(s["type"], s["text"]) for s in r["spans"]] == [(k, (r["after"] if k == "insert" else r["before"])[i:j]) for k, i, j in plain]
    assert diff.shortest("abc" * 50, "xyz" * 50, budget=100)[1] == "trace_budget_exceeded"
    assert diff.shortest("abc" * 50, "xyz" * 50, budget=30_000)[1] == "trace_growth_budget_exceeded"
    assert diff.shortest("ab", "ba")[0] == [("delete", 0, 1), ("unchanged", 1, 2), ("insert", 1, 2)]
