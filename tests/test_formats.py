"""Regions and slots of Markdown and TeX, write-back, commits and replies on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import names
from foliant.operators import commit, diff, editor, markdown_regions, targets, template, tex_blocks, tex_regions, writeback
from foliant.operators.segment import joined, struct
from foliant.plans import protocol
from tests import plain_markdown

CODES = "TALSO"


def markdown(text, headings=False):
    out = []
    for kind, block in plain_markdown.blocks_of(text):
        out += markdown_regions.regions_of(block, kind, headings)
    assert "".join(x for _, x in out) == text
    return [(CODES[k], x) for k, x in out]


def tex(text, headings=False):
    out = tex_regions.regions_of(text, headings)
    assert "".join(x for _, x in out) == text
    return [(CODES[k], x) for k, x in out]


@pytest.mark.parametrize(
    "text, want",
    [
        ("1. [标题](https://example.com)\n", [("S", "1. "), ("S", "["), ("A", "标题"), ("S", "]("), ("O", "https://example.com"), ("S", ")\n")]),
        ("foo_bar_baz", [("T", "foo_bar_baz")]),
        ("***a*", [("S", "*"), ("T", "**a"), ("S", "*")]),
        ("**b _i_**", [("S", "**"), ("T", "b "), ("S", "_"), ("T", "i"), ("S", "_**")]),
        ("a * b * c **d", [("T", "a * b * c **d")]),
        ("~~x~~ ~y~", [("S", "~~"), ("T", "x"), ("S", "~~"), ("T", " ~y~")]),
        (r"\*a\* *b*", [("T", r"\*a\* "), ("S", "*"), ("T", "b"), ("S", "*")]),
        ("- [x] `a``b` $x$ $$y$$ [^n]", [("S", "- [x] "), ("O", "`a``b`"), ("T", " "), ("O", "$x$"), ("T", " "), ("O", "$$y$$"), ("T", " "), ("O", "[^n]")]),
        ("see http://a.b/c, <b>x</b>", [("T", "see "), ("O", "http://a.b/c"), ("T", ", "), ("S", "<b>"), ("T", "x"), ("S", "</b>")]),
        ("![i](u) [r][s] <http://u> <!-- c -->", [("O", "![i](u)"), ("T", " "), ("O", "[r][s]"), ("T", " "), ("O", "<http://u>"), ("T", " "), ("O", "<!-- c -->")]),
        ("# title\n", [("L", "# title\n")]),
        ("```\ncode\n```\n", [("L", "```\ncode\n```\n")]),
    ],
)
def test_markdown(text, want):
    assert markdown(text) == want


def test_headings_when_allowed():
    assert markdown("# title\n", True) == [("S", "# "), ("T", "title\n")]
    assert tex("\\section{a}", True) == [("S", "\\section{"), ("A", "a"), ("S", "}")] and tex("\\section{a}") == [("S", "\\section{"), ("L", "a"), ("S", "}")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a $x$ b", [("T", "a "), ("O", "$x$"), ("T", " b")]),
        ("a % c\nb", [("T", "a "), ("L", "% c\n"), ("T", "b")]),
        (r"\textbf{x \emph{y}} z", [("S", "\\textbf{"), ("A", "x "), ("S", "\\emph{"), ("A", "y"), ("S", "}}"), ("T", " z")]),
        (r"\href{u}{l}", [("S", "\\href{"), ("O", "u"), ("S", "}{"), ("A", "l"), ("S", "}")]),
        (r"\texttt{a} \verb|b| \path|c|", [("L", "\\texttt{a}"), ("T", " "), ("O", "\\verb|b|"), ("T", " "), ("O", "\\path|c|")]),
        ("\\begin{verbatim}\nx\n\\end{verbatim}\ny", [("O", "\\begin{verbatim}\nx\n\\end{verbatim}\n"), ("T", "y")]),
        (r"5\% and \$5 \\[2pt] x", [("T", "5"), ("L", "\\%"), ("T", " and "), ("L", "\\$"), ("T", "5 "), ("L", "\\\\[2pt]"), ("T", " x")]),
        (r"\[a\] \(b\)", [("O", "\\[a\\]"), ("T", " "), ("O", "\\(b\\)")]),
        ("\\textbf{", [("L", "\\textbf{")]),
    ],
)
def test_tex(text, want):
    assert tex(text) == want


def test_regions_are_lossless():
    rng = random.Random(3)
    bits = ["\\section{a}", "\\textbf{b \\emph{c}}", "\\href{u}{v}", "\\href{", "$", "$$", "%x", "\n", "\\(", "\\)", "\\[", "\\]", "{", "}", "[", "]", " ", "w", "\\\\", "\\verb|a|", "\\begin{math}", "\\end{math}", "\\", "é"]
    marks = ["*", "**", "_", "~~", "`", "``", "[a](b)", "[", "]", "(", ")", "!", "<b>", "<!-- c -->", "http://x.y/z,", "www.a.", "$", "$$", "\\", "\n", "- ", "> ", "1. ", "# ", "w", " ", "é", "[^n]", "|"]
    for i in range(2000):
        tex("".join(rng.choice(bits) for _ in range(rng.randint(0, 20))), i % 2 == 0)
        markdown("".join(rng.choice(marks) for _ in range(rng.randint(0, 20))), i % 2 == 0)


def test_deep_nesting_and_long_lines_end():
    tex("\\textbf{" * 3000 + "x" + "}" * 3000)
    markdown("*a " * 1000 + "b* " * 1000)
    assert "".join(x for _, x in tex_blocks.blocks_of("\\begin{verbatim}\n" + "x\n" * 5000)) == "\\begin{verbatim}\n" + "x\n" * 5000


def test_slots_of_all_formats(spark):
    rows = [
        (1, "[第一句，第二句](https://example.com)\n", "markdown"), (2, "\\href{https://e.org}{第一句，第二句}", "tex"), (3, "One! Two!\n\nThree", "plainText"),
        (4, "- a, b.\n\n  c\n", "markdown"), (5, None, "markdown"), (6, "", "tex"), (7, "   \n\n x", "markdown"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, format string")
    got = {r["doc_id"]: r for r in template.slot_arrays(docs).withColumn("text", joined(F.col("slots"))).collect()}
    for i, text, _ in rows:
        assert (got[i]["text"] or "") == (text or "") or i == 5
    words = lambda i: [s["text"] for s in got[i]["slots"] if s["editable"]]
    assert words(1) == ["第一句，第二句"] == words(2) and words(3) == ["One!", "Two!", "Three"] and words(4) == ["a,", "b.", "  c"]
    assert [s["slot_order"] for s in got[4]["slots"]] == list(range(len(got[4]["slots"])))
    regions = template.regions(docs.filter("format <> 'plainText'")).filter("doc_id = 1").orderBy("region_order").collect()
    assert [(r["anchor"], r["role"], r["split_mode"]) for r in regions][:2] == [("md:b0:r0", "syntaxToken", "atomic"), ("md:b0:r1", "editableText", "atomic")]


def test_round_trip_of_edits(spark):
    """After a mark before the first editable slot and writing back, the structure is what it was."""
    rows = [(1, "# T\n\nSome *text* here.\n- item [l](u)\n", "markdown"), (2, "\\section{T}\nText, $x$ more.\n", "tex")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, format string")
    slots = template.slot_arrays(docs)
    first = F.get(F.filter("slots", lambda s: s["editable"]), F.lit(0))["slot_order"]
    edited = slots.withColumn("slots", F.transform("slots", lambda s: s.withField("text", F.when(s["slot_order"] == first, F.concat(F.lit("改"), s["text"])).otherwise(s["text"]))))
    again = template.slot_arrays(edited.select("doc_id", joined(F.col("slots")).alias("text")).join(docs.select("doc_id", "format"), "doc_id"))
    sign = lambda df: {r[0]: r[1] for r in df.select("doc_id", writeback.slots_signature(F.col("slots"))).collect()}
    assert sign(slots) == sign(again)


def test_commit_is_all_or_nothing(spark):
    slot = lambda i, text, editable=True: (i, f"s{i}", text, "\n", editable, "editableText")
    slots = [slot(0, "one"), slot(1, "two"), slot(2, "kept", False)]
    units = [("u0", 0, "running", True, ["s0"]), ("u1", 1, "idle", True, ["s1"]), ("u2", 2, "done", False, ["s2"]), ("u3", 3, "running", True, ["s1"])]
    good = '{"batchId":"b","results":[{"rewriteUnitId":"u0","updates":[{"slotId":"s0","text":"ONE  \\r\\n"}]},{"rewriteUnitId":"u1","updates":[{"slotId":"s1","text":"TWO"}]}]}'
    twice = good.replace('"s1"', '"s0"')
    rows = [(1, "b", ["u0", "u1"], slots, units, good, 7), (2, "b", ["u0", "u1"], slots, units, twice, 7), (3, "b", ["u9"], slots, units, good, 7), (4, "b", ["u2"], slots, units, '{"batchId":"b","results":[{"rewriteUnitId":"u2","updates":[]}]}', 7)]
    kind = "doc_id long, batch_id string, unit_ids array<string>, slots array<struct<slot_order:int,slot_id:string,text:string,separator_after:string,editable:boolean,role:string>>, units array<struct<unit_id:string,unit_order:int,status:string,editable:boolean,slot_ids:array<string>>>, response string, next_sequence long"
    for auto in (False, True):
        got = {r["doc_id"]: r for r in commit.committed(spark.createDataFrame(rows, kind), auto).collect()}
        assert [got[i]["problem"] for i in (1, 2, 3, 4)] == [None, "repeated_in_batch", "unknown_unit", "protected_unit"]
        s = got[1]["suggestions"]
        assert [(x["sequence"], x["unit_id"], x["before_text"], x["after_text"], x["decision"]) for x in s] == [(7, "u0", "one\n", "ONE\n\n", "applied" if auto else "proposed"), (8, "u1", "two\n", "TWO\n", "applied" if auto else "proposed")]
        assert [u["status"] for u in got[1]["units"]] == ["done", "done", "done", "running"] and got[1]["next_sequence"] == 9
        assert got[2]["suggestions"] is None and [u["status"] for u in got[2]["units"]] == ["failed", "failed", "done", "idle"] and got[2]["next_sequence"] == 7
        assert [u["status"] for u in got[3]["units"]] == [u[2] for u in units]


def test_replies(spark):
    bodies = [
        '{"choices":[{"message":{"content":" hi "}}]}', '{"choices":[{"message":{"content":[{"text":"a"},{"value":"b"}]}}]}', '{"choices":[{"text":"t"}]}', "", "no", '{"choices":[]}',
        '{"choices":[{"message":{"content":"[1] see"}}]}',
    ]
    found = spark.createDataFrame([(b,) for b in bodies], "body string").select(protocol.reply(F.col("body")).alias("r")).collect()
    assert [tuple(r["r"]) for r in found] == [("hi", None), ("ab", None), ("t", None), (None, "empty"), (None, "not_json"), (None, "no_text"), ("[1] see", None)]
    streams = ['data: {"choices":[{"delta":{"content":"a"}}]}\n\n: c\ndata: {"choices":[{"delta":{"text":"b"}}]}\ndata: [DONE]', '{"choices":[{"delta":{"content":"x"}}]}\n{"choices":[{"delta":{"content":"y"}}]}', "oops", "data: {", " "]
    found = spark.createDataFrame([(b,) for b in streams], "body string").select(protocol.stream(F.col("body")).alias("r")).collect()
    assert [tuple(r["r"]) for r in found] == [("ab", None), ("xy", None), (None, "no_data"), (None, "not_json"), (None, "empty")]
    errors = spark.createDataFrame([(401, '{"error":{"message":" bad key "}}'), (500, "down"), (502, ""), (400, '{"message":"m"}')], "status int, body string")
    assert [r[0] for r in errors.select(protocol.api_error(F.col("status"), F.col("body"))).collect()] == ["401 bad key", "500 down", "502", "400 m"]


def test_inserts_between_units():
    assert editor.dealt(["a\n", "b"], [("unchanged", "a\n"), ("insert", "\n x"), ("unchanged", "b")]) == ["a\n\n ", "xb"]
    assert editor.dealt(["a", "b"], [("unchanged", "a"), ("delete", "b"), ("insert", "c")]) == ["a", "c"]
    assert editor.dealt(["a", ""], [("delete", "a"), ("insert", "z")]) == ["", "z"]


def test_bounds_of_edits_never_exceed_the_edits():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        edits, _ = diff.shortest(a, b)
        assert diff._least_edits(*diff._numbered(a, b)) <= sum(k != diff.EQUAL for k, *_ in edits)


def test_names(spark):
    one = spark.range(1)
    col = lambda c: one.select(c).first()[0]
    assert [col(names.byte_size(F.lit(n))) for n in (0, 1023, 1024, 10752, 104857600)] == ["0 B", "1023 B", "1.00 KB", "10.5 KB", "100 MB"]
    assert col(names.short_hash(F.lit("😀a"))) == format(abs(((0xD83D * 31 + 0xDE00) * 31 + 97 + 2**31) % 2**32 - 2**31), "x") and col(names.short_hash(F.lit(""))) == "0"
    import uuid

    space = uuid.UUID(bytes=bytes(range(16)))
    assert [col(names.session_id(F.lit(p), space.bytes)) for p in ("/a/b.md", "é")] == [str(uuid.uuid5(space, p)) for p in ("/a/b.md", "é")]
    assert [col(names.session_title(F.lit(p))) for p in ("/a/b.c.md", ".x", "/a/", "")] == ["b.c", ".x", "a", names.UNTITLED]
    assert col(names.display_path(F.lit("\\\\?\\UNC\\s\\x"))) == "\\\\s\\x" and col(names.file_name(F.lit(' a:b"c '))) == "a_b_c" and col(names.file_name(F.lit(" "))) == "result"
    assert col(names.targets_label(F.array(F.lit("a"), F.lit("b")))) == "[a,b]" and col(names.state_label(F.lit("idle"))) == "待机"


def test_settings_and_in_place_writes(spark, tmp_path):
    rows = spark.createDataFrame([(999, 1.0, 1, 1), (1000, 2.1, 1, 1), (1000, 2.0, 9, 1), (1000, 0.0, 8, 0), (1000, 0.0, 8, 1)], "a int, b double, c int, d int")
    assert [r[0] for r in rows.select(targets.settings_error(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == ["timeout", "temperature", "concurrency", "units_per_batch", None]
    (tmp_path / "x.txt").write_text("old")
    done = writeback.write_in_place(spark.createDataFrame([(f"{tmp_path}/x.txt", "new"), (f"{tmp_path}/no/y.txt", "z"), (f"{tmp_path}/x2.txt", None)], "path string, text string")).collect()
    assert (tmp_path / "x.txt").read_text() == "new" and {r["error"] for r in done} == {None, "FileNotFoundError"} and len(done) == 2


def test_sessions_round_trip(spark, tmp_path):
    from foliant.sources import sessions

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":"a","sourceText":"t","writeBackSupported":false,"suggestions":[{"id":"x","diffSpans":[{"type":"insert","text":"n"}]}]}')
    (tmp_path / "in" / "b.json").write_text("{oops")
    loaded = sessions.load(spark, f"{tmp_path}/in")
    rows = {r["id"]: r for r in loaded.collect()}
    assert rows["a"]["source_gate"]["allowed"] is False and rows["a"]["source_gate"]["reason"] == "no_reason" and rows["a"]["suggestions"][0]["diff"]["spans"][0]["text"] == "n"
    assert rows[None]["error"] == "not_a_session"
    sessions.save(loaded.filter("error IS NULL"), f"{tmp_path}/out")
    back = sessions.load(spark, f"{tmp_path}/out").first()
    assert back["id"] == "a" and back["source_gate"] == rows["a"]["source_gate"]
    assert sessions.without(loaded, spark.createDataFrame([("a",)], "id string")).filter("id IS NOT NULL").count() == 0
    opened = sessions.open_sessions(
        spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.array(struct(slot_id=F.lit("s0"))).alias("slots")), spark.createDataFrame([(1, "/a/b.md", " ")], "doc_id long, path string, text string"), bytes(16)
    ).first()
    assert opened["title"] == "b" and opened["error"] == "empty_document" and opened["nextSuggestionSequence"] == 1
