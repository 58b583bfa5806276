"""Office documents: regions, lists, styles, placeholders, slots and writing back on small files."""

import io
import zipfile

import pytest

from foliant.operators import office as slots_of
from foliant.sources import office

NS = 'xmlns:w="w" xmlns:r="r" xmlns:m="m" xmlns:mc="mc" mc:Ignorable="w14" xmlns:w14="w14"'
LINK = '<Relationships><Relationship Id="rId9" Type="x/hyperlink" Target="https://example.org/"/><Relationship Id="rId1" Type="x/styles" Target="s"/></Relationships>'
NUMBERS = (
    f"<w:numbering {NS}><w:abstractNum w:abstractNumId='7'>"
    "<w:lvl w:ilvl='0'><w:start w:val='3'/><w:numFmt w:val='upperRoman'/><w:lvlText w:val='%1)'/><w:suff w:val='space'/><w:pStyle w:val='Bound'/></w:lvl>"
    "<w:lvl w:ilvl='1'><w:numFmt w:val='lowerLetter'/><w:lvlText w:val='%1.%2'/><w:suff w:val='tab'/></w:lvl>"
    "<w:lvl w:ilvl='2'><w:numFmt w:val='bullet'/><w:lvlText w:val='*'/></w:lvl></w:abstractNum>"
    "<w:num w:numId='1'><w:abstractNumId w:val='7'/></w:num><w:num w:numId='2'><w:abstractNumId w:val='7'/><w:lvlOverride w:ilvl='0'><w:startOverride w:val='9'/></w:lvlOverride></w:num></w:numbering>"
)
STYLES = (
    f"<w:styles {NS}><w:style w:type='paragraph' w:styleId='H'><w:pPr><w:outlineLvl w:val='1'/></w:pPr></w:style><w:style w:type='paragraph' w:styleId='Sub'><w:basedOn w:val='H'/></w:style>"
    "<w:style w:type='paragraph' w:styleId='L'><w:pPr><w:numPr><w:ilvl w:val='1'/><w:numId w:val='1'/></w:numPr></w:pPr></w:style>"
    "<w:style w:type='paragraph' w:styleId='A'><w:basedOn w:val='B'/></w:style><w:style w:type='paragraph' w:styleId='B'><w:basedOn w:val='A'/></w:style></w:styles>"
)


def file(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {NS}><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", LINK)
        z.writestr("word/numbering.xml", parts.get("numbers", NUMBERS))
        z.writestr("word/styles.xml", parts.get("styles", STYLES))
        z.writestr("word/media/x.bin", b"\x00\x01")
    return out.getvalue()


def p(inner, props=""):
    return f"<w:p>{'<w:pPr>' + props + '</w:pPr>' if props else ''}{inner}</w:p>"


def r(text, props=""):
    return f"<w:r>{'<w:rPr>' + props + '</w:rPr>' if props else ''}<w:t>{text}</w:t></w:r>"


def num(name, depth=None):
    return f"<w:numPr>{'' if depth is None else f'<w:ilvl w:val=%s/>' % repr(str(depth))}<w:numId w:val='{name}'/></w:numPr>"


def regions(body, **parts):
    return [[(x.text, x.editable) for x in b.regions] for b in office.Document(file(body, **parts)).blocks]


@pytest.mark.parametrize(
    "body, want",
    [
        (p(r("a") + r("b")), [[("ab", True)]]),
        (p(r("a") + r("b", "<w:b/>") + r("c", '<w:b w:val="0"/>')), [[("a", True), ("b", True), ("c", True)]]),
        (p("<w:bookmarkStart/>" + r("a") + "<w:proofErr/>" + r("b")), [[("ab", True)]]),
        (p("<w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:noBreakHyphen/><w:softHyphen/></w:r>"), [[("a\tb\n‑­", True)]]),
        (p("<w:r><w:t>a</w:t><w:br w:type='page'/><w:t>b</w:t></w:r>"), [[("a", True), ("[分页符]", False), ("b", True)]]),
        (p(r("see https://a.b/c. Or www.x.y, ok xhttp://no")), [[("see ", True), ("https://a.b/c", False), (". Or ", True), ("www.x.y", False), (", ok xhttp://no", True)]]),
        (p(r(" x ", "<w:u w:val='single'/>")), [[(" ", False), ("x", True), (" ", False)]]),
        (p(r("a") + "<m:oMath><m:r><m:t> x </m:t></m:r><m:r><m:t>=1</m:t></m:r></m:oMath>"), [[("a", True), ("x=1", False)]]),
        (p("<w:hyperlink r:id='rId9'>" + r("l") + "</w:hyperlink>" + r("t")), [[("l", True), ("t", True)]]),
        (p("<w:hyperlink r:id='rId9'><w:r><w:drawing><pic/></w:drawing></w:r></w:hyperlink>"), [[("[复杂结构:hyperlink]", False)]]),
        (p("<w:r><w:drawing><pic/></w:drawing><w:drawing><pic/></w:drawing></w:r>" + r("a")), [[("[图片][图片]", False), ("a", True)]]),
        (p("<w:r><w:pict><v:line xmlns:v='v'/></w:pict></w:r><w:fldSimple>" + r("7") + "</w:fldSimple><w:fldSimple/><w:sdt>" + r("s") + "</w:sdt><w:r><w:object/></w:r>"),
         [[("[图形]", False), ("7[字段]", False), ("[内容控件]", False), ("[复杂结构:object]", False)]]),
        ("<w:tbl>" + p(r("x")) + "</w:tbl><w:bookmarkEnd/><w:sdt/><w:p/><w:sectPr/><w:odd/>", [[("[表格]", False)], [("[内容控件]", False)], [], [("[分节符]", False)], [("[复杂结构:odd]", False)]]),
        (p(r("﻿a")) + p(r("b﻿")), [[("a", True)], [("b", True)]]),
        (p(r("a &lt;b&gt; <![CDATA[&c]]>")), [[("a <b> &c", True)]]),
    ],
)
def test_regions(body, want):
    assert regions(body) == want


def test_lists_count_and_start_again():
    body = [(1, 0), (1, 1), (1, 1), (1, 0), (1, 1), (1, 2), (2, 0), (2, 0), (1, 0), (1, 8), (5, 0)]
    found = regions("".join(p(r("x"), num(*x)) for x in body))
    assert [b[0][0] if len(b) > 1 else None for b in found] == ["III) ", "III.a\t", "III.b\t", "IV) ", "IV.a\t", "*", "IX) ", "X) ", "V) ", None, None]


def test_lists_by_style_and_blank_paragraphs():
    body = p(r("x"), "<w:pStyle w:val='Bound'/>") + p(r(" "), num(1)) + p(r("x"), num(1)) + p(r("x"), "<w:pStyle w:val='L'/>") + p(r("x"), "<w:pStyle w:val='A'/>")
    assert [b[0][0] for b in regions(body)] == ["III) ", " ", "IV) ", "IV.a\t", "x"]


@pytest.mark.parametrize("kind, n, want", [("upperLetter", 27, "AA"), ("lowerLetter", 702, "zz"), ("lowerLetter", 703, "aaa"), ("upperRoman", 1994, "MCMXCIV"), ("lowerRoman", 4, "iv"), ("none", 3, ""), ("decimal", -2, "-2"), ("upperRoman", 0, "0"), ("chicago", 5, "5")])
def test_counters(kind, n, want):
    assert office.counter(kind, n) == want


def test_headings():
    body = p(r("x"), "<w:pStyle w:val='Sub'/>") + p(r("x"), "<w:outlineLvl w:val='0'/>") + p(r("x"), "<w:pStyle w:val='A'/>") + p(r("x"), "<w:pStyle w:val='none'/>")
    assert [b.heading for b in office.Document(file(body)).blocks] == [True, True, False, False]


BODY = (
    p(r("Title"), "<w:pStyle w:val='H'/>")
    + p(r("One, two. ") + "<w:r><w:rPr><w:i/></w:rPr><w:t>three</w:t><w:br/><w:br/><w:t>four</w:t><w:br w:type='page'/><w:t>five</w:t></w:r>" + "<w:r><w:drawing><wp:anchor xmlns:wp='wp'><pic/></wp:anchor></w:drawing></w:r>" + r("six"))
    + "<w:p/><w:tbl/>" + p(r("end"))
)


def rows(spark, *contents):
    return spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "doc_id int, content binary")


def test_slots(spark):
    got = [(x.slot_order, x.slot_id, x.text, x.separator_after, x.editable, x.role) for x in slots_of.slot_rows(rows(spark, file(BODY))).orderBy("slot_order").collect()]
    assert [(g[1:]) for g in got] == [
        ("docx:p0:r0", "Title", "\n\n", False, "lockedText"), ("docx:p1:r0:s0", "One, ", "", True, "editableText"), ("docx:p1:r0:s1", "two. ", "", True, "editableText"),
        ("docx:p1:r1:s0", "three", "\n\n", True, "editableText"), ("docx:p1:r1:s1", "four", "", True, "editableText"), ("docx:p1:r2", "[分页符]", "", False, "inlineObject"),
        ("docx:p1:r3", "five", "", True, "editableText"), ("docx:p1:r5", "six", "\n\n", True, "editableText"), ("docx:p1:r4", "[图片]", "\n\n", False, "inlineObject"),
        ("docx:p2:break", "", "\n\n", False, "paragraphBreak"), ("docx:block:3", "[表格]", "\n\n", False, "inlineObject"), ("docx:p4:r0", "end", "", True, "editableText"),
    ]
    assert [g[0] for g in got] == list(range(12))


def test_slots_of_headings_and_separators_at_the_start(spark):
    body = p("<w:r><w:br/><w:t>a</w:t></w:r>") + p(r("h"), "<w:pStyle w:val='H'/>")
    got = slots_of.slot_rows(rows(spark, file(body)), headings=True).orderBy("slot_order").collect()
    assert [(x.slot_id, x.text, x.separator_after, x.editable) for x in got] == [("docx:p0:r0:s0", "", "\n", False), ("docx:p0:r0:s1", "a", "\n\n", True), ("docx:p1:r0", "h", "", True)]


def document_xml(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read("word/document.xml").decode()


def slots_from(spark, content):
    return [x.asDict() for x in slots_of.slot_rows(rows(spark, content)).orderBy("slot_order").collect()]


def rewritten(content, slots):
    return office._tried(office._rewrite_one, content, slots)


def test_writing_back_keeps_all_other_bytes(spark):
    content = file(BODY)
    slots = slots_from(spark, content)
    same, error = rewritten(content, slots)
    assert error is None and document_xml(same) == document_xml(content)
    for s in slots:
        s["text"] = {"three": "3 & <3>\t", "six": "6", "Title": "drift", "[图片]": "drift"}.get(s["text"], s["text"])
    new, error = rewritten(content, slots)
    want = document_xml(content).replace("<w:t>three</w:t><w:br/><w:br/><w:t>four</w:t>", "<w:t>3 &amp; &lt;3&gt;</w:t><w:tab/><w:br/><w:br/><w:t>four</w:t>").replace("<w:t>six</w:t>", "<w:t>6</w:t>")
    assert error is None and document_xml(new) == want
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.read("word/media/x.bin") == b"\x00\x01" and len(z.namelist()) == 5


def test_merged_runs_are_rewritten_once():
    content = file(p(r("ab") + "<w:proofErr/>" + r("cd") + r("e", "<w:b/>")))
    slots = [{"slot_id": "docx:p0:r0", "text": "X", "separator_after": "", "editable": True}, {"slot_id": "docx:p0:r1", "text": "e", "separator_after": "", "editable": True}]
    new, error = rewritten(content, slots)
    assert error is None and regions_of(new) == [[("X", True), ("e", True)]]


def regions_of(content):
    return [[(x.text, x.editable) for x in b.regions] for b in office.Document(content).blocks]


def test_write_errors(spark):
    content = file(p(r("a")) + p(r("b")))
    slots = slots_from(spark, content)
    assert rewritten(content, slots[:1])[1] == "structure_changed"
    assert rewritten(content, slots[::-1])[1] == "structure_changed"
    slots[0]["separator_after"] = ""
    assert rewritten(content, slots)[1] == "separator_lost"


def test_unreadable_files_are_rows_with_an_error(spark):
    empty_zip = io.BytesIO()
    zipfile.ZipFile(empty_zip, "w").close()
    broken = file(p(r("a"))).replace(b"</w:body>", b"</w:bodx>")
    cases = [None, b"", b"no zip", empty_zip.getvalue(), broken, file("<w:p>"), file("<w:p/>"), file(p("<w:r><w:drawing><x/></w:drawing></w:r>")), file(p("x" and r("a")), numbers="<n><num numId='1'/></n>"), file(p(r("ok")))]
    got = {x.doc_id: (x.error, x.blocks is None) for x in office.read(rows(spark, *cases)).collect()}
    assert [got[i][0] for i in range(4)] == ["empty_file", "empty_file", "not_a_zip", "no_document"]
    assert got[4][0] in ("invalid_xml", "not_a_zip", "damaged_entry") and [got[i][0] for i in range(5, 10)] == ["invalid_xml", "no_visible_text", "unknown_graphic", "broken_numbering", None]
    assert all(error is not None or not missing for error, missing in got.values())


def test_export_of_any_text_is_read_back(spark):
    text = "a\tb\nc­‑ \x00 <&> é\U0001f600\rz "
    content = office.exported([(text, "plain"), ("", "list"), ("x", "table"), ("h", "heading")])
    assert regions_of(content)[0] == [(text.replace("\x00", "�"), True)]
    assert [b.kind for b in office.Document(content).blocks] == ["p", "p", "block", "p"]
    empty = office.export(spark.createDataFrame([(None, None)], "doc_id long, paragraphs array<struct<text:string,style:string>>"))
    assert office.read(empty).select("error").collect()[0][0] == "no_visible_text"
    assert office.read(rows(spark).limit(0)).count() == 0


def edited(body, text):
    content, error = office._tried(office._edit_one, file(body), text)
    return error or regions_of(content)


STYLED = p(r("abc") + r("def", "<w:b/>") + "<w:r><w:br w:type='page'/></w:r>" + r("x"))


@pytest.mark.parametrize(
    "text, want",
    [
        ("abcdef[分页符]x", ["abc", "def", "x"]),
        ("abcZdef[分页符]x", ["abcZ", "def", "x"]),
        ("Zabcdef[分页符]", ["Zabc", "def", ""]),
        ("abZf[分页符]yx", ["abZ", "f", "yx"]),
        ("abcdef!", "crosses_boundary"),
        ("abc[分页符]def[分页符]x", "ambiguous"),
        ("abcdef[分页符]x\n\nmore", "paragraph_count"),
    ],
)
def test_edited_texts_go_to_their_regions(text, want):
    got = edited(STYLED, text)
    if isinstance(want, list):
        got = [x for x, editable in got[0] if editable]
        want = [x for x in want if x]
    assert got == want


def test_edited_blocks_and_headings():
    body = p(r("h"), "<w:pStyle w:val='H'/>") + "<w:p/><w:tbl/>" + p(r("t"))
    assert edited(body, "H\r\n\r\n\n\ntyped over\n\nT") == [[("H", True)], [], [("[表格]", False)], [("T", True)]]
    assert edited(body, "h\n\nno\n\n[表格]\n\nt") == "empty_paragraph_changed"


def test_places_against_all_ways():
    import random

    def ways(regions, text, free=False):
        if not regions:
            return int(free or not text)
        if regions[0].editable:
            return ways(regions[1:], text, True)
        literal = regions[0].text
        if not free:
            return ways(regions[1:], text[len(literal) :]) if text.startswith(literal) else 0
        found, at = 0, 0
        while literal and (at := text.find(literal, at)) >= 0:
            found += ways([r for r in regions[1:]], text[at + len(literal) :])
            at += len(literal)
        return found

    rng = random.Random(11)
    seen = set()
    for _ in range(2000):
        editable = [rng.random() < 0.5]
        for _ in range(rng.randint(0, 4)):
            editable.append(not editable[-1])
        regions = [office.Region(rng.choice(["a", "b", "ab"]), e) for e in editable]
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 8)))
        made, error = office._tried(office.placed, regions, text)
        n = ways(regions, text)
        assert error == {0: "crosses_boundary", 1: None}.get(n, "ambiguous")
        seen.add(error)
        if made is not None:
            new = {id(r): x for r, x in made}
            assert "".join(new.get(id(r), r.text) for r in regions) == text
    assert len(seen) == 3
    # many ways that all fail at the end take no more than their states
    many = [office.Region("a", i % 2 == 0) for i in range(60)] + [office.Region("c", False)]
    assert office._tried(office.placed, many, "a" * 200)[1] == "crosses_boundary"


def test_owned_parts_make_the_text():
    import random

    rng = random.Random(5)
    for _ in range(300):
        word = lambda n: "".join(rng.choice("ab ") for _ in range(rng.randint(1, n)))
        gap, new = [office.Region(word(4)) for _ in range(rng.randint(1, 4))], word(12)
        assert "".join(x for _, x in office.owned(gap, new)) == new
        same = "".join(r.text for r in gap)
        assert [x for _, x in office.owned(gap, same)] == [r.text for r in gap]


def test_signatures_and_loading(spark, tmp_path):
    for name, body in (("a.docx", p(r("a"))), ("b.DOCX", p(r("b"))), ("c.docx", p(r("a")) + p(r("b"))), ("d.docx", "<w:p>"), ("e.txt", "")):
        (tmp_path / name).write_bytes(file(body))
    got = {x.doc_id[-6:-5]: x for x in slots_of.signed(office.load(spark, str(tmp_path))).collect()}
    assert sorted(got) == ["a", "b", "c", "d"] and got["d"].error == "invalid_xml" and got["d"].template_signature is None and got["d"].structure_signature is None
    assert got["a"].structure_signature == got["b"].structure_signature != got["c"].structure_signature
    assert len({got[k].template_signature for k in "abc"}) == 3
