"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from foliant.llm import chat_repair, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, mixing, pii, quality, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} and some more text" for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "a", 1),
    (1, "The cat sat on the mat and looked at the dog.", "en", "a", 1),
    (2, "The cat sat on  the mat and looked at the dog.", "en", None, None),
    (3, "Der Hund lag auf der Matte und sah die Katze.", "de", "b", 1),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \n\t ", "de", "b", 3),
    (7, "1234 5678", "en", "b", 3),
    (8, LONG, "en", "b", 3),
    (None, "A row without an id.", "en", "c", 3),
    (None, None, None, None, None),
]
CLASH = ("bytes", "n_words", "spans", "items", "row", "key", "size", "score", "cls", "grp", "src", "c0", "host", "path", "rest", "cands", "more", "Kind")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "cat sat on the mat"), (2, None), (None, "lag auf der Matte"), (3, "  "), (1, "looked at the dog")], "item_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_id(docs, none):
    model = language_id.train(docs)
    found = language_id.identify(docs, model)
    assert found.count() == len(ROWS)
    rows = by_id(found)
    assert (rows[1]["lang_pred"], rows[3]["lang_pred"]) == ("en", "de")
    for k in (4, 5, 6, 7):
        assert (rows[k]["lang_pred"], rows[k]["score"], rows[k]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 6
    assert language_id.train(none) == {} and language_id.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["taken"] == sum(d["words"] for d in r["draws"]) <= 3 * r["size"] for r in rows)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    targets = {r["source"]: r["target"] for r in rows}
    assert sum(targets.values()) == pytest.approx(sum(r["size"] for r in rows))
    for source, target in targets.items():
        assert abs(sum(r["taken"] for r in rows if r["source"] == source) - target) <= 1
    assert mixing.mix(none).count() == 0
    blank = none.sparkSession.createDataFrame([(1, None, None, "a", 0), (2, " ", None, None, 0)], SCHEMA)
    assert {(r["taken"], r["target"]) for r in mixing.mix(blank).collect()} == {(0, 0.0)}


def test_decontamination(docs, none, items):
    rows = decontaminate.contamination(docs, items).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r for r in rows}
    assert (found[1]["n_words"], found[1]["n_hit"], found[1]["n_items"]) == (11, 9, 1)
    assert (found[3]["n_hit"], found[3]["n_items"], found[3]["contaminated"]) == (4, 0, True)
    assert (found[4]["n_words"], found[4]["contaminated"], found[8]["n_hit"]) == (0, False, 0)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 4, 5, 6, 7, 8]
    cut = by_id(decontaminate.cut_spans(docs, items))
    assert cut[1]["text"] == "The  and ." and cut[4]["text"] is None and cut[8]["text"] == LONG
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, items.limit(0)).collect())


def test_jaccard(docs, none):
    rows = jaccard_join.jaccard_components(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert (found[1]["component_id"], found[2]["component_id"], found[3]["component_id"]) == (1, 1, 3)
    assert (found[4]["n_shingles"], found[4]["component_id"], found[6]["component_id"], found[7]["n_shingles"]) == (0, 4, 6, 1)
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and 2 not in {r["doc_id"] for r in kept.collect()}
    assert jaccard_join.jaccard_components(none).count() == 0


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert (found[1]["keep_id"], found[1]["group_size"], found[1]["kept"]) == (2, 3, False)
    assert (found[5]["keep_id"], found[4]["group_size"], found[6]["kept"]) == (6, 4, True)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 6, 7, 8, None}
    assert exact_dedup.exact_groups(none).count() == 0


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 0, 1), (8, 0, None), (9, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.score(none, quality.train(none, labels)).count() == 0
    one = quality.train(docs, labels.filter("quality = 1"))
    assert {r["predicted"] for r in quality.score(docs, one).collect()} == {1}


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.EXAMPLE.org/es/1?x=1#t", "https://b.example.com/fr/9", "ftp://example.org", "x://y://z/p", "http://example.org/en/12", "http://q.net/" + "a/" * 3000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "score": F.lit(3)})
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert len(rows) == len(urls)
    assert all((rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == ("", "", None) for i in (0, 1, 2))
    assert (rows[3]["host"], rows[3]["path"], rows[3]["rule"], rows[3]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (rows[4]["verdict"], rows[5]["rule"], rows[6]["host"], rows[7]["rule"]) == ("allow", None, "y:", "example.org/en/1")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_personal_data(docs, none, spark):
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(ROWS) and all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == 0 for r in rows)
    assert pii.personal_data(none).count() == 0
    text = "é a.b@c-d.org, 10.0.0.255 and 1.2.3.256; 4111 1111 1111 1111 or +44 (20) 7946-0958, " + "9" * 40_000 + "a" * 40_000
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.personal_data(one).first()
    assert (found["n_email"], found["n_ip"], found["n_card"], found["n_phone"]) == (1, 1, 1, 1)
    assert found["spans"].startswith("email:2:13,ip:15:25,card:")
    assert pii.redacted(one).first()["text"].startswith("é [EMAIL], [IP] and 1.2.3.256; [CARD] or [PHONE], ")
    assert by_id(pii.redacted(docs))[4]["text"] is None


def test_licenses(docs, none, spark):
    rows = license_scan.licenses(docs).collect()
    assert len(rows) == len(ROWS) and all((r["n_base"], r["labels"], r["first_word"]) == (0, "", None) for r in rows)
    assert license_scan.licenses(none).count() == 0
    text = "Under the MIT License! x under-the mit license; Apache License, Version 2 cc by nc cc by nc"
    found = license_scan.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (found["n_base"], found["first_word"], found["last_word"], found["base_labels"], found["score"]) == (5, 0, 16, "apache-2,cc-by-nc,mit", 1.0)


def test_chats(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "b"), (None, 0, None, None), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string"
    ).withColumns({"part": F.lit(1), "turns": F.lit(2)})
    rows = {r["conv_id"]: r for r in chat_repair.repair_chats(turns).collect()}
    assert rows[1]["rendered"] == "<|user|>\na\na<|end|>\n<|assistant|>\nb<|end|>\n" and rows[1]["cost"] == 1
    assert (rows[2]["n_inserted"], rows[None]["n_relabelled"]) == (1, 1)
    assert chat_repair.repair_chats(turns.limit(0)).count() == 0


def test_text_ids(spark):
    """Every operator that groups takes ids of any orderable type."""
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "one two  three four"), ("a", None), (None, "one two three four")], "doc_id string, text string")
    rows = {(r["doc_id"], r["kept"]): r for r in exact_dedup.exact_groups(docs).collect()}
    assert rows["a", True]["keep_id"] == "a" and rows["b", False]["group_size"] == 3 and rows[None, False]["keep_id"] == "a"
    assert {r["component_id"] for r in jaccard_join.jaccard_components(docs).collect() if r["n_shingles"]} == {"a"}
    assert exact_dedup.drop_exact_copies(docs).count() == 2 and jaccard_join.keep_one_of_each(docs).count() == 2


def test_colliding_words_do_not_link(spark):
    """Words whose linear hashes modulo 2 ** 64 are equal: a Thue-Morse word and its complement."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x y {word} z w"), (2, f"x y {other} z w"), (3, f"x y {word} z w")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("weights_fit", [True, False])
def test_heavy_keys_are_split_off(spark, monkeypatch, weights_fit):
    """The joins beyond the broadcast limit give the rows of the ones below it."""
    if not weights_fit:
        for module in (exact_dedup, jaccard_join):
            monkeypatch.setattr(module, "small", lambda df, rows=0: False)
        monkeypatch.setattr("foliant.llm.common.small", lambda df, rows=0: False)
        monkeypatch.setattr("foliant.llm.common.HEAVY_LEAST", 3)
    rows = [(i, f"same words in every one of these rows {i % 3}") for i in range(30)] + [(i, f"text {i} of its own {i * 7}") for i in range(30, 60)] + [(None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert groups == {i: (i % 3, 10) if i < 30 else (i, 1) for i in range(60)} | {None: (None, 5)}
    assert exact_dedup.drop_exact_copies(docs).count() == 34
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert found == {i: i % 3 if i < 30 else i for i in range(60)} | {None: None}
    assert jaccard_join.keep_one_of_each(docs).count() == 33 + 5
