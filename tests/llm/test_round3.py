"""Token alignment, filter audit and sharding against plain versions, and on odd rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import common, filter_audit, queries, sharding, token_alignment
from tests.oracle import check

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}, émis and more\n\ntext" for i in range(9_000))
ROWS = [
    (1, "The cat sat on the mat.", "en", "a", 1),
    (1, "The cat sat on the mat.", "en", "a", 1),
    (2, "The cat sat on the mat.", "en", None, None),
    (3, "Der Hund  naïve €5 日本語 \U0001f600 <|endoftext|> <s> <0x41>", "de", "b", 1),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \n\t ", "de", "b", 3),
    (7, "holds ▁ itself", "en", "b", 3),
    (8, LONG, "en", "b", 3),
    (None, "A row without an id.", "en", "c", 3),
    (None, "A row without an id.", "en", "c", 3),
    (None, None, None, None, None),
]
CLASH = ("row", "key", "piece", "pieces", "links", "part", "fails", "n", "size", "slot", "shard", "place", "hashed", "first", "_scores", "record")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encoders():
    with open(f"{token_alignment.FOLDER}/{token_alignment.FILE_A}", "rb") as a, open(f"{token_alignment.FOLDER}/{token_alignment.FILE_B}", "rb") as b:
        return token_alignment.Encoders(a.read(), b.read())


# Token alignment


def plain_groups(encoders, text):
    """Ids of A and B, the groups as text and the links, by walking both token lists; whole texts, never in parts."""
    if not text:
        return [], [], [], []
    a = encoders.a.encode(" " + text, add_special_tokens=False).ids
    b = encoders.b.encode(text)
    if not b"".join(encoders.bytes_a[i] for i in a) == b"".join(encoders.bytes_b[i] for i in b) == (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(encoders.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(encoders.bytes_b[i]) for i in b]).tolist()
    at_b = {e: k for k, e in enumerate(ends_b)}
    groups, links, i, j = [], [], 0, 0
    for k, e in enumerate(ends_a):
        if e in at_b:
            m = at_b[e]
            groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
            links.append((a[k], b[m]))
            i, j = k + 1, m + 1
    return a, b, groups, links


def plain_alignment(encoders, rows):
    made = [(r[0], *plain_groups(encoders, r[1])) for r in rows]
    counts = Counter(x for m in made for x in m[4])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        (
            (k, len(a), len(b), len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for k, a, b, g, x in made
        ),
        key=repr,
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("work", [token_alignment.PIECE, 7, 1])
def test_alignment_plain(docs, encoders, work):
    if work < 10:
        docs = docs.filter("coalesce(doc_id, 0) <> 8")
    rows = [r for r in ROWS if work > 10 or r[0] != 8]
    got = token_alignment.align(docs, work=work)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(encoders, rows)


def test_alignment_supplied(spark, encoders):
    table = common.read_table(spark, SF, "documents")
    got = queries.op11_token_alignment(spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment(encoders, [tuple(r) for r in table.select("doc_id", "text").collect()])


def test_alignment_words_as_the_whole(spark, encoders, monkeypatch):
    """Ids of texts cut into words are those of the whole text, with and without kept words."""
    table = [r[0] for r in common.read_table(spark, SF, "documents").select("text").collect()]
    odd = ["a  b   c", " a b", "a \u0301b c", "x\u00a0y z", "l'été est là. Oui, 3.5 €!", "don't  stop 'til\n\n it's 12 %", "日本 語 x", "\u200b a \ufeff b", "a _b __c", "tab\tq w", "x" * 500 + " " + "y" * 500]
    texts = [*table, *odd, LONG, *(r[1] for r in ROWS if r[1])]
    assert len(encoders.parts(LONG)) > 1000 and "".join(encoders.parts(LONG)) == " " + LONG
    for kept in (token_alignment.CACHE_WORDS, 0):
        monkeypatch.setattr(token_alignment, "CACHE_WORDS", kept)
        for lo in range(0, len(texts), 50):
            some = texts[lo : lo + 50]
            for text, a, b in zip(some, *encoders.encode(some), strict=True):
                if "▁" in text:
                    assert len(a) == len(b) == 0
                else:
                    assert a.tolist() == encoders.a.encode(" " + text, add_special_tokens=False).ids and b.tolist() == encoders.b.encode(text)


def test_alignment_pieces_even(docs):
    pieces = token_alignment.tokens(docs, work=5000).filter("pieces > 1").collect()
    sizes = [len(p["ids_a"]) + len(p["ids_b"]) for p in pieces if p["key"] == 8]
    assert len(sizes) > 10 and all(4999 <= s <= 5001 for s in sizes[:-1]) and sizes[-1] <= 5001


def test_alignment_rare_pairs_shuffled(docs):
    links = token_alignment.links(token_alignment.tokens(docs))
    counts = token_alignment.link_counts(links)
    rows = lambda df: sorted(map(tuple, df.select("row", "pair", "n", "best").collect()))
    assert rows(token_alignment.with_counts(links, counts)) == rows(token_alignment.with_counts(links, counts, 20)) == rows(token_alignment.with_counts(links, counts, 0))


def test_alignment_dictionary(docs, encoders):
    counts = Counter(x for r in ROWS for x in plain_groups(encoders, r[1])[3])
    got = token_alignment.linked_ids(docs).collect()
    assert {(r["a"], r["b"]): r["n"] for r in got} == counts
    assert all(r["best"] == (r["n"] == max(n for (_, b), n in counts.items() if b == r["b"])) for r in got)


def test_alignment_empty(none):
    assert token_alignment.align(none).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.lists(st.integers(1, 6), min_size=1, max_size=40), st.integers(1, 90))
def test_crossing(a, b, work):
    a, b = np.cumsum(a), np.cumsum(b)
    merged = sorted([(int(e), 0, k) for k, e in enumerate(a)] + [(int(e), 1, k) for k, e in enumerate(b)])
    for d in range(1, len(merged)):
        taken = merged[:d]
        if merged[d][1] == 1 and taken[-1][:2] == (merged[d][0], 0):
            taken = merged[: d + 1]
        assert token_alignment.crossing(a, b, d) == (sum(x[1] == 0 for x in taken), sum(x[1] for x in taken))
    pieces = token_alignment.cut_pieces(a, b, work)
    assert [p[0] for p in pieces[1:]] == [p[1] for p in pieces[:-1]] and [p[2] for p in pieces[1:]] == [p[3] for p in pieces[:-1]]
    assert pieces[0][0] == pieces[0][2] == 0 and (pieces[-1][1], pieces[-1][3]) == (len(a), len(b))


# Filter audit


def test_audit_sql(spark):
    check(spark, SF, queries.op12_filter_audit, queries.OP12)


def plain_audit(rows, labels):
    import itertools

    texts = {}
    for r in rows:
        if r[0] is not None:
            t = r[1] or ""
            texts[t] = min(texts.get(t, r[0]), r[0])
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    facts = []
    for r in rows:
        t = r[1] or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if r[0] is not None and r[0] > texts[t] else set()
        facts.append((r[3] or "", fails, r[0] in good, r[0] in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(x in f[1] for f in own) - len(gone), sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone),
                ]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return sorted((*k, *v) for k, v in out.items())


LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (None, 1, 1), (8, 1, None), (99, 1, 1)]


def test_audit_plain(spark, docs, none, monkeypatch):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("n", F.lit(3))
    want = plain_audit(ROWS, LABELS)
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == want
    # heavy keys split off
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HEAVY_LEAST", 1)
    monkeypatch.setattr(common, "small", lambda df, rows=0: False)
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == want
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).count() == 600 * len({r[3] for r in ROWS})


def test_audit_other_filters(docs, spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, labels, {"S": filter_audit.few_words(3)}).collect()
    assert len(rows) == 4 * len({r[3] for r in ROWS}) and {r["filter_order"] for r in rows} == {"SE", "ES"}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {c: filter_audit.few_words() for c in "ABCDEF"})


# Sharding


def plain_shard(key, weights, seed=sharding.SEED):
    """XXH64 chained by seeds, as Spark's xxhash64 does; Python's logarithm."""
    import math

    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    if key is not None:
        h = xxhash.xxh64_intdigest(str(key).encode(), h)
    h = xxhash.xxh64_intdigest(int(key is None).to_bytes(4, "little"), h)
    best = None
    for k, w in enumerate(weights):
        if w > 0:
            x = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
            s = math.log(((x >> 12) + 0.5) / 2**52) / w
            if best is None or s > best[0]:
                best = (s, k)
    return best[1]


def sound(rows, table, weights):
    assert len(rows) == len(table)
    slots = {}
    for r in rows:
        assert (r["shard"], r["grown_shard"], r["law"]) == (plain_shard(r["doc_id"], weights), plain_shard(r["doc_id"], [*weights, 1.0]), "key")
        assert r["grown_shard"] in (r["shard"], len(weights))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in table), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want


def test_sharding_plain(spark, docs, none):
    sound(sharding.assign(docs).collect(), ROWS, [1.0] * 40)
    sound(sharding.assign(docs, [1, 0, 2.5]).collect(), ROWS, [1, 0, 2.5])
    table = common.read_table(spark, SF, "documents").select("doc_id", "text")
    rows = queries.op13_sharding(spark, SF).collect()
    sound(rows, [tuple(r) for r in table.collect()], [1.0] * 40)
    assert sorted(rows) == sorted(sharding.assign(table.repartition(7)).collect())
    assert sharding.assign(none).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs, [0, 0])


def test_sharding_weights_and_moves(spark, tmp_path):
    table = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("shard_before"))
    weights = [1, 2, 3, 2]
    loads = sharding.loads(sharding.assign(table, weights), weights).collect()
    assert all(abs(r["rows_part"] - r["weight"] / 8) < 0.02 for r in loads) and sum(r["n_bytes"] for r in loads) == 17 * 20_000
    moved = sharding.moves(table, weights, [*weights, 2])
    assert moved.columns == ["doc_id", "text", "shard_before", "_shard_before", "shard_after"]
    assert {r[0] for r in moved.select("shard_after").distinct().collect()} == {4} and abs(moved.count() / 20_000 - 0.2) < 0.02
    less = sharding.moves(table, weights, [1, 2, 0, 2])
    assert {r[0] for r in less.select("_shard_before").distinct().collect()} == {2}


def test_sharding_hot_key(spark):
    """A third of all rows has no id: one shard, but its slots are numbered in several ranges."""
    table = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.assign(table, [1.0, 1.0])
    hot = got.filter("doc_id IS NULL").select("slot", "shard").collect()
    assert len(hot) == 3000 and len({r["shard"] for r in hot}) == 1
    for k in (0, 1):
        slots = [r["slot"] for r in got.filter(f"shard = {k}").collect()]
        assert sorted(slots) == list(range(len(slots)))


def test_sharding_written(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), [1.0] * 3, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and set(docs.columns) < set(back.columns)
    assert all(r["_shard"] == plain_shard(r["doc_id"], [1.0] * 3) for r in back.collect())


# Hot keys and clashing names


def test_no_name_clashes(spark):
    import corpus_pipeline
    from foliant.llm import decontaminate, exact_dedup, jaccard_join, language_id

    names = ["_", "_row_key", "kept", "row", "rest", "size", "source_size", "target", "taken", "draws", "shard", "place", "words", "doc_shard", "at", "src", "a b", "x.y"]
    rows = [(k, t, lang, "s", *range(100 + k, 100 + k + len(names))) for k, t, lang in ((1, "The cat sat on the mat today.", "en"), (2, "The cat sat on the mat today.", "en"), (3, "Der Hund lag auf der Matte.", "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in names))
    items = spark.createDataFrame([(1, "nothing here")], "item_id long, text string")
    every = sorted(map(tuple, docs.collect()))
    first_and_last = [every[0], every[2]]
    for got, want in (
        (exact_dedup.drop_exact_copies(docs), first_and_last),
        (jaccard_join.keep_one_of_each(docs), first_and_last),
        (language_id.keep_identified(docs, language_id.train(docs)), every),
        (decontaminate.drop_contaminated(docs, items), every),
        (decontaminate.drop_contaminated(docs, items, max_words=13), every),
    ):
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == want
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    assert len(set(mixed.columns)) == len(mixed.columns) == len(docs.columns) + 5
    assert {r["_size"] for r in mixed.collect()} == {7, 6} and {r["size"] - r["doc_id"] for r in mixed.collect()} == {100 + names.index("size")}
    from foliant.llm import mixing

    shards = mixing.sharded(docs)
    assert len(set(shards.columns)) == len(shards.columns) == len(docs.columns) + 3


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_LEAST", 5)
    monkeypatch.setattr(common, "HEAVY_PART", 10)
    left = common.stored(spark.range(300).select((F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("x")), "left")
    right = spark.range(0, 300, 3).select(F.col("id").alias("k"), F.array(F.lit(1), F.lit(2)).alias("set"))
    got = common.join_salted(left, right, "k", "x")
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "x", "set").collect())
    assert rows(got) == rows(left.join(right, "k")) and len(rows(got)) == 150 + 50


@pytest.mark.parametrize("least", [1000, 2])
def test_near_copies_with_hot_groups(spark, monkeypatch, least):
    """Half of all classes share a prefix or a list; the heavy keys are split off, or not."""
    import random

    from foliant.llm import components, jaccard_join

    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for i in range(120):
        words = list(base) if i % 2 else [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(40)]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(common, "HEAVY_LEAST", least)
    if least < 10:
        monkeypatch.setattr(common, "HEAVY_PART", 20)
        monkeypatch.setattr(common, "small", lambda df, rows=0: False)
        monkeypatch.setattr(jaccard_join, "small", lambda df, rows=0: False)
        monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in texts}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}
    star = spark.range(1, 200).select(F.lit(0).alias("a"), F.col("id").alias("b")).union(spark.range(300, 310).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    found = {r["node"]: r["component"] for r in components.connected_components(star).collect()}
    assert found == {k: 0 if k < 300 else 300 for k in [*range(200), *range(300, 311)]}


def test_mix_edge_among_repeated_rows(spark):
    """All of a source but a little is one repeated row: the target ends among its copies."""
    rows = [(7, "one two three", "a")] * 400 + [(i, "four five", "a") for i in range(20)] + [(i, "six " * 30, "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    from foliant.llm import mixing

    got = mixing.mix(docs).collect()
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert sum(0 < r["taken"] % max(r["size"], 1) for r in own) <= 1
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r["source"], r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


# Quality against a plain Bradley-Terry fit


def test_quality_is_plain_bradley_terry(spark):
    """The same pairs, by small steps up the gradient of the log likelihood instead of Newton's; whole texts scored by the formula."""
    import math

    from foliant.llm import quality

    docs, labels = (common.read_table(spark, SF, t) for t in ("documents", "labels"))
    known = sorted((r["doc_id"], r["text"], r["quality"]) for r in docs.join(labels, "doc_id").filter("quality IS NOT NULL").collect())
    rows = np.array([quality.features(t.encode()) for _, t, _ in known])
    good = np.array([q == 1 for *_, q in known])
    pairs = 400
    model = quality.fit(rows, good, pairs)
    center, scale = rows.mean(0), np.maximum(rows.std(0), 1e-9)
    z = np.array([[*(v := [max(-6.0, min(6.0, (x - c) / s)) for x, c, s in zip(row, center, scale, strict=True)]), *(x * x for x in v)] for row in rows])
    rng = np.random.default_rng(quality.SEED)
    winners, losers = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    differ = z[winners] - z[losers]
    ridge = pairs / 2000
    steep = np.linalg.norm(differ, 2) ** 2 / 4 + ridge
    w = ahead = np.zeros(z.shape[1])
    momentum = (1 - math.sqrt(ridge / steep)) / (1 + math.sqrt(ridge / steep))
    for _ in range(20_000):
        new = ahead + (differ.T @ (1 / (1 + np.exp(differ @ ahead))) - ridge * ahead) / steep
        w, ahead = new, new + momentum * (new - w)
    utility = z @ w
    assert np.abs(utility - model.utility(rows)).max() < 0.02 * np.abs(utility).max()
    cut = float(np.quantile(utility, 1 - good.mean()))
    odds = math.log(quality.CUT_SCORE / (1 - quality.CUT_SCORE))
    want = [1 / (1 + math.exp(-max(-40, min(40, model.slope * (u - cut) + odds)))) for u in utility]
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert max(abs(got[k] - s) for (k, *_), s in zip(known, want, strict=True)) < 0.05
