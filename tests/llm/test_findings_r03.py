"""What the third round's findings were about."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from foliant.llm import boosting, common, jaccard_join, pii
from tests.llm.test_pii_added import corpus


def batches_of(texts, rows):
    for at in range(0, len(texts), rows):
        yield pa.record_batch({"bytes": pa.array([t.encode() for t in texts[at : at + rows]], pa.binary())})


def test_a_block_of_shingles_is_held_once(monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 1 << 18)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=400)) for _ in range(1000)] + [" ".join(f"x{i}" for i in range(600_000))]
    expected = Counter()
    for t in texts:
        expected.update((jaccard_join.shingles(t.encode()) >> np.uint64(24)).tolist())
    jaccard_join.give_back()
    got = Counter()
    data = list(batches_of(texts[:-1], 100))
    tracemalloc.start()
    for out in jaccard_join._blocks(3, 8)(iter(data)):
        assert tracemalloc.get_traced_memory()[1] < 2 * 8 * jaccard_join.BLOCK
        tracemalloc.reset_peak()
        del out
    assert tracemalloc.get_traced_memory()[1] < 2 * 8 * jaccard_join.BLOCK
    tracemalloc.stop()
    for out in jaccard_join._blocks(3, 8)(batches_of(texts, 100)):
        for r in out.to_pylist():
            low = jaccard_join._unpacked(r["low"]).tolist()
            counts = np.frombuffer(zstandard.decompress(r["counts"]), np.uint32).tolist()
            assert len(low) == len(counts) and low == sorted(set(low))
            got.update({r["range"] << 32 | x: n for x, n in zip(low, counts, strict=True)})
    assert got == expected


def test_sliced_batches_keep_every_row():
    batch = pa.record_batch({"n": pa.array(range(2 * common.SLICE_ROWS + 1))})
    parts = list(common.sliced([batch, batch.slice(0, 0), batch.slice(5, 3)]))
    assert [p.num_rows for p in parts] == [common.SLICE_ROWS, common.SLICE_ROWS, 1, 3]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(2 * common.SLICE_ROWS + 1), 5, 6, 7]


def test_the_trees_are_fitted_on_every_candidate(spark, monkeypatch):
    rows = corpus() + corpus()[:200]  # copies count once
    docs = spark.createDataFrame([*enumerate(rows), (None, None)], "doc_id long, text string")
    fits, fit = [], boosting.fit

    def spied(rows, features, **options):
        fits.append(rows.agg({options.get("weight") or "label": "sum" if options.get("weight") else "count"}).first()[0])
        return fit(rows, features, **options)

    monkeypatch.setattr(boosting, "fit", spied)
    chooser = pii.Chooser(docs)
    texts = pii.with_spans(docs.filter("text IS NOT NULL").select("text").distinct())
    every = texts.select(F.sum(F.size(pii.Chooser._labelled()))).first()[0]
    assert every > 1000 and max(fits) == every and sum(fits) == 2 * every
    assert set(chooser.thresholds) == set(pii.KINDS)


def test_the_thresholds_count_every_candidate(spark, monkeypatch):
    # 21 positives of one kind are enough, those of a part of the texts are not
    texts = [f"mail {name}@example.com now" for name in ("ann", "bob", "cleo")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    halves = {r[0] for r in docs.select(F.pmod(F.shiftrightunsigned(F.xxhash64("text"), 32), F.lit(2))).collect()}
    assert halves == {0, 1} and pii.LEAST_SUPPORT == 20
    monkeypatch.setattr(boosting, "fit", lambda *args, **options: [(1.0, 2.0)])
    assert pii.Chooser(docs).thresholds == {"email": 0.98}
