"""Audit of how document filters interact, for every order in which they can be applied.

Each row fails some of the filters: one of 2 ** m combinations. Rows, rows of good quality and toxic rows are counted for each
part and combination, which makes three tensors of m axes of length 2 a part. Contracting every axis with the three
selectors pass, fail and all gives every question of the audit at once: a step of an order asks for pass on the axes applied
before it, fail or pass on its own, and all on the axes still to come.

Texts are only read to find what they fail; rows are slim from then on. Only the counts, at most 2 ** m rows a
part, go to numpy, so the work there grows with the parts and not with the rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import join_weighted, let, stored

PASS, FAIL, ALL = 0, 1, 2
#: Rows of the selectors over one axis (passed, failed).
SELECT = np.array([[1, 0], [0, 1], [1, 1]], dtype=np.int64)
#: Of an answer's batch: parts, each with m! * m rows.
PARTS_A_BATCH = 32


def few_words(least: int = 200) -> Callable:
    return lambda text, words: F.size(words) < least


def repetitive(percent: int = 50) -> Callable:
    return lambda text, words: 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def shouting(percent: int = 2) -> Callable:
    return lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > percent * F.length(text)


def symbols(marks: str = "#$%&*|") -> Callable:
    return lambda text, words: F.length(F.translate(text, marks, "")) < F.length(text)


#: Conditions on one text, by letter; COPY is the one that needs the other rows.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words(), "B": repetitive(), "C": shouting(), "D": symbols()}
COPY = "E"


def failures(docs: DataFrame, filters: dict[str, Callable] = FILTERS) -> DataFrame:
    """doc_id, part, digest and fails (bit k: the k-th filter) with n, the number of such rows; null texts are empty, null sources ''.

    Repeated rows become one, so a key with a third of all rows is combined before it is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    bits = lambda words: sum((F.when(f(F.col("body"), words), 1 << k).otherwise(0) for k, f in enumerate(filters.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("body")).select(
        "doc_id", "part", F.sha2("body", 256).alias("digest"),
        let(F.regexp_extract_all("body", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), bits).alias("fails"),
    )
    return rows.groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))


def tensors(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable] = FILTERS) -> DataFrame:
    """part, fails (bit k: the k-th filter, the last: a smaller doc_id has the same text), n, good, toxic.

    Texts are the same if their SHA-256 is. A row without doc_id has no smaller one and is smaller than none. Labels count if any
    row of that doc_id has them. Extra columns are not read; an empty table gives no rows.
    """
    rows = stored(failures(docs, filters), "failures")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    copies = stored(copies.filter("copies > 1 AND first IS NOT NULL"), "copies")
    rows = join_weighted(rows, copies, ["digest"], "copies")
    rows = rows.withColumn("fails", F.col("fails") + F.when(F.col("doc_id") > F.col("first"), 1 << len(filters)).otherwise(0))
    # a doc_id's rows of one kind are one row from here, so labels meet few rows of a repeated id
    rows = stored(rows.groupBy("doc_id", "part", "fails").agg(F.sum("n").alias("n")), "kinds")
    told = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    known = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("times"))
    told = stored(told.join(known, "doc_id"), "told")
    rows = join_weighted(rows, told, ["doc_id"], "times")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return rows.groupBy("part", "fails").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def _questions(m: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray], np.ndarray]:
    """All orders; for each order and step, where in the contracted tensors its answers are; and the step's filter."""
    orders = list(itertools.permutations(range(m)))
    ask: dict[str, list[int]] = {"kept": [], "removed": [], "fail": [], "only": []}
    axes = []
    for order in orders:
        for k, axis in enumerate(order):
            before, chosen = set(order[:k]), {}
            chosen["kept"] = [PASS if a in before or a == axis else ALL for a in range(m)]
            chosen["removed"] = [PASS if a in before else FAIL if a == axis else ALL for a in range(m)]
            chosen["fail"] = [FAIL if a == axis else ALL for a in range(m)]
            chosen["only"] = [FAIL if a == axis else PASS for a in range(m)]
            for name, picks in chosen.items():
                ask[name].append(int(np.ravel_multi_index(picks, (3,) * m)))
            axes.append(axis)
    return orders, {k: np.array(v) for k, v in ask.items()}, np.array(axes)


def contracted(tensor: np.ndarray) -> np.ndarray:
    """tensor: parts by m axes of 2. Every choice of selectors on every axis: parts by 3 ** m."""
    m = tensor.ndim - 1
    axes, picks = "abcdefghijkl"[:m], "ABCDEFGHIJKL"[:m]
    spec = f"z{axes}," + ",".join(p + a for p, a in zip(picks, axes, strict=True)) + f"->z{picks}"
    return np.einsum(spec, tensor, *[SELECT] * m, optimize=True).reshape(len(tensor), -1)


def _answers(letters: str):
    m = len(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, ask, axes = _questions(m)
        named = pa.array(["".join(letters[a] for a in order) for order in orders])
        rows = len(axes)
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS_A_BATCH):
                some = batch.slice(lo, PARTS_A_BATCH)
                counts = np.zeros((3, some.num_rows, 2**m), dtype=np.int64)
                for p, cells in enumerate(some.column("cells").to_pylist()):
                    for c in cells:
                        counts[:, p, c["fails"]] = c["n"], c["good"], c["toxic"]
                # bit k is axis k: the last axis of a reshaped array is the lowest bit
                shape = (some.num_rows, *[2] * m)
                n, good, toxic = (contracted(x.reshape(shape).transpose(0, *range(m, 0, -1))) for x in counts)
                removed = n[:, ask["removed"]]
                shapley = np.stack([removed[:, axes == a].sum(axis=1) for a in range(m)], axis=1)[:, axes]
                made = [n[:, ask["kept"]], removed, n[:, ask["fail"]] - removed, n[:, ask["only"]], good[:, ask["removed"]], toxic[:, ask["removed"]], shapley]
                part = some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), rows)))
                order = named.take(pa.array(np.tile(np.repeat(np.arange(len(orders)), m), some.num_rows)))
                step = pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), some.num_rows * len(orders)))
                names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(np.ascontiguousarray(x).ravel()) for x in made)], names=names)

    return run


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable] = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step in it, zeros included.

    part, filter_order, step, and the documents of the part that are kept after the step, removed by it, redundant (they fail
    its filter, but went before), unique_fails (they fail no other filter), good_lost and toxic_lost (removed here), shapley (what
    its filter removes, summed over all orders). The copy filter comes last, as COPY. At most six filters.
    """
    letters = "".join(filters) + COPY
    if len(set(letters)) != len(letters) or math.factorial(len(letters)) > 720:
        raise ValueError("filters: at most five besides the copies, each a letter of its own")
    cells = tensors(docs, labels, filters).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return cells.mapInArrow(_answers(letters), f"part string, filter_order string, step int, {longs}")
