"""Exact deduplication with counting quotient filters.

A 64-bit fingerprint of the normalised text splits into a quotient (high bits) and a remainder (low
bits). Every partition builds filters that hold, per occupied quotient, a sorted run of remainders with
a count each. No bits are dropped, so filters merge losslessly: the runs of equal quotients are merged by
sorted remainder and their counts added. Fingerprints whose count is above one are then verified on the bytes of
the normalised texts, all others are unique without further work.

Verification needs no pairs: of all rows with one fingerprint and digest the least and the greatest normalised text
are kept, which tasks combine before anything is shuffled, so a group of any size is one row of each task. Where both
are the same bytes, all rows between them are. Should they ever differ, that is a SHA-256 collision and an error.

A copy group of any size is one counter in each filter, and where rows meet a value of their group, groups with
over a thousandth of the rows are split off and broadcast, so no task gets a hot group's rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import ROW, give_back, join_weighted, keyed_rows, sliced, small, stored, unpacked, without_rows

WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
REMAINDER_BITS = 40
#: A partition's open filter is handed on at this many fingerprints; bounds a Python worker's memory.
FILTER_CAPACITY = 1 << 20


def _normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, WHITESPACE)


def _digests(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prints, shas, norms = [], [], []
            for text in batch.column("bytes"):
                norm = _normalised(text.as_py())
                prints.append(xxhash.xxh3_64_intdigest(norm) - (1 << 63))
                shas.append(hashlib.sha256(norm).digest())
                if texts:
                    norms.append(norm)
            more = [pa.array(norms, pa.binary())] if texts else [batch.column("n_points")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(prints, pa.int64()), pa.array(shas, pa.binary()), *more],
                [*batch.schema.names[:-2], "fingerprint", "sha", "norm" if texts else "n_points"],
            )
        batch = prints = shas = norms = norm = text = more = None
        give_back()

    return run


def digest_table(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carry columns, fingerprint, sha, n_points of every row; one pass over the texts."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return _slim(docs, carry).mapInArrow(_digests(False), f"{kinds}, fingerprint long, sha binary, n_points long")


def _slim(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    return docs.select(*carry, F.col("text").cast("binary").alias("bytes"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"))


def build_filter(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occupied quotients, run lengths, remainders sorted within each run, counts. prints: uint64."""
    values, counts = np.unique(prints, return_counts=True)
    return _runs(values, counts)


def _runs(values: np.ndarray, counts: np.ndarray):
    shift = np.uint64(REMAINDER_BITS)
    quotients, lengths = np.unique(values >> shift, return_counts=True)
    return quotients, lengths, values & np.uint64((1 << REMAINDER_BITS) - 1), counts


def merge_filters(filters: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge by sorted remainder within equal quotients; counts add."""
    shift = np.uint64(REMAINDER_BITS)
    values = np.concatenate([(np.repeat(q, n) << shift) | r for q, n, r, _ in filters])
    counts = np.concatenate([c for *_, c in filters])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return _runs(values[first], np.add.reduceat(counts, first))


def _partition_filters(range_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63))
            size += batch.num_rows
            if size >= FILTER_CAPACITY:
                yield from _blocks(np.concatenate(held), range_bits)
                held, size = [], 0
        if size:
            yield from _blocks(np.concatenate(held), range_bits)

    return build


def _blocks(prints: np.ndarray, range_bits: int) -> Iterator[pa.RecordBatch]:
    """One row for each range of quotients that the filter occupies."""
    quotients, lengths, remainders, counts = build_filter(prints)
    ends = np.cumsum(lengths)
    ranges = (quotients >> np.uint64(64 - REMAINDER_BITS - range_bits)).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1], True])
    out: dict[str, list] = {k: [] for k in ("range", "quotients", "lengths", "remainders", "counts")}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = (ends[a - 1] if a else 0), ends[b - 1]
        out["range"].append(int(ranges[a]))
        out["quotients"].append(quotients[a:b].astype(np.uint64).tobytes())
        out["lengths"].append(lengths[a:b].astype(np.int32).tobytes())
        out["remainders"].append(remainders[lo:hi].tobytes())
        out["counts"].append(counts[lo:hi].astype(np.int64).tobytes())
    yield pa.RecordBatch.from_pydict(
        out, pa.schema([("range", pa.int32()), *((k, pa.binary()) for k in ("quotients", "lengths", "remainders", "counts"))])
    )


def _merge_range(table: pa.Table) -> pa.Table:
    parts = [
        (np.frombuffer(r["quotients"], np.uint64), np.frombuffer(r["lengths"], np.int32), np.frombuffer(r["remainders"], np.uint64), np.frombuffer(r["counts"], np.int64))
        for r in table.to_pylist()
    ]
    quotients, lengths, remainders, counts = merge_filters(parts)
    values = (np.repeat(quotients, lengths) << np.uint64(REMAINDER_BITS)) | remainders
    repeated = counts > 1
    prints = (values[repeated] ^ np.uint64(1 << 63)).view(np.int64)
    return pa.table({"fingerprint": pa.array(prints, pa.int64()), "n_prints": pa.array(counts[repeated], pa.int64())})


def repeated_fingerprints(digests: DataFrame) -> DataFrame:
    """fingerprint, n_prints of the fingerprints that the merged filter counts more than once."""
    parts = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_bits = min(20, max(8, math.ceil(math.log2(4 * parts))))
    blocks = digests.select("fingerprint").mapInArrow(
        _partition_filters(range_bits), "range int, quotients binary, lengths binary, remainders binary, counts binary"
    )
    return blocks.groupBy("range").applyInArrow(_merge_range, "fingerprint long, n_prints long")


def verified_groups(docs: DataFrame, digests: DataFrame, row: str = "row") -> DataFrame:
    """A stored table of the groups of two and more equal texts: fingerprint, sha, n_rows, and best, the row that stays.

    digests: stored, of digest_table(), with a column row of any orderable type besides doc_id. best is a struct
    (less, none, doc_id, row): most code points, then least doc_id, null ids last, then least row.
    """
    repeated = stored(repeated_fingerprints(digests), "repeated")
    rows = join_weighted(digests, repeated, ["fingerprint"], "n_prints", "left_semi")
    place = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))
    groups = stored(rows.groupBy("fingerprint", "sha").agg(F.count("*").alias("n_rows"), F.min(place).alias("best")).filter("n_rows > 1"), "groups")
    texts = _slim(docs, ()).mapInArrow(_digests(True), "fingerprint long, sha binary, norm binary")
    known = groups.select("fingerprint", "sha", "n_rows")
    texts = texts.join(F.broadcast(known.drop("n_rows")), ["fingerprint", "sha"], "left_semi") if small(known) else join_weighted(texts, known, ["fingerprint", "sha"], "n_rows", "left_semi")
    bounds = texts.groupBy("fingerprint", "sha").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    unlike = bounds.filter("least <> most").select("fingerprint", "sha").limit(1).collect()
    if unlike:
        raise ValueError(f"different texts with one SHA-256 digest: {unlike[0]['sha'].hex()}")
    return groups


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; null counts as empty, so null,
    empty and blank texts are one group. Of a group the row with the most code points stays, then the
    smallest doc_id, of any orderable type; a null doc_id comes after all others. Rows that share a doc_id share its
    outcome. Other columns of docs are ignored; an empty table gives an empty result.
    """
    digests = stored(digest_table(docs), "digests")
    groups = verified_groups(docs, digests, "doc_id").select("fingerprint", "sha", "n_rows", F.col("best.doc_id").alias("best_id"))
    found = join_weighted(digests, stored(groups, "groups"), ["fingerprint", "sha"], "n_rows")
    keep = F.when(F.col("n_rows").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n_rows", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts; same columns.

    The row that stays is chosen as in exact_groups, but by a key of its own for each row, so that repeated and
    missing doc_ids neither save a copy nor take a row of another group along. Null, empty and blank texts are one
    group; an empty table stays empty; the texts are only moved where there are too many copies to broadcast their keys.
    """
    rows = keyed_rows(docs)
    keyed = rows.select(ROW, *(F.col("kept").getField(c).alias(c) for c in ("doc_id", "text")))
    digests = stored(digest_table(keyed, ("doc_id", ROW)), "digests")
    groups = verified_groups(keyed, digests, ROW).select("fingerprint", "sha", "n_rows", F.col("best.row").alias("best_row"))
    found = join_weighted(digests, stored(groups, "groups"), ["fingerprint", "sha"], "n_rows", "inner")
    copies = stored(found.filter(F.col(ROW) != F.col("best_row")).select(ROW), "copies")
    return unpacked(without_rows(rows, copies, ROW), docs.columns)
