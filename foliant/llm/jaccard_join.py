"""Jaccard self-join on word n-grams: a grouped prefix join.

Two sets can only reach the threshold if their prefixes, the first few shingles under one global order,
share a shingle. The order puts rare shingles first. Documents with the same set are one class; classes with
the same size and the same prefix are one group, and only groups are joined on prefix shingles. Group pairs
pass a size filter and a positional filter, then expand to their member classes, whose whole sets are compared.

A group of near copies would still make a quadratic number of pairs. So the posting lists are first joined to
one pivot each, which gives at most one pair for each posting; the verified links of these star joins
are merged into components. After that, or after more rounds with other pivots, the remaining pairs are those of
one posting list whose classes lie in different components, and all of these are verified. Pairs inside one
component need no check, as they cannot change which documents are reachable. Nothing is capped or sampled.
These pairs are not emitted: lists are compared inside tasks, long ones in blocks against blocks, on parity bitmaps
of the sets. The bits in which two bitmaps differ are at most as many as the shingles in which the sets do, so only
pairs that may link come out. A pivot is the class with the fewest shingles of its own, which in a group of near
copies is the text they were copied from.

Frequencies are counted over all shingles of all documents: tasks hand on sorted blocks of shingles, cut by hash
range, and each range is merged by itself. What comes out are bitmaps that tell which shingles occur at least twice
and which reach three further levels; they give the order. As at most total / level shingles reach a level, levels
go up with the corpus where a bitmap of 16 MB would fill up, so the frequent ones are told apart at any size. Shingles
whose first bit is not set occur once, so they can share nothing and need no posting. Collisions in a bitmap change
the order and the speed, never the result.

Words are hashed by seeded XXH3 to 64 bits, which has no linear structure that unlike words could share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_ROWS, ROW, give_back, join_salted, join_weighted, keyed_rows, sliced, small, stored, unpacked, without_rows
from foliant.llm.components import connected_components

#: A-Z lower-cased, ASCII white space as space, all other bytes as they are.
SPLIT_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
STAR_ROUNDS = 1
#: Bits of a frequency bitmap and of the bitmap of wanted classes at most (16 MB and 32 MB), and the least levels.
LEVEL_BITS = 27
WANTED_BITS = 28
LEVELS = (2, 8, 64, 512)
#: Bits of a set's parity bitmap; rows of a block of a long list, and about those of a unit of short lists.
PARITY_BITS = 1024
LIST_BLOCK = 2048
#: Shingles in a task's open block.
BLOCK = 1 << 22
SEED = 0x5EED_0F_70_1A_27

_rng = np.random.default_rng(20)
_MIX = _rng.integers(1, 1 << 63, 16, np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None, split: bytes = SPLIT_BYTES) -> np.ndarray:
    """A 64-bit hash of each word; split maps bytes, those between words to spaces."""
    words = (text or b"").translate(split).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def shingles(text: bytes | None, n: int = 3) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams; of a shorter text, of all its words as one."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(n, len(words))
    last = len(words) - n + 1
    total = np.full(last, np.uint64(n * int(_STEP) % 2**64))
    for k in range(n):
        total += words[k : k + last] * _MIX[k % 16]
    total = np.sort(_mixed(total))
    return total[_firsts(total)]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])


def _packed(values: np.ndarray) -> bytes:
    """Sorted uint32 values: differences, their bytes by place, compressed."""
    gaps = np.diff(values, prepend=np.uint32(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint32), dtype=np.uint32)


def _blocks(n: int, range_bits: int):
    """Distinct shingles of a block of texts with their counts, by hash range; 32 bits below those of the range."""

    def cut(values: np.ndarray) -> pa.RecordBatch:
        # in place, and each range by itself: all but the block is a 2 ** range_bits-th of it
        values >>= np.uint64(32 - range_bits)
        values.sort()
        bounds = np.searchsorted(values, np.arange((1 << range_bits) + 1, dtype=np.uint64) << np.uint64(32))
        ranges = np.flatnonzero(bounds[1:] > bounds[:-1])
        lows, counts = [], []
        for part in (values[bounds[r] : bounds[r + 1]] for r in ranges):
            first = _firsts(part)
            lows.append(_packed(part[first].astype(np.uint32)))
            counts.append(zstandard.compress(np.diff(first, append=len(part)).astype(np.uint32).tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(lows, pa.binary()), pa.array(counts, pa.binary())], ["range", "low", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = np.empty(BLOCK, np.uint64), 0
        for batch in batches:
            for x in batch.column(0):
                s = shingles(x.as_py(), n)
                while len(s):
                    part, s = s[: BLOCK - size], s[BLOCK - size :]
                    block[size : size + len(part)] = part
                    size += len(part)
                    if size == BLOCK:
                        yield cut(block)
                        size = 0
        if size:
            yield cut(block[:size])
        block = batch = s = part = None
        give_back()

    return run


def levels_of(total: int, range_bits: int) -> list[tuple[int, int]]:
    """(level, bits) of each bitmap for a corpus of about total shingles; a range fills whole bytes of each."""
    base = max(LEVELS[1], math.ceil(total / (1 << (LEVEL_BITS - 1))))
    levels = [LEVELS[0], *(base * x // LEVELS[1] for x in LEVELS[1:])]
    return [(x, min(LEVEL_BITS, max(20, range_bits + 3, math.ceil(math.log2(total / x + 1)) + 1))) for x in levels]


def _levels(range_bits: int, levels: list[tuple[int, int]]):
    """Merges the blocks of a range into its segment of each bitmap."""

    def merge(table: pa.Table) -> pa.Table:
        low = np.concatenate([_unpacked(x.as_py()) for x in table.column("low")])
        counts = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), np.uint32) for x in table.column("counts")]).astype(np.int64)
        order = np.argsort(low, kind="stable")
        low, counts = low[order], counts[order]
        first = _firsts(low)
        low, counts = low[first], np.add.reduceat(counts, first)
        out = {"range": table.column("range")[:1]}
        for k, (level, bits) in enumerate(levels):
            flags = np.zeros(1 << (bits - range_bits), bool)
            flags[low[counts >= level] >> np.uint32(32 + range_bits - bits)] = True
            out[f"level{k}"] = pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())
        return pa.table(out)

    return merge


def frequency_bitmaps(texts: DataFrame, n: int) -> list[np.ndarray]:
    """texts: one binary column. A bitmap for each level, by the first bits of a shingle."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    range_bits = min(20, max(8, math.ceil(math.log2(4 * parts))))
    total = (texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0) // 4 + 1  # of words, rather too many
    levels = levels_of(total, range_bits)
    blocks = texts.mapInArrow(_blocks(n, range_bits), "range long, low binary, counts binary")
    names = [f"level{k}" for k in range(len(levels))]
    merged = blocks.groupBy("range").applyInArrow(_levels(range_bits, levels), "range long, " + ", ".join(f"{x} binary" for x in names))
    out = [np.zeros(1 << (bits - 3), np.uint8) for _, bits in levels]
    for r in merged.collect():
        for bitmap, name in zip(out, names, strict=True):
            size = len(r[name])
            bitmap[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r[name], np.uint8)
    return out


def frequency_class(found: np.ndarray, bitmaps: list[np.ndarray]) -> np.ndarray:
    """How many of the levels each shingle reaches, as far as the bitmaps tell."""
    out = np.zeros(len(found), np.uint8)
    for bitmap in bitmaps:
        bit = (found >> np.uint64(64 - 3 - (len(bitmap) - 1).bit_length())).astype(np.int64)
        out += bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & np.uint8(1)
    return out


def _prefixes(n: int, num: int, den: int, bitmaps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, rare, classes, groups, places, prefixes = [], [], [], [], [], []
            for x in batch.column("bytes"):
                s = shingles(x.as_py(), n)
                sizes.append(len(s))
                if not len(s):
                    rare.append(0), classes.append(None), groups.append(None), places.append([]), prefixes.append([])
                    continue
                take = len(s) - -(-num * len(s) // den) + 1
                often = frequency_class(s, bitmaps.value)
                order = np.argsort(often, kind="stable")[:take]
                rare.append(int((often == 0).sum()))
                prefix = s[order]
                open_ = np.flatnonzero(often[order])
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                groups.append(int.from_bytes(hashlib.blake2b(prefix.tobytes(), digest_size=8, key=str(len(s)).encode()).digest(), "big", signed=True))
                places.append(open_)
                prefixes.append(prefix[open_].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(rare, pa.int64()), pa.array(classes, pa.binary()), pa.array(groups, pa.int64()),
                    pa.array(places, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "rare", "cls", "grp", "pos", "shingle"],
            )
        batch = sizes = rare = classes = groups = places = prefixes = None
        give_back()

    return run


def parity(found: np.ndarray) -> bytes:
    """A bitmap: whether an odd number of the shingles falls on each bit."""
    bits = np.bincount((found & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(bool), bitorder="little").tobytes()


def _sets(n: int, wanted, wanted_bits: int):
    """The sets of the classes that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in sliced(batches):
            classes, sets, parities, seen = [], [], [], set()
            for x in batch.column(0):
                s = shingles(x.as_py(), n)
                if not len(s) or (c := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) in seen:
                    continue
                bit = int.from_bytes(c[:4], "big") >> (32 - wanted_bits)
                if bits[bit >> 3] >> (bit & 7) & 1:
                    seen.add(c)
                    classes.append(c)
                    sets.append(s.view(np.int64))
                    parities.append(parity(s))
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(parities, pa.binary())], ["cls", "shingles", "parity"]
            )
        batch = classes = sets = parities = seen = bits = None
        give_back()

    return run


def _bitmap(bits: DataFrame, size: int) -> np.ndarray:
    """bits: one column with numbers under 2 ** size. A bit for each number, whatever the input's size."""
    bit = F.col(bits.columns[0]).cast("long")
    rows = bits.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(1 << (size - 3), np.uint8)
    for r in rows:
        out[r["part"] << 12 : (r["part"] << 12) + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - F.col("both")
    # a pivot's pairs are as many as its group or list has classes: its set is copied to several parts of them
    pairs = stored(pairs, "pairs")
    return (
        join_salted(join_salted(pairs, left, "a", "b"), right, "b", "a", pairs).select("a", "b", both.alias("both"), "sa", "sb")
        .filter(F.col("both") * den >= union * num).select("a", "b")
    )


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def jaccard_classes(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, star_rounds: int = STAR_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(members, components): doc_id, n_shingles, cls of every row, and cls, component of classes with links.

    Two sets link when den * intersection >= num * union.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("bytes"))

    bitmaps = spark.sparkContext.broadcast(frequency_bitmaps(texts.select("bytes"), n))
    members = stored(
        texts.mapInArrow(_prefixes(n, num, den, bitmaps), f"doc_id {kind}, n_shingles long, rare long, cls binary, grp long, pos array<long>, shingle array<long>"),
        "prefixes",
    )
    filled = members.filter("n_shingles > 0")
    classes = stored(filled.select("cls", "grp", "n_shingles", "rare").distinct(), "classes")
    # grp is a 64-bit digest of size and prefix; should two groups share it, they only make more candidates
    groups = filled.filter("size(shingle) > 0").select("grp", "n_shingles", "pos", "shingle").distinct()
    groups = stored(groups.select("grp", "n_shingles", F.explode(F.arrays_zip("pos", "shingle")).alias("p")).select("grp", "n_shingles", "p.pos", "p.shingle"), "postings")
    # two sets of sizes x <= y can only link if the first shared shingle is this early in the smaller set
    early = F.col("pos") < F.col("n_shingles") - F.ceil(F.col("n_shingles") * (2 * num) / (num + den)) + 2
    # sizes of a pair lie in one band or in neighbouring bands, so each posting goes to its own band and the next
    band = F.floor(F.log("n_shingles") / math.log(den / num * (1 + 1e-6)))
    banded = groups.withColumn("early", early.cast("int")).withColumn("band", F.explode(F.array(band, band + 1)))
    lists = banded.groupBy("shingle", "band").agg(F.count("*").alias("n"), F.max("early").alias("early")).filter("n > 1 AND early = 1")
    postings = stored(banded.join(lists.select("shingle", "band"), ["shingle", "band"], "left_semi").drop("early"), "postings")

    crowded = classes.groupBy("grp").agg(F.count("*").alias("n_classes")).filter("n_classes > 1").select("grp")
    wanted = classes.join(postings.select("grp").union(crowded).distinct(), "grp", "left_semi")
    wanted_bits = min(WANTED_BITS, max(20, classes.count().bit_length() + 3))
    bit = F.shiftrightunsigned(F.conv(F.substring(F.hex("cls"), 1, 8), 16, 10).cast("long"), 32 - wanted_bits)
    bits = spark.sparkContext.broadcast(_bitmap(wanted.select(bit.alias("bit")), wanted_bits).tobytes())
    sets = texts.select("bytes").mapInArrow(_sets(n, bits, wanted_bits), "cls binary, shingles array<long>, parity binary")
    sets = stored(sets.groupBy("cls").agg(F.first("shingles").alias("shingles"), F.first("parity").alias("parity")), "sets")

    comp = classes.select("cls", "grp", "n_shingles", "rare", F.col("cls").alias("component"))
    links = None
    for k in range(max(star_rounds, 1)):
        pairs = _star_pairs(comp, postings, k, num, den)
        found = _verified(pairs, sets, num, den)
        links = stored(found if links is None else links.union(found), "links")
        comp = _labelled(classes, connected_components(links))
    pairs = _cross_pairs(comp, postings, sets, num, den)
    links = stored(links.union(_verified(pairs, sets, num, den)), "links")
    return members.select("doc_id", "n_shingles", "cls"), connected_components(links)


def _labelled(classes: DataFrame, found: DataFrame) -> DataFrame:
    label = F.coalesce("component", "cls").alias("component")
    return stored(classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "grp", "n_shingles", "rare", label), "labels")


def _size_ok(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _star_pairs(comp: DataFrame, postings: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Each class with the pivot of its group, and one class of each group with the pivot of its posting lists.

    The first pivot has the fewest shingles of its own; later ones are the smallest under a hash that changes with
    the round. Pairs of one component are left out.
    """
    first = F.col("rare") if k == 0 else F.lit(0).cast("long")
    key = F.struct(first.alias("rare"), F.xxhash64("cls", F.lit(k)).alias("h"), "cls", "component", "n_shingles")
    heads = comp.groupBy("grp").agg(F.min(key).alias("head"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    heads = stored(heads, "heads")
    inner = join_weighted(comp, heads.filter("lo <> hi").select("grp", "head", "n"), ["grp"], "n", "inner").filter(F.col("component") != F.col("head.component"))
    inner = inner.select(*_ordered(F.col("cls"), F.col("head.cls")))
    # a group has as many entries as its prefix has open shingles
    entries = postings.select("shingle", "band", "grp").join(heads.select("grp", "head"), "grp")
    pivots = entries.groupBy("shingle", "band").agg(
        F.min("head").alias("pivot"), F.min("head.component").alias("lo"), F.max("head.component").alias("hi"), F.count("*").alias("n")
    )
    pivots = stored(pivots.filter("lo <> hi").select("shingle", "band", "pivot", "n"), "pivots")
    outer = join_weighted(entries, pivots, ["shingle", "band"], "n", "inner").filter(
        (F.col("head.component") != F.col("pivot.component")) & _size_ok(F.col("head.n_shingles"), F.col("pivot.n_shingles"), num, den)
    )
    return inner.union(outer.select(*_ordered(F.col("head.cls"), F.col("pivot.cls")))).distinct()


def _compared(num: int, den: int):
    """Pairs of a unit's lists, of different components, whose sizes and parity bitmaps allow a link."""

    def run(table: pa.Table) -> pa.Table:
        keys = [table.column(c).to_numpy() for c in ("key", "band", "i", "j")]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        change = np.any([k[1:] != k[:-1] for k in keys], axis=0) if len(order) > 1 else np.empty(0, bool)
        cuts = np.flatnonzero(np.r_[True, change, True])
        table = table.take(pa.array(order))
        names = table.column("cls").to_pylist()
        numbers: dict[bytes, int] = {}
        comps = np.array([numbers.setdefault(c, len(numbers)) for c in table.column("component").to_pylist()])
        sizes, block = table.column("n_shingles").to_numpy(), table.column("block").to_numpy()
        bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(len(names), -1)
        found: set[tuple[bytes, bytes]] = set()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            same = keys[2][lo] == keys[3][lo]
            left = np.arange(lo, hi) if same else lo + np.flatnonzero(block[lo:hi] == keys[2][lo])
            right = left if same else lo + np.flatnonzero(block[lo:hi] == keys[3][lo])
            for at in range(0, len(left), 64):
                rows = left[at : at + 64]
                total = sizes[rows][:, None] + sizes[right][None, :]
                least = -(-num * total // (num + den))
                may = (comps[rows][:, None] != comps[right][None, :]) & (least <= np.minimum(sizes[rows][:, None], sizes[right][None, :]))
                a, b = np.nonzero(may)
                if same:
                    a, b = a[rows[a] < right[b]], b[rows[a] < right[b]]
                if len(a):
                    differ = np.zeros(len(a), np.int64)
                    for w in range(bits.shape[1]):
                        differ += np.bitwise_count(bits[rows[a], w] ^ bits[right[b], w])
                    near = differ <= total[a, b] - 2 * least[a, b]
                    found.update(tuple(sorted((names[x], names[y]))) for x, y in zip(rows[a[near]], right[b[near]], strict=True))
        pairs = sorted(found)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})

    return run


def _cross_pairs(comp: DataFrame, postings: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of classes of one group or posting list that lie in different components and may link."""
    crowded = comp.select(F.col("grp").alias("key"), F.lit(-1).cast("long").alias("band"), "cls", "component", "n_shingles")
    listed = join_salted(comp.select("grp", "cls", "component", "n_shingles"), postings.select("grp", F.col("shingle").alias("key"), "band"), "grp", "cls")
    entries = crowded.unionByName(listed.drop("grp"))
    spread = entries.groupBy("key", "band").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    spread = stored(spread.filter("lo <> hi").select("key", "band", "n"), "lists")
    entries = stored(join_weighted(entries, spread, ["key", "band"], "n", "inner"), "spread")
    # a class stands in as many lists as its prefix has open shingles, so few classes are broadcast and not dealt
    parities = sets.select("cls", "parity")
    entries = stored(entries.join(F.broadcast(parities) if small(sets, BROADCAST_ROWS // 2) else parities, "cls"), "entries")
    units = max(1, -(-entries.count() // LIST_BLOCK))
    blocks = F.ceil(F.col("n") / LIST_BLOCK)
    entries = entries.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), blocks))
    entries = entries.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    entries = entries.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    unit = F.when(F.col("blocks") > 1, F.xxhash64("key", "band", "i", "j")).otherwise(F.pmod(F.xxhash64("key", "band"), F.lit(units)))
    columns = ["key", "band", "i", "j", "block", "cls", "component", "n_shingles", "parity"]
    found = entries.select(unit.alias("unit"), *columns).groupBy("unit").applyInArrow(_compared(num, den), "a binary, b binary")
    return found.distinct()


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    component_id: the smallest doc_id reachable by links, its own included. Null, empty and blank texts have
    no shingles and link with nothing, so each is its own component. Rows without doc_id link like others;
    their component_id is null only if no row of their component has an id. Repeated rows each get a row.
    An empty table gives an empty result; other columns are ignored.
    """
    members, components = jaccard_classes(docs, **options)
    least = members.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows"))
    labels = least.join(components.select(F.col("node").alias("cls"), "component"), "cls", "left")
    labels = stored(labels.select("cls", "least_id", "n_rows", F.coalesce("component", "cls").alias("component")), "labelled")
    ids = stored(labels.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_classes")), "component-ids")
    labels = stored(join_weighted(labels, ids, ["component"], "n_classes").select("cls", "n_rows", "component_id"), "class-ids")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return join_weighted(members, labels, ["cls"], "n_rows").select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component, and all rows without words; same columns.

    The row with the smallest doc_id stays; a null one comes after all others. Components are made over a key
    of its own for each row, so a doc_id that several rows share neither saves a copy nor drops another text, and of
    repeated rows one stays. An empty table stays empty; the texts are only moved where there are too many copies to
    broadcast their keys.
    """
    rows = keyed_rows(docs)
    keyed = rows.select(ROW, *(F.col("kept").getField(c).alias(c) for c in ("doc_id", "text")))
    found = jaccard_components(keyed.select(F.col(ROW).alias("doc_id"), "text"), **options)
    linked = stored(found.filter("n_shingles > 0").select(F.col("doc_id").alias(ROW), "component_id"), "linked")
    crowded = stored(linked.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1"), "crowded")
    members = stored(join_weighted(linked, crowded, ["component_id"], "n", "left_semi"), "members")
    ids = keyed.select(ROW, F.col("doc_id").alias("id"))
    members = stored((ids.join(F.broadcast(members), ROW) if small(members) else ids.join(members, ROW)), "members")
    place = F.struct(F.col("id").isNull().alias("none"), "id", ROW)
    best = members.groupBy("component_id").agg(F.min(place).alias("best")).select(F.col(f"best.{ROW}").alias(ROW))
    copies = stored(without_rows(members.select(ROW), stored(best, "best"), ROW), "copies")
    return unpacked(without_rows(rows, copies, ROW), docs.columns)
