"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Each source's target is its weight's part of all words, at most `limit` times its own size;
the excess is shared out again by weight. A target is taken as whole passes over the source plus a part of one
more pass. Documents are dealt by hash into `cells` cells for each source, so that no source, however large,
is one group; a cell in one pass is a block. The partial pass takes cells in a permuted order up to its quota;
the cell at the edge is dealt again by further bits of the hash, and only the last sub-cell is summed row by row.
The document at the very edge gives the words that are still missing, so each source meets its rounded target.

The blocks are then spread over the output shards: a binary tree over the shards splits every source's
block count by a multivariate-hypergeometric draw, computed with SQL functions, until each shard has exact
quotas. Each source's blocks, in a permuted order, fill the shards' quotas in turn: disjoint draws. mix() tells
for each document which shards draw it; sharded() and write_shards() make the shards, the document at an edge cut to
its words, and shuffle the rows of each by a hash.

Everything is DataFrame work; tables that grow with the rows are only dealt by (source, cell).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import free_name, let, small, stored

WEIGHTS = (5, 2, 1)
LIMIT = 3
CELLS = 256
SHARDS = 16
SEED = 11
#: Blocks that are broadcast at most, about 300 bytes each: those of four hundred sources with 256 cells.
BLOCK_ROWS = 100_000
PRIME = 1_000_003  # over the number of any source's blocks, (limit + 1) * cells


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ln_factorial(n: Column) -> Column:
    x = n.cast("double")
    small = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(10)))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 10, F.get(small, n.cast("int"))).otherwise(series)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of `good` items are among `draws` of `total`, by inversion of u in [0, 1)."""
    mean = draws.cast("double") * good / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(mean * (1 - good / F.greatest(total, F.lit(1))), F.lit(0.0)))
    least = F.greatest(F.lit(0).cast("long"), draws + good - total, F.floor(mean - 9 * spread) - 2)
    most = F.least(good, draws, F.ceil(mean + 9 * spread) + 2)

    def draw(s: Column) -> Column:
        n, k, d, lo, hi = (s[x] for x in ("n", "k", "d", "lo", "hi"))
        ln = _ln_factorial
        start = F.exp(
            ln(k) - ln(lo) - ln(k - lo) + ln(n - k) - ln(d - lo) - ln(n - k - d + lo) - ln(n) + ln(d) + ln(n - d)
        )
        state = F.struct(lo.alias("at"), start.alias("p"), s["u"].alias("left"), F.lit(False).alias("done"))

        def step(a: Column, i: Column) -> Column:
            stop = a["done"] | (a["left"] < a["p"]) | (a["at"] >= hi)
            ratio = (k - a["at"]).cast("double") * (d - a["at"]) / ((a["at"] + 1) * F.greatest(n - k - d + a["at"] + 1, F.lit(1)))
            on = F.struct((a["at"] + 1).alias("at"), (a["p"] * ratio).alias("p"), (a["left"] - a["p"]).alias("left"), F.lit(False).alias("done"))
            return F.when(stop, F.struct(a["at"].alias("at"), a["p"].alias("p"), a["left"].alias("left"), F.lit(True).alias("done"))).otherwise(on)

        return F.aggregate(F.sequence(lo, hi), state, step, lambda a: a["at"])

    given = F.struct(*(c.cast("long").alias(a) for c, a in ((total, "n"), (good, "k"), (draws, "d"), (least, "lo"), (most, "hi"))), u.alias("u"))
    return let(given, draw)


def split_blocks(root: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """root: one row with counts array<long>. Returns shard, counts: each shard's quota of every entry."""
    nodes = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts")
    for _ in range(math.ceil(math.log2(max(shards, 2)))):
        mid = F.expr("(lo + hi) div 2").cast("int")
        every = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        state = F.struct(every.alias("rest"), F.expr("0L").alias("quota"), F.array().cast("array<long>").alias("out"))
        state = state.withField("quota", F.floor(every * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long"))

        def draw(a: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), "lo", "hi", F.size(a["out"])), F.lit(1 << 52)) / float(1 << 52)
            return let(hypergeometric(a["rest"], x, a["quota"], u), lambda k: F.struct((a["rest"] - x).alias("rest"), (a["quota"] - k).alias("quota"), F.concat(a["out"], F.array(k)).alias("out")))

        left = F.aggregate("counts", state, draw, lambda a: a["out"])
        nodes = nodes.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, left))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        halves = F.when(F.col("left").isNull(), F.array(F.struct("lo", "hi", "counts"))).otherwise(
            F.array(F.struct("lo", mid.alias("hi"), F.col("left").alias("counts")), F.struct(mid.alias("lo"), "hi", right.alias("counts")))
        )
        # one small job for each level keeps the plans, and with them the driver's memory, small
        nodes = stored(nodes.select(halves.alias("halves")).select(F.inline("halves")), "nodes")
    return nodes.select(F.col("lo").alias("shard"), "counts")


def _rank(cell: Column, cells: int, salt: int) -> Column:
    """The cell's place in its source's permuted order."""
    step = next(p for p in (167, 173) if cells % p)  # no factor of cells, so that no two cells share a place
    return F.pmod(cell * step + F.pmod(F.xxhash64("src", F.lit(salt)), F.lit(cells)), F.lit(cells)).cast("int")


def _edge(cells: Column, quota: Column) -> Column:
    """The first cell, in order, that no longer fits in the quota: its place, and the words left for it."""
    start = F.struct(F.lit(-1).alias("place"), F.lit(-1).alias("cell"), quota.cast("long").alias("words"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        stop = F.struct(x["place"].alias("place"), x["cell"].alias("cell"), a["words"].alias("words"), F.lit(True).alias("done"))
        on = F.struct(F.lit(-1).alias("place"), F.lit(-1).alias("cell"), (a["words"] - x["words"]).alias("words"), F.lit(False).alias("done"))
        return F.when(a["done"], a).when(x["words"] > a["words"], stop).otherwise(on)

    return F.aggregate(cells, start, step)


def targets(totals: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """totals: src, source, total. Returns idx, src, source, total, target. One row for each source.

    The weights repeat over the sources in the order of src.
    """
    one = totals.groupBy().agg(F.sort_array(F.collect_list(F.struct("src", "source", "total"))).alias("s"))
    w = F.array(*(F.lit(float(x)) for x in weights))
    every = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["total"])
    one = one.select(
        F.transform("s", lambda x, i: F.struct((limit * x["total"] / F.get(w, i % len(weights))).alias("ratio"), i.alias("idx"), F.get(w, i % len(weights)).alias("w"), x.alias("x"))).alias("s"),
        every.cast("double").alias("every"),
    )
    state = F.struct(F.col("every").alias("left"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"]).alias("weight"))

    def fill(a: Column, x: Column) -> Column:
        full = F.struct((a["left"] - limit * x["x"]["total"]).alias("left"), (a["weight"] - x["w"]).alias("weight"))
        return F.when(a["left"] > x["ratio"] * a["weight"], full).otherwise(a)

    level = F.aggregate(F.array_sort("s"), state, fill, lambda a: F.when(a["weight"] > 0, a["left"] / a["weight"]))
    one = one.select(level.alias("level"), "s").select("level", F.explode("s").alias("e"))
    cap = limit * F.col("e.x.total").cast("double")
    return one.select("e.idx", "e.x.src", "e.x.source", "e.x.total", F.coalesce(F.least(cap, F.col("level") * F.col("e.w")), cap).alias("target"))


def _dealt_words(rows: DataFrame, words: Column) -> DataFrame:
    """rows with extra: what each gives of its source's words, dealt in the order of key and place of reading.

    A key's rows are summed for each partition they were read in before anything is sorted, so a row that is repeated a billion
    times is one sum for each partition; row by row, only rows of one key and partition are summed.
    """
    rows = rows.withColumn("read_in", F.shiftright("at", 33))
    sums = rows.groupBy("src", "key", "read_in").agg(F.sum("size").alias("own"))
    before = F.sum("own").over(Window.partitionBy("src").orderBy("key", "read_in").rowsBetween(Window.unboundedPreceding, -1))
    sums = stored(sums.select("src", "key", "read_in", F.coalesce(before, F.lit(0)).alias("before")), "edges")
    rows = rows.join(F.broadcast(sums) if small(sums) else sums, ["src", "key", "read_in"])
    run = F.sum("size").over(Window.partitionBy("src", "key", "read_in").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run)
    left = words - F.col("before") - (F.col("run") - F.col("size"))
    return rows.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least("size", left))).drop("read_in", "before", "run")


def mix(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT, cells: int = CELLS, shards: int = SHARDS, seed: int = SEED, carry: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, draws; with carry also row, all of its columns.

    draws: array of (shard, words, place) for each time the mix takes the document; rows of a shard are
    ordered by place. taken is the sum of the draws' words, at most limit * size. A null text has size 0 and is
    never drawn; rows without a source form one source, the last. Rows without doc_id and repeated rows are
    dealt like others. If no document has words, all targets are 0; an empty table gives none. A document of any
    length is one row of a block. The plan is one row with a few numbers for each source, so it is made for up to some
    ten thousand sources. Other columns are ignored.
    """
    if not 1 <= cells <= 4096:
        raise ValueError("cells: from 1 to 4096")
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    sized = docs.select(
        "doc_id", "source", text_size(F.col("text")).alias("size"), key.alias("key"),
        F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("src"), *row,
    )
    cell = lambda shift: F.pmod(F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << 30) - 1)), F.lit(cells)).cast("int")
    sized = stored(sized.select("*", cell(34).alias("c0"), cell(4).alias("c1"), F.monotonically_increasing_id().alias("at")), "sized")

    by_cell = sized.groupBy("src", "source", "c0").agg(F.sum("size").alias("words"))
    by_source = by_cell.groupBy("src", "source").agg(
        F.sum("words").alias("total"),
        F.sort_array(F.collect_list(F.struct(_rank(F.col("c0"), cells, 0).alias("place"), F.col("c0").alias("cell"), "words"))).alias("cells"),
    )
    by_source = stored(by_source, "sources")
    plan = targets(by_source.select("src", "source", "total"), weights, limit).join(by_source.select("src", "cells"), "src")
    want = F.round("target").cast("long")
    passes = F.when(F.col("total") > 0, F.expr("CAST(round(target) AS BIGINT) div total")).otherwise(0).cast("long")
    plan = plan.select("idx", "src", "total", "target", "cells", passes.alias("passes"), want.alias("want"))
    plan = plan.withColumn("edge0", _edge(F.col("cells"), F.col("want") - F.col("passes") * F.col("total")))
    part = F.when(F.col("edge0.place") < 0, F.size("cells")).otherwise(F.col("edge0.place")) + F.when(F.col("edge0.words") > 0, 1).otherwise(0)
    plan = stored(plan.withColumn("n_blocks", F.col("passes") * cells + F.when(F.col("total") > 0, part).otherwise(0)).drop("cells"), "plan")

    at_edge = plan.select("src", F.col("edge0.cell").alias("c0"), F.col("edge0.words").alias("words0"))
    inside = sized.join(at_edge, ["src", "c0"]).groupBy("src", "words0", "c1").agg(F.sum("size").alias("words"))
    inside = inside.groupBy("src", "words0").agg(
        F.sort_array(F.collect_list(F.struct(_rank(F.col("c1"), cells, 1).alias("place"), F.col("c1").alias("cell"), "words"))).alias("cells")
    )
    plan = plan.join(inside.select("src", _edge(F.col("cells"), F.col("words0")).alias("edge1")), "src", "left")

    leaves = split_blocks(plan.groupBy().agg(F.sort_array(F.collect_list(F.struct("idx", "n_blocks"))).alias("n")).select(F.col("n.n_blocks").alias("counts")), shards, seed)
    quotas = leaves.select("shard", F.posexplode("counts").alias("idx", "quota")).groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("q"))
    ends = F.transform("q", lambda x, i: F.aggregate(F.slice("q", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["quota"]))
    plan = stored(plan.join(quotas.select("idx", ends.alias("ends")), "idx"), "quotas")

    blocks = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("c0"))
    blocks = blocks.withColumn("place0", _rank(F.col("c0"), cells, 0))

    def shard_of(block: Column) -> Column:
        turn = F.pmod(block * PRIME + F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(PRIME)), F.greatest("n_blocks", F.lit(1)))
        return F.size(F.filter("ends", lambda e: e <= turn))

    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest("passes", F.lit(1)) - 1), lambda p: shard_of(p * cells + F.col("place0")))
    blocks = blocks.select(
        "src", "c0", "place0", "total", "target", "passes", "edge0", "edge1",
        F.when(F.col("passes") > 0, whole).otherwise(F.array().cast("array<int>")).alias("whole"),
        shard_of(F.col("passes") * cells + F.col("place0")).alias("part"),
    )
    blocks = stored(blocks, "blocks")
    rows = sized.join(F.broadcast(blocks) if small(blocks, BLOCK_ROWS) else blocks, ["src", "c0"]).withColumn("place1", _rank(F.col("c1"), cells, 1))
    edge = (F.col("place0") == F.col("edge0.place")) & (F.col("place1") == F.col("edge1.place"))
    before = (F.col("edge0.place") < 0) | (F.col("place0") < F.col("edge0.place")) | (
        (F.col("place0") == F.col("edge0.place")) & ((F.col("edge1.place") < 0) | (F.col("place1") < F.col("edge1.place")))
    )
    edge, before = (F.coalesce(x, F.lit(False)) for x in (edge, before))
    outer = rows.filter(~edge).withColumn("extra", F.when(before, F.col("size")).otherwise(0).cast("long"))
    last = _dealt_words(rows.filter(edge), F.col("edge1.words"))
    rows = outer.unionByName(last)

    def drawn(shard: Column, words: Column, p: Column) -> Column:
        return F.struct(shard.alias("shard"), words.alias("words"), F.xxhash64("key", p).alias("place"))

    whole = F.when(F.col("size") > 0, F.transform("whole", lambda s, i: drawn(s, F.col("size"), i)))
    part = F.when(F.col("extra") > 0, F.array(drawn(F.col("part"), F.col("extra"), F.lit(-1))))
    nothing = F.array().cast("array<struct<shard:int,words:bigint,place:bigint>>")
    return rows.select(
        "doc_id", "source", "size", F.col("total").alias("source_size"), "target",
        (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"),
        F.concat(F.coalesce(whole, nothing), F.coalesce(part, nothing)).alias("draws"), *(["row"] if carry else []),
    )


def first_words(text: Column, words: Column) -> Column:
    """text up to the end of its words-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")


def sharded(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: one row for each draw, with shard, place, words and the columns of docs.

    A document that a source's target takes in part has its text cut after the words taken. Rows are in the order
    (shard, place) across and within partitions, so a shard is shuffled wherever it is cut, and no shard is one task.
    Columns of docs called shard, place or words are kept, as doc_shard and so on.
    """
    drawn = mix(docs, carry=True, **options).select("row", "size", F.inline("draws"))
    text = F.when(F.col("words") < F.col("size"), first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    own = [(text if c == "text" else F.col("row").getField(c)).alias(free_name(docs.columns, f"doc_{c}") if c.lower() in ("shard", "place", "words") else c) for c in docs.columns]
    # the draws are many more rows than partitions of the mix, and their number is only known to Spark
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.select("shard", "place", "words", *own).repartitionByRange(parts, "shard", "place").sortWithinPartitions("shard", "place")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes sharded() as Parquet, a folder shard=n for each shard; its files follow each other in the order of place."""
    sharded(docs, **options).write.partitionBy("shard").parquet(path)
