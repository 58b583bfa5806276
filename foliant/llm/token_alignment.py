"""Alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizers cut the same bytes: A, a byte-level BPE, encodes a space and the text; B, a piece BPE with byte fallback,
encodes the text and adds that space. The merged order of A's and B's token ends is a path through the grid of (A, B); its
crossing with a diagonal i + j = d is found by binary search, without merging what lies before. Diagonals at equal steps cut
every document into pieces of equal work, each a row of its own: a very long document is spread over the tasks like many
short ones. A piece finds the ends that A and B share; they cut its tokens into groups. What a piece has before its first
and after its last shared end belongs to groups that cross pieces, and is stitched for each document in the order of its pieces.

Tokens are written once (ids only, no texts); the corpus-wide counts of linked ids, and then the documents' answers, read
that table. The tokenizers' files are read by the driver and sent to the executors, a few MB whatever the corpus.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_ROWS, give_back, stored

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Tokens of A and B together in one piece.
PIECE = 1 << 16
#: Bytes of a batch's texts that are encoded together.
SLICE_BYTES = 1 << 20
#: Words, and tokens of theirs, that a worker keeps before it begins anew; new words that are encoded as one text.
CACHE_WORDS, CACHE_TOKENS, JOINED_WORDS = 200_000, 4_000_000, 500
#: Tokens of pieces that are aligned in one go.
SLICE_TOKENS = 1 << 20
#: Neither tokenizer has a token over this place: A starts a word there, and no piece of B holds a space but at its start.
SAFE_CUT = re.compile(r"(?<=[^\s\u180e\u200b\ufeff])(?= \w)")
#: A word between two such places.
INNER = re.compile(r" \w(?s:.*)(?<=[^\s\u180e\u200b\ufeff])")
#: Fixed value: how the byte-level tokenizer cuts a text into words.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes between the pieces' ends when many are searched together, over the bytes of any text.
APART = 1 << 40


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoders:
    """Both tokenizers of a Python worker, the bytes of their tokens, and the tokens of the words met so far.

    good[k] tells whether the tokens of word k give its bytes.
    """

    def __init__(self, file_a: bytes, file_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(file_a.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=file_b)
        alphabet = _byte_alphabet()
        self.special = special = {t["id"] for t in json.loads(file_a).get("added_tokens", []) if t.get("special")}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = token.encode() if k in special else bytes(alphabet[c] for c in token)
        self.ascii_a = self._ranked(json.loads(file_a))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.lengths = tuple(np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self._forget()

    def _ranked(self, content: dict):
        """A faster encoder of the same vocabulary, for ASCII texts; none where the file's merges are not in the order of their ids.

        Classes of other characters may differ between the libraries' Unicode tables, those of ASCII do not.
        """
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        made = [content["model"]["vocab"].get("".join(m)) for m in merges]
        if None in made or made != sorted(made) or content.get("normalizer") or (content.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or content["pre_tokenizer"].get("add_prefix_space"):
            return None
        import tiktoken

        ranks = {b: k for k, b in enumerate(self.bytes_a) if k not in self.special}
        if len(ranks) + len(self.special) != len(self.bytes_a):
            return None
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.good = np.empty(0, bool)
        self.pools = [np.empty(0, np.int32)] * 2
        self.ends = [np.zeros(1, np.int64)] * 2  # word k has pool[ends[k] : ends[k + 1]]

    def parts(self, text: str) -> list[str]:
        """text after a space, in words that both tokenizers encode as they do the whole."""
        return SAFE_CUT.split(" " + text) if self.cuttable else [" " + text]

    def _both(self, text: str) -> tuple[list[int], list[int], bool]:
        """Ids of A and of B for a text that begins with a space, and whether both give its bytes."""
        a = self.ascii_a.encode_ordinary(text) if self.ascii_a and text.isascii() else self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:], num_threads=1)
        return a, b, b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b]) == text.encode("utf-8", "surrogatepass")

    def _learn(self, words: set[str], edges: set[str]) -> None:
        """Adds words; edges: those that may begin or end a text.

        Words from within texts can follow each other, so many are encoded as one text, and its tokens dealt to them by their bytes.
        """
        odd = {w for w in edges if not INNER.fullmatch(w)}
        kinds: tuple[list[str], list[str]] = [], []
        for w in words - odd:
            kinds[w.isascii()].append(w)
        blocks = [some[k : k + JOINED_WORDS] for some in kinds for k in range(0, len(some), JOINED_WORDS)] + [[w] for w in odd]
        pools, sizes, good = ([], []), ([], []), []
        while blocks:
            block = blocks.pop()
            *ids, same = self._both("".join(block))
            if not same and len(block) > 1:
                blocks += [[w] for w in block]
                continue
            ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in block])
            for side, (own, length) in enumerate(zip(ids, self.lengths, strict=True)):
                own = np.array(own, np.int32)
                pools[side].append(own)
                if len(block) > 1:
                    cuts = np.searchsorted(np.cumsum(length[own]), ends, side="right")
                    sizes[side].append(np.diff(cuts, prepend=0))
                else:
                    sizes[side].append(np.array([len(own)]))
            self.words.update(zip(block, range(len(self.words), len(self.words) + len(block)), strict=True))
            good.append(np.full(len(block), same))
        if good:
            self.good = np.concatenate([self.good, *good])
            for side in (0, 1):
                self.pools[side] = np.concatenate([self.pools[side], *pools[side]])
                self.ends[side] = np.concatenate([self.ends[side], self.ends[side][-1] + np.cumsum(np.concatenate(sizes[side]))])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B for each text; none where a text is empty or the tokens do not give its bytes."""
        if len(self.words) > CACHE_WORDS or len(self.pools[0]) > CACHE_TOKENS:
            self._forget()
        parts = [self.parts(t) if t else [] for t in texts]
        known = self.words.keys()
        self._learn(set().union(*parts) - known, {w for x in parts if x for w in (x[0], x[-1])} - known)
        sizes = [len(x) for x in parts]
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        bad = np.concatenate([[0], np.cumsum(~self.good[numbers])])
        whole = bad[ends[1:]] == bad[ends[:-1]]
        out = []
        for pool, own in zip(self.pools, self.ends, strict=True):
            starts, lengths = own[numbers], own[numbers + 1] - own[numbers]
            at = np.concatenate([[0], np.cumsum(lengths)])
            flat = pool[np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)]
            cuts = at[ends]
            out.append([flat[lo:hi] if ok else flat[:0] for lo, hi, ok in zip(cuts[:-1], cuts[1:], whole, strict=True)])
        return tuple(out)


def crossing(ends_a: np.ndarray, ends_b: np.ndarray, diagonal: int) -> tuple[int, int]:
    """How many of A's and B's ends are the first `diagonal` of their merged order; an end they share is never parted.

    Both rise strictly. Of equal ends A's comes first, and takes B's with it.
    """
    lo, hi = max(0, diagonal - len(ends_b)), min(diagonal, len(ends_a))
    # the first i for which A's next end comes after the last of B's taken
    i = lo + bisect.bisect_left(range(lo, hi), True, key=lambda i: bool(ends_a[i] > ends_b[diagonal - 1 - i]))
    j = diagonal - i
    if i and j < len(ends_b) and ends_a[i - 1] == ends_b[j]:
        j += 1
    return i, j


def cut_pieces(ends_a: np.ndarray, ends_b: np.ndarray, work: int = PIECE) -> list[tuple[int, int, int, int]]:
    """(A from, A to, B from, B to) of pieces with `work` ends each, one more at most, in order."""
    total = len(ends_a) + len(ends_b)
    marks = [crossing(ends_a, ends_b, d) for d in range(work, total, work)]
    points = [(0, 0), *marks, (len(ends_a), len(ends_b))]
    return [(i, k, j, m) for (i, j), (k, m) in zip(points, points[1:], strict=False)]


def _texts(column: pa.Array) -> list[str]:
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:  # bytes that are no text have no tokens

        def read(x: pa.Scalar) -> str:
            try:
                return x.as_py() or ""
            except UnicodeDecodeError:
                return ""

        return [read(x) for x in column]


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with `most` together, or one alone."""
    lo = total = 0
    for k, n in enumerate(sizes):
        if k > lo and total + n > most:
            yield lo, k
            lo, total = k, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


PIECES = "piece int, pieces int, start_a long, start_b long, ids_a array<int>, ids_b array<int>"
ALIGNED = "n_a long, n_b long, link_a array<int>, link_b array<int>"
SIDES = ["start_a", "start_b", "ids_a", "ids_b"]


def _tokenise(files, work: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(*files.value)
        lengths, names = encoders.lengths, _names(encoders.lengths)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rest = [k for k in range(batch.num_columns) if k != at]
            for lo, hi in _slices(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), SLICE_BYTES):
                rows, piece, pieces, starts, lists = [], [], [], ([], []), ([], [])
                both = encoders.encode(_texts(batch.column(at).slice(lo, hi - lo)))
                for row, ids in enumerate(zip(*both, strict=True), lo):
                    ends = [np.cumsum(length[x]) for length, x in zip(lengths, ids, strict=True)] if len(ids[0]) + len(ids[1]) > work else None
                    own = cut_pieces(*ends, work) if ends else [(0, len(ids[0]), 0, len(ids[1]))]
                    for k, (i, j, p, q) in enumerate(own):
                        rows.append(row)
                        piece.append(k)
                        pieces.append(len(own))
                        for side, (x, y) in enumerate(((i, j), (p, q))):
                            starts[side].append(int(ends[side][x - 1]) if x else 0)
                            lists[side].append(ids[side][x:y])
                cut = pa.array([n > 1 for n in pieces], pa.bool_())
                sides = [*(pa.array(x, pa.int64()) for x in starts), *(_list(x) for x in lists)]
                # a piece that is a whole document is aligned here; the pieces of longer ones are dealt to other tasks
                alone = pc.indices_nonzero(pc.invert(cut))
                made = align_pieces(*(x.take(alone) for x in sides), lengths, names)
                digest = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in made.pop("body").to_pylist()], pa.string())
                back = pa.array(np.where(cut.to_numpy(zero_copy_only=False), 0, np.cumsum(~cut.to_numpy(zero_copy_only=False)) - 1), pa.int64(), mask=cut.to_numpy(zero_copy_only=False))
                told = [x.take(back) for x in (made["n_a"], made["n_b"], made["link_a"], made["link_b"], digest)]
                # null where not needed, so that only long documents' ids are written
                kept = [x.take(pa.array(range(len(rows)), pa.int64(), mask=~cut.to_numpy(zero_copy_only=False))) for x in sides]
                taken = [batch.column(k).take(pa.array(rows, pa.int64())) for k in rest]
                columns = [*taken, pa.array(piece, pa.int32()), pa.array(pieces, pa.int32()), *kept, *told]
                yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[k] for k in rest), "piece", "pieces", *SIDES, "n_a", "n_b", "link_a", "link_b", "groups_sha256"])
        del encoders
        give_back()

    return run


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and where each row's begin, with the end."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _grouped(names: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), names.take(pa.array(ids))), ",")


def _names(lengths) -> pa.Array:
    """Ids as text."""
    return pa.array([str(k) for k in range(max(map(len, lengths)))])


def align_pieces(start_a: pa.Array, start_b: pa.Array, ids_a: pa.ListArray, ids_b: pa.ListArray, lengths: tuple[np.ndarray, np.ndarray], names: pa.Array) -> dict[str, pa.Array]:
    """n_a, n_b, link_a, link_b, body, head_a, head_b, tail_a, tail_b of some pieces, each found for itself, all in one go.

    links: A's and B's id at each shared end. head: ids up to the first shared end; tail: those after the last one (all, if there is
    none); both as text. body: the groups between, as text; of a piece whose tail is empty and which begins a document, all groups.
    """
    (a, from_a), (b, from_b) = _flat(ids_a), _flat(ids_b)
    rows = len(ids_a)

    def ends(ids: np.ndarray, offsets: np.ndarray, starts: pa.Array, length: np.ndarray) -> np.ndarray:
        runs = np.concatenate([[0], np.cumsum(length[ids])])
        return runs[1:] + np.repeat(starts.to_numpy() - runs[offsets[:-1]] + APART * np.arange(rows), np.diff(offsets))

    ends_a, ends_b = ends(a, from_a, start_a, lengths[0]), ends(b, from_b, start_b, lengths[1])
    at = np.searchsorted(ends_b, ends_a)
    shared = np.flatnonzero((at < len(b)) & (ends_b[np.minimum(at, len(b) - 1)] == ends_a)) if len(b) else np.empty(0, np.int64)
    pair = at[shared]
    linked = np.searchsorted(shared, from_a)  # where each piece's links begin
    offsets = pa.array(linked.astype(np.int32))
    link_a, link_b = (pa.ListArray.from_arrays(offsets, pa.array(ids[k])) for ids, k in ((a, shared), (b, pair)))
    # every piece has one group more than links: what follows the last one
    first = linked + np.arange(rows + 1)
    cuts = [np.sort(np.concatenate([x, cut])) for x, cut in ((shared + 1, from_a), (pair + 1, from_b))]
    joined_a, joined_b = (_grouped(names, ids, cut) for ids, cut in zip((a, b), cuts, strict=True))
    groups = pc.binary_join_element_wise(joined_a, joined_b, "|")
    few = np.diff(linked) == 0
    heads, tails = first[:-1], first[1:] - 1
    closed = (np.diff(from_a) > 0) & (start_a.to_numpy() == 0) & (start_b.to_numpy() == 0) & ~few
    lows = np.where(closed, heads, np.minimum(heads + 1, tails))
    sizes = np.concatenate([[0], np.cumsum(tails - lows)])
    between = np.arange(sizes[-1]) + np.repeat(lows - sizes[:-1], tails - lows)
    body = pc.binary_join(pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), groups.take(pa.array(between, pa.int64()))), ";")
    at_head = pa.array(heads, pa.int64(), mask=few | closed)
    return {
        "n_a": pa.array(np.diff(from_a)), "n_b": pa.array(np.diff(from_b)), "link_a": link_a, "link_b": link_b, "body": body,
        "head_a": pc.fill_null(joined_a.take(at_head), ""), "head_b": pc.fill_null(joined_b.take(at_head), ""),
        "tail_a": joined_a.take(pa.array(tails, pa.int64())), "tail_b": joined_b.take(pa.array(tails, pa.int64())),
    }


def _align(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = tables.value
        names = _names(lengths)
        for batch in batches:
            weights = (pc.list_value_length(batch.column("ids_a")).to_numpy() + pc.list_value_length(batch.column("ids_b")).to_numpy()).tolist()
            carried = [n for n in batch.schema.names if n not in SIDES]
            for lo, hi in _slices(weights, SLICE_TOKENS):
                some = batch.slice(lo, hi - lo)
                made = align_pieces(*(some.column(n) for n in SIDES), lengths, names)
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in carried), *made.values()], names=[*carried, *made])

    return run


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each document's groups from its pieces in order, piece by piece."""
    for batch in batches:
        out = []
        for pieces in batch.column("parts"):
            digest, open_a, open_b, begun = hashlib.sha256(), [], [], False

            def tell(text: str) -> None:
                nonlocal begun
                digest.update((";" if begun else "").encode() + text.encode())  # noqa: B023
                begun = True

            for p in pieces.as_py():
                if p["n_links"]:
                    if open_a or open_b:  # else the piece begins the document, and its body has all of its groups
                        tell("|".join(",".join(filter(None, [*x, p[k]])) for x, k in ((open_a, "head_a"), (open_b, "head_b"))))
                    if p["body"]:
                        tell(p["body"])
                    open_a, open_b = [], []
                open_a.append(p["tail_a"])
                open_b.append(p["tail_b"])
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "groups_sha256"])


def _read(*paths: str) -> tuple[bytes, ...]:
    content = []
    for path in paths:
        with open(path, "rb") as f:
            content.append(f.read())
    return tuple(content)


def tokens(docs: DataFrame, file_a: str = f"{FOLDER}/{FILE_A}", file_b: str = f"{FOLDER}/{FILE_B}", key: str = "doc_id", work: int = PIECE) -> DataFrame:
    """The pieces of every row's tokens, as a stored table: row, key, piece, pieces, and what PIECES and ALIGNED name.

    row is a number of its own for each row of docs, so rows without id, repeated ids and repeated rows stay apart. A document of
    one piece is aligned already and has a digest of its groups; pieces of longer ones have their ids, and where they start in bytes.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col("text").cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()
    files = docs.sparkSession.sparkContext.broadcast(_read(file_a, file_b))
    return stored(slim.mapInArrow(_tokenise(files, work), f"row long, key {kind}, {PIECES}, {ALIGNED}, groups_sha256 string"), "tokens")


def aligned_pieces(made: DataFrame, file_a: str = f"{FOLDER}/{FILE_A}", file_b: str = f"{FOLDER}/{FILE_B}") -> DataFrame:
    """tokens() of long documents, dealt anew piece by piece and aligned, as a stored table: row, key, piece, the columns of align_pieces()."""
    kind = made.schema["key"].dataType.simpleString()
    tables = made.sparkSession.sparkContext.broadcast(Encoders(*_read(file_a, file_b)).lengths)
    texts = ", ".join(f"{c} string" for c in ("body", "head_a", "head_b", "tail_a", "tail_b"))
    long = made.filter("pieces > 1").select("row", "key", "piece", *SIDES).repartition("row", "piece")
    return stored(long.mapInArrow(_align(tables), f"row long, key {kind}, piece int, {ALIGNED}, {texts}"), "aligned")


def links(pieces: DataFrame) -> DataFrame:
    """row, pair of every link: A's id in the upper, B's in the lower 32 bits."""
    both = pieces.select("row", F.explode(F.arrays_zip("link_a", "link_b")).alias("l"))
    return both.select("row", F.shiftleft(F.col("l.link_a").cast("long"), 32).bitwiseOR(F.col("l.link_b").cast("long")).alias("pair"))


def link_counts(linked: DataFrame) -> DataFrame:
    """pair, n (its links in all documents), best (n is the highest of its B id), as a stored table."""
    counts = stored(linked.groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    own = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(own.alias("b")).agg(F.max("n").alias("most"))  # at most one row for each id of B
    return stored(counts.withColumn("b", own).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def with_counts(linked: DataFrame, counts: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """linked (a column pair) with n and best. The commonest pairs, `rows` at most, are broadcast; only links of rarer ones are shuffled."""
    if counts.count() <= rows:
        return linked.join(F.broadcast(counts), "pair")
    # of all counts of 1, 2, ... the least from which on no more than `rows` pairs are left
    by_count = counts.groupBy("n").agg(F.count("*").alias("pairs")).withColumn("step", F.floor(F.log2("n") * 16))
    steps = sorted(((r[0], r[1]) for r in by_count.groupBy("step").agg(F.sum("pairs")).collect()), reverse=True)  # 16 * 63 at most
    common, bound = 0, 16 * 64
    for step, pairs in steps:
        if common + pairs > rows:
            break
        common, bound = common + pairs, step
    is_common = F.floor(F.log2("n") * 16) >= bound
    hot, rare = F.broadcast(counts.filter(is_common)), counts.filter(~is_common)
    return linked.join(hot, "pair").unionByName(linked.join(hot.select("pair"), "pair", "left_anti").join(rare, "pair"), allowMissingColumns=True)


def align(docs: DataFrame, file_a: str = f"{FOLDER}/{FILE_A}", file_b: str = f"{FOLDER}/{FILE_B}", key: str = "doc_id", work: int = PIECE) -> DataFrame:
    """One row for each row of docs: the key column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null, empty, or whose tokens do not give back a space and the text (one that holds U+2581, say) have no tokens:
    zeros and an empty digest. Token bytes are never empty, so ends rise strictly and each group has one link. Texts are
    encoded word by word, cut where that changes no token; a text with no such place is encoded whole. The stitch of one
    document holds the names of its groups, about its tokens' ids as text. An empty table gives none; other columns are ignored.
    """
    made = tokens(docs, file_a, file_b, key, work)
    long = aligned_pieces(made, file_a, file_b)
    short = ["row", "key", "n_a", "n_b", "link_a", "link_b"]
    pieces = made.filter("pieces = 1").select(*short, "groups_sha256").unionByName(long.select(*short), allowMissingColumns=True)
    linked = links(pieces)
    counted = with_counts(linked, link_counts(linked))
    looked = counted.groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    zero = F.lit(0).cast("long")
    told = pieces.select("row", "key", "n_a", "n_b", F.size("link_a").cast("long").alias("n_links"), zero.alias("n_best"), zero.alias("count_sum"), "groups_sha256")
    part = F.struct("piece", F.size("link_a").alias("n_links"), "body", "head_a", "head_b", "tail_a", "tail_b")
    stitched = long.groupBy("row").agg(F.sort_array(F.collect_list(part)).alias("parts")).mapInArrow(_stitch, "row long, groups_sha256 string")
    every = told.unionByName(looked, allowMissingColumns=True).unionByName(stitched, allowMissingColumns=True)
    total = lambda c: F.sum(c).alias(c)
    out = every.groupBy("row").agg(F.max("key").alias(key), total("n_a"), total("n_b"), F.sum("n_links").alias("n_groups"), total("n_links"), total("n_best"), total("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return out.drop("row")


def linked_ids(docs: DataFrame, file_a: str = f"{FOLDER}/{FILE_A}", file_b: str = f"{FOLDER}/{FILE_B}", key: str = "doc_id", work: int = PIECE) -> DataFrame:
    """The corpus-wide dictionary of the two tokenizers: a, b (ids), n (links), best (whether no other A id has more with that B id)."""
    made = tokens(docs, file_a, file_b, key, work)
    pieces = made.filter("pieces = 1").select("row", "link_a", "link_b").unionByName(aligned_pieces(made, file_a, file_b).select("row", "link_a", "link_b"))
    counts = link_counts(links(pieces))
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n", "best")
