"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts. A text
is compressed with every dictionary in turn, whole, in blocks; the language whose dictionary gives the
fewest bytes wins. A text whose two smallest sizes are too close is rejected.

Blocks keep a long text from being compressed by its own earlier content, which would drown the
dictionary's share; every block of the text counts. A run of zero bytes after the text makes every last block
compressible: otherwise zstandard stores a short text as it is, with one size for all languages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.llm.common import give_back, packed, sliced, unpacked

UNKNOWN = "und"
#: Bounds of the training sample for each language: texts, and characters taken from one text.
SAMPLE_TEXTS = 600
PASSAGE_CHARS = 300
#: The least that the format allows; shorter content is filled up with line ends.
LEAST_BYTES = 8
BLOCK_BYTES = 8192
LEVEL = 6
TAIL = b"\0" * 300
#: Least margin of the second over the best size, as a part of the best, not to be rejected.
MIN_MARGIN = 0.001


def train(labelled: DataFrame, lang: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """A dictionary for each non-null language. Takes at most about sample_texts passages of each to the driver.

    The passages are chosen by a hash of id and text, so reruns agree; copies of one passage count once.
    """
    usable = labelled.filter(F.col(lang).isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in usable.groupBy(lang).agg(F.count("*")).collect()}
    if not counts:
        return {}
    key = F.xxhash64("doc_id", F.length("text"))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_texts / n))))
    start = F.pmod(key, F.greatest(F.length("text") - PASSAGE_CHARS, F.lit(1))).cast("int") + 1
    rows = (
        usable.filter(F.pmod(key, F.lit(1 << 30)) < share[F.col(lang)] * (1 << 30))
        .select(F.col(lang).alias("lang"), key.alias("key"), F.lower(F.substr("text", start, F.lit(PASSAGE_CHARS))).alias("passage"))
        .distinct().collect()  # repeated rows have one key
    )
    out: dict[str, bytes] = {}
    for name in sorted(counts):
        passages = dict.fromkeys(r["passage"] for r in sorted(rows, key=lambda r: (r["key"], r["passage"])) if r["lang"] == name)
        if passages:
            out[name] = "\n".join(passages).encode().ljust(LEAST_BYTES, b"\n")
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = sorted(dictionaries)
        self.compressors = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode("utf-8", "surrogatepass") + TAIL
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def judge(self, text: str) -> tuple[str, float, float]:
        """Language, score, margin."""
        sizes = self.sizes(text)
        best = min(sizes)
        rest = sorted(sizes)[1:2]
        margin = (rest[0] - best) / best if rest else 1.0
        scale = 1 + 0.02 * best
        return self.names[sizes.index(best)], 1 / sum(math.exp((best - s) / scale) for s in sizes), margin


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(model.value) if model.value else None
        for batch in sliced(batches):
            at = batch.schema.get_field_index("text")
            out = [judge.judge(x.as_py()) if judge and x.is_valid else (UNKNOWN, 0.0, 0.0) for x in batch.column(at)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            langs, scores, margins = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                names=[*names, "lang_pred", "score", "margin"],
            )
        judge = batch = out = columns = langs = scores = margins = None
        give_back()

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], carry: list[Column | str] = ("doc_id",), min_margin: float = MIN_MARGIN) -> DataFrame:
    """carry columns, lang_pred, score, margin, rejected for every row of docs.

    lang_pred is `und`, with score 0 and rejected, where text is null or has no letter, and everywhere if no
    dictionary was learned. With one language only, nothing else is rejected. Ties go to the language that
    sorts first and are rejected. Texts of any length are compressed whole, in blocks. Rows are judged one by one, so
    repeated rows each get a row and an empty table gives none. Only the columns in carry and text are read.
    """
    judged = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))  # null if there is nothing to judge
    slim = docs.select(*carry, judged.alias("text"))
    schema = StructType([f for f in slim.schema if f.name != "text"]).add("lang_pred", "string").add("score", "double").add("margin", "double")
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)
    out = slim.mapInArrow(_judge(model), schema)
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("margin") < min_margin))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs without the rejected rows; same columns, no shuffle."""
    found = identify(docs, dictionaries, [packed(docs).alias("row")], min_margin).filter(~F.col("rejected"))
    return unpacked(found, docs.columns, "row")
