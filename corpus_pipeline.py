"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes each stage's
result as Parquet in the shared folder and reads it again, so a lost executor costs no finished stage.

Every stage tells rows apart by rows, never by doc_id: rows without id, repeated rows and rows that share an id are judged
each by its own text. Columns of any name are carried, texts of any length are read whole, and an empty table stays
empty. Null, empty and blank texts have no letter and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixing
from foliant.llm.common import free_name, id_crc, read_table, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go. Learned as in op1."""
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    return language_id.keep_identified(docs, language_id.train(docs.filter(~held_out)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group linked by 3-word shingles at 0.9 stays."""
    return jaccard_join.keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents with their words, taken words and draws (shard, words, place in the shard).

    Where docs has a column of such a name, the new one gets an underscore before it.
    """
    drawn = mixing.mix(docs, carry=True).filter("taken > 0")
    new = [F.col(c).alias(free_name(docs.columns, c)) for c in ("size", "source_size", "target", "taken", "draws")]
    return drawn.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *new)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", benchmark),
    ("mixing", mixture),
]

#: Compression and hashed draws have no SQL form; tests/llm holds run() against a plain version, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
