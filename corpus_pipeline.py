"""From raw documents to token shards: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Rows are told apart by 128 bits of hashes over all their
columns, so rows that share a doc_id, or have none, stay separate; rows that repeat
wholly are judged alike, and end as one in the near-duplicate stage. Columns that a stage
adds take names that ``documents`` does not have.

Nulls in any column, empty and very long texts, ties and empty tables are handled by the
operators as their docstrings say; each stage says what follows for its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import Scratch, fresh, row_key
from colloquy.llm.decontaminate import decontaminate
from colloquy.llm.minhash import near_duplicates
from colloquy.llm.mixing import mix_sources
from colloquy.llm.quality_rules import quality_rules
from colloquy.llm.tokens import read_tokens, write_tokens


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with their row key, and the key's column."""
    key = fresh(docs.columns, "row_key")
    return docs.withColumn(key, row_key(docs.columns)), key


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts fail the base rules and go."""
    keyed, key = _keyed(docs)
    verdicts = quality_rules(keyed.select(F.col(key).alias("doc_id"), "text", "lang"))
    kept = verdicts.where("kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").select(*_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates; one without a doc_id only where all are.

    Of rows that tie, the one with the smallest row key stays. Documents without words are
    alone in their group.
    """
    keyed, key = _keyed(docs)
    groups = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id").distinct()
    ids = keyed.select(key, "doc_id").dropDuplicates([key])
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key).alias("at")))
    kept = groups.join(ids, key).groupBy("component_id").agg(first.alias("first")).select(F.col("first.at").alias(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*_own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, each judged by its text. An empty benchmark removes none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without words are never taken."""
    keyed, key = _keyed(docs)
    copies = mix_sources(keyed.select("doc_id", "source", "text", key), keep=(key,)).where("n_copies > 0")
    # rows that repeat wholly share a key: they are taken as often as all of them together
    n = fresh(keyed.columns, "n_copies")
    copies = copies.groupBy(key).agg(F.sum("n_copies").cast("int").alias(n))
    taken = keyed.dropDuplicates([key]).join(copies, key)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*_own(docs))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back: doc_id, start, n_tokens, ids_crc32. Null doc_ids come first."""
    path = Scratch(spark, "pipeline-tokens").path()
    write_tokens(docs, path)
    return read_tokens(spark, path)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", mixing),
    ("token_output", token_output),
]

#: SQL can't tokenize; tests/llm holds the pipeline against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
