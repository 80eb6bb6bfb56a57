"""From raw documents to token ids, in stages that each call one text operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsweave.llm import decontamination, linededup, sentencepieces, simhash, toxicity
from newsweave.llm.common import read
from newsweave.session import new_folder

TOKENIZERS = "/opt/tokenizers"
MIN_CHARS = 40
MIN_DOCS = 5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the labels of ``sf_dir`` teach the score."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents share stay in the last of them only. All
    documents stay; n_chars follows the text."""
    kept = linededup.deduplicated(docs, MIN_CHARS, MIN_DOCS, "_all_lines", "_lost_lines")
    changed = F.when(F.col("_lost_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id:
    sets of five-word shingles with a similarity of 0.8 or more."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with where it comes from."""
    model = sentencepieces.model_bytes(f"{TOKENIZERS}/piece_bpe_32k.model")
    encoded = sentencepieces.encode(docs, model)
    return encoded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("simhash near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", token_stage),
]

# A learned score decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes a table that the next one reads."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
