"""A training corpus from raw documents: classify, remove repeated lines, remove near-duplicates, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes every stage's rows to the shared
folder and reads them back as the next one's documents, so a stage never repeats the work of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import classifier, common, linededup, mixing, packing, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; trained on the labelled ones among ``docs``."""
    weights = classifier.train(docs, common.table(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, weights)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated lines; a text that loses all its lines becomes empty."""
    done = linededup.dedup_lines(docs, linededup.PASSAGE_WORDS)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), that with the smallest id."""
    return simhash.keep_one(docs, shingle=5, radius=4, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (up to three times); those it doesn't take go."""
    return mixing.repeat_taken(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of every document lie in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the trained classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.durable(docs, name)
    return docs
