"""A corpus pipeline: four operators applied to ``documents`` one after another.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last keep the columns of ``documents``. Null, empty and wordless texts fail
the quality rules; an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modelgate.llm import dartminhash, packing, repetition, toxicity
from modelgate.llm.common import cut, table
from modelgate.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the suffix-array repetition rule."""
    return repetition.keep_quality(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier, trained on the labelled
    documents at hand, does not flag at the threshold of their language."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    flagged = toxicity.flag(docs, model)
    return flagged.where(~flagged[flagged.columns[-1]]).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return dartminhash.near_duplicate_free(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in the packed sequences. The
    stages before leave the executors' heaps large, so texts are tokenised
    in small slices."""
    documents = docs.select("doc_id", "text")
    return packing.pack(documents, tokenizer_path("word_bpe_49k.json"), with_ids=False, slice_bytes=2 << 20)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("minhash_dedup", minhash_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the near-duplicates and the tokenizer are beyond SQL; the
#: tests hold the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
