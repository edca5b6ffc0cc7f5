"""Queries of the training-data operators over the given tables.

Each query applies its operator, with production parameters, to the whole
table it is meant for, and derives the digest columns of its result from the
operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgate.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, which every executor has."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every whole document, and whether
    decoding them gives its text back."""
    from modelgate.llm.nbest import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"], with_ids=False)


@query("op2_embedding_dedup")
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings, compared within equal labels."""
    from modelgate.llm.cosine import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from modelgate.llm.boilerplate import extract_text

    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences whose whole texts stand in each document."""
    from modelgate.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in the packed sequences."""
    from modelgate.llm.packing import pack

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(documents, tokenizer_path("word_bpe_49k.json"), with_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op6_url_filters")
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rule or by its path template."""
    from modelgate.llm.url_templates import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), keep=["page_id"])


@query("op7_minhash_dedup")
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, one row per document: class_id
    is the smallest doc_id of its class, kept says whether that is its own."""
    from modelgate.llm.dartminhash import near_duplicates

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = near_duplicates(documents).withColumnRenamed("id", "doc_id")
    ids = documents.select("doc_id")
    return ids.join(classes, "doc_id", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("class_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
    )


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document. The classifier learns from the
    labels whose crc32 remainder is not 0; the others are held out."""
    from modelgate.llm import toxicity

    documents = table(spark, sf_dir, "documents")
    remainder = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5))
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), allowed=remainder(F.col("id__")) != 0)
    scored = toxicity.score(documents, model, keep=["doc_id", "lang"])
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= toxicity.threshold_column(model, F.col("lang"))).alias("flagged"),
    )


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, learned without true labels."""
    from modelgate.llm import weak_quality

    documents = table(spark, sf_dir, "documents")
    scored = weak_quality.score(documents, weak_quality.fit(documents), keep=["doc_id"])
    return scored.withColumn("kept", F.col("score") >= 0.5)


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-array repetition and base counts of every document."""
    from modelgate.llm.repetition import repetition_stats

    return repetition_stats(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "quality.*")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 leading components, scaled to unit variance."""
    from modelgate.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])


@query("op12_pii")
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: counts and digest of the base
    kinds' spans, and all spans."""
    from modelgate.llm import pii

    found = pii.find_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.listed(F.col("spans"), pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query("op13_collocations")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2 000 collocations of two or three words of each language."""
    from modelgate.llm.collocations import mine

    return mine(table(spark, sf_dir, "documents"))


def _oracles() -> None:
    from modelgate.llm import collocations, cosine, licences, url_templates

    ORACLES["op2_embedding_dedup"] = cosine.oracle_sql()
    ORACLES["op4_license_scan"] = licences.oracle_sql()
    ORACLES["op6_url_filters"] = url_templates.oracle_sql()
    ORACLES["op13_collocations"] = collocations.oracle_sql()


_oracles()
