"""Corpus cleaning in five stages over documents; part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.llm import kneser_ney, linededup, packing, partenum, toxicity
from quaylight.llm.common import made_within, save, small_batches
from quaylight.llm.queries import table, tokenizer_path


def _slim(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that a stage reads, and all others in one, so that no name of theirs can clash with an operator's."""
    return docs.select(*own, F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in own]).alias("_rest"))


def _wide(out: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of docs again, in their order."""
    return out.select(*[F.col(c) if c in own else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexities are within their language's thresholds.

    Null and empty texts, and those without words, go. Repeated rows share a fate; any further columns stay.
    """
    small_batches(spark)
    own = ("doc_id", "text", "lang")
    return _wide(kneser_ney.keep_good(_slim(docs, *own), table(spark, sf_dir, "labels")), docs, *own)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learned from the labelled ones among docs that aren't held out.

    A null or empty text has the score of the bias alone. Repeated rows share a fate; any further columns stay.
    """
    small_batches(spark)
    own = ("doc_id", "text")
    slim = _slim(docs, *own)
    return _wide(toxicity.score(slim, toxicity.train(slim.select(*own), table(spark, sf_dir, "labels")), "_toxicity").where("_toxicity < 0.5"), docs, *own)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages and chunks of lines, n_chars anew; a document of which nothing is left goes.

    Null and empty texts stay as they are; rows that repeat id and text count as one document; any further columns stay.
    """
    own = ("doc_id", "text")
    out = _wide(linededup.dedup_passages(_slim(docs, *own)).where("removed_lines = 0 or text <> ''"), docs, *own)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by links: that with the smallest doc_id. Five words and a similarity of 0.8.

    Rows that share a doc_id share its fate; rows without a doc_id are kept.
    """
    small_batches(spark)
    return partenum.first_of_groups(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens. Null and empty texts have the end id alone; each row is a document; further columns go."""
    small_batches(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality", quality), ("toxicity", toxic), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("packing", pack)]
#: Trained models, hashes of token ids and packing plans aren't SQL's; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each written as Parquet and reread. What a stage has read and what it made on its way goes once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with made_within() as made:
            out = stage(spark, docs, sf_dir)
        docs = save(out, docs, *made)
    return docs
