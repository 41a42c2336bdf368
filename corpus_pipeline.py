"""From raw documents to packed training sequences: five stages, each one of the corpus operators.

Every stage reads what its predecessor kept; all but the last return the columns of documents. In all of them a
null text counts as empty and stays null, a null id is an id like others, rows that agree in id and text are the same
document, which stays as often as it came, further columns (whatever their names) are kept by all but the last stage
and not read, texts are read whole whatever their length, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import language_id, near_dedup, packing, secret_scan, substring_dedup
from wayfare.llm.common import cut


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, if there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, made longer where docs has them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in no learned language: those without a letter (null and empty texts too), and those
    whose chance against strange texts is below what sample documents of the learned languages reach. Without any
    labelled document no language is learned, so nothing can be told and all documents stay."""
    model = language_id.train(docs)
    if not model["groups"]:
        return docs
    lang, score, known = _fresh(docs, "_lang", "_score", "_known")
    told = language_id.classify(docs, model, keep=tuple(docs.columns), pred=lang, score=score, known=known)
    return told.where((F.col(lang) != "und") & (F.col(known) >= model["least"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id: five-word shingles, similarity
    0.8 or more. Documents without a word are like no other and stay."""
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out every byte run of 100 or more that also stands earlier in the corpus, and characters cut by one; every
    document stays, if need be with an empty text."""
    return _measured(substring_dedup.remove_repeats(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets, as [EXAMPLE_SECRET] where many owners have the value; every document stays."""
    return _measured(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence; an empty text is one token."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: Tokens, trained weights and hashes are not for SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
