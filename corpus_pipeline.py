"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of ``documents``; the last returns the pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.llm.common import table
from curbflow.llm.decontaminate import contamination
from curbflow.llm.near_duplicates import near_duplicates
from curbflow.llm.packing import packed
from curbflow.llm.queries import tokenizer
from curbflow.llm.secrets import redact_secrets
from curbflow.llm.shared_tables import written
from curbflow.llm.toxicity import labelled_texts, score_toxicity, train_toxicity

#: Score from which a document counts as toxic.
TOXIC = 0.7
#: Percent of common shingles of five words from which documents are near-duplicates.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below TOXIC; the model is learned from labelled documents, a bounded number of them.

    Null and empty texts score low and stay; repeated rows stay repeated;
    without labels nothing is learned and all stay.  Texts of any length are
    scored whole, other columns are kept as they are, an empty table stays empty.
    """
    model = train_toxicity(labelled_texts(docs, table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs, model, score_col="__score")
    return scored.where(F.col("__score") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Rows that repeat a doc_id and text count as one; an id's other texts are
    documents of their own; rows without a doc_id, and texts without words,
    stay.  An empty table stays empty.
    """
    found = near_duplicates(docs, threshold=NEAR).where("kept and doc_id is not null")
    kept = found.select("doc_id", F.col("mark").alias("__mark")).distinct()
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    one = marked.join(kept, ["doc_id", "__mark"], "left_semi").dropDuplicates(["doc_id", "__mark"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item.

    Null and empty texts stay, as do repeated rows; an empty benchmark drops nothing.
    Texts of any length are scanned whole; only the columns of docs come back.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and n_chars to match; null texts stay null.

    Repeated rows stay repeated, other columns are kept, texts of any length are
    scanned whole, an empty table stays empty.
    """
    clean = redact_secrets(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens, each with its ids; a null or empty text is its end id alone.

    Rows that repeat a doc_id are documents of their own, other columns aren't
    looked at, a long text is cut into many pieces, an empty table has none.
    """
    return packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages that learn; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
