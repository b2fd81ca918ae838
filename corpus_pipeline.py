"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each
stage's rows as Parquet in the shared folder and reads them again for the next.
Every stage but the last gives the columns of documents, all of them, whatever their
names. Null texts count as empty ones and stay null where they stay; an empty table
passes through; texts are worked on whole.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyfold.llm import common, packing, secret_scan, simhash, substring_dedup, toxicity

THRESHOLD = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the labelled ones) doesn't reject; a null text scores as an empty one."""
    machine = toxicity.train(spark, docs, common.read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, machine)("text") < THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five-word similarity 0.8); rows without doc_id stay.

    Rows that repeat the kept document's doc_id and text stay with it.
    """
    doc, text = common.spare_names(docs, "copy_id", "copy_hash")
    copies = simhash.near_copies(spark, docs).where("doc_id <> component_id").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(copies, (F.col("doc_id") == F.col(doc)) & (own == F.col(text)), "left_anti")


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that start in an earlier document; other texts stay as they are."""
    common.prepare(spark)

    @pandas_udf("string")
    def kept(texts: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.Series:
        rows = zip(texts, starts, counts, strict=True)
        return pd.Series([None if s is None else b" ".join(substring_dedup.kept_words(t, s, n)[0]).decode("utf-8") for t, s, n in rows], dtype=object)

    cut, starts, counts = substring_dedup.cut(spark, docs)
    text = F.when(F.col(starts).isNull(), F.col("text")).otherwise(kept("text", starts, counts))
    return _with_text(cut, text, docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the secrets found replaced by a mark; null texts stay null."""
    common.prepare(spark)
    (out,) = common.spare_names(docs, "scan")
    scanned = secret_scan.scan(docs, secret_scan.train(spark), out=out)
    return _with_text(scanned, F.col(f"{out}.redacted"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document, with its sequence and place there; rows without doc_id are left out."""
    return packing.pack_documents(spark, docs)


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """docs with a new text, and n_chars to match where the text changed."""
    (new,) = common.spare_names(docs, "new_text")
    out = docs.withColumn(new, text)
    if "n_chars" in columns:
        changed = ~F.col(new).eqNullSafe(F.col("text"))
        out = out.withColumn("n_chars", F.when(changed, F.char_length(new).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(new)).select(*columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_spans),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Tokenizing and learned models have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = common.shared_dir(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return docs
