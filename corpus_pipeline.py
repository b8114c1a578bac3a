"""The training-data pipeline: documents in, encoded training rows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinlake.llm import langid, line_dedup, mixing, pieces, simhash
from vinlake.llm.common import removed, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or without a letter, and those that no learnt language explains (`und`) go. lang becomes the predicted one where it
    is missing or the prediction is confident; a given lang stands against a prediction that isn't."""
    found = langid.identify(docs, langid.fit(docs, purge=True), carry=("text", "lang", "source", "n_chars"), reject=True)
    lang = F.when(F.col("lang").isNull() | (F.col("score") >= langid.CONFIDENT), F.col("lang_pred")).otherwise(F.col("lang"))
    return found.filter("lang_pred != 'und'").select("doc_id", "text", lang.alias("lang"), "source", "n_chars")


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those of which only white space is left go."""
    found = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return found.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), that of the smallest id, then of the smallest text hash; a null id
    comes last. Of rows that repeat an id and a text the one of the smallest other columns stays. Rows that only share an id are documents of their own."""
    found = simhash.similar_texts(docs, width=5, similarity=0.8)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("th")))
    heads = found.groupBy("root_id").agg(first.alias("first")).select("first.id", "first.th")
    rows = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    kept = rows.join(heads, F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")), "left_semi")
    one = kept.groupBy("doc_id", "text_hash").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row"))
    return one.select("doc_id", "row.text", "row.lang", "row.source", "row.n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, shuffled within its shards: a row for each whole text taken, and for each piece of one."""
    planned = mixing.plan(docs, carry=("text", "lang", "source"))
    rows = mixing.mixed(planned, "text", ("doc_id", "lang", "source"))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's pieces."""
    return pieces.encode(docs)


STAGES = [("language ID", language_id), ("line dedup", line_spread), ("SimHash near-dedup", near_dedup), ("mixing sources", mix), ("SentencePiece", tokens)]

#: Language ID, SimHash and the mix's order are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it; what no later stage reads is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            removed(spark, f"{base}/{k - 1}")
    return docs
