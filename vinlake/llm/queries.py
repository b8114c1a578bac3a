"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinlake.llm import ann, centroids, filter_audit, langid, line_dedup, minhash, mixing, pieces, quality_model, quality_rules, simhash, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts scored from labelled examples. Null and empty texts get the score of texts without a neighbour; each repeated row returns a row."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every vec_id divisible by 100, ties to the smaller id. Null, zero or non-finite vectors take no part; repeated rows count once."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on ten or more sites cut from all documents but the first. A null text stays null; repeated rows each return a row."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles linked at two bits or fewer. Null and empty texts have fingerprint zero; each repeated row returns a row."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, max_bits=2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from each document for the sources' weights. A null text has size 0; a null source is one of its own, the last; repeated rows are documents each."""
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of whole texts. A null or empty text has none; each repeated row returns a row."""
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts scored by positive-unlabelled learning. Null and empty texts get a score too; each repeated row returns a row."""
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls judged by rules, else by the cascade. A null url, or one without ://, has empty host and path and is judged as such; each repeated row returns a row."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by cross-parsing. A null text or one without a letter is `und`; a tie goes to the smaller language; each repeated row returns a row."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and lines that many documents of a host hold. Null and empty texts fail; each repeated row returns a row."""
    return quality_rules.rule_quality(_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles overlap by 85 % or more. Documents without words are linked with nothing; each repeated row returns a row."""
    return minhash.near_copies(_table(spark, sf_dir, "documents"), width=5, percent=85)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, by source. Null texts and sources are empty ones; repeated rows count each and are no repeats of one another."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters by five exact rounds, ties to the smaller number. Null, other than 64-component or non-finite vectors return no row; each repeated row returns one."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_nearest_vectors, op3_line_dedup, op4_simhash, op5_mixing, op6_sentencepiece, op7_quality_model, op8_url_filter, op9_language, op10_quality_rules, op11_minhash, op12_filter_audit, op13_centroids)
}

ORACLE_SQL = {"op3_line_dedup": line_dedup.ORACLE_SQL, "op8_url_filter": url_filter.ORACLE_SQL, "op10_quality_rules": quality_rules.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_centroids": centroids.ORACLE_SQL}
