"""A training corpus from documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontamination, exact_dedup, queries, simhash, toxicity
from tidelog.llm.common import filter_words, maybe_in, new_dir, table, written


FILTER_BITS = 26


#: The column that tells a stage's rows apart, whatever their doc_ids.
ROW = "_row"


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a key for each row, written once so that all passes of a stage see the same keys."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _by_row(rows: DataFrame) -> DataFrame:
    """The rows under their keys as doc_ids, for operators whose verdict hangs on the text alone."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def _without(rows: DataFrame, verdicts: DataFrame, bad, key: str) -> DataFrame:
    """The rows that have no verdict that says otherwise; key: the verdicts' column with the rows' keys.

    Rows that a bounded filter of the dropped keys clears stay where they are; the rest meet the verdicts.
    """
    drop = written(verdicts.where(bad).select(F.col(key).alias("_id")), "dropped")
    words = written(filter_words(drop.select(F.xxhash64("_id").alias("h")), FILTER_BITS), "dropped-bits")
    marked = maybe_in(rows, F.xxhash64(ROW), words, FILTER_BITS, "_maybe")
    maybe = marked.where("_maybe").join(drop, F.col(ROW) == F.col("_id"), "left_anti")
    return marked.where("not _maybe").unionByName(maybe).select(*rows.columns).drop(ROW)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic.

    Each row is judged by its own text: rows with a null or repeated doc_id stay or go one by one, and a null
    or empty text has no evidence.
    """
    rows = _rows(docs)
    model = toxicity.learn(spark, rows, table(spark, sf_dir, "labels"))
    return _without(rows, toxicity.score(spark, _by_row(rows), model), F.col("predicted") == 1, "doc_id")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, exactly one row: one with the largest doc_id.

    A null doc_id stays only if no equal text has another; of rows that repeat doc_id and text one stays; rows
    that repeat a doc_id with other texts are apart; a null text equals an empty one.
    """
    rows = _rows(docs)
    return _without(rows, exact_dedup.exact_groups(rows, row=ROW), ~F.col("kept"), ROW)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints, exactly one row: one with the smallest doc_id.

    A null doc_id stays only if no linked row has another; of rows that repeat a doc_id and are linked one
    stays, those not linked stay each; null and empty texts are linked with each other.
    """
    rows = _rows(docs)
    return _without(rows, simhash.near_duplicates(spark, rows, row=ROW), ~F.col("kept"), ROW)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a window of a benchmark item, however long they are otherwise.

    Each row is judged by its own text: rows with a null or repeated doc_id stay or go one by one, and a null
    or empty text has no hits.
    """
    rows = _rows(docs)
    found = decontamination.contamination(spark, _by_row(rows), table(spark, sf_dir, "benchmark"))
    return _without(rows, found, F.col("n_hit") > 0, "doc_id")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, for each row.

    Null and repeated doc_ids are kept as they are; a null text is encoded as an empty one.
    """
    return queries.digested(bpe.encode_decode(docs, queries.tokenizer_path()))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash_near_dedup", near), ("benchmark_decontamination", benchmark), ("bpe", tokens)]
#: Fingerprints, likelihoods and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
