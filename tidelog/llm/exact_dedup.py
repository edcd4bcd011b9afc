"""Exact deduplication: two passes around a Bloom filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_stats, filter_words, maybe_in, text_or_empty, written

#: The filter has 2**FILTER_BITS bits (8 MB as bits; at most 2**20 broadcast rows). More documents than
#: bits only mean that more rows take the way over the shuffle.
FILTER_BITS = 26


def exact_groups(docs: DataFrame, bits: int = FILTER_BITS, row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Pass one counts the bits that the texts' 64-bit hashes set, summed in each task before the shuffle, and
    keeps the bits set twice. Pass two holds each row against them: rows with an unset bit have no equal and
    pass straight through; the rest shuffle by SHA-256, without their text, hot groups dealt over salts.

    Texts are equal when identical; a null text counts as empty. The largest doc_id of a group stays. Rows
    that repeat a doc_id and text count in group_size and are marked alike. A null doc_id is never the
    one that stays unless its group has no other; then keep_id is null and kept is true. No rows give no
    rows; other columns are ignored.

    row: a long column, other in each row of docs. It is put out too, and of a group's rows with the largest
    doc_id only the one with the largest row is kept, so that each group keeps exactly one.
    """
    text = text_or_empty()
    words = written(filter_words(docs.select(F.xxhash64(text).alias("h")), bits, twice=True), "repeated-bits")
    own = [row] if row else []
    keyed = docs.select("doc_id", *own, F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    keyed = written(maybe_in(keyed, F.col("h"), words, bits, "maybe").drop("h"), "digests")
    alone = keyed.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *own)
    again = keyed.where("maybe").drop("maybe")
    if row:
        again = attach_stats(again.withColumn("_who", F.struct("doc_id", row)), ["text_sha256"], F.col(row), keep=("max", "_who"), group_size=("count", "doc_id"))
        again = again.withColumn("keep_id", F.col("keep.doc_id")).withColumn("kept", F.col(row) == F.col(f"keep.{row}"))
        return alone.unionByName(again.drop("keep", "_who"))
    again = attach_stats(again, ["text_sha256"], F.col("doc_id"), keep_id=("max", "doc_id"), group_size=("count", "doc_id"))
    return alone.unionByName(again.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))
