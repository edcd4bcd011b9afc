"""Token counts through a cache of digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, bounded_batches, filter_words, maybe_in, remember, slices, text_or_empty, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Bits of the filters of repeated texts and of stored digests (at most 2**20 broadcast rows each).
FILTER_BITS = 26
#: Words that a worker remembers; only speed depends on it.
MEMO_WORDS = 150_000
# Fixed value: the split pattern of a tokenizer whose tokens never hold or cross white space.
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: its kind and its file's bytes."""
    with open(path, "rb") as f:
        return hashlib.sha256(path.rpartition(".")[2].encode() + b"\0" + f.read()).hexdigest()


def wordwise(path: str) -> bool:
    """Whether text can be cut at ASCII white space without a change of its tokens."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex") == WORDWISE


def normalised(text: Column, by_words: bool) -> Column:
    """Content that has the same tokens; runs of ASCII white space count as one space if words are cut there anyway."""
    return F.regexp_replace(text, "[ \t\n\r]+", " ") if by_words else text


def _counter(path: str, by_words: bool):
    """texts -> counts, as the file's own library gives them."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    counts = lambda texts: [len(x) for x in tok.encode_batch(texts, add_special_tokens=False)]
    if not by_words:
        return counts
    memo = Memo(lambda words: [n for at in range(0, len(words), 4096) for n in counts(words[at : at + 4096])], MEMO_WORDS)

    def by_word(texts: list[str]) -> list[int]:
        words = [t.split(" ") for t in texts]
        known = memo.holding({w for ws in words for w in ws})
        return [sum(map(known.__getitem__, ws)) for ws in words]

    return by_word


def _encode(path: str, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = remember(("counter", path))
        count = kept.get("f") or kept.setdefault("f", _counter(path, by_words))
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(count(part.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    The SHA-256 of the normalised text and the tokenizer's digest are looked up in the table at `cache`
    (made if absent; one writer at a time). Only digests not found there are encoded, each once, and
    appended; rows of documents meet their counts by digest. Two bounded filters spare texts the way over the
    shuffle: one that is surely in no other row and surely not stored is encoded where it stands. Fuller
    filters only send more texts by the other way.

    A null text counts as empty, an empty text has 0 tokens, a null doc_id is kept, repeated rows each
    get their count, no rows give no rows, other columns are ignored.
    """
    bounded_batches(spark)
    by_words, version = wordwise(tokenizer), tokenizer_digest(tokenizer)
    text = normalised(text_or_empty(), by_words)
    digest = F.unhex(F.sha2("text", 256))
    texts = docs.select("doc_id", text.alias("text"))
    # all that later steps need of a row but its text
    keyed = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text.alias("text"))
    keyed = written(keyed.select("doc_id", "n_bytes", digest.alias("digest"), F.xxhash64("text").alias("h")), "keys")

    def stored() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")

    def append(new: DataFrame) -> None:
        new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    repeated = written(filter_words(keyed.select("h"), bits, twice=True), "repeated-bits")
    known = written(filter_words(stored().select(F.xxhash64("digest").alias("h")), bits), "stored-bits")
    cold = known.isEmpty()

    def marked(rows: DataFrame, h, d) -> DataFrame:
        """maybe: the row's text may be in another row too, or stored."""
        rows = maybe_in(rows, h, repeated, bits, "maybe")
        return rows if cold else maybe_in(rows, F.xxhash64(d), known, bits, "known").withColumn("maybe", F.col("maybe") | F.col("known")).drop("known")

    # what may be stored or repeated is looked up, and one row of each digest that misses is encoded
    first = marked(keyed, F.col("h"), F.col("digest")).where("maybe").groupBy("digest").agg(F.min("doc_id").alias("rep")).join(stored(), "digest", "left_anti").withColumnRenamed("digest", "miss")
    flagged, encode = marked(texts, F.xxhash64("text"), digest), _encode(tokenizer, by_words)
    some = flagged.where("maybe").withColumn("digest", digest)
    misses = some.join(first, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("miss")), "left_semi").select("digest", "text")
    missed = misses.mapInArrow(encode, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # rows of one doc_id may repeat
    alone = flagged.where("not maybe").select(digest.alias("digest"), "text").mapInArrow(encode, "digest binary, n_tokens long")
    append(alone.unionByName(missed))
    return keyed.join(stored(), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
