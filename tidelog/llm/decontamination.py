"""Benchmark decontamination by a prefix-filtered join of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, bitmap_of, bounded_batches, filter_words, in_bitmap, remember, slices, text_or_empty, written

#: Words of an item's window, and of the shingles that windows are found by.
WINDOW, SHINGLE = 13, 5
#: Bits of the filter of items' shingles (8 MB); a fuller filter only lets more of the documents through.
FILTER_BITS = 26
#: Shingles of a document that travel as one row.
CHUNK = 64
#: Words whose hash a worker remembers; only speed depends on it.
MEMO_WORDS = 150_000
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and anything beyond ASCII."""
    return text.encode().translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of an item; a shorter item is one window, an empty one has none."""
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def _hashes() -> Memo:
    import xxhash

    return remember("shingle words").setdefault("memo", Memo(lambda words: list(map(xxhash.xxh64_intdigest, words)), MEMO_WORDS))


def _shingles(words: list[bytes], size: int, memo: Memo) -> np.ndarray:
    """A hash for each run of `size` words; it only decides who passes the filter."""
    known = memo.holding(set(words))
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(32)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, size, n, window) for each distinct window of an item, n words long, and the size of its shingles."""
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = list(dict.fromkeys(windows_of(words_of(text))))
            for at in range(0, len(found), 10_000):
                some = found[at : at + 10_000]
                sizes = [min(SHINGLE, len(w)) for w in some]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(some)), pa.array(sizes, pa.int32()), pa.array(list(map(len, some)), pa.int32()), pa.array([b" ".join(w).decode() for w in some], pa.string())], ["item_id", "size", "n", "window"])


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingle hashes of each item."""
    memo = _hashes()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_shingles(words, min(SHINGLE, len(words)), memo)).view(np.int64))], ["h"])


_RUNS = "array<struct<size:int,start:long,lead:int,n:int,words:string>>"
_RUN = pa.list_(pa.struct([("size", pa.int32()), ("start", pa.int64()), ("lead", pa.int32()), ("n", pa.int32()), ("words", pa.string())]))


def _probe(bitmap_, bits: int, least: dict[int, int]):
    """doc_id, n_words, runs: chunks of neighbouring shingles that may all be items' shingles.

    least: how many neighbours a window has at least, for each size of shingle. A chunk begins at word `start` of the
    document and has n shingles, and the `lead` words of its run before them and as many after that a window may
    need.
    """

    def runs_of(words: list[bytes], ends: np.ndarray, size: int, memo: Memo) -> Iterator[tuple[int, int]]:
        """(place in words, shingles) of each long enough run within one document."""
        h = _shingles(words, size, memo)
        at = np.flatnonzero(in_bitmap(h, bitmap_.value, bits))
        doc = np.searchsorted(ends, at, side="right")
        whole = at + size <= ends[doc]
        at, doc = at[whole], doc[whole]
        if len(at):
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)]))
            n = np.diff(np.append(begin, len(at)))
            long = n >= least[size]
            yield from zip(at[begin[long]].tolist(), n[long].tolist(), strict=True)

    def run(batches):
        memo = _hashes()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                split = [words_of(t) for t in part.column("text").to_pylist()]
                counts = np.array([len(ws) for ws in split], np.int64)
                ends = np.cumsum(counts)
                words = [w for ws in split for w in ws]
                out: list[list[tuple]] = [[] for _ in split]
                for size in least:
                    for first, n in runs_of(words, ends, size, memo):
                        d = int(np.searchsorted(ends, first, side="right"))
                        origin, reach, last = int(ends[d] - counts[d]), WINDOW - size, first + n + size - 1
                        for at in range(first, first + n, CHUNK):
                            begin, some = max(first, at - reach), min(CHUNK, first + n - at)
                            chunk = b" ".join(words[begin : min(last, at + some + size - 1 + reach)]).decode()
                            out[d].append((size, at - origin, at - begin, some, chunk))
                runs = pa.array([[dict(zip(("size", "start", "lead", "n", "words"), r, strict=True)) for r in rs] for rs in out], _RUN)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), runs], ["doc_id", "n_words", "runs"])

    return run


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, bits: int = FILTER_BITS, salts: int = 16) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start, n of each occurring window), items (ids) for each row of docs.

    Windows have WINDOW words, and shingles SHINGLE of these (a shorter item is one window, and its own shingle if
    it is shorter than that). A window occurs only where all its shingles do, side by side: one pass over the
    documents keeps runs of neighbouring shingles that are long enough for a window, as a bounded filter of the
    items' shingles tells. Of these all shingles are counted. Each window's prefix is its rarest shingle (ties by
    hash); one that no document has rules its window out. Documents' shingles meet the prefixes by hash, dealt
    over salts; where the window's place in the run leaves room for it, its words are compared one for one.

    Null and empty texts have no words and no hits; null and empty items match nothing; equal items are all
    named; a null item_id is skipped, a null doc_id kept; every row of docs is judged by its own text, repeated
    ids or not; no documents give no rows, no items no hits; other columns are ignored.
    """
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    named = items.where("item_id is not null").select("item_id", text_or_empty().alias("text"))
    kind = named.schema["item_id"].dataType.simpleString()
    windows = written(named.mapInArrow(_item_windows, f"item_id {kind}, size int, n int, window string"), "windows")
    least = {r["size"]: r["n"] - r["size"] + 1 for r in windows.groupBy("size").agg(F.min("n").alias("n")).collect()}  # SHINGLE rows at most
    if not least:
        none = F.array().cast("array<struct<start:long,n:long>>"), F.array().cast(f"array<{kind}>")
        counted = texts.mapInArrow(_probe(None, bits, {}), f"doc_id long, n_words long, runs {_RUNS}")
        return counted.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none[0].alias("spans"), none[1].alias("items"))
    bitmap = spark.sparkContext.broadcast(bitmap_of(filter_words(named.mapInArrow(_item_shingles, "h long"), bits), bits))
    rows = texts.mapInArrow(_probe(bitmap, bits, least), f"doc_id long, n_words long, runs {_RUNS}").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "runs")

    text_at = lambda words, at, n: F.array_join(F.slice(words, at + 1, n), " ")
    chunks = rows.select("row", F.explode("runs").alias("r")).select("row", "r.*").withColumn("words", F.split("words", " "))
    # a shingle's own words, and as many around it as a window may need
    each = chunks.select("row", "size", "start", "lead", "words", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    place = F.col("lead") + F.col("k")
    behind = F.least(place, WINDOW - F.col("size"))
    each = each.select("row", "size", (F.col("start") + F.col("k")).alias("at"), F.xxhash64(text_at("words", place, F.col("size"))).alias("h"), behind.alias("behind"), F.slice("words", place - behind + 1, 2 * WINDOW - F.col("size")).alias("words"))
    counts = written(each.groupBy("size", "h").agg(F.count(F.lit(1)).alias("n_docs")), "shingles")

    distinct = windows.groupBy("window").agg(F.first("size").alias("size"), F.first("n").alias("n"))
    parts = F.split("window", " ")
    offsets = F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size")))
    shingles = distinct.select("window", "size", "n", offsets.alias("offset")).withColumn("h", F.xxhash64(text_at(parts, F.col("offset"), F.col("size"))))
    rarest = F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "h", "offset")).alias("p")
    prefixes = shingles.join(counts, ["size", "h"], "left").groupBy("window", "size", "n").agg(rarest).where("p.n_docs > 0")
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    prefixes = prefixes.select("window", "size", "n", "p.h", "p.offset", salt)

    dealt = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    room = (F.col("behind") >= F.col("offset")) & (F.size("words") - F.col("behind") >= F.col("n") - F.col("offset"))
    met = dealt.join(prefixes, ["size", "h", "salt"]).where(room & (text_at("words", F.col("behind") - F.col("offset"), F.col("n")) == F.col("window")))
    met = written(met.select("row", (F.col("at") - F.col("offset")).alias("start"), F.col("n").cast("long").alias("n"), "window"), "hits")
    spans = met.groupBy("row", "start").agg(F.max("n").alias("n")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("spans"))
    holders = windows.select("window", "item_id", salt)
    found = met.select("row", "window").distinct().withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(holders, ["window", "salt"])
    found = found.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a.end, s.start + s.n).alias("end"), (a.n + F.greatest(F.lit(0), s.start + s.n - F.greatest(a.end, s.start))).cast("long").alias("n")),
        lambda a: a.n,
    )
    hit = spans.join(found, "row").select("row", covered.alias("n_hit"), "spans", "items")
    some = rows.where("size(runs) > 0").select("doc_id", "n_words", "row").join(hit, "row", "left")
    quiet = rows.where("size(runs) = 0").select("doc_id", "n_words", *(F.lit(None).cast(hit.schema[c].dataType).alias(c) for c in ("n_hit", "spans", "items")))
    out = some.select(*quiet.columns).unionByName(quiet)
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast(hit.schema["spans"].dataType)).alias("spans"), F.coalesce("items", F.array().cast(hit.schema["items"].dataType)).alias("items"))
