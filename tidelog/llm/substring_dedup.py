"""Removal of repeated word windows by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, attach_stats, bitmap_of, bounded_batches, filter_words, in_bitmap, maybe_in, remember, slices, text_or_empty, written

#: Words of a window, and of the grams among which a window's minimiser is chosen.
WINDOW, GRAM = 50, 16
#: Bits of the filters (8 MB each); fuller filters only let more rows through.
FILTER_BITS = 26
#: Windows of a super-k-mer at most; a longer run of windows with one minimiser travels as several.
MOST_WINDOWS = 256
#: A minimiser in more super-k-mers than this is dealt over salts, so many that a bucket seldom has more.
HOT_ROWS = 1_000
#: Each level of hotter minimisers has STEP times the salts of the one before, and a filter of 2**LEVEL_BITS bits.
STEP, LEVEL_BITS = 8, 22
#: Super-k-mers that a bucket task is meant for.
TASK_ROWS = 100_000
#: Words whose hash a worker remembers; only speed depends on it.
MEMO_WORDS = 150_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes() -> Memo:
    import xxhash

    return remember("substring words").setdefault("memo", Memo(lambda words: list(map(xxhash.xxh64_intdigest, words)), MEMO_WORDS))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(32))


def runs(words: list[bytes], lengths: np.ndarray, window: int, gram: int, memo: Memo) -> tuple[np.ndarray, ...]:
    """The super-k-mers of several documents' words laid end to end: document, first word in the
    document, place in `words`, windows and minimiser of each run of windows with one minimiser."""
    n, none = len(words), np.zeros(0, np.int64)
    if n < window or not (lengths >= window).any():
        return none, none, none, none, none.view(np.uint64)
    known = memo.holding(set(words))
    h, span = _mixed(np.fromiter(map(known.__getitem__, words), np.uint64, n)), 1
    with np.errstate(over="ignore"):
        factor, rest, got, covered = _M1, gram, None, 0
        while rest:  # the gram's hash, from hashes of 1, 2, 4 ... words
            if rest & 1:
                got = h if got is None else got[: n - covered - span + 1] * factor + h[covered : n - span + 1]
                covered += span
            rest >>= 1
            if rest:
                h = h[: len(h) - span] * factor + h[span:]
                factor, span = factor * factor, span * 2
    low, span, need = _mixed(got), 1, window - gram + 1
    while span * 2 <= need:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: n - window + 1], low[need - span : need - span + n - window + 1])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    doc = np.repeat(np.arange(len(lengths)), lengths)[: n - window + 1]
    at = np.arange(n - window + 1)
    whole = at + window <= first[doc] + lengths[doc]
    at, doc, low = at[whole], doc[whole], low[whole]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    more = -(-count // MOST_WINDOWS)  # long runs in parts
    part = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    begin, count = np.repeat(begin, more) + part * MOST_WINDOWS, np.minimum(np.repeat(count, more) - part * MOST_WINDOWS, MOST_WINDOWS)
    return doc[begin], at[begin] - first[doc[begin]], at[begin], count, low[begin]


def _laid(batches: Iterator[pa.RecordBatch], window: int, gram: int):
    memo = _hashes()
    for batch in batches:
        for part in slices(batch, "text"):
            split = [t.encode().split() for t in part.column("text").to_pylist()]
            words = [w for ws in split for w in ws]
            yield part, words, runs(words, np.array([len(ws) for ws in split], np.int64), window, gram, memo)


def _minimisers(window: int, gram: int):
    def run(batches):
        for _, _, (doc, _, _, _, low) in _laid(batches, window, gram):
            order = np.lexsort((doc, low))
            low, doc = low[order], doc[order]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            keys, n = np.unique(low[new], return_counts=True)
            rows = np.unique(low, return_counts=True)[1]
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(rows.astype(np.int64))], ["h", "n", "rows"])

    return run


def _super_kmers(window: int, gram: int, bits: int, filter_, hot_):
    def run(batches):
        bitmap, levels = filter_.value, hot_.value
        for part, words, (doc, start, at, count, low) in _laid(batches, window, gram):
            keep = np.flatnonzero(in_bitmap(low, bitmap, bits)) if len(low) else low
            if not len(keep):
                continue
            ids = part.column("doc_id").to_pylist()
            lows = low[keep].view(np.int64)
            docs = [ids[d] for d in doc[keep]]
            salts = np.ones(len(keep), np.int64)
            for level, hot in enumerate(levels):
                salts[in_bitmap(low[keep], hot, LEVEL_BITS)] = 4 * STEP ** (level + 1)
            hot = salts > 1
            own = np.array([-1 if d is None else d for d in docs], np.int64).view(np.uint64) * _M2 + start[keep].astype(np.uint64) * _M1
            salts = (_mixed(own) % salts.astype(np.uint64)).astype(np.int32)
            packed = [b" ".join(words[a : a + c + window - 1]) for a, c in zip(at[keep].tolist(), count[keep].tolist(), strict=True)]
            arrays = [pa.array(lows), pa.array(salts), pa.array(hot), pa.array(docs, pa.int64()), pa.array(start[keep]), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["m", "salt", "hot", "doc_id", "start", "packed"])

    return run


_FOUND = "doc_id long, start long, n long, digest binary"


def _judge(window: int):
    """Buckets, sorted by (m, salt): which windows start in a smaller doc_id too.

    Of a hot minimiser a bucket sees one salt's documents. What has a smaller doc_id there is settled; what has
    the smallest there goes on as a digest, to be held against the other salts: a row for each distinct window.
    """

    def windows(packed: bytes) -> list[bytes]:
        words = packed.split(b" ")
        offsets = [0]
        for w in words:
            offsets.append(offsets[-1] + len(w) + 1)
        return [packed[offsets[i] : offsets[i + window] - 1] for i in range(len(words) - window + 1)]

    def bucket(rows: list[tuple[int, int, bytes]], hot: bool) -> Iterator[tuple]:
        if not hot and len({d for d, _, _ in rows}) < 2:
            return
        by_text: dict[bytes, int] = {}
        for d, _, packed in rows:
            if by_text.get(packed, d) >= d:
                by_text[packed] = d
        each = {packed: windows(packed) for packed in by_text}
        listed = sorted((w, d) for packed, d in by_text.items() for w in each[packed])
        least: dict[bytes, int] = {}
        for w, d in listed:
            least.setdefault(w, d)
        firsts = {packed: [least[w] for w in each[packed]] for packed in by_text}
        for d, start, packed in rows:
            begin = None
            for i, least_d in enumerate([*firsts[packed], d]):
                if least_d < d:
                    begin = i if begin is None else begin
                elif begin is not None:
                    yield d, start + begin, i - begin + window - 1, None
                    begin = None
            if hot and d in firsts[packed]:
                for i, w in enumerate(each[packed]):
                    if least[w] == d:
                        yield d, start + i, window, hashlib.blake2b(w, digest_size=16).digest()

    def run(batches):
        key, rows, out = None, [], []

        def flush():
            nonlocal out
            cols = list(zip(*out, strict=True))
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n", "digest"])

        for batch in batches:
            for m, salt, hot, d, start, packed in zip(*(batch.column(c).to_pylist() for c in ("m", "salt", "hot", "doc_id", "start", "packed")), strict=True):
                if (m, salt, hot) != key:
                    out += bucket(rows, key is not None and key[2])
                    key, rows = (m, salt, hot), []
                rows.append((d, start, packed))
                if len(out) > 50_000:
                    yield flush()
        out += bucket(rows, key is not None and key[2])
        if out:
            yield flush()

    return run


def repeated_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, start, n): words that lie in a window whose word sequence also starts in a smaller doc_id.

    A pass over the texts counts each minimiser's documents. A second packs the super-k-mers of minimisers
    that several documents have (as a bounded Bloom filter tells) and sends each to its minimiser's
    bucket, where sorted windows are compared exactly. Minimisers too frequent for one task are dealt over
    salts; what is smallest in its salt meets the other salts by 128-bit digest. Spans of a document may overlap.
    """
    bounded_batches(spark)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    seen = texts.mapInArrow(_minimisers(window, gram), "h long, n long, rows long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).where("n > 1")
    seen = written(seen, "minimisers")
    total, hottest = seen.agg(F.sum("rows"), F.max("rows")).first()
    total, hot = total or 0, []
    while (hottest or 0) > hot_rows * STEP ** len(hot):  # a filter for each level; who passes by mistake is dealt wider than need be
        level = seen.where(F.col("rows") > hot_rows * STEP ** len(hot))
        hot.append(bitmap_of(filter_words(level.select("h"), LEVEL_BITS), LEVEL_BITS))
    bitmap = bitmap_of(filter_words(seen, bits), bits)
    filter_, hot_ = spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(hot)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    kmers = texts.mapInArrow(_super_kmers(window, gram, bits, filter_, hot_), "m long, salt int, hot boolean, doc_id long, start long, packed binary")
    found = written(kmers.repartition(tasks, "m", "salt").sortWithinPartitions("m", "salt").mapInArrow(_judge(window), _FOUND), "spans")
    sure = found.where("digest is null").select("doc_id", "start", "n")
    if not hot:
        return sure
    tied = attach_stats(found.where("digest is not null"), ["digest"], F.col("doc_id"), least=("min", "doc_id"))
    return sure.union(tied.where("least < doc_id").select("doc_id", "start", "n"))


def _cut(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                out, at = [], 0
                for span in sorted((s["start"], s["start"] + s["n"]) for s in spans or ()):
                    out += words[at : span[0]] if span[0] > at else ()
                    at = max(at, span[1])
                out += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(out))
                kept.append(b" ".join(out))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (bytes: the kept words joined by one space) for each row of docs.

    Words are runs of anything but ASCII white space, unchanged. Texts move only for documents that a
    bounded filter can't clear of spans. A null or empty text has no words; a text shorter than a window
    loses none; of windows within one document, or of equal doc_ids, none is removed on the other's account;
    rows that repeat a doc_id get all spans found for it; a row with a null doc_id keeps its text whole and
    removes nothing elsewhere; no rows give no rows; other columns are ignored.
    """
    spans = repeated_spans(spark, docs, window, gram, bits, hot_rows).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    spans = written(spans, "spans-by-doc")
    words = written(filter_words(spans.select(F.xxhash64("doc_id").alias("h")), bits), "doc-bits")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = maybe_in(texts, F.xxhash64("doc_id"), words, bits, "maybe")
    clear = texts.where(~F.col("maybe")).select("doc_id", "text", F.lit(None).cast("array<struct<start:long,n:long>>").alias("spans"))
    hit = texts.where("maybe").join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return clear.unionByName(hit).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")
