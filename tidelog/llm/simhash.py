"""Near-duplicates by SimHash fingerprints and Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_stats, bounded_batches, components, slices, text_or_empty, written

SHINGLE, SEED, BITS_APART = 4, 42, 4
#: Key rows that a bucket task is meant for.
TASK_ROWS = 1_000_000
#: Shingles' hashes that a worker turns to bits at once.
HASHES = 50_000
#: Fingerprints of a bucket that are held against each other directly; more are dealt by equal blocks of bits first.
BUCKET = 2_000
#: (shift, bits) of the three segments of a fingerprint; the last is filled up with zeros to 23 bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fixed value: the generator polynomial of the binary Golay code (23, 12, 7).
GOLAY = 0b110001110101


def fingerprints(texts: list[str], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the shingles' hashes.

    HASHES of them are held at a time, however long a text is.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones, counts = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    spans: list[tuple[int, int]] = []  # text, hashes in held

    def count() -> None:
        if held:
            bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sizes = np.array([n for _, n in spans])
            np.add.at(ones, [k for k, _ in spans], np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
            held.clear()
            spans.clear()

    for k, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        n = counts[k] = max(1, len(words) - shingle + 1)
        del words
        begins = np.concatenate([[0], ends[: n - 1]])
        stops = ends[-n:] - 1
        for at in range(0, n, HASHES):
            some = [digest(joined[a:b], seed) for a, b in zip(begins[at : at + HASHES].tolist(), stops[at : at + HASHES].tolist(), strict=True)]
            held += some
            spans.append((k, len(some)))
            if len(held) >= HASHES:
                count()
    count()
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def _fingerprints(batches):
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            fps = fingerprints(part.column("text").to_pylist())
            own = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(part.column, own), pa.array(fps.view(np.int64))], [*own, "fp"])


@lru_cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 12 high bits, and for each syndrome the error patterns of weight 4 at most (1 or 6) and their number.

    The code is perfect: each word has one codeword within 3 bits. Words 2 bits or fewer apart have a word
    between them that is within 1 bit of both, and whose codeword is therefore within 4 bits of both.
    """
    high = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for b in range(22, 10, -1):
            if r >> b & 1:
                r ^= GOLAY << (b - 11)
        high[m] = r
    syndrome = lambda x: int(high[x >> 11]) ^ (x & 0x7FF)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            e = sum(1 << b for b in at)
            patterns[syndrome(e)].append(e)
    out, n = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for s, es in enumerate(patterns):
        n[s] = len(es)
        out[s, : len(es)] = es
    return high, out, n


def codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word, one below the other: row of x, index."""
    high, patterns, n = golay_tables()
    s = high[x >> 11] ^ (x & 0x7FF)
    row = np.repeat(np.arange(len(x)), n[s])
    k = np.arange(len(row)) - np.repeat(np.cumsum(n[s]) - n[s], n[s])
    return row, (x[row] ^ patterns[s[row], k]) >> 11


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of fps, key) such that fingerprints 4 bits or fewer apart have a key in common.

    Of three segments' errors, either one is 0, and then another is 2 at most: that segment as it is with the
    other's codewords. Or they are 2, 1, 1 at most in some order: one half of each segment with 1 error has
    none, so those halves as they are with the third's codewords.
    """
    seg = [(fps >> np.uint64(s)).astype(np.int64) & ((1 << b) - 1) for s, b in SEGMENTS]
    halves = [(x & ((1 << (b // 2)) - 1), x >> (b // 2)) for x, (_, b) in zip(seg, SEGMENTS, strict=True)]
    near = [codewords(x) for x in seg]
    rows, out, family = [], [], 0
    for q in range(3):
        row, code = near[q]
        others = [p for p in range(3) if p != q]
        for exact in [*([(seg[p], 23)] for p in others), *([(halves[others[0]][i], 12), (halves[others[1]][j], 12)] for i in (0, 1) for j in (0, 1))]:
            key = np.full(len(row), family, np.int64)
            for values, bits in exact:
                key = key << bits | values[row]
            rows.append(row)
            out.append(key << 12 | code)
            family += 1
    return np.concatenate(rows), np.concatenate(out)


def _keys(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            fps = batch.column("fp").slice(at, 2000).to_numpy(zero_copy_only=False)
            row, key = keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])


def bucket_links(fps: np.ndarray, apart: int = BITS_APART, at: int = 0) -> Iterator[tuple[int, int]]:
    """Links that join what is within `apart` bits in a bucket: a spanning forest, at most len(fps) - 1.

    Each fingerprint is held once against those that no link has reached yet, so a tight bucket takes
    about as many steps as it has fingerprints, and no pair within a component is emitted beyond need.

    In a larger bucket, of apart + 1 blocks of bits one is equal in two that link; so each block in turn deals
    it into smaller ones, with a forest for each. Those that are still large have a block in common, and mostly
    links.
    """
    if len(fps) > BUCKET and at <= apart:
        for k in range(at, apart + 1):
            low, high = 64 * k // (apart + 1), 64 * (k + 1) // (apart + 1)
            block = fps >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for part in np.split(fps[order], cuts):
                if len(part) > 1:
                    yield from bucket_links(part, apart, apart + 1)
        return
    left = fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            close = np.bitwise_count(left ^ x) <= apart
            if close.any():
                found = left[close]
                left = left[~close]
                yield from ((int(x), int(y)) for y in found)
                todo += list(found)


def _links(batches):
    got = [(b.column("key").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)) for b in batches]
    if not got:
        return
    key, fp = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order].view(np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    two = begin[size == 2]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= BITS_APART]
    links = set(zip(fp[two].tolist(), fp[two + 1].tolist(), strict=True))
    for b, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        links.update(bucket_links(fp[b : b + n]))
    if links:
        pairs = np.array(sorted(links), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def near_duplicates(spark: SparkSession, docs: DataFrame, salts: int = 64, row: str | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs: components of fingerprints 4 bits or fewer apart.

    Words are lower-cased in A-Z and split at ASCII white space; shingles have four words. Only distinct
    fingerprints get keys and meet in buckets; links found there are verified on all 64 bits, and equal
    fingerprints are linked without a bucket. component_id is the smallest doc_id of a component.

    Null and empty texts, and those of white space only, have fingerprint zero and are linked like any
    other; fewer words than a shingle are one shingle; rows that repeat a doc_id are marked each; a null
    doc_id is kept and never is the smallest, unless all are null; no rows give no rows; other columns are
    ignored.

    row: a long column, other in each row of docs. It is put out too, with kept: true for exactly one row of
    a component, of those with the smallest doc_id the one with the smallest row.
    """
    bounded_batches(spark)
    own = [row] if row else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own, text_or_empty().alias("text"))
    fps = written(texts.mapInArrow(_fingerprints, "doc_id long, " + "".join(f"{n} long, " for n in own) + "fp long"), "fingerprints")
    salted = fps.withColumn("salt", F.pmod(F.xxhash64(row or "doc_id"), F.lit(salts)).cast("int"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row) if row else F.col("doc_id")
    distinct = salted.groupBy("fp", "salt").agg(F.min(who).alias("first")).groupBy("fp").agg(F.min("first").alias("first"), F.collect_set("salt").alias("salts"))
    distinct = written(distinct, "distinct-fingerprints")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() * 100 // TASK_ROWS))
    links = distinct.select("fp").mapInArrow(_keys, "key long, fp long").repartition(tasks, "key").mapInArrow(_links, "u long, v long")
    roots = components(links)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "salts", F.coalesce("root", "fp").alias("root"))
    whole = attach_stats(rooted, ["root"], F.col("fp"), component_id=("min", "first"))
    out = salted.join(whole.select("fp", "component_id", F.explode("salts").alias("salt")), ["fp", "salt"])
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    if row:
        return out.select("doc_id", hexed, F.col("component_id.doc_id").alias("component_id"), row, (F.col(row) == F.col(f"component_id.{row}")).alias("kept"))
    return out.select("doc_id", hexed, "component_id")
