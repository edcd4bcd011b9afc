"""Sharding by a minimax contiguous partition of equal-text groups."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Bits of the hash that the first summary goes by (65,536 sums at most), and that one refinement adds.
FIRST_BITS, MORE_BITS = 16, 6
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Rows that a numbering task is meant for.
BLOCK_ROWS = 1 << 20


@dataclass(frozen=True)
class Atom:
    """A range of hashes, lo to lo + 2**shift - 1, with the bytes, groups and largest group in it."""

    lo: int
    shift: int
    size: int
    groups: int
    most: int


def _reach(ends: list[int], start: int, capacity: int) -> int:
    """How many atoms lie before the last cut that keeps start..cut within the capacity."""
    return bisect_right(ends, start + capacity)


def _greedy(atoms: list[Atom], ends: list[int], shards: int, capacity: int) -> tuple[bool, bool, set[int]]:
    """Whether the capacity surely suffices, whether it may, and the unresolved atoms that the answer hangs on.

    A sure cut goes before an atom that doesn't fit whole; a hopeful one goes through it if it has
    several groups.
    """
    total, sure, hope, open_ = ends[-1] if ends else 0, 0, 0, set()
    for _ in range(shards):
        at, to = _reach(ends, sure, capacity), _reach(ends, hope, capacity)
        open_.update(i for i in range(at, min(to + 1, len(atoms))) if atoms[i].groups > 1)
        sure = ends[at - 1] if at else 0
        # before an atom of one group a hopeful cut can't go further either
        hope = hope + capacity if to < len(atoms) and atoms[to].groups > 1 else max(hope, ends[to - 1] if to else 0)
    return sure >= total, hope >= total, open_


def minimax_cuts(atoms: list[Atom], shards: int, refine) -> tuple[int, list[int]]:
    """The smallest capacity for which greedy cutting needs at most `shards` parts, and the hashes where parts begin.

    refine(atoms) gives finer atoms for those given; only those that an undecided answer hangs on are asked for.
    """
    ends = list(accumulate(a.size for a in atoms))
    if not atoms:
        return 0, []
    most = max(a.most for a in atoms)
    low, high = max(most, -(-ends[-1] // shards)) - 1, ends[-1]  # low doesn't suffice, high does
    while high - low > 1:
        mid = low + 1 if high == ends[-1] and low == max(most, -(-ends[-1] // shards)) - 1 else (low + high) // 2
        sure, maybe, open_ = _greedy(atoms, ends, shards, mid)
        if sure:
            high = mid
        elif not maybe or not open_:
            low = mid
        else:
            finer = refine([atoms[i] for i in sorted(open_)])
            atoms = sorted([a for i, a in enumerate(atoms) if i not in open_] + finer, key=lambda a: a.lo)
            ends = list(accumulate(a.size for a in atoms))
    return high, _cut(atoms, ends, shards, high)


def _cut(atoms: list[Atom], ends: list[int], shards: int, capacity: int) -> list[int]:
    """Cuts within the capacity, each as near to an equal share of what is left as the rest allows."""
    starts = [0, *ends[:-1]]
    latest, end = [], ends[-1]  # from behind: where a part must begin at the earliest for the rest to fit
    for _ in range(shards):
        latest.append(end)
        end = min((s for s in starts[max(0, bisect_right(starts, end - capacity - 1)) :] if s >= end - capacity), default=end)
    cuts, start, greedy, at_greedy = [], 0, [], 0
    for left in range(shards, 1, -1):
        at = _reach(ends, start, capacity)
        far = ends[at - 1] if at else 0
        want = start + -(-(ends[-1] - start) // left)
        k = _reach(ends, 0, want)
        near = [x for x in ((ends[k - 1] if k else 0), (ends[k] if k < len(ends) else ends[-1])) if x >= start] or [start]
        start = max(min(min(near, key=lambda x: abs(x - want)), far), min(latest[left - 1], far))
        cuts.append(start)
        to = _reach(ends, at_greedy, capacity)
        at_greedy = ends[to - 1] if to else 0
        greedy.append(at_greedy)
    if ends[-1] - start > capacity:
        cuts = greedy
    return [atoms[i].lo if (i := bisect_right(starts, c - 1)) < len(atoms) else 1 << 63 for c in cuts]


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs. Law: bytes.

    Groups of equal texts are atomic, ordered by the text's 64-bit hash. The driver gets sums over at most
    2**FIRST_BITS hash ranges, and finer ones only where a cut may fall; the smallest sufficient capacity is
    binary-searched over them, checked greedily, and exact over all groups. Rows then find their shard by
    comparing their hash with the cuts. Slots are numbered in blocks of about BLOCK_ROWS rows.

    A null text counts as empty (size 16, checksum 0), a null doc_id is kept and comes first in its block,
    repeated rows share a shard and get a slot each, no rows give no rows; other columns are ignored.
    """
    text = text_or_empty()
    keyed = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.xxhash64(text).alias("h"))
    groups = written(keyed.groupBy("h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")

    def atoms(df: DataFrame, shift: int) -> list[Atom]:
        got = df.groupBy(F.shiftright("h", shift).alias("k")).agg(F.sum("bytes"), F.count(F.lit(1)), F.max("bytes")).collect()
        return sorted((Atom(k << shift, shift, size, n, most) for k, size, n, most in got), key=lambda a: a.lo)

    def refine(open_: list[Atom]) -> list[Atom]:
        out = []
        for shift in {a.shift for a in open_}:
            own = [a.lo >> shift for a in open_ if a.shift == shift]
            out += atoms(groups.where(F.shiftright("h", shift).isin(own)), max(0, shift - MORE_BITS))
        return out

    _, cuts = minimax_cuts(atoms(groups, 64 - FIRST_BITS), shards, refine)
    cuts = [c for c in cuts if c < 1 << 63]
    past = [F.when(F.col("h") >= F.lit(c), 1).otherwise(0) for c in cuts]
    rows = groups.agg(F.sum("n")).first()[0] or 0
    blocks = max(16, -(-rows // BLOCK_ROWS))
    placed = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    placed = placed.select("doc_id", "size", "text_crc32", sum(past, F.lit(0)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"))
    # one count for each block of each shard; blocks grow with the rows, and only their counts meet in a window
    per = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select("shard", "block", F.coalesce(before, F.lit(0)).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        placed.withColumn("_n", slot).join(offsets, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("_n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
