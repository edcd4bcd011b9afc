"""BPE encoding and decoding by an automaton compiled from the merges."""

from __future__ import annotations

import gc
import hashlib
import json
import struct
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_batches, remember, slices, text_or_empty

#: Words that a worker remembers; only speed depends on it.
MEMO_WORDS = 120_000
#: Bytes of text whose tokens leave the worker at once.
PART_BYTES = 1 << 20
#: Texts with letters beyond these are normalised and split by the file's library; up to them Python gives the same.
BEYOND = r"[^\x00-\u024F]"
OUT_SCHEMA = "doc_id long, ids binary, decoded string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where Latin-1 prints it, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, more = {b: chr(b) for b in plain}, iter(range(0x100, 0x200))
    return [letters.get(b) or chr(next(more)) for b in range(256)]


class Automaton(NamedTuple):
    """A deterministic automaton over tokens as flat tables: a path from the start spells a word's one encoding.

    After a token the automaton is in the state `state[token]`; arcs of class k leave a state if bit k of the
    state's row in `rows` is set. Spellings are read byte by byte (`symbol + 256` ends a word): node p goes by
    symbol x to follow[p + x] if check[p + x] == p, and if emits[p + x] is a token, that is the one spelt on the
    way, with an arc of class arc[p + x]. A node is the offset of its own row, so rows overlap without clashes.
    """

    state: Sequence[int]
    rows: bytes
    width: int
    check: Sequence[int]
    follow: Sequence[int]
    emits: Sequence[int]
    arc: Sequence[int]
    root: int

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word, each byte's arcs taken once and none taken back.

        Every prefix of the word has one encoding, so one state; the arc of a token from a prefix's state leads to
        the longer prefix's if that state has it. The word's own path is read from its end.
        """
        n = len(word)
        if not n:
            return []
        state, rows, width, check, follow, emits, arc, root = self
        symbols = array("l", iter(word))
        symbols[-1] += 256
        at, last, came = array("l", symbols), array("l", symbols), array("l", symbols)  # by where a prefix's last byte is
        row = 0
        for i in range(n):
            p = root
            for j in range(i, n):
                x = p + symbols[j]
                if check[x] != p:
                    break
                k = arc[x]
                if k >= 0 and rows[row + (k >> 3)] >> (k & 7) & 1:
                    last[j], came[j], at[j] = emits[x], i, state[emits[x]] * width
                p = follow[x]
            row = at[i]
        out = []
        while n:
            out.append(last[n - 1])
            n = came[n - 1]
        return out[::-1]


def compile_merges(model: dict) -> Automaton:
    """The automaton, by one gadget for each merge, oldest first.

    At first every symbol leaves the start, and the state after every symbol that doesn't end a word. The gadget of
    the merge of u and v to w lets w leave every state that u leaves, makes the state after w that after v, and
    takes v's arc away from the state after u; without that arc w never comes up. If u is v, w doesn't follow u
    either: of three, the first two merge. States and arcs that no further symbol can tell apart are then one.
    """
    suffix, vocab, letters = model.get("end_of_word_suffix") or "", model["vocab"], byte_letters()
    if not suffix or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        raise ValueError("this kind of BPE model is not supported")
    spelt = {vocab[x + end]: (b + shift,) for end, shift in (("", 0), (suffix, 256)) for b, x in enumerate(letters)}
    born = dict.fromkeys(spelt, -1)  # token -> its merge's place
    inner = {t: i + 1 for i, t in enumerate(t for t in spelt if spelt[t][-1] < 256)}  # token that doesn't end a word -> its state
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    states = 1 + len(inner) + sum(not right.endswith(suffix) for _, right in merges)
    # a row for each token: from which states its arc leaves, as bits
    leaves, n = np.zeros((len(spelt) + len(merges), (states + 7) // 8), np.uint8), len(spelt)
    leaves[:n] = np.packbits(np.arange(states) <= len(inner), bitorder="little")
    place = {t: i for i, t in enumerate(spelt)}
    for k, (left, right) in enumerate(merges):
        u, v, w = vocab[left], vocab[right], vocab[left + right]
        if w in born or u not in inner or v not in born or max(born[u], born[v]) >= k:
            raise ValueError(f"merge {k} isn't in the order of its parts")
        born[w], spelt[w], place[w] = k, spelt[u] + spelt[v], n
        byte, bit = divmod(inner[u], 8)
        if leaves[place[v], byte] >> bit & 1:
            leaves[n] = leaves[place[u]]
        n += 1
        if spelt[w][-1] < 256:
            inner[w] = len(inner) + 1
            (to, shift), (of, at) = divmod(inner[w], 8), divmod(inner[v], 8)
            leaves[:n, to] |= (leaves[:n, of] >> at & 1) << shift
        for t in {place[v], n - 1} if u == v else {place[v]}:
            leaves[t, byte] &= 255 ^ (1 << bit)
    arcs: dict[bytes, int] = {}
    arc_of = {t: arcs.setdefault(leaves[place[t]].tobytes(), len(arcs)) for t in place}
    # the same bits by state
    by_arc = np.unpackbits(np.frombuffer(b"".join(arcs), np.uint8).reshape(len(arcs), -1), axis=1, count=states, bitorder="little")
    by_state = np.packbits(by_arc.T, axis=1, bitorder="little")
    rows = {by_state[0].tobytes(): 0}
    state_of = {t: rows.setdefault(by_state[i].tobytes(), len(rows)) for t, i in inner.items()}
    most = max(vocab.values()) + 1
    state = array("l", [state_of.get(t, 0) for t in range(most)])
    return Automaton(state, b"".join(rows), by_state.shape[1], *_spellings(spelt, arc_of))


def _spellings(spelt: dict[int, tuple[int, ...]], arc_of: dict[int, int]) -> tuple[array, array, array, array, int]:
    """check, follow, emits, arc and root: the tree of all spellings, each node at the first offset where its arcs are free."""
    tree, token = [{}], {}
    for t, symbols in spelt.items():
        at = 0
        for x in symbols:
            if x not in tree[at]:
                tree[at][x] = len(tree)
                tree.append({})
            at = tree[at][x]
        token[at] = t
    taken, offset, used, free = bytearray(600 * len(tree)), [0] * len(tree), set(), 0
    for at in sorted(range(len(tree)), key=lambda k: -len(tree[k])):
        symbols = sorted(tree[at])
        first = symbols[0] if symbols else 0
        p = max(0, free - first)
        while p in used or any(taken[p + x] for x in symbols):
            p += 1
        used.add(p)
        offset[at] = p
        for x in symbols:
            taken[p + x] = 1
        free = max(free, p + first - 256)  # few places are left before that
    check, follow, emits, arc = (array("l", [-1]) * (max(offset) + 512) for _ in range(4))
    for at, arcs in enumerate(tree):
        for x, to in arcs.items():
            k = offset[at] + x
            check[k], follow[k] = offset[at], offset[to]
            if to in token:
                emits[k], arc[k] = token[to], arc_of[token[to]]
    return check, follow, emits, arc, offset[0]


class Compiled(NamedTuple):
    """What workers need of a tokenizer file."""

    automaton: Automaton
    labels: dict[int, str]
    special: dict[str, int]
    split: str  # the expression that finds words
    library: str  # the file without its vocabulary: normaliser and split for letters beyond PLAIN


@lru_cache(maxsize=1)
def compiled(path: str) -> Compiled:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, to_bytes = (spec["pre_tokenizer"].get("pretokenizers") or [{}, {}])[:2]
    named = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    if named != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or not split.get("invert") or to_bytes.get("type") != "ByteLevel" or spec.get("decoder"):
        raise ValueError("only files that lower-case, split by words and name no decoder are supported")
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    labels = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in special.items()}
    automaton = compile_merges(spec["model"])
    bare = spec | {"model": spec["model"] | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
    return Compiled(automaton, labels, special, split["pattern"]["Regex"], json.dumps(bare))


class Codec:
    """Whole texts: special strings first, then the file's normaliser and split, then the automaton."""

    def __init__(self, made: Compiled):
        import regex
        from tokenizers import Tokenizer

        # lists are read faster than arrays
        self.automaton = Automaton(*(x.tolist() if isinstance(x, array) else x for x in made.automaton))
        self.labels, self.special = made.labels, made.special
        self.words = regex.compile(made.split)
        self.beyond = regex.compile(BEYOND)
        self.library = Tokenizer.from_str(made.library)
        self.bytes_of = {ord(x): b for b, x in enumerate(byte_letters())}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.by_word = Memo(lambda words: [self._out(self.automaton.encode_word(w.encode())) for w in words], MEMO_WORDS)

    def _out(self, ids: list[int]) -> tuple[bytes, str]:
        """ids as bytes; the labels of the arcs, with a space between two: the file names no decoder of its own."""
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.labels.__getitem__, ids))

    def _split(self, text: str) -> list[str]:
        """The text's words after the file's normaliser; by Python where letters are known to fare alike there."""
        if text.isascii() or not self.beyond.search(text):
            return self.words.findall(text.lower())
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, map(ord, x))).decode() for x, _ in found]

    def whole(self, text: str) -> tuple[bytes, str]:
        """ids as little-endian unsigned 32-bit integers, and the text they decode to."""
        special = self.special
        got: list[tuple[bytes, str]] = []
        for piece in self.specials.split(text) if special else [text]:
            if piece in special:
                got.append(self._out([special[piece]]))
            else:
                words = self._split(piece)
                known = self.by_word.holding(set(words))
                got += [known[w] for w in words]
        return b"".join([x for x, _ in got]), " ".join([x for _, x in got])


def _run(version: str, made):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = remember(("bpe", version))
        if "codec" not in kept:
            kept["codec"] = Codec(Compiled(Automaton(*made.value[0]), *made.value[1:]))
        codec = kept["codec"]
        gc.disable()  # nothing here is cyclic, and there is much to look through
        try:
            for batch in batches:
                for part in slices(batch, "text", PART_BYTES):
                    got = [codec.whole(t) for t in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.string())], ["doc_id", "ids", "decoded"])
        finally:
            gc.enable()

    return run


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded for each row; nothing is shuffled.

    A null or empty text, and one of white space only, has no ids and decodes to an empty string. A null
    doc_id is kept, repeated rows are encoded each, no rows give no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    automaton, *rest = compiled(tokenizer)
    made = spark.sparkContext.broadcast((tuple(automaton), *rest))  # as large as the vocabulary makes it, 30 MB for 49k tokens
    run = _run(hashlib.sha256(rest[-1].encode()).hexdigest() + tokenizer, made)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, OUT_SCHEMA)
