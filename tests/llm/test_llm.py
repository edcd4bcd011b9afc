"""The operators against brute force, on a small messy table."""

import hashlib
import json
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("tidelog.llm")
from tidelog.llm import bpe, chat_format, decontamination, exact_dedup, line_dedup, queries, sharding, simhash, substring_dedup, token_counts, toxicity  # noqa: E402
from tidelog.llm.common import attach_stats, components, new_dir  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, m long, h long, n int"
WORDS = ["the", "of", "tionre", "anded", "ouin", "ñez", "Éa", "loser", "idiot", "x1", "thble.", "a,b", "’s", "i'm"]


def messy(n=160, seed=5):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(60, 260))) for _ in range(12)]
    texts = [None, "", " \t\n", "a", "A b c", " ".join(["same"] * 3000), "x" * 20000, "\x0b\x0cq\xa0　w", "<|endoftext|>hi <|startoftext|>"]
    for _ in range(n - len(texts)):
        kind, t = rnd.random(), rnd.choice(base)
        words = t.split()
        if kind < 0.3:
            texts.append(t)
        elif kind < 0.6:
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS)
            texts.append(" ".join(words))
        elif kind < 0.8:
            other = rnd.choice(base).split()
            at = rnd.randrange(len(words))
            texts.append("  ".join(words[:at] + other[: rnd.randint(40, 90)] + words[at:]))
        else:
            texts.append("\n".join(rnd.choice(WORDS).upper() for _ in range(rnd.randint(0, 120))))
    rnd.shuffle(texts)
    rows = [(i * 3, t, None, "src", 1, 7, 8, 9) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return messy()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def sha(b):
    return hashlib.sha256(b).hexdigest()


def with_odd_rows(spark, docs):
    """The same rows again, and rows without a doc_id."""
    return docs.union(docs.limit(3)).union(spark.createDataFrame([(None, "the of", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], DOCS))


def test_token_counts(spark, docs, rows, empty, library):
    cache = new_dir(spark, "cache")
    run = lambda d, path=queries.tokenizer_path(): token_counts.count_tokens(spark, d, path, cache).collect()
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in run(docs)} == want
    stored = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache)
    before = stored.count()
    assert before <= len({t for _, t, *_ in rows})
    again = run(docs)
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in again} == want and all(r.over_limit == (r.n_tokens > 2048) for r in again)
    assert spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).count() == before
    odd = run(with_odd_rows(spark, docs))
    n = len(library.encode("the of", add_special_tokens=False).ids)
    assert len(odd) == len(rows) + 5 and sorted(r.n_tokens for r in odd if r.doc_id is None) == [0, n] and all((r.n_bytes, r.n_tokens) == want[r.doc_id] for r in odd if r.doc_id is not None)
    small = token_counts.count_tokens(spark, with_odd_rows(spark, docs), queries.tokenizer_path(), new_dir(spark, "cache"), bits=8)  # full filters
    assert sorted(map(tuple, small.collect()), key=repr) == sorted(map(tuple, odd), key=repr)
    assert token_counts.count_tokens(spark, empty, queries.tokenizer_path(), new_dir(spark, "cache")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_other_files(spark, docs, rows, name):
    path = queries.tokenizer_path(name)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark, docs, path, new_dir(spark, "cache")).collect()}
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        assert got == {i: len(model.encode(t or "")) for i, t, *_ in rows}


def test_bpe_codec(library):
    codec, rnd = bpe.Codec(bpe.compiled(queries.tokenizer_path())), random.Random(2)
    letters = "abcdeEIOUnst'!&1 2éßΣİ中́\x1c\x85​　ªǅ😀aaaa\n"
    for k in range(1500):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        text = text + "<|endoftext|>" + text[:3] if k % 7 == 0 else text[:1] * rnd.randint(1, 60) if k % 11 == 0 else text
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.whole(text) == (struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)), repr(text)


def test_bpe_every_letter(library):
    """Each code point between two letters, as the file's library has it."""
    codec = bpe.Codec(bpe.compiled(queries.tokenizer_path()))
    for low in range(0, 0x110000, 1 << 14):
        texts = [f"a{chr(c)}b" for c in range(low, low + (1 << 14)) if not 0xD800 <= c < 0xE000]
        for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            got = codec.whole(text)
            assert got[0] == struct.pack(f"<{len(e.ids)}I", *e.ids), repr(text)
            assert got[1] == " ".join(e.tokens), repr(text)


def test_bpe_long_words(library):
    codec = bpe.Codec(bpe.compiled(queries.tokenizer_path()))
    for word in ("a" * 100_000, "the" * 20_000, "\u4e2d" * 10_000, "ab" * 2_000_000):
        ids = library.encode(word, add_special_tokens=False).ids
        assert codec.whole(word)[0] == struct.pack(f"<{len(ids)}I", *ids)


def test_merge_gadgets():
    """The automaton of random merges against merging one by one, oldest first and from the left."""
    rnd = random.Random(11)
    letters = bpe.byte_letters()
    for _ in range(60):
        few = letters[97:100]
        vocab = {x: i for i, x in enumerate([*letters, *(x + "</w>" for x in letters)])}
        known, merges = [*few, *(x + "</w>" for x in few)], []
        for _ in range(rnd.randint(1, 40)):
            left, right = rnd.choice([x for x in known if not x.endswith("</w>")]), rnd.choice(known)
            if left + right not in vocab:
                vocab[left + right] = len(vocab)
                known.append(left + right)
                merges.append([left, right])
        automaton = bpe.compile_merges({"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"})
        for _ in range(120):
            word = "".join(rnd.choice(few) for _ in range(rnd.randint(1, 14)))
            parts = [*word[:-1], word[-1] + "</w>"]
            for left, right in merges:
                out, k = [], 0
                while k < len(parts):
                    two = parts[k : k + 2] == [left, right]
                    out.append(left + right if two else parts[k])
                    k += 1 + two
                parts = out
            assert automaton.encode_word(word.encode()) == [vocab[x] for x in parts], (word, merges)


def test_bpe_query(spark, docs, rows, empty, library):
    got = {r.doc_id: r for r in queries.digested(bpe.encode_decode(docs, queries.tokenizer_path())).collect()}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode()))
    assert bpe.encode_decode(with_odd_rows(spark, docs), queries.tokenizer_path()).count() == len(rows) + 5
    assert bpe.encode_decode(empty, queries.tokenizer_path()).count() == 0


def test_exact(spark, docs, rows, empty):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = {(i, max(g), len(g), i == max(g), sha(t.encode())) for t, g in groups.items() for i in g}
    for bits in (26, 8):  # the smaller filter is full: all rows take the way over the shuffle
        assert {tuple(r) for r in exact_dedup.exact_groups(docs, bits).collect()} == want
    odd = exact_dedup.exact_groups(with_odd_rows(spark, docs)).collect()
    assert len(odd) == len(rows) + 5 and sum(r.kept for r in odd if r.doc_id is not None) >= len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, now = (low + high) // 2, 1, 0
        for s in sizes:
            n, now = (n + 1, s) if now + s > mid else (n, now + s)
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def test_minimax_cuts():
    rnd = random.Random(3)
    for t in range(150):
        shards = rnd.randint(1, 12)
        keys = sorted({rnd.randint(-(2**63), 2**63 - 1) if rnd.random() < 0.5 else rnd.randint(0, 2**50) for _ in range(rnd.randint(1, 300))})
        groups = [(h, rnd.choice([17, 100, rnd.randint(16, 5000), 10**6 if t % 5 == 0 else 20])) for h in keys]

        def atoms(items, shift):
            by = defaultdict(list)
            for h, s in items:
                by[h >> shift].append(s)
            return sorted((sharding.Atom(k << shift, shift, sum(v), len(v), max(v)) for k, v in by.items()), key=lambda a: a.lo)

        refine = lambda open_: [x for a in open_ for x in atoms([g for g in groups if g[0] >> a.shift == a.lo >> a.shift], max(0, a.shift - 6))]
        best, cuts = sharding.minimax_cuts(atoms(groups, 60), shards, refine)
        assert best == capacity([s for _, s in groups], shards)
        total = [0] * shards
        for h, s in groups:
            total[sum(h >= c for c in cuts)] += s
        assert max(total) <= best


def test_shard(spark, docs, rows, empty):
    got = sharding.shard(docs, 7).collect()
    text = {i: (t or "").encode() for i, t, *_ in rows}
    assert len(got) == len(rows) and all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "bytes" and r.grown_shard is None for r in got)
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r.shard].append(r.slot)
        by_text[text[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and all(len(s) == 1 for s in by_text.values())
    assert len(sharding.shard(with_odd_rows(spark, docs), 7).collect()) == len(rows) + 5
    assert sharding.shard(empty).count() == 0


def removed(texts, window):
    """By brute force: doc -> words, kept words."""
    words = {i: (t or "").encode().split() for i, t in texts}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


@pytest.mark.parametrize("window,gram,bits,hot", [(50, 16, 26, 20_000), (50, 16, 8, 2), (12, 5, 20, 3)])
def test_substrings(spark, docs, rows, empty, window, gram, bits, hot):
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.remove_repeats(spark, docs, window, gram, bits, hot).collect()}
    want = removed([(i, t) for i, t, *_ in rows], window)
    assert got == want and sum(x[1] for x in want.values()) > 1000
    if hot == 2:
        assert substring_dedup.remove_repeats(spark, with_odd_rows(spark, docs)).count() == len(rows) + 5
        assert substring_dedup.remove_repeats(spark, empty).count() == 0


def test_substrings_long_texts(spark):
    """One word over and over, and a long text within a longer one."""
    rnd = random.Random(6)
    prose = " ".join(f"{rnd.choice(WORDS)}{rnd.randint(0, 500)}" for _ in range(60_000))
    rows = [(5, "w " * 1_000_000), (3, "w " * 700_000), (9, f"own words {prose} more of them"), (None, prose), (7, prose), (7, prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark, df).collect()), key=repr)
    assert got == sorted([(5, 1_000_000, 1_000_000), (3, 700_000, 0), (9, 60_005, 60_000), (None, 60_000, 0), (7, 60_000, 0), (7, 60_000, 0)], key=repr)


def test_lines(spark):
    page = lambda *lines: "<html><head><script>x<p></script></head><body>" + "".join(f"<p class='a'> {x} </p>" for x in lines) + "<!-- c\n --></body></html>"
    rows = [(i, f"https://A.example/{i}?q", page("Menu", f"own <b>{i}</b>", "Menu", "twice" if i < 2 else "")) for i in range(5)]
    rows += [(10, "http://b.example", page("Menu", "x")), (11, None, None), (12, "nonsense", ""), (0, "https://A.example/0?q", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n", "'x' as host", "'y' as line")
    got = sorted((r.page_id, r.host, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_boilerplate(df).collect() if r.page_id)
    assert got[:4] == [(1, "a.example", 4, 2, "own 1\ntwice")] + [(i, "a.example", 3, 2, f"own {i}") for i in (2, 3, 4)]
    assert got[4:] == [(10, "b.example", 2, 0, "Menu\nx"), (11, "", 0, 0, ""), (12, "", 0, 0, "")]
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_chats(spark):
    call = lambda *cs: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in cs]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", "é"), (1, 1, "tool", result("b", 2)), (1, 2, "assistant", call(("a", "add", {"y": 1, "x": 2}), ("b", "add", {"x": {"$result": "a"}, "y": 3}))),
        (1, 3, "tool", result("a", "ok")), (1, 4, "assistant", call(("c", "add", {"x": {"$result": "d"}}), ("d", "add", {"x": {"$result": "c"}}))), (1, 5, "tool", result("zz", 0)),
        (2, 0, "assistant", call(("a", "none", {}))), (2, 1, "assistant", call(("q", "add", {"x": "no", "y": 1}))), (3, None, None, None), (None, 1, "tool", result("a", 1)), (4, 0, "assistant", "{broken"),
    ]
    schema = {"add": {"type": "object", "properties": {"x": {"enum": [2, {"$result": "a"}, {"$result": "c"}, {"$result": "d"}]}, "y": {"type": "integer"}}, "required": ["x"]}}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as kind", "2 as level")
    got = {(r.conv_id, r.turn, r.part): r for r in chat_format.format_chats(df, schema).collect()}
    assert len(got) == 13
    flat = {k: (r.kind, r.linked, r.valid, r.level, r.place_turn) for k, r in got.items()}
    assert flat[1, 0, 0] == ("message", None, True, 0, 0) and got[1, 0, 0].json == '{"content":"é","role":"user"}'
    assert flat[1, 1, 0] == ("result", True, True, 3, 2) and flat[1, 3, 0] == ("result", True, True, 1, 3)
    assert flat[1, 2, 0] == ("call", True, True, 0, 2) and flat[1, 2, 1] == ("call", True, True, 2, 2)
    assert got[1, 2, 0].json == '{"role":"assistant","tool_call":{"arguments":{"x":2,"y":1},"id":"a","name":"add"}}'
    assert flat[1, 4, 0][1:4] == (False, False, None) and flat[1, 4, 1][1:4] == (False, False, None)
    assert flat[1, 5, 0][1] is False and flat[2, 0, 0][2] is False and flat[2, 1, 0][2] is False
    assert flat[3, None, 0][0] == "message" and flat[None, 1, 0][1] is False and flat[4, 0, 0][0] == "message"
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chats_odd_values():
    fits, parse = chat_format.fits, chat_format.parse
    deep = lambda n: json.loads("[" * n + "]" * n)
    assert fits(None, {"type": ["string", "null"]}) and not fits(1, {"type": ["string", "null"]}) and not fits(1, {"type": "nonsense"})
    assert fits(1.0, {"type": "integer"}) and not fits(1.5, {"type": "integer"}) and not fits(True, {"type": "number"}) and not fits(True, {"enum": [1]})
    assert fits(1.0, {"enum": [1]}) and fits(deep(900), {"items": True}) and not fits({"a": 1}, {"additionalProperties": {"type": "string"}}) and not fits(1, False)
    call = lambda i, a, n="t": json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a}]})
    for text in (call("x", float("nan")), call("x", {"a": float("inf")}), '{"tool_calls":[{"id":"x","arguments":1e999}]}', "{" * 100_000, '{"a":' * 30_000 + "1" + "}" * 30_000, '{"a":' + "9" * 5000 + "}"):
        assert parse("assistant", text, {})[0][0] == "message"
    for depth in (2_000, 20_000):
        kind, *_, out = parse("assistant", '{"tool_calls":[{"id":"x","name":"t","arguments":{"v":' + "[" * depth + '{"$result":"y"}' + "]" * depth + "}}]}", {"t": {}})[0]
        assert kind in ("call", "message") and json.loads(out) if depth == 2_000 else kind == "message"
    kind, call_id, ok, needs, out = parse("assistant", call("\ud800", {"v": {"$result": "\udfff"}}, "\ud900"), {"\ud900": {}})[0]
    assert (kind, call_id, ok, needs) == ("call", '"\\ud800"', True, ['"\\udfff"']) and out.encode() and json.loads(out)["tool_call"]["id"] == "\ud800"
    assert parse("tool", json.dumps({"tool_call_id": "\ud800", "content": "\ud800"}), {})[0][1] == call_id and chat_format.identifier('"q') != '"q'


def linked_chats(rows, schemas):
    """By brute force, a conversation at a time."""
    parts = [(c, t, k, *p) for c, t, role, text in rows for k, p in enumerate(chat_format.parse(role, text, schemas))]
    out = []
    for conv in {p[0] for p in parts}:
        mine = [p for p in parts if p[0] == conv]
        calls = {}
        for p in sorted((p for p in mine if p[3] == "call" and p[4] is not None and conv is not None), key=lambda p: (p[1] is not None, p[1] or 0, p[2], p[6])):
            calls.setdefault(p[4], p)
        level, turn = {c: 0 for c in calls}, {c: p[1] for c, p in calls.items()}
        for _ in range(len(calls) + 1):  # a chain has no more steps than calls
            before = dict(level)
            for c, p in calls.items():
                for n in p[6]:
                    if n in calls:
                        level[c] = max(level[c], before[n] + 1)
                        turn[c] = max((t for t in (turn[c], turn[n]) if t is not None), default=None)
        stuck = {c for c in calls if level[c] >= len(calls)}
        for _ in calls:
            stuck |= {c for c, p in calls.items() if stuck.intersection(p[6])}
        answered = {p[4] for p in mine if p[3] == "result"}
        for c, t, k, kind, call_id, valid, _, text in mine:
            met = call_id in calls and call_id not in stuck
            linked = met if kind == "result" else met and call_id in answered if kind == "call" else None
            deep = 0 if kind == "message" else (2 * level[call_id] if met else None) if kind == "call" else 2 * level[call_id] + 1 if met else 1
            place = max((x for x in (t, turn[call_id] if met else None) if x is not None), default=None)
            out.append((c, t, k, kind, call_id, linked, valid and (kind != "call" or met), deep, place, text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("local", [5_000, 6])
def test_chats_against_brute_force(spark, local):
    rnd, rows = random.Random(4), []
    for conv in [*range(600), None]:
        ids = [f"c{k}" for k in range(rnd.choice([0, 1, 3, 8, 30 if conv and conv % 50 == 0 else 5]))]
        for t in range(rnd.randint(1, 8)):
            kind = rnd.random()
            if kind < 0.3 or not ids:
                rows.append((conv, t, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", None, "", "{", '{"tool_calls": []}', "é" * 50])))
            elif kind < 0.8:
                made = []
                for _ in range(rnd.randint(1, 5)):
                    needs = rnd.sample(ids, min(len(ids), rnd.choice([0, 0, 1, 2]))) + (["missing"] if rnd.random() < 0.1 else [])
                    args = {"x": [{"$result": n} for n in needs], "y": rnd.choice([1, 1.0, "s", None, True])}
                    made.append({"id": rnd.choice([*ids, None]), "name": rnd.choice(["add", "none"]), "arguments": rnd.choice([args, args, args, 3])})
                rows.append((conv, rnd.choice([t, t, None]), "assistant", json.dumps({"tool_calls": made})))
            else:
                rows.append((conv, t, "tool", json.dumps({"tool_call_id": rnd.choice([*ids, "missing"]), "content": rnd.choice([1, "r", None])})))
        if rnd.random() < 0.1:
            rows.append(rows[-1])
    chain = [{"id": f"k{k}", "name": "add", "arguments": {"x": [{"$result": f"k{k - 1}"}] if k else [], "y": 1}} for k in range(12)]
    rows += [(1000, 12 - k, "assistant", json.dumps({"tool_calls": [c]})) for k, c in enumerate(chain)] + [(1000, 0, "tool", json.dumps({"tool_call_id": "k11", "content": 1}))]
    rows.append((1001, 0, "user", "w " * 2_500_000))
    schemas = {"add": {"type": "object", "properties": {"x": {"type": "array"}, "y": {"type": ["integer", "null"]}}, "required": ["x"]}}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as salt", "2 as level").repartition(4)
    got = [tuple(r) for r in chat_format.format_chats(df, schemas, local).collect()]
    want = linked_chats(rows, schemas)
    assert sorted(got, key=repr) == want
    assert sum(bool(r[5]) for r in want) > 300 and any(r[7] is None for r in want) and max(r[7] or 0 for r in want) >= 23


def hits(texts, items, window=13):
    out = {}
    wins = [(i, w) for i, t in items if i is not None for w in decontamination.windows_of(decontamination.words_of(t or ""), window)]
    for d, t in texts:
        ws, hit, found = decontamination.words_of(t or ""), set(), set()
        starts = defaultdict(list)
        for k, x in enumerate(ws):
            starts[x].append(k)
        for i, w in wins:
            for k in starts[w[0]]:
                if tuple(ws[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    found.add(i)
        out[d] = (len(ws), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit) and 20 * len(hit) >= len(ws))
    return out


@pytest.mark.parametrize("bits,salts", [(26, 16), (7, 1)])
def test_contamination(spark, docs, rows, empty, bits, salts):
    texts = [(i, t) for i, t, *_ in rows]
    long_ones = [t for _, t in texts if t and len(t.split()) > 60][:6]
    items = [(k, " ".join(t.split()[k : k + 20])) for k, t in enumerate(long_ones)] + [(30 + k, " ".join(long_ones[k].split()[9 : 9 + n])) for k, n in enumerate((2, 4, 5, 6, 12))] + [(20, "The same same"), (21, None), (22, ""), (23, "a a a"), (24, long_ones[0].upper()), (None, "the"), (25, "a")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in queries.contaminated(decontamination.contamination(spark, docs, table, bits, salts)).collect()}
    want = hits(texts, items)
    odd = [(None, texts[5][1]), (3, long_ones[0]), (3, "a"), (3, None), (None, "A a, A! " * 50), (77, " ".join(t or "" for _, t in texts) + " b" * 1_000_000)]
    frame = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in odd], "doc_id long, text string, row string, words string, size int")
    found = sorted(tuple(r)[1:] for r in queries.contaminated(decontamination.contamination(spark, frame, table, bits, salts)).collect())
    assert found == sorted(x for k, (_, t) in enumerate(odd) for x in hits([(k, t)], items).values())
    assert got == want and any(x[4] for x in want.values()) and not all(x[4] for x in want.values())
    assert decontamination.contamination(spark, docs, table.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(spark, empty, table).count() == 0


def test_words_of_pattern():
    import regex

    text = "".join(map(chr, range(1, 400))) + " Aé’中B0_z"
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    assert [w.decode() for w in decontamination.words_of(text)] == regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_duplicates(spark, docs, rows, empty):
    fps = {i: fingerprint(t) for i, t, *_ in rows}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps} and len(set(root.values())) < len(root) - 20
    assert simhash.near_duplicates(spark, with_odd_rows(spark, docs)).count() == len(rows) + 5
    assert simhash.near_duplicates(spark, empty).count() == 0


def test_keys_meet():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 5, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    mine, theirs = defaultdict(set), defaultdict(set)
    for out, fps in ((mine, x), (theirs, y)):
        for r, k in zip(*simhash.keys(fps), strict=True):
            out[r].add(k)
    assert all(mine[i] & theirs[i] for i in range(len(x)))
    assert sorted(set(simhash.golay_tables()[2].tolist())) == [1, 6]


def test_large_buckets():
    """A bucket of many fingerprints, few of them near each other, links as two by two comparison does."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 6000, dtype=np.uint64)
    near = fps[:500].copy()
    for i in range(len(near)):
        for b in rng.choice(64, 1 + i % 5, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate([fps, near, fps[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    group = {int(f): int(f) for f in fps}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a, b in simhash.bucket_links(fps):
        assert (a ^ b).bit_count() <= 4
        group[find(a)] = find(b)
    for f in fps:
        for g in fps[np.bitwise_count(fps ^ f) <= 4]:
            assert find(int(f)) == find(int(g))


def test_long_texts_fingerprint():
    rnd = random.Random(8)
    long = " ".join(rnd.choice(WORDS) for _ in range(60_001))
    assert [f"{x:016x}" for x in simhash.fingerprints(["a b", long, "", "same " * 1_000_000])] == [f"{fingerprint(t):016x}" for t in ("a b", long, "", "same same same same")]


def test_bucket_links_span():
    rng = np.random.default_rng(1)
    fps = np.unique((rng.integers(0, 2**64, 1, dtype=np.uint64)[0] ^ (np.uint64(1) << rng.integers(0, 64, (400, 3)).astype(np.uint64)).sum(axis=1).astype(np.uint64)))
    links = list(simhash.bucket_links(fps))
    group = {int(f): int(f) for f in fps}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a, b in links:
        assert (a ^ b).bit_count() <= 4
        group[find(a)] = find(b)
    assert len(links) < len(fps) and all(find(int(a)) == find(int(b)) for a in fps for b in fps if (int(a) ^ int(b)).bit_count() <= 4)


def test_components_of_a_chain(spark):
    rnd = random.Random(1)
    order = list(range(40))
    rnd.shuffle(order)
    edges = list(zip(order, order[1:], strict=False)) + [(100, 101), (101, 100), (7, 7)] + [(200, k) for k in range(201, 240)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(40)} | {100: 100, 101: 100} | {k: 200 for k in range(200, 240)}


def test_attach_stats(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).selectExpr("id", "if(id < 400, 0, id % 7) as g")
    got = attach_stats(df, ["g"], F.col("id"), salts=8, top=("max", "id"), low=("min", "id"), n=("count", "id")).collect()
    assert len(got) == 500 and all((r.top, r.low) == (max(x.id for x in got if x.g == r.g), min(x.id for x in got if x.g == r.g)) for r in got[:40])


def toxic_rows(n=900):
    rnd = random.Random(9)
    plain = ["".join(rnd.choice("aeioustnr") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [rnd.choice(plain) for _ in range(rnd.randint(30, 300))]
        if bad:
            for _ in range(2 + len(words) // 40):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "Scum", "loser!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def kneser_ney(rows, truth):
    """By brute force, in plain dicts: text -> log-likelihood difference a word, and the share that each class leaves to the backoff."""
    pairs, occurs = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            ws = decontamination.words_of(t)
            for before, w in zip([None, *ws], ws, strict=False):
                pairs[before, w][truth[i]] += 1
                occurs[w][truth[i]] += 1
    contexts = defaultdict(lambda: [0, 0, 0])
    for (_, w), n in pairs.items():
        for k in (0, 1):
            contexts[w][k] += n[k] > 0
        contexts[w][2] += 1
    total = [sum(c[k] for c in contexts.values()) for k in (0, 1)]
    taken = [sum(min(c[k], toxicity.DISCOUNT) for c in contexts.values()) for k in (0, 1)]
    left = max(taken[k] / total[k] for k in (0, 1))
    discount = [max(toxicity.PAIR_DISCOUNT, sum(n[k] for n in occurs.values()) / toxicity.MOST_EXPRESSIONS) for k in (0, 1)]

    def word(w, k):
        c = contexts.get(w, (0, 0, 0))
        return (1 - left) * max(c[k] - toxicity.DISCOUNT, 0) / (total[k] - taken[k]) + left * (c[2] + 1) / (len(pairs) + len(contexts) + 1)

    excess = {k: {p: n[k] - discount[k] for p, n in pairs.items() if p[0] is not None and n[k] > discount[k]} for k in (0, 1)}

    def after(before, w, k):
        mine = {p: x for p, x in excess[k].items() if p[0] == before}
        own = max(occurs[before][k], 1) if before in occurs else 1
        return mine.get((before, w), 0) / own + (1 - sum(mine.values()) / own) * word(w, k)

    def gain(t):
        ws = decontamination.words_of(t or "")
        total = 0
        for before, w in zip([None, *ws], ws, strict=False):
            p0, p1 = after(before, w, 0), after(before, w, 1)
            total += math.log((1 - toxicity.SHARE) + toxicity.SHARE * p1 / p0)
        return total / (len(ws) + toxicity.LENGTH_PRIOR)

    norm = [sum(word(w, k) for w in contexts) + word(None, k) for k in (0, 1)]
    after_norm = [sum(after(b, w, k) for w in contexts) + after(b, None, k) for k in (0, 1) for b in {p[0] for p in excess[k]}]
    assert norm == pytest.approx([1, 1]) and after_norm and after_norm == pytest.approx([1] * len(after_norm))
    return gain


@pytest.mark.parametrize("block", [1_500_000, 60])
def test_toxicity(spark, empty, block):
    rows, labels = toxic_rows()
    truth = dict(labels)
    # an expression of ordinary words, often in toxic texts and never elsewhere
    rows = [(i, t + " you there" * 2 if truth[i] else "there you " + t) for i, t in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, t) for i, t in labels] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(spark, docs, marks)
    odd = [(None, "idiot scum loser idiot scum"), (5000, None), (5001, ""), (5002, "nothing known of these " * 30), (5003, "you there " * 40), (5004, "there " * 40 + "you " * 40), (0, rows[1][1]), (0, rows[1][1]), (5005, "idiot " * 300_000)]
    extra = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as gain", "'x' as digest", "2 as word", "3 as salt")
    found = toxicity.score(spark, extra, model, block_words=block).collect()
    got = {(r.doc_id, r.score) for r in found}
    gain, (at, slope) = kneser_ney(rows, truth), model.scale
    want = {(i, 1 / (1 + math.exp(-(at + slope * math.asinh(gain(t) / toxicity.BEND))))) for i, t in [*rows, *odd]}
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert len(found) == len(rows) + len(odd) and len(got) == len(want)
    for (i, x), (j, y) in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert i == j and x == pytest.approx(y, rel=1e-9)
    by_id = {r.doc_id: r for r in found}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in truth if by_id[i].held_out} == set(out) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert sum(by_id[i].predicted == truth[i] for i in out) >= 0.97 * len(out)
    assert by_id[5000].score == by_id[5001].score and by_id[5000].predicted == 0 and by_id[None].held_out
    assert by_id[5002].predicted == 0  # words that neither class knows
    assert by_id[5003].score > by_id[5004].score  # the same words in another order
    if block == 60:
        # held-out labels don't matter
        other = spark.createDataFrame([(i, 1, 1 - t if i in out else t) for i, t in labels], "doc_id long, quality int, toxic int")
        again = toxicity.learn(spark, docs, other)
        assert again.scale == model.scale and again.totals == model.totals
        assert toxicity.score(spark, empty, toxicity.learn(spark, empty, marks.limit(0))).count() == 0
        one_class = toxicity.learn(spark, docs, marks.where("toxic = 0"))
        assert toxicity.score(spark, docs, one_class).where("predicted = 1").count() == 0


def test_toxicity_keeps_all_pairs(spark, monkeypatch):
    """More pairs and contexts than are broadcast at once: each keeps its count, and further passes score the rest."""
    rnd = random.Random(17)
    words = [f"w{k}" for k in range(16)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (k + 1 + 3 * (i % 4 == 0) * (k % 2)) for k in range(16)], k=90))) for i in range(160)]
    truth = {i: int(i % 4 == 0) for i, _ in rows}
    monkeypatch.setattr(toxicity, "PAIR_DISCOUNT", 30.0)
    gain = kneser_ney(rows, truth)
    monkeypatch.setattr(toxicity, "MOST_EXPRESSIONS", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(spark, docs, spark.createDataFrame(list(truth.items()), "doc_id long, toxic int"))
    pairs = model.expressions.count()
    assert pairs > 8
    places = [b[0] for b in model.blocks(1000)]
    n, _, m, _ = places[0]
    assert n > 1 and m > 1 and len(places) == len(set(places)) == n * m
    assert sum(len(b[2][0]) for b in model.blocks(1000)) == pairs
    at, slope = model.scale
    again = [(1000, rows[0][1]), (1001, " ".join(reversed(rows[0][1].split()))), (1002, "w0"), (1003, ""), (1004, None), (1005, "unknown w0 w1")]
    found = toxicity.score(spark, docs.union(spark.createDataFrame(again, "doc_id long, text string")), model).collect()
    want = {i: 1 / (1 + math.exp(-(at + slope * math.asinh(gain(t) / toxicity.BEND)))) for i, t in [*rows, *again]}
    assert len(found) == len(want) and {r.doc_id: r.score for r in found} == pytest.approx(want, rel=1e-9)
    assert want[1000] != pytest.approx(want[1001], rel=1e-6)


def test_toxicity_scale_is_of_all_rows(spark, monkeypatch):
    """More labelled rows than a sample would hold: the scale is the optimum over all of them, by brute force."""
    rnd = random.Random(23)
    words = [f"w{k}" for k in range(400)]
    truth = {i: int(i % 5 == 0) for i in range(8000)}
    rows = [(i, " ".join([*rnd.choices(words, k=rnd.randint(0, 8)), *rnd.choices(["bad", "worse", "vile", "foul", "w1", "w2"], k=2 * t)])) for i, t in truth.items()]
    docs = spark.createDataFrame([*rows, (10, rows[7][1])], "doc_id long, text string")
    train = {i for i in truth if zlib.crc32(str(i).encode()) % 3 != 1}
    split = [(truth[i], t.split()) for i, t in [*rows, (10, rows[7][1])] if i in train]
    known = defaultdict(lambda: [0, 0])
    for toxic, ws in split:
        for p in zip([None, *ws], ws, strict=False):
            known[p][toxic] += 1
    assert len(split) > 5000 and max(max(n) for (b, _), n in known.items() if b) <= toxicity.PAIR_DISCOUNT
    contexts = defaultdict(lambda: [0, 0, 0])
    for (_, w), n in known.items():
        for k, one in enumerate([n[0] > 0, n[1] > 0, True]):
            contexts[w][k] += one
    total = [sum(c[k] for c in contexts.values()) for k in (0, 1)]
    taken = [sum(min(c[k], toxicity.DISCOUNT) for c in contexts.values()) for k in (0, 1)]
    left = max(taken[k] / total[k] for k in (0, 1))

    def evidence(toxic, ws):
        own, gain = defaultdict(set), 0
        for before, w in zip([None, *ws], ws, strict=False):
            own[w].add(before)
        for w in ws:
            c = [max(contexts[w][k] - (len(own[w]) if k in (toxic, 2) else 0), 0) for k in (0, 1, 2)]
            p = [(1 - left) * max(c[k] - toxicity.DISCOUNT, 0) / (total[k] - taken[k]) + left * (c[2] + 1) / (len(known) + len(contexts) + 1) for k in (0, 1)]
            gain += math.log(1 - toxicity.SHARE + toxicity.SHARE * p[1] / p[0])
        return math.asinh(gain / (len(ws) + toxicity.LENGTH_PRIOR) / toxicity.BEND)

    x, y = np.array([evidence(*r) for r in split]), np.array([r[0] for r in split])
    marks = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    for block in (1_500_000, 150):
        monkeypatch.setattr(toxicity, "BLOCK_WORDS", block)
        model = toxicity.learn(spark, docs, marks)
        at, slope = model.scale
        p = 1 / (1 + np.exp(-(at + slope * x)))
        # both derivatives of the likelihood, with the slope's ridge, vanish
        assert abs((y - p).mean()) < 1e-9 and abs(((y - p) * x).mean() / x.std() - 1e-3 * slope * x.std()) < 1e-9


def test_toxicity_workers_need_no_package(spark, tmp_path):
    """What goes to the workers can be read where this package isn't."""
    import pickle
    import subprocess
    import sys

    rows, labels = toxic_rows(120)
    model = toxicity.learn(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    with open(tmp_path / "block", "wb") as f:
        pickle.dump(next(model.blocks(1000)), f)
    subprocess.run([sys.executable, "-c", "import pickle; pickle.load(open('block', 'rb'))"], cwd=tmp_path, check=True, env={"PATH": ""})


def test_long_texts(spark, library):
    """A text of one word 5 MB long, one of one word over and over, and one of 20 MB, through each operator on texts."""
    rnd = random.Random(12)
    prose = " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 900)) for _ in range(20_000))
    rows = [(1, "x" * 5_000_000), (2, "same " * 1_000_000), (3, f"{prose} " * 130), (4, "short one")]
    assert len(rows[2][1].encode()) > 15_000_000
    texts, docs = dict(rows), spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    n_ids = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {i: r.n_tokens for i, r in by_id(token_counts.count_tokens(spark, docs, queries.tokenizer_path(), new_dir(spark, "cache"))).items()} == n_ids
    assert {i: r.n_tokens for i, r in by_id(queries.digested(bpe.encode_decode(docs, queries.tokenizer_path()))).items()} == n_ids
    train, labels = toxic_rows(200)
    model = toxicity.learn(spark, spark.createDataFrame(train, "doc_id long, text string").union(docs), spark.createDataFrame([*labels, (10_002, 0)], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(spark, docs, model).collect())
    assert {i: r.size for i, r in by_id(sharding.shard(docs, 3)).items()} == {i: len(t.encode()) + 16 for i, t in rows}
    assert {i: r.text_sha256 for i, r in by_id(exact_dedup.exact_groups(docs)).items()} == {i: sha(t.encode()) for i, t in rows}
    assert {i: (r.n_words, r.n_removed) for i, r in by_id(substring_dedup.remove_repeats(spark, docs)).items()} == {i: (len(t.split()), 0) for i, t in rows}
    item = spark.createDataFrame([(0, prose[:2000]), (1, "same same same")], "item_id long, text string")
    found = by_id(decontamination.contamination(spark, docs, item))
    assert (found[1].n_hit, found[2].n_hit, found[4].n_hit) == (0, 1_000_000, 0) and found[3].n_hit >= 130 * 100 and list(found[3].items) == [0]
    near = by_id(simhash.near_duplicates(spark, docs))
    assert near[1].fingerprint == f"{fingerprint(texts[1]):016x}" and near[2].fingerprint == f"{fingerprint('same same same same'):016x}"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_rows(400)
    docs = [(i, t, "en", "src", len(t)) for i, t in rows]
    docs += [(1000 + k, rows[1][1], "en", "src", 1) for k in range(4)] + [(2000, None, None, None, None), (2001, rows[2][1] + " tail", "en", "src", 1)]
    item = " ".join(rows[3][1].split()[:25])
    # one passage in a long document, under a twentieth of it
    docs.append((3000, " ".join(f"long{k * k % 997}" for k in range(900)) + f" {item} " + " ".join(f"end{k * k % 997}" for k in range(900)), "en", "src", 1))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id: r.text for r in at.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, at, str(tmp_path))
        got.write.parquet(f"{tmp_path}/out{k}")
        after = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert after.columns == at.columns
        ids = {r.doc_id for r in after.collect()}
        gone = set(left) - ids
        if name == "toxicity":
            assert sum(i % 6 == 0 and i < 1000 for i in gone) > 0.9 * len([i for i in left if i < 400 and i % 6 == 0]) and sum(i % 6 != 0 for i in gone) <= 3
        elif name == "exact_dedup":
            assert gone == {1, 1000, 1001, 1002} & set(left)
        elif name == "simhash_near_dedup":
            fps = {i: fingerprint(t) for i, t in left.items()}
            root = {i: min(j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
            assert gone == {i for i in fps if root[i] != i}
        elif name == "benchmark_decontamination":
            assert gone == {d for d, x in hits(left.items(), [(0, item)]).items() if x[1]} and 3000 in gone
        left = {i: left[i] for i in ids}
        at = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left)


def test_pipeline_odd_ids(spark, tmp_path):
    """Null and repeated doc_ids in every stage: rows are dropped one by one, and each group keeps one."""
    import corpus_pipeline

    stages, schema = dict(corpus_pipeline.STAGES), "doc_id long, text string, lang string"
    train, labels = toxic_rows(400)
    bad, item = "idiot Scum loser! " * 8, " ".join(f"item{k}" for k in range(30))
    prose = [" ".join(f"{c}{(k * k + 7 * k) % 91}" for k in range(80)) for c in "abcdefgh"]
    a, b, c, d, e, f, g, _ = prose
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(name, rows):
        df = spark.createDataFrame([(*r, "en") for r in rows], schema).repartition(3)
        got = stages[name](spark, df, str(tmp_path))
        assert name == "bpe" or got.columns == df.columns
        return sorted(((r.doc_id, r.text) if name != "bpe" else r.doc_id for r in got.collect()), key=repr)

    ordered = lambda rows: sorted(rows, key=repr)
    odd = [(None, a), (None, b), (9000, c), (None, None), (None, "")]
    assert [r for r in left("toxicity", [*train, *odd, (None, bad), (9000, bad)]) if r[0] is None or r[0] == 9000] == ordered(odd)
    mixed = [(None, a), (None, a), (None, b), (3, b), (5, b), (7, c), (7, c), (7, d), (None, e), (None, None), (None, ""), (8, f)]
    got = left("exact_dedup", mixed)
    assert ordered((i, t or "") for i, t in got) == ordered([(None, a), (5, b), (7, c), (7, d), (None, e), (None, ""), (8, f)])
    mixed = [(None, a), (None, a.upper()), (None, b), (3, b.upper()), (5, b + " "), (7, c), (7, c), (7, d), (None, e), (None, None), (None, ""), (8, f)]
    got = ordered((i, (t or "").lower()) for i, t in left("simhash_near_dedup", mixed))
    assert got == ordered([(None, a), (3, b), (7, c), (7, d), (None, e), (None, ""), (8, f)])
    clean = [(None, a), (None, b), (4, c), (4, c), (None, None)]
    assert left("benchmark_decontamination", [*clean, (None, f"x {item}"), (4, f"y {item}")]) == ordered(clean)
    assert left("bpe", [*clean, (4, g)]) == ordered([None, None, 4, 4, None, 4])
