"""Collocations, prefix trie and token counts against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, hot keys."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm import collocations, prefix_trie, token_counts

DOCS = "doc_id long, text string, lang string, piece string, __lang string, f long"


def made_docs():
    rng = random.Random(11)
    words = ["New", "york", "new", "is", "a", "city", "é", "<|endoftext|>", "x-1", "don't", "\x1c", "nbsp here"]
    some = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "; ", "!"]) for _ in range(n))
    texts = [None, "", " \t\n", ".,;", "one", "New york city " * 400, "a " * 3000, "-" * 3000] + [some(rng.randint(1, 80)) for _ in range(150)]
    rows = [(k if k % 13 else None, t, rng.choice(["en", "en", "en", "fr", None, "und", ""]), "p", "q", k) for k, t in enumerate(texts)]
    return rows + [rows[5]] * 2 + [(9, "Big Apple pie " * 40, "en", "p", "q", 1)] * 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_docs(), DOCS).repartition(7)


def phrases_by_counting(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang, text = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        most = collections.Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        best = []
        for p, a in found.items():
            if not (most[p] and 100 * most[p] >= 80 * a):
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top, size", [(30, 2000, 8 << 20), (3, 25, 1 << 9)])
def test_collocations(spark, docs, least, top, size):
    got = collocations.collocations(docs, least, top, size, size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases_by_counting(made_docs(), least, top)
    assert len(want) > 5 and sorted(tuple(r) for r in got.collect()) == want
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_colliding_fingerprints_are_told_apart():
    words = np.array([[0, 1], [0, 2], [0, 1], [3, 4], [0, 2], [5, 6]])
    first, n = collocations.told_apart(np.array([7, 7, 7, 7, 7, 8], np.uint64), words)
    assert sorted((tuple(words[k]), c) for k, c in zip(first, n)) == [((0, 1), 2), ((0, 2), 2), ((3, 4), 1), ((5, 6), 1)]


def test_phrases_are_counted_once_and_told_apart_by_text(spark, docs, monkeypatch):
    """In however many blocks a phrase occurs, one of them gives it; a fingerprint of two phrases doesn't go unseen."""
    counts = [collocations.phrase_counts(docs, 3, 1 << 9, 1 << 9, by_text) for by_text in (False, True)]
    quick, slow = (sorted(map(tuple, c.filter("n_words > 0").collect())) for c in counts)
    assert quick == slow and len(slow) > 20

    def block(*texts):
        rows = collocations.packed([pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": list(texts)})], 0, 0)
        return collocations.Text(rows["rows"][0].as_buffer())

    def given(blocks):
        totals, out = collections.Counter(int(k) for t in blocks for k in t.grams(2)[1]), []
        for t in blocks:
            at, key = t.grams(2)
            none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            out += [r for b in collocations.phrase_rows(t, [none, (at, key, np.array([totals[int(k)] for k in key], np.uint64))]) for r in b.to_pylist()]
            totals = collections.Counter()  # the first block has named them all
        return [(r["phrase"], r["f"]) for r in out if r["n_words"] > 0], sum(r["f"] for r in out if r["n_words"] == -1) % (1 << 64)

    assert given([block("a b", "a b"), block("a b")]) == ([("a b", 3)], 0)
    grams = collocations.Text.grams
    monkeypatch.setattr(collocations.Text, "grams", lambda t, n: (grams(t, n)[0], np.full(len(grams(t, n)[1]), 5, np.uint64)))
    assert given([block("a b", "a b"), block("a c")])[1] != 0


def test_prefix_polynomials():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    base = collocations.BASES[0]
    begin = rng.integers(0, 490, 60)
    got = collocations.windows(v, begin, begin + 7, base)
    assert [int(x) for x in got] == [sum(int(v[b + j]) * pow(base, j, 1 << 64) for j in range(7)) % (1 << 64) for b in begin.tolist()]


def trie_by_counting(rows, family=5, most=9):
    conv = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            conv[c].append((turn is not None, turn or 0, tie, role, text))
    made = {}
    for c, turns in conv.items():
        h = zlib.crc32(str(c).encode()) % most
        made[c] = tuple(t[3:] for t in sorted(conv.get(c - c % family, []))[:h] + sorted(turns)[h:])
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                kids[turns[: d - 1]].add(turns[:d])
    leaves, saved, out = {}, {}, collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[x] for x in kids[p])
        ends = ",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p))))
        out[min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def made_conversations():
    rng, rows = random.Random(3), []
    for c in range(0, 400):
        if c % 3 == 0:  # a third of all say the same
            turns = [("user", "hello"), ("assistant", "hi"), ("user", "same"), ("assistant", "thing é")] * 4
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ccc", "", None, "é"])) for _ in range(rng.choice([1, 2, 5, 9, 14, 40]))]
        rows += [(c, k if k else None, role, text, "x", 1) for k, (role, text) in enumerate(turns)]
    rows += [(None, 1, "user", "lost", "x", 1), (7, 2, "user", "tie", "x", 1), (7, 2, "user", "other", "x", 1), (7, 2, "user", "tie", "x", 1), (4003, 0, "user", "no head", "x", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 900, "band": 3, "fan_in": 2}, {"shard_bytes": 1, "band": 5, "fan_in": 3}])
def test_prefix_trie(spark, sizes):
    rows = made_conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, shard string, `kind` int").repartition(5)
    got = prefix_trie.conversation_trie(table, **sizes)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == columns and collections.Counter(map(tuple, got.collect())) == trie_by_counting(rows)


def test_prefix_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, 1, "u", "a")], [(5, 1, "u", "a"), (6, 1, "u", "a"), (9, None, None, None)]):
        assert collections.Counter(map(tuple, prefix_trie.conversation_trie(spark.createDataFrame(rows, schema)).collect())) == trie_by_counting(rows)


@pytest.mark.parametrize("room", [6, 1 << 15])
def test_token_counts(docs, room, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN_IN", 2)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        want = collections.Counter()
        for i, text, *_ in made_docs():
            n = len(t.encode(text or "", add_special_tokens=False).ids)
            want[i, len((text or "").encode()), n, n > 2048] += 1
        assert any(k[3] for k in want) and collections.Counter(map(tuple, token_counts.token_counts(docs, path, room=room).collect())) == want
        assert token_counts.token_counts(docs.limit(0), path).count() == 0


def test_frequent_pieces_are_never_lost():
    rng = np.random.default_rng(2)
    every, parts = collections.Counter(), []
    for _ in range(9):
        own = token_counts.Frequent.none(20)
        for _ in range(5):
            words, n = np.unique(rng.zipf(1.3, 400) % 500, return_counts=True)
            own.add(pa.array([f"w{w}" for w in words]), n)
            every.update({f"w{w}": int(c) for w, c in zip(words, n)})
        parts.append(own.row(0))
    got = token_counts.merged(pa.Table.from_batches(parts), 20)
    assert len(got.pieces) <= 20 and {w for w, c in every.items() if c > every.total() / 20} <= set(got.pieces.to_pylist())


def test_length_table():
    keys = [f"k{k}" for k in range(1000)]
    table = token_counts.LengthTable(keys, np.arange(1000))
    assert (table.find(token_counts.hashes(keys)) == np.arange(1000)).all() and (table.find(token_counts.hashes(["none", ""])) == -1).all()
    assert (token_counts.LengthTable([], np.zeros(0, int)).find(token_counts.hashes(["x"])) == -1).all()
