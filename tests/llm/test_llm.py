"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import collections
import uuid
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import exact_dedup, lm_scoring, minhash, mixing, packing, quality_classifier, quality_rules, suffix_dedup, textmodel, token_files, tokens, window_dedup
from foliant.llm.common import shared_dir

SCHEMA = "doc_id long, text string, source string, __row string"


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(120)) for _ in range(8)]
    out = [None, "", " \n ", "one", "one two three", "one two three", base[0], base[0], base[1] + " " + base[2], base[2] + "\n" + base[3], "zz " * 300, "-" * 500]
    near = base[4].split()
    for k in range(6):
        out.append(" ".join(w if i != 10 * k else "changed" for i, w in enumerate(near)))
    out += base[5:] + [" ".join(base * 12)]
    return out


@pytest.fixture(scope="module")
def rows():
    made = [(k * 3, t, ["a", "b", None][k % 3], "x") for k, t in enumerate(texts())]
    return made + [made[8]]  # a row that is there twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.dedup_report(docs).collect()
    best, n = {}, collections.Counter()
    for i, t, *_ in rows:
        best[t or ""] = max(i, best.get(t or "", i))
        n[t or ""] += 1
    by = {i: t or "" for i, t, *_ in rows}
    assert len(got) == len(rows) and all((g.keep_id, g.group_size) == (best[by[g.doc_id]], n[by[g.doc_id]]) for g in got)
    assert collections.Counter(g.doc_id for g in got if g.kept) == collections.Counter(best.values())
    assert exact_dedup.exact_dedup(docs).count() == len(best) and exact_dedup.exact_dedup(docs).columns == docs.columns
    assert exact_dedup.dedup_report(empty).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix_report(docs).collect()
    taken, target, size = collections.Counter(), {}, collections.Counter()
    by = {i: s for i, _, s, _ in rows}
    for g in got:
        assert g.taken <= 3 * g.size
        taken[by[g.doc_id]] += g.taken
        size[by[g.doc_id]] += g.size
        target[by[g.doc_id]] = g.target
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    due = [g.due for g in got if g.due is not None]
    assert due == sorted(due) and mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_packing(docs, rows, empty):
    path, size = public_tokenizers.path("byte_bpe_50k.json"), 64
    got = packing.pack(docs, path, size).collect()
    t = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, text, *_ in rows:
        ids = np.array((t.encode(text, add_special_tokens=False).ids if text else []) + [0], "<u4")
        cuts = [0, *range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    held = collections.defaultdict(list)
    for g in got:
        held[g.sequence_id].append((g.offset, g.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(held) <= -(-sum(g.length for g in got) // size) + 2
    assert packing.pack(empty, path).count() == 0


def test_packing_plan_is_whole_and_never_worse_than_best_fit():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.choice([10, 30, 100])
        counts = {rng.randint(1, size): rng.choice([1, 2, 7]) for _ in range(rng.randint(1, 40))}
        plan, used = packing.plan_packing(counts, size), collections.Counter()
        for content, n in plan:
            assert sum(content) <= size
            for s in content:
                used[s] += n
        assert used == counts
        assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, size))


def test_token_files(spark, docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"  # a new one for each run: the shared folder outlives it
    for name, d in (("some", docs), ("none", empty)):
        token_files.write(d, f"{folder}/{name}", path, shard_ids=500)
    t, want = Tokenizer.from_file(path), collections.Counter()
    for i, text, *_ in rows:
        ids = (t.encode(text, add_special_tokens=False).ids if text else []) + [2]
        want[i, tuple(ids)] += 1
    got = token_files.read(spark, f"{folder}/some", with_ids=True).orderBy("start").collect()
    assert collections.Counter((g.doc_id, tuple(g.ids)) for g in got) == want
    at = 0
    for g in got:
        assert g.start == at and g.n_tokens == len(g.ids)
        at += g.n_tokens
    assert [g.doc_id for g in got] == sorted(g.doc_id for g in got)
    assert token_files.read(spark, f"{folder}/none").count() == 0
    some = token_files.read_documents(spark, f"{folder}/some", [rows[5][0], rows[12][0], 10**9]).collect()
    assert {(g.doc_id, tuple(g.ids)) for g in some} == {k for k in want if k[0] in (rows[5][0], rows[12][0])}
    many = token_files.read_documents(spark, f"{folder}/some", [*range(1, 20_000, 2), None]).collect()
    assert {(g.doc_id, tuple(g.ids)) for g in many} == {k for k in want if k[0] % 2}
    token_files.write(docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))), f"{folder}/nulls", path, shard_ids=500)
    lost = collections.Counter((g.doc_id, tuple(g.ids)) for g in token_files.read_documents(spark, f"{folder}/nulls", [None, 6]).collect())
    expected = collections.Counter()
    for (i, ids), n in want.items():
        expected[i if i % 2 == 0 else None, ids] += n if i % 2 or i == 6 else 0
    assert lost == +expected and lost.total() > 5
    assert token_files.id_ranges(np.array([1, 2, 3, 50, 51, 900]), 3) == [(1, 3), (50, 51), (900, 900)] and token_files.id_ranges(np.array([], np.int64)) == []
    assert token_files.read_documents(spark, f"{folder}/some", []).count() == 0


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "word", "Word", "é", "it's", "42", "x,y", "<|", "abcdefgh", "е", "\r\n", "zz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, "", "a " * 2000, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x" for k in range(2000))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        whole = Tokenizer.from_file(public_tokenizers.path(name))
        ids, n = tokens.Encoder(public_tokenizers.path(name)).encode(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        assert [ids[z - k : z].tolist() for z, k in zip(ends, n)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_repair_random_access():
    rng = np.random.default_rng(3)
    ids = np.tile(rng.integers(0, 50, 40), 200).astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[[99, 1999, len(ids) - 1]] = True
    symbols, rules, ends = token_files.compress(ids, last.copy())
    lengths = token_files.rule_lengths(rules, token_files.TERMINALS)
    shard = token_files.Shard(np.arange(3), np.flatnonzero(ends) + 1, rules.astype(np.int64), lengths, symbols, token_files.TERMINALS)
    assert len(symbols) < len(ids) / 4
    assert (shard.document(1) == ids[100:2000]).all() and (shard.ids_at(1234, 1300) == ids[1234:1300]).all()


def test_near_copies(docs, rows, empty):
    sets = {i: frozenset(minhash.shingles(t)) for i, t, *_ in rows}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_copies(docs).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g.n_shingles, g.component_id, g.kept) == (len(sets[g.doc_id]), find(g.doc_id), find(g.doc_id) == g.doc_id)
    assert minhash.drop_near_copies(docs).count() == len({find(i) for i in sets})
    assert minhash.near_copies(empty).count() == 0


def many_near_copies():
    """150 copies of one text with up to five changes each (some changes are the same ones, some copies end earlier), around the limit."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(140)]
    out = []
    for k in range(150):
        text = list(words)
        for at in rng.sample(range(140), rng.randint(1, 5)):
            text[at] = rng.choice([f"x{k}-{at}", f"x{k}-{at}", f"y{at}", ""])
        out.append(" ".join(w for w in text[: rng.choice([140, 140, 140, 132])] if w))
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_near_copies_in_one_large_group(spark, monkeypatch, percent):
    texts = many_near_copies()
    sets, root = [frozenset(minhash.shingles(t)) for t in texts], list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    given, compared = [], minhash.compared
    monkeypatch.setattr(minhash, "compared", lambda pairs, *more: given.append(pairs.count()) or compared(pairs, *more))
    docs = spark.createDataFrame([(k, t, None, "x") for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {g.doc_id: g.component_id for g in minhash.near_copies(docs, percent).collect()}
    assert got == {k: find(k) for k in range(len(texts))}
    assert len(given) == 2 and given[1] <= len(links)  # only pairs that are linked are left for the second comparison


def test_near_copies_of_null_and_reused_ids(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(150)) for _ in range(8)]
    ids = [None, None, None, 7, 7, None, 9, 9]
    rows = [(i, t, None, f"{k}") for k, (i, t) in enumerate(zip(ids, base))]
    rows += [(i, t + " end", None, f"{k} near") for k, (i, t) in enumerate(zip([20, 21, None, 22, 5, 9, 23, None], base))]  # each a near copy of one text
    rows += [(9, base[0], None, "equal"), (None, None, None, "none"), (None, " ", None, "blank"), (7, "", None, "empty")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = minhash.drop_near_copies(docs)
    got = [r.text for r in kept.collect()]
    assert kept.columns == docs.columns and sorted((t or "").removesuffix(" end").strip() for t in got) == sorted(base + [""] * 3)
    least = {t: min((i for i, u, *_ in rows if (u or "").removesuffix(" end") == t), key=lambda i: -1 if i is None else i) for t in base}
    want = collections.Counter((i, least.get((t or "").removesuffix(" end"), i)) for i, t, *_ in rows)
    assert collections.Counter((g.doc_id, g.component_id) for g in minhash.near_copies(docs).collect()) == want


def test_near_stage_takes_pairs_from_80_percent(spark):
    words = [f"w{k}" for k in range(154)]  # 150 shingles; each new word makes 5 others: 135 of 165
    other = [f"new{k}" if k in (40, 80, 120) else w for k, w in enumerate(words)]
    far = [f"far{k}" if k % 30 == 10 else w for k, w in enumerate(words)]
    a, b, c = (minhash.shingles(" ".join(t)) for t in (words, other, far))
    assert 0.80 < len(a & b) / len(a | b) < 0.85 and len(a & c) / len(a | c) < 0.80 and len(b & c) / len(b | c) < 0.80
    docs = spark.createDataFrame([(k, " ".join(t), None, "x") for k, t in enumerate((words, other, far))], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, None).collect()) == [0, 2]
    assert minhash.drop_near_copies(docs).count() == 3


def removed(entries, window, rows):
    """doc_id -> flags of what a window that starts earlier covers."""
    first, out = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        own = entries(t)
        flags = [False] * len(own)
        for k in range(len(own) - window + 1):
            if first.setdefault(tuple(own[k : k + window]), (i, k)) != (i, k):
                flags[k : k + window] = [True] * window
        out[i] = own, flags
    return out


def test_window_dedup(docs, rows, empty):
    want = removed(lambda t: t.encode().split() if t else [], 20, rows)
    for g in window_dedup.without_repeats(docs).collect():
        own, flags = want[g.doc_id]
        left = b" ".join(w for w, f in zip(own, flags) if not f)
        assert (g.n_words, g.n_removed, g.kept_sha256) == (len(own), sum(flags), hashlib.sha256(left).hexdigest())
    assert window_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize("heavy", [10, 1000])
def test_suffix_dedup(docs, rows, empty, monkeypatch, heavy):
    monkeypatch.setattr(window_dedup, "HEAVY", heavy)  # with 10, most keys of the fixture are ordinary ones
    want = removed(lambda t: t.encode() if t else b"", 100, rows)
    for g in suffix_dedup.without_repeats(docs).collect():
        own, flags = want[g.doc_id]
        spans = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        left = bytes(b for b, f in zip(own, flags) if not f)
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (len(own), sum(flags), spans, hashlib.sha256(left).hexdigest())
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_suffix_dedup_passages_that_go_on_in_two_ways(spark):
    rng, rows = random.Random(8), []
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for _ in range(120):
        passage, x, y = some(rng.randint(200, 500)), some(300), some(300)
        rows += [(len(rows) + k, passage + end, None, "x") for k, end in enumerate((x, x, y, y))]
    want = removed(lambda t: t.encode(), 100, rows)
    for g in suffix_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        own, flags = want[g.doc_id]
        assert (g.doc_id, g.n_removed, g.kept_sha256) == (g.doc_id, sum(flags), hashlib.sha256(bytes(b for b, f in zip(own, flags) if not f)).hexdigest())


def labelled(spark):
    good = [(k, f"the report on item {k} was read by many people and found clear " * 6, 1, 0) for k in range(60)]
    poor = [(100 + k, f"BUY!! NOW!! ### {k} *** $$$ WIN!! FREE!! && " * 8, 0, 0) for k in range(60)]
    rude = [(200 + k, f"the report on item {k} was read by a moron and an oaf who found it clear " * 6, 1, 1) for k in range(60)]
    return spark.createDataFrame([r[:2] for r in good + poor + rude] + [(999, None)], "doc_id long, text string"), spark.createDataFrame([(i, q, x) for i, _, q, x in good + poor + rude] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def test_quality_rules(spark, empty):
    docs, labels = labelled(spark)
    got = {g.doc_id: g for g in quality_rules.quality_rules(docs, labels).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    model = {i for i, g in got.items() if g.p_good < 0.5}
    assert model >= set(range(100, 160)) and not model & set(range(60))
    for i, g in got.items():
        words = (text[i] or "").split()
        tri = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {k + j for k in range(len(words) - 2) if tri[tuple(words[k : k + 3])] > 1 for j in range(3)}
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text[i] or ""), len(hit))
        assert g.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
    assert quality_rules.repeated_lines("a\nb\n a\na\n\n\n") == 1
    assert quality_rules.quality_rules(empty, labels).count() == 0


def test_quality_classifier(spark, empty):
    docs, labels = labelled(spark)
    got = {g.doc_id: g for g in quality_classifier.classify(docs, labels).collect()}
    assert all(got[i].selected for i in range(60)) and not any(got[i].selected for i in [*range(100, 160), *range(200, 260)])
    assert np.mean([got[i].expected_grade for i in range(100, 160)]) < np.mean([got[i].expected_grade for i in range(200, 260)]) < np.mean([got[i].expected_grade for i in range(60)])
    assert quality_classifier.classify(empty, labels).count() == 0


def lm_losses(target, rows):
    """Per row the losses under the target's and all rows' model, by plain counting. ``target``: places in ``rows``."""
    count = lambda ds: (collections.Counter(p for d in ds for p in zip(["<s>", *d], d)), collections.Counter(w for d in ds for w in (["<s>"] if d else []) + d), sum(map(len, ds)))
    models, types = (count([rows[k] for k in target]), count(rows)), len({w for d in rows for w in d})
    scales = 1.0, models[0][2] / max(models[1][2], 1)
    out = []
    for k, d in enumerate(rows):
        two, one, _ = own = count([d])
        losses = []
        for m, ((pairs, words, total), scale) in enumerate(zip(models, scales)):
            off = own if m or k in target else (collections.Counter(), collections.Counter(), 0)

            def loss(v, w):
                base = 0.95 * (models[1][1][w] - one[w]) / max(models[1][2] - len(d), 1) + 0.05 / types
                single = (scale * (words[w] - off[1][w]) + 1000 * base) / (scale * (total - off[2]) + 1000)
                return -np.log((scale * (pairs[v, w] - off[0][v, w]) + 10 * single) / (scale * (words[v] - off[1][v]) + 10))

            losses.append(np.mean([loss(v, w) for v, w in zip(["<s>", *d], d)]) if d else None)
        out.append(losses if d else None)
    return out


@pytest.mark.parametrize("size", [1 << 10, 1 << 24])
def test_lm_scoring(spark, empty, size):
    docs, labels = labelled(spark)
    text = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    good = {r.doc_id for r in lm_scoring.good_documents(labels).collect()}
    got = {g.doc_id: g for g in lm_scoring.lm_scores(docs, lm_scoring.good_documents(labels), size, size).collect()}
    for (i, words), want in zip(text.items(), lm_losses({k for k, i in enumerate(text) if i in good}, list(text.values()))):
        g = got.pop(i)
        assert g.n_tokens == len(words) and (g.loss_target, g.loss_background) == (pytest.approx(want) if words else (None, None))
    assert not got and lm_scoring.lm_scores(empty, labels).count() == 0
    none = lm_scoring.lm_scores(docs, labels.select("doc_id").limit(0)).filter("n_tokens > 0").agg(F.max(F.abs("loss_difference")).alias("most"), F.count("*").alias("n")).head()
    assert none.most < 1e-9 and none.n == sum(map(bool, text.values()))


def test_lm_scoring_tells_good_texts_apart_seen_or_not(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64(F.lit("lm"), "doc_id"), F.lit(2)) == 0
    scores = lm_scoring.lm_scores(docs, lm_scoring.good_documents(labels).filter(half))
    rows = scores.join(labels, "doc_id").filter("n_tokens > 20").select("quality", "toxic", half.alias("seen"), "loss_difference").collect()
    of = lambda *k: np.array([r.loss_difference for r in rows if (r.quality, r.toxic, r.seen) == k])
    seen, unseen, poor = of(1, 0, True), of(1, 0, False), np.concatenate([of(0, t, s) for t in (0, 1) for s in (True, False)])
    auc = np.mean([np.mean(unseen < x) + np.mean(unseen == x) / 2 for x in poor])
    print("medians", np.median(seen), np.median(unseen), np.median(poor), "AUC", auc)
    assert abs(np.median(seen) - np.median(unseen)) < 0.1 and auc > 0.7


def test_lm_scoring_counts_every_pair_and_word(spark):
    rng = np.random.default_rng(4)
    words = np.where(rng.random((1500, 1000)) < 0.1, 1, rng.integers(1, 80_000, (1500, 1000)))
    rows = [(k, " ".join(f"w{x}" for x in own)) for k, own in enumerate(words)] + [(3, " "), (None, "w1 w2"), (7, "w1\x0bw2")]
    split = [t.split() for _, t in rows]
    assert len({w for d in split for w in d}) > 60_000 and len({p for d in split for p in zip(d, d[1:])}) > 1 << 20
    want = collections.Counter((i, len(d), *([round(x, 7) for x in loss] if loss else (None, None))) for (i, _), d, loss in zip(rows, split, lm_losses({k for k in range(0, 1500, 3) if k != 3}, split)))
    got = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in range(0, 1500, 3) if k not in (3, 7)] + [(None,)], "doc_id long"), 1 << 20)
    have = collections.Counter((g.doc_id, g.n_tokens, *([round(g.loss_target, 7), round(g.loss_background, 7)] if g.n_tokens else (None, None))) for g in got.collect())
    assert len(want) == len(have) and all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(sorted(k for k in want if k[1] > 2), sorted(k for k in have if k[1] > 2)))


def test_classifiers_on_ratings_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    fit, held = labels.filter(half == 0), labels.filter(half == 1)
    model = quality_classifier.fit_grades(docs, quality_classifier.grades_of(fit))
    rows = quality_classifier.score_grades(docs.join(held.select("doc_id"), "doc_id", "left_semi"), model).join(quality_classifier.grades_of(held), "doc_id").groupBy("grade").agg(F.avg(F.col("selected").cast("int")).alias("share"), F.avg("expected_grade").alias("expected"))
    share, expected = ({r.grade: r[c] for r in rows.collect()} for c in ("share", "expected"))
    assert share[2] > 0.98 and share[1] < 0.5 and share[0] < 0.2 and expected[0] < expected[1] < expected[2]


def test_strengths_tell_grades_apart():
    row = lambda grade, *places: textmodel.Weighed(grade, np.array(places, "<i4").tobytes(), np.ones(len(places), "<f4").tobytes())
    rows = [row(k % 2, 0, 1 + k % 2) for k in range(40)] + [row(1, 3)]
    got = textmodel.strengths(rows, 2, 4)
    used = textmodel.fitted(rows)
    for place in range(3):
        n = [sum(r.grade == g and place in np.frombuffer(r.place, "<i4") for r in used) for g in (0, 1)]
        all_ = [sum(r.grade == g for r in used) for g in (0, 1)]
        assert got[place] == pytest.approx(abs(np.log((n[1] + 1) / (all_[1] + 2)) - np.log((n[0] + 1) / (all_[0] + 2))), rel=1e-5)
    assert got[3] == 0 and got[1] > 1 < got[2]
    assert not textmodel.strengths([], 3, 4).any()
