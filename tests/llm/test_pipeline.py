"""The pipeline, stage by stage, against plain Python: null and reused ids, repeated rows, empty texts, an empty table, columns with clashing names."""

import collections
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import minhash, quality_rules
from foliant.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, __number long, x0 string, size long"


def made():
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = [prose(rng.randint(60, 140)) for _ in range(70)]
    poor = [f"BUY!! NOW!! ### {k} *** $$$ WIN!! FREE!! && " * 9 for k in range(40)]
    texts = good + poor + [None, "", " \n ", prose(10), "same " * 80]
    texts += [good[0]] * 3 + [good[1]] * 2  # exact copies
    for k in range(2, 8):  # near copies: one word of a hundred changed
        w = good[k].split()
        texts.append(" ".join([*w[:50], "changed", *w[51:]]))
    rows = [(None if k % 31 == 30 else 7 if k in (20, 21) else k, t, "en", ["a", "b", None, "c"][k % 4 if k % 3 else 0], len(t or ""), "r", k, "x", 1) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3]]
    labels = [(k, 1, 0) for k in range(0, 60)] + [(70 + k, 0, 0) for k in range(40)] + [(None, 1, 0), (5000, 0, None)]
    return rows, labels


def stage_results(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = f"{shared_dir(spark)}/{tmp_path_factory.mktemp('pipeline').name}-{random.randint(0, 10**9)}"
    rows, labels = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def key(rows):
    return collections.Counter(tuple(r) for r in rows)


def near_groups(rows):
    """Documents that links of 80 % join, as lists of rows."""
    sets = [minhash.shingles(r.text) for r in rows]
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k) if sets[k] else ("alone", k)].append(r)
    return list(groups.values())


def mixed(rows, weights=(5, 2, 1), most=3):
    """How often each row is in the mix."""
    size = lambda r: len((r.text or "").split())
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r) for r in rows if r.source == s) for s in sources}
    weight, left, target = {s: weights[k % len(weights)] for k, s in enumerate(sources)}, sum(total.values()), {}
    open_ = list(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s], left = most * total[s], left - most * total[s]
        open_ = [s for s in open_ if s not in over]
    out = collections.Counter()
    for s in sources:
        epochs, before = (int(target[s]) // total[s] if total[s] else 0), 0
        own = sorted((r for r in rows if r.source == s), key=lambda r: (hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest(), r.doc_id is not None, r.doc_id or 0, size(r)))
        for r in own:
            part = max(0, min(size(r), int(target[s]) - epochs * total[s] - before))
            out[tuple(r)] += epochs + (size(r) > 0 and part * 2 >= size(r))
            before += size(r)
    return +out


def test_stages(spark, folder):
    start = spark.read.parquet(f"{folder}/documents.parquet")
    good, exact, near, mix, packed = stage_results(spark, folder)
    columns = start.columns
    assert all(d.columns == columns for d in (good, exact, near, mix))
    report = quality_rules.quality_rules(start, spark.read.parquet(f"{folder}/labels.parquet"))
    pass_ = collections.Counter(r.doc_id for r in report.filter("kept").collect())
    kept = good.collect()
    assert collections.Counter(r.doc_id for r in kept) == pass_ and set(range(8, 20)) <= set(pass_) and not set(range(70, 110)) & set(pass_)
    assert key(kept) <= key(start.collect()) and all(len((r.text or "").split()) >= 50 for r in kept)
    best = {}
    for r in kept:
        best[r.text] = max(best.get(r.text, (-1,)), (-1 if r.doc_id is None else r.doc_id,))
    left = exact.collect()
    assert collections.Counter((r.text, -1 if r.doc_id is None else r.doc_id) for r in left) == collections.Counter((t, i[0]) for t, i in best.items())
    assert key(left) <= key(kept)
    one = near.collect()
    groups = near_groups(left)
    assert key(one) <= key(left) and len(one) == len(groups) < len(left) and all(sum(r in g for r in one) == 1 for g in groups)
    assert key(mix.collect()) == mixed(one) and any(n > 1 for n in mixed(one).values())
    t, size, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 2048, collections.Counter()
    for r in mix.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        assert len(ids) <= size
        want[r.doc_id, 0, 0, len(ids), zlib.crc32(ids.tobytes())] += 1
    pieces = packed.collect()
    assert collections.Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    for _, parts in packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length")))).collect():
        ends = np.cumsum([p.length for p in parts])
        assert [p.offset for p in parts] == [0, *ends[:-1].tolist()] and ends[-1] <= size


def test_run_is_the_stages_in_a_row(spark, folder):
    facts = lambda rows: collections.Counter((p.doc_id, p.length, p.ids_crc32) for p in rows)
    assert facts(corpus_pipeline.run(spark, folder).collect()) == facts(spark.read.parquet(f"{folder}/stage4").collect())


def test_no_documents(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0
