"""LM scoring by cross-entropy difference.

Two word-bigram models of one form, one of the target texts and one of the background (all documents), share one vocabulary, all words of all
documents, and one base distribution b. They are matched: the background's counts are scaled by s, so that both models have the target's number of tokens.

    b(w)     = (1 - FLOOR) * count(w) / total + FLOOR / types                      of all documents
    u(w)     = (s * count(w) + UNIGRAM * b(w)) / (s * total + UNIGRAM)             s = 1 for the target, its tokens over all tokens for the background
    p(w | v) = (s * pairs(v, w) + CONTEXT * u(w)) / (s * count(v) + CONTEXT)

So how much a context's own pairs count depends on how often it was seen. A document is never scored by its own counts: they are taken off both models, as far
as it is in them, and off b. So what a score says is what a text is like, not whether it was among the target texts.

All counts are exact, cover all documents and grow with them. Texts are put into blocks of about BLOCK_BYTES. A block's distinct
words and pairs, by 64-bit hashes, are sorted and cut into ranges, as many as the corpus has BUCKET_BYTES; a range of all blocks is
added up in one task, which tells each block the counts of the whole corpus where they aren't all its own. A block has a word or pair once
in its range, so none weighs on one task. A block's texts and counts then meet in one task and give the losses. Nothing is broadcast. A document's score is the mean over its tokens of loss under the target
minus loss under the background: the lower, the more it is like the target.

Defined results: null and empty texts have 0 tokens and null losses; a target with no texts leaves the base
distribution, and differences of 0; repeated rows each get their row; an empty table gives an empty table. Of 10**9 different words and pairs,
two share a hash with a probability of 3 %; their counts are then added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import slices, sums
from foliant.llm.common import U64, batch_words, free_shuffles, mix, stored

BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
FLOOR, UNIGRAM, CONTEXT = 0.05, 1000.0, 10.0
#: Tokens that are scored together.
CHUNK = 1 << 16
#: Stands before the first word of a text.
BEGIN = U64(0)
PAIR = U64(0x9FB21C651E98DF25)


def key_of_words(token: np.ndarray) -> np.ndarray:
    return mix(token, 21) & ~U64(1)


def key_of_pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(before, 22) * PAIR + token, 23) | U64(1)


def packed(rows: list[pa.RecordBatch], number: int, size: int) -> pa.RecordBatch:
    """A block as one row: its texts as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for r in rows:
            out.write_batch(r)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "size", "rows"])


def into_blocks(flagged: DataFrame, block_bytes: int) -> DataFrame:
    """(block, size, rows): texts in blocks of about ``block_bytes``; a longer text is a block of its own."""

    def pack(batches):
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for b in slices(batches, "text"):
            held.append(b)
            size += pc.sum(pc.binary_length(b["text"])).as_py() or 0
            if size >= block_bytes:
                yield packed(held, number, size)
                number, held, size = number + 1, [], 0
        if held:
            yield packed(held, number, size)

    return flagged.select("doc_id", "text", "is_target").mapInArrow(pack, "block long, size long, rows binary")


class Grams:
    """The words and pairs of a block: the key of each token's word, of the word before it and of both; all keys, sorted, with their counts."""

    def __init__(self, blob):
        self.table = pa.ipc.open_stream(blob).read_all()
        words = batch_words(self.table["text"].combine_chunks())
        self.starts, token = words.starts, words.tokens()
        before, filled = np.concatenate(([BEGIN], token))[: len(token)], np.diff(self.starts) > 0
        before[self.starts[:-1][filled]] = BEGIN
        self.word, self.pair, self.before = key_of_words(token), key_of_pairs(before, token), key_of_words(before)
        self.target = target = self.table["is_target"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        begin, wanted = key_of_words(np.array([BEGIN])), np.repeat(target, np.diff(self.starts))
        self.keys, self.n = np.unique(np.concatenate((self.word, self.pair, np.repeat(begin, filled.sum()))), return_counts=True)
        found, n = np.unique(np.concatenate((self.word[wanted], self.pair[wanted], np.repeat(begin, (filled & target).sum()))), return_counts=True)
        self.n_target = np.zeros(len(self.keys), np.int64)
        self.n_target[np.searchsorted(self.keys, found)] = n

    def cuts(self, buckets: int) -> np.ndarray:
        """Where each of so many ranges of keys begins, and the end."""
        return np.searchsorted((self.keys >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1, dtype=U64))


def planes(x: np.ndarray) -> bytes:
    """The bytes of whole numbers, all lowest bytes first, so that empty upper bytes take no room once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def gram_rows(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, keys, n, n_target): a row for each range of keys of a block; keys as differences."""

    def count(batches):
        for b in batches:
            for number, blob in zip(b["block"].to_pylist(), b["rows"]):
                g = Grams(blob.as_buffer())
                cuts, rows = g.cuts(buckets), []
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[k], cuts[k + 1])
                    rows.append((k, number, planes(np.diff(g.keys[own], prepend=U64(0))), planes(g.n[own].astype("<u4")), planes(g.n_target[own].astype("<u4"))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "block", "keys", "n", "n_target"])

    return blocks.mapInArrow(count, "bucket int, block long, keys binary, n binary, n_target binary")


def counted(grams: DataFrame) -> DataFrame:
    """(block, bucket, elsewhere, n, n_target): which keys of a block's range other blocks have too, as bits, and the counts of those.

    The first row of a range has its number of words, and of all tokens and target tokens (0 in other rows).
    """
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("elsewhere", pa.binary()), ("n", pa.binary()), ("n_target", pa.binary()), ("types", pa.int64()), ("total", pa.int64()), ("total_target", pa.int64())])
    begin = key_of_words(np.array([BEGIN]))[0]

    def add_up(rows: pa.Table) -> pa.Table:
        parts = [np.cumsum(from_planes(x, "<u8"), dtype=U64) for x in rows["keys"].to_pylist()]
        n, target = (np.concatenate([from_planes(x, "<u4") for x in rows[c].to_pylist()]).astype(np.int64) for c in ("n", "n_target"))
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        all_, all_target = (np.bincount(at, x).astype(np.int64) for x in (n, target))
        word = (keys & U64(1) == 0) & (keys != begin)
        facts, out, start = (int(word.sum()), int(all_[word].sum()), int(all_target[word].sum())), [], 0
        for block, bucket, part in zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), parts):
            mine = at[start : start + len(part)]
            more = all_[mine] > n[start : start + len(part)]
            out.append((block, bucket, np.packbits(more).tobytes(), planes(all_[mine[more]]), planes(all_target[mine[more]]), *facts))
            facts, start = (0, 0, 0), start + len(part)
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return grams.groupBy("bucket").applyInArrow(add_up, "block long, bucket int, elsewhere binary, n binary, n_target binary, types long, total long, total_target long")


def own_counts(text: np.ndarray, key: np.ndarray, n_keys: int) -> np.ndarray:
    """How often each token's key occurs in its own text."""
    _, at, n = np.unique(text * n_keys + key, return_inverse=True, return_counts=True)
    return n[at]


def losses(g: Grams, n: np.ndarray, n_target: np.ndarray, sizes: tuple[int, int, int], first: int, last: int) -> list[np.ndarray]:
    """Mean losses under the target and under the background of the block's texts from ``first`` to before ``last``. ``n``, ``n_target``: counts of g.keys; ``sizes``: types, tokens, target tokens."""
    types, total, total_target = sizes
    starts = g.starts[first : last + 1]
    own = slice(starts[0], starts[-1])
    of_word, of_before, of_pair = (np.searchsorted(g.keys, x[own]) for x in (g.word, g.before, g.pair))
    n_tokens = np.diff(starts)
    text, size = np.repeat(np.arange(last - first), n_tokens), np.repeat(n_tokens, n_tokens)
    word, pair = own_counts(text, of_word, len(g.keys)), own_counts(text, of_pair, len(g.keys))
    before = np.concatenate(([1], word))[: len(word)]  # a text's beginning is there once
    before[(starts[:-1] - starts[0])[n_tokens > 0]] = 1
    base, out = (1 - FLOOR) * (n[of_word] - word) / np.maximum(total - size, 1) + FLOOR / max(types, 1), []
    for count, all_, part, scale in ((n_target, total_target, g.target[first:last][text], 1.0), (n, total, 1, total_target / max(total, 1))):
        single = (scale * (count[of_word] - part * word) + UNIGRAM * base) / (scale * (all_ - part * size) + UNIGRAM)
        p = (scale * (count[of_pair] - part * pair) + CONTEXT * single) / (scale * (count[of_before] - part * before) + CONTEXT)
        out.append(sums(-np.log(p), starts - starts[0]) / np.maximum(n_tokens, 1))
    return out


def lm_scores(docs: DataFrame, target_ids: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: doc_id, n_tokens, loss_target, loss_background, loss_difference. ``target_ids``: doc_id of target texts.

    The target ids grow with the corpus, so they are merged with the documents at every size, never broadcast.
    """
    wanted = target_ids.select("doc_id").distinct().withColumn("is_target", F.lit(True))
    flagged = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    blocks = stored(into_blocks(flagged, block_bytes))
    buckets = (blocks.agg(F.sum("size")).head()[0] or 0) // bucket_bytes + 1
    free_shuffles(docs.sparkSession)
    whole = stored(counted(gram_rows(blocks, buckets)))
    types, total, total_target = whole.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "total", "total_target")]).head()
    free_shuffles(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("loss_target", pa.float64()), ("loss_background", pa.float64())])

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        g = Grams(own["rows"][0].as_buffer())
        cuts, n, n_target = g.cuts(buckets), g.n.copy(), g.n_target
        for bucket, more, all_, all_target in zip(*(found[c].to_pylist() for c in ("bucket", "elsewhere", "n", "n_target"))):
            here = cuts[bucket] + np.flatnonzero(np.unpackbits(np.frombuffer(more, np.uint8), count=cuts[bucket + 1] - cuts[bucket]))
            n[here], n_target[here] = from_planes(all_, "<i8"), from_planes(all_target, "<i8")
        n_tokens = np.diff(g.starts)
        edges = np.unique(np.append(np.searchsorted(g.starts, np.arange(0, g.starts[-1], CHUNK)), len(n_tokens)))
        parts = [losses(g, n, n_target, (types, total, total_target), a, z) for a, z in zip(edges[:-1], edges[1:])]
        both = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * 2
        none = n_tokens == 0
        pa.default_memory_pool().release_unused()
        return pa.table([g.table["doc_id"], pa.array(n_tokens), *[pa.array(x, mask=none) for x in both]], schema=schema)

    scored = blocks.groupBy("block").cogroup(whole.drop("types", "total", "total_target").groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, loss_target double, loss_background double")
    return scored.withColumn("loss_difference", F.col("loss_target") - F.col("loss_background"))


def good_documents(labels: DataFrame) -> DataFrame:
    """The target texts: labelled as good and not toxic."""
    return labels.filter("quality = 1 AND toxic = 0").select("doc_id")
