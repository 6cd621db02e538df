"""Phrases of two to four words that occur together more often than their parts, by Rabin-Karp fingerprints.

A word's hash is a difference of prefix polynomials over the bytes of its text, a phrase's fingerprint one over the hashes of its words
(all modulo 2**64, numpy, no loop over places); the language and the number of words go into it.

1. Texts are put into blocks of about BLOCK_BYTES, a row each. A block counts the fingerprints of its words and of its phrases of two
   and sorts them; ranges of fingerprints, as many as the corpus has BUCKET_BYTES, travel as packed rows whose pointer is the block. A
   range's sums tell each block, a bit for each of its fingerprints, which ones occur LEAST times or more in the corpus.
2. The same for three and four words, only where every phrase of two words inside is frequent: no other one can be frequent.
3. A range also tells one block of each frequent fingerprint its count in the corpus, and this block alone gives the phrase as text. So rows are
   as many as there are frequent phrases, in however many blocks they occur.
4. Counts are of texts: all blocks compare the words at the places of a frequent fingerprint, and each adds up its counts, times a second hash of
   the words, less the told counts times the same. Over all blocks this gives 0 unless two phrases have one fingerprint; then all
   blocks give their phrases, those that differ are told apart, and Spark adds them up by text.
5. Cuts, containment and ranks are joins and sums on the frequent phrases. A language's first ones are ranked in two levels, so that no
   language meets in one task.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count again; ties are broken down to the
phrase; an empty table gives an empty table; ids and other columns are not read. Once the corpus has so many ranges that a block has
a fingerprint in few of them, rows hold fewer fingerprints each, down to one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.arrow import flatten, slices
from foliant.llm.common import U64, discard, free_shuffles, mix, stored
from foliant.llm.lm_scoring import from_planes, packed, planes

BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
LONGEST = 4
#: How often a phrase must occur, how many a language reports, from what share of its count (in percent) on a longer phrase stands for it.
LEAST, TOP, COVERS = 30, 2000, 80
SCALE = 2_000_000
#: Kinds of bytes: 1 separates words, 2 separates pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
CHUNK = 1 << 16
GRAM_SCHEMA = "bucket int, block long, keys binary, n binary"
MASK_SCHEMA = "block long, bucket int, level int, often binary, named binary, total binary"
SHARES = 64


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, n.bit_length())
        steps = [np.full(size, b, U64) for b in (base, pow(base, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        have = _POWERS[base] = tuple(np.cumprod(s, dtype=U64) for s in steps)
    return have


def windows(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The polynomial of values[begin:end] for each window, by prefix sums."""
    up, down = powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[end] - prefix[begin]) * down[begin]


class Text:
    """The words of a block: where each stands in ``raw`` (lower case), its hash, its piece, its language's number."""

    def __init__(self, blob):
        rows = pa.ipc.open_stream(blob).read_all().combine_chunks()
        texts = pc.fill_null(rows["text"], "").combine_chunks().cast(pa.binary())
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        self.raw = LOWER[np.frombuffer(b"".join(texts.to_pylist()), np.uint8)]
        coded = pc.fill_null(rows["lang"], "und").combine_chunks().dictionary_encode()
        self.langs = coded.dictionary
        kind = KIND[self.raw]
        inside = kind == 0
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        filled = size > 0
        heads, tails = (ends - size)[filled], ends[filled] - 1
        begins[heads], stops[tails] = inside[heads], inside[tails]  # texts that follow each other without a blank
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        text = np.searchsorted(ends, self.begin, side="right")
        self.lang = coded.indices.to_numpy()[text]
        breaks = np.flatnonzero(kind == 2)
        self.piece = np.searchsorted(breaks, self.begin) + text
        self.hash = np.empty(len(self.begin), U64)
        for k in range(0, len(self.begin), CHUNK):
            b, e = self.begin[k : k + CHUNK], self.end[k : k + CHUNK]
            self.hash[k : k + CHUNK] = windows(self.raw[b[0] : e[-1]].astype(U64) + U64(1), b - b[0], e - b[0], BASES[0])
        self.hash = mix(self.hash, 31)
        self.of_lang = np.array([xxhash.xxh3_64_intdigest(x.as_py()) for x in self.langs], U64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of n words begin, and the fingerprint of each."""
        m = max(0, len(self.hash) - n + 1)
        at, out = np.flatnonzero(self.piece[:m] == self.piece[n - 1 : n - 1 + m]), []
        for k in range(0, m, CHUNK):
            own = at[np.searchsorted(at, k) : np.searchsorted(at, k + CHUNK)] - k
            out.append(windows(self.hash[k : k + CHUNK + n], own, own + n, BASES[1]))
        found = np.concatenate(out) if out else np.zeros(0, U64)
        return at, mix(found + self.of_lang[self.lang[at]] if len(at) else found, 32 + n)

    def words(self) -> pa.DictionaryArray:
        """All words as text."""
        n, flat = self.end - self.begin, []
        for k in range(0, len(n), CHUNK):
            own = slice(k, k + CHUNK)
            flat.append(self.raw[flatten(np.arange(len(n[own])), self.begin[own], n[own])])
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        flat = np.concatenate(flat) if flat else self.raw[:0]
        return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(flat)).dictionary_encode()


def first_level(t: Text) -> list[tuple[np.ndarray, np.ndarray]]:
    return [t.grams(1), t.grams(2)]


def second_level(t: Text, frequent_pairs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Phrases of three and four words of which every two neighbours are frequent. ``frequent_pairs``: a flag for each word, whether it begins one."""
    out = []
    for n in range(3, LONGEST + 1):
        at, key = t.grams(n)
        good = np.ones(len(at), bool)
        for k in range(n - 1):
            good &= frequent_pairs[at + k]
        out.append((at[good], key[good]))
    return out


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of so many ranges of sorted fingerprints begins, and the end."""
    return np.searchsorted((keys >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1, dtype=U64))


def packed_grams(number: int, grams: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """A row for each range of a block's fingerprints: their differences and their counts."""
    keys, n = np.unique(np.concatenate([k for _, k in grams]), return_counts=True)
    edge, rows = cuts(keys, buckets), []
    for k in np.flatnonzero(np.diff(edge)).tolist():
        own = slice(edge[k], edge[k + 1])
        rows.append((k, number, planes(np.diff(keys[own], prepend=U64(0))), planes(n[own].astype("<u4"))))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["bucket", "block", "keys", "n"])


def often(grams: DataFrame, level: int, least: int) -> DataFrame:
    """(block, bucket, level, often, named, total): a bit for each of a block's fingerprints in a range, set where all blocks together have ``least`` of it.

    ``named`` has a bit for each of these frequent ones, set in one block only, and ``total`` has how many all blocks have of each of those.
    """
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("level", pa.int32()), ("often", pa.binary()), ("named", pa.binary()), ("total", pa.binary())])

    def add_up(rows: pa.Table) -> pa.Table:
        parts = [np.cumsum(from_planes(x, "<u8"), dtype=U64) for x in rows["keys"].to_pylist()]
        n = np.concatenate([from_planes(x, "<u4") for x in rows["n"].to_pylist()])
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        total, out, start = np.bincount(at, n), [], 0
        good, seen = total >= least, np.zeros(len(keys), bool)
        for block, bucket, part in zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), parts):
            own = at[start : start + len(part)]
            bits = good[own]
            own = own[bits]
            new = ~seen[own]
            seen[own] = True
            out.append((block, bucket, level, np.packbits(bits).tobytes(), np.packbits(new).tobytes(), planes(total[own[new]].astype("<u8"))))
            start += len(part)
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return grams.groupBy("bucket").applyInArrow(add_up, MASK_SCHEMA)


def found(grams: list[tuple[np.ndarray, np.ndarray]], masks: pa.Table, buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places of ``grams`` that have a frequent fingerprint, it, and its count where this block names it (elsewhere 0), from the block's masks."""
    keys = np.unique(np.concatenate([k for _, k in grams]))
    edge, good, total = cuts(keys, buckets), np.zeros(len(keys), bool), np.zeros(len(keys), U64)
    for bucket, bits, named, n in zip(*(masks[c].to_pylist() for c in ("bucket", "often", "named", "total"))):
        good[edge[bucket] : edge[bucket + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=edge[bucket + 1] - edge[bucket])
        own = edge[bucket] + np.flatnonzero(good[edge[bucket] : edge[bucket + 1]])
        total[own[np.unpackbits(np.frombuffer(named, np.uint8), count=len(own)).astype(bool)]] = from_planes(n, "<u8")
    out = []
    for at, key in grams:
        number = np.searchsorted(keys, key)
        f = good[number] if len(keys) else np.zeros(0, bool)
        out.append((at[f], key[f], total[number[f]]))
    return out


def frequent(t: Text, masks: pa.Table, buckets: int) -> tuple[list, list]:
    """The frequent ones of the first level, and all candidates of the second."""
    short = found(first_level(t), masks.filter(pc.equal(masks["level"], 1)), buckets)
    pairs = np.zeros(len(t.hash), bool)
    pairs[short[1][0]] = True
    return short, second_level(t, pairs)


def told_apart(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each phrase and its number of places, phrases with one fingerprint but other words being told apart."""
    while True:
        _, first, group, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        other = (words != words[first[group]]).any(axis=1)
        if not other.any():
            return first, n
        key = np.where(other, mix(key, 41), key)


def phrase_rows(t: Text, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], by_text: bool = False) -> list[pa.RecordBatch]:
    """(lang, n_words, phrase, f): the phrases that this block names, with their counts in the corpus (``by_text``: all its frequent ones, with its own counts).

    With n_words 0 the words of each language, with -1 (unless ``by_text``) what gives 0 over all blocks, modulo 2**64, if no fingerprint has two phrases.
    """
    out, coded, left_over = [], t.words(), np.zeros(1, U64)
    ids = coded.indices.to_numpy()
    schema = pa.schema([("lang", pa.string()), ("n_words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
    second = np.fromiter((xxhash.xxh3_64_intdigest(w, 1) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), U64, len(coded.dictionary))
    for n, (at, key, total) in enumerate(grams, 1):
        if len(at):
            first, f = told_apart(key, np.stack([t.lang[at], *[ids[at + k] for k in range(n)]], axis=1))
            if not by_text:
                check = t.of_lang[t.lang[at[first]]]
                for k in range(n):
                    check = mix(check ^ second[ids[at[first] + k]], n)
                left_over += ((f.astype(U64) - total[first]) * check).sum(dtype=U64)
                first = first[total[first] > 0]
                f = total[first].astype(np.int64)
            words = [coded.dictionary.take(pa.array(ids[at[first] + k])) for k in range(n)]
            phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))
            columns = [t.langs.take(pa.array(t.lang[at[first]])), pa.array(np.full(len(first), n, np.int32)), phrase.cast(pa.string()), pa.array(f)]
            out.append(pa.RecordBatch.from_arrays(columns, schema=schema))
    sums = np.bincount(t.lang, minlength=len(t.langs))
    out.append(pa.RecordBatch.from_arrays([t.langs, pa.array(np.zeros(len(sums), np.int32)), pa.nulls(len(sums), pa.string()), pa.array(sums)], schema=schema))
    if not by_text:
        out.append(pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array(left_over.view(np.int64))], schema=schema))
    return out


def text_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, size, rows): languages and texts in blocks of about ``block_bytes``; a longer text is a block of its own."""

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

    return docs.select("lang", "text").mapInArrow(pack, "block long, size long, rows binary")


def phrase_counts(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, by_text: bool = False) -> DataFrame:
    """A stored table (lang, n_words, phrase, f) of the words and phrases that occur ``least`` times or more; n_words 0: all words of a language.

    ``by_text``: all blocks give all their frequent phrases at once, as they do where two phrases have one fingerprint.
    """
    blocks = stored(text_blocks(docs, block_bytes))
    buckets = (blocks.agg(F.sum("size")).head()[0] or 0) // bucket_bytes + 1

    def count(batches):
        for b in batches:
            for number, blob in zip(b["block"].to_pylist(), b["rows"]):
                yield packed_grams(number, first_level(Text(blob.as_buffer())), buckets)

    def count_longer(own: pa.Table, masks: pa.Table) -> pa.Table:
        _, longer = frequent(Text(own["rows"][0].as_buffer()), masks, buckets)
        return pa.Table.from_batches([packed_grams(own["block"][0].as_py(), longer, buckets)])

    def phrases(own: pa.Table, masks: pa.Table, by_text: bool) -> pa.Table:
        t = Text(own["rows"][0].as_buffer())
        short, longer = frequent(t, masks, buckets)
        return pa.Table.from_batches(phrase_rows(t, short + found(longer, masks.filter(pc.equal(masks["level"], 2)), buckets), by_text))

    masks = stored(often(blocks.mapInArrow(count, GRAM_SCHEMA), 1, least))
    free_shuffles(docs.sparkSession)
    more = stored(often(blocks.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(count_longer, GRAM_SCHEMA), 2, least))
    free_shuffles(docs.sparkSession)
    pairs = blocks.groupBy("block").cogroup(masks.unionByName(more).groupBy("block"))
    row = "lang string, n_words int, phrase string, f long"
    if not by_text:
        named = stored(pairs.applyInArrow(lambda own, m: phrases(own, m, False), row))
        left_over = named.filter("n_words = -1").agg(F.sum(F.col("f").cast("decimal(38,0)"))).head()[0] or 0
        by_text = int(left_over) % (1 << 64) != 0
        out = named.filter("n_words > 0").unionByName(named.filter("n_words = 0").groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f")))
    if by_text:
        rows = pairs.applyInArrow(lambda own, m: phrases(own, m, True), row)
        out = stored(rows.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("n_words") == 0)))
    discard(blocks, masks, more)
    return out


def sub_phrases(words: str, n: str) -> str:
    """SQL: the phrases of two words or more inside an array of ``n`` words, without the whole."""
    inner = f"transform(sequence(1, {n} - size + 1), start -> array_join(slice({words}, start, size), ' '))"
    return f"flatten(transform(sequence(2, {n} - 1), size -> {inner}))"


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases.

    a, l and r are the counts of the phrase and of its parts at the cut that scores lowest, floor(SCALE * a / (l + r)), n the language's words.
    """
    counts = phrase_counts(docs, least, block_bytes, bucket_bytes)
    known = counts.filter("n_words > 0").select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), F.col("f").alias("__f"))
    phrases = counts.filter("n_words > 1").select("lang", "phrase", F.col("f").alias("a"), "n_words", F.split("phrase", " ").alias("w"))
    cut = phrases.select("lang", "phrase", "a", "n_words", "w", F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("before"), F.expr("array_join(slice(w, k + 1, n_words - k), ' ')").alias("behind"))
    for part, f in (("before", "l"), ("behind", "r")):
        cut = cut.join(known, (F.col("lang") == F.col("__lang")) & (F.col(part) == F.col("__phrase"))).withColumnRenamed("__f", f).drop("__lang", "__phrase")
    score = F.expr(f"CAST((CAST(a AS DECIMAL(20, 0)) * {SCALE}) div (CAST(l AS DECIMAL(20, 0)) + r) AS LONG)")
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    inside = phrases.filter("n_words > 2").select(F.col("lang").alias("__lang"), F.col("a").alias("__a"), F.explode(F.expr(sub_phrases("w", "n_words"))).alias("__phrase"))
    most = inside.groupBy("__lang", "__phrase").agg(F.max("__a").alias("__most"))
    left = scored.join(most, (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__phrase")), "left").filter(f"__most IS NULL OR 100 * __most < {COVERS} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("__share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    left = left.withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__share").orderBy(*order))).filter(F.col("__rank") <= top)
    first = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = counts.filter("n_words = 0").select(F.col("lang").alias("__of"), F.col("f").alias("n"))
    return first.join(total, F.col("lang") == F.col("__of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
