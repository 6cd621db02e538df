"""Token counts by a lookup in two tiers on the map side; no piece of text is ever shuffled.

A text is cut into pieces whose ids don't depend on what stands around them (see tokens.py), so a text's count is the sum of its pieces'.

1. Every task goes through its texts with COUNTERS Misra-Gries counters of pieces: whatever more than one in COUNTERS of its pieces
   is equal to is among them at the end. Tasks' summaries, a row each, are added up FAN_IN at a time into summaries of the same size.
2. The lengths of the pieces left become a compact hash table (open addressing, two slots a key, ten bytes a slot: 640 KB), which is broadcast.
3. Every task looks the distinct pieces of a batch up in the table, then in its worker's cache; what neither has is encoded and kept in the cache.

The table only saves work: a piece it lacks is encoded, so counts don't depend on it. Its keys are 64-bit hashes; one of 10**9
other pieces shares one with a probability below 10**-5.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each get their row; null ids pass through; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import result, slices, sums
from foliant.llm.common import U64, discard, stored
from foliant.llm.tokens import CUT, MAX_PIECES, RAW, Encoder, encoder, odd_texts, strings

COUNTERS, FAN_IN = 1 << 15, 16
#: Tokens beyond which a document is over the limit.
LIMIT = 2048
SUMMARY = "task long, pieces array<string>, counts array<long>"


def keyed_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys of the pieces of all texts (see tokens.RAW), each once; the number of each piece's key; each text's number of pieces."""
    plain = ~odd_texts(texts)
    split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(plain)), "\n", " \n"), " ")
    words, n = split.flatten(), split.value_lengths().to_numpy().astype(np.int64)
    first, coded = np.cumsum(n) - n, words.dictionary_encode()
    heads = pc.binary_join_element_wise(RAW, words.take(pa.array(first)), "").dictionary_encode()
    odd = [[RAW + p for p in CUT.split(t)] if t else [] for t in texts.filter(pa.array(~plain)).to_pylist()]
    others = pa.array(list(chain.from_iterable(odd)), pa.string()).dictionary_encode()
    own = coded.indices.to_numpy().astype(np.int64)
    own[first] = len(coded.dictionary) + heads.indices.to_numpy()
    keys = pa.concat_arrays([coded.dictionary, heads.dictionary.cast(pa.string()), others.dictionary])
    if plain.all():
        return keys, own, n
    n_pieces = np.empty(len(plain), np.int64)
    n_pieces[plain], n_pieces[~plain] = n, [len(x) for x in odd]
    index, of_plain = np.empty(n_pieces.sum(), np.int64), np.repeat(plain, n_pieces)
    index[of_plain], index[~of_plain] = own, others.indices.to_numpy() + np.int64(len(coded.dictionary) + len(heads.dictionary))
    return keys, index, n_pieces


@dataclass
class Frequent:
    """Misra-Gries counters: a piece that stands for more than 1 in ``room`` of all counted ones is among ``pieces``."""

    pieces: pa.Array
    counts: np.ndarray
    room: int

    @classmethod
    def none(cls, room: int) -> Frequent:
        return cls(pa.array([], pa.string()), np.zeros(0, np.int64), room)

    def add(self, pieces: pa.Array, counts: np.ndarray) -> None:
        coded = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        total = np.bincount(coded.indices.to_numpy(), np.concatenate((self.counts, counts)), len(coded.dictionary)).astype(np.int64)
        if len(total) > self.room:
            total -= np.partition(total, -self.room - 1)[-self.room - 1]  # what the largest counter without room has, all give up
        left = np.flatnonzero(total > 0)
        self.pieces, self.counts = coded.dictionary.take(pa.array(left)), total[left]

    def row(self, number: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(self.pieces)], self.pieces), pa.ListArray.from_arrays([0, len(self.counts)], pa.array(self.counts))], names=["task", "pieces", "counts"])


def merged(rows: pa.Table, room: int) -> Frequent:
    out = Frequent.none(room)
    for pieces, counts in zip(rows["pieces"], rows["counts"]):
        out.add(pieces.values, counts.values.to_numpy())
    return out


def frequent_pieces(docs: DataFrame, room: int = COUNTERS) -> Frequent:
    """The counters over all texts. A summary has ``room`` rows at most, and FAN_IN of them at most reach one task or the driver."""

    def count(batches):
        found = Frequent.none(room)
        for b in slices(batches, "text"):
            keys, index, _ = keyed_pieces(pc.fill_null(b["text"], ""))
            n = np.bincount(index, minlength=len(keys))
            used = np.flatnonzero(n)
            found.add(keys.take(pa.array(used)), n[used])
        yield found.row(TaskContext.get().partitionId())

    def add_up(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([merged(rows, room).row(rows["task"][0].as_py())])

    rows = stored(docs.select("text").mapInArrow(count, SUMMARY))
    while rows.count() > FAN_IN:
        above = stored(rows.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("task").applyInArrow(add_up, SUMMARY))
        discard(rows)
        rows = above
    out = merged(rows.toArrow(), room)
    discard(rows)
    return out


def hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), U64, len(keys)) | U64(1)


class LengthTable:
    """hash of a key -> number of ids, by open addressing; a hash of 0 is an empty slot."""

    def __init__(self, keys: list[str], lengths: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.slots, self.lengths, self.probes = U64(64 - bits), np.zeros(1 << bits, U64), np.zeros(1 << bits, np.uint16), 0
        for h, n in zip(hashes(keys).tolist(), lengths.tolist()):
            home = h >> (64 - bits)
            for step in range(1 << bits):
                at = (home + step) % (1 << bits)
                if not self.slots[at]:
                    self.slots[at], self.lengths[at], self.probes = h, n, max(self.probes, step + 1)
                    break

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of ids of each key, -1 where the table lacks it."""
        home, out = (h >> self.shift).astype(np.int64), np.full(len(h), -1, np.int64)
        for step in range(self.probes):
            at = (home + step) & (len(self.slots) - 1)
            hit = self.slots[at] == h
            out[hit] = self.lengths[at[hit]]
        return out


def cached_lengths(cache: Encoder, keys: list[str]) -> np.ndarray:
    """The numbers of ids of pieces by the worker's cache, which encodes those it meets for the first time."""
    if len(cache) > MAX_PIECES:
        cache.reset()
    number = [cache[k] for k in keys]
    if cache.fresh:
        cache.learn()
    return cache.length[number]


def length_table(frequent: Frequent, path: str) -> LengthTable:
    """The table of the pieces of ``frequent``; those of more than 65,535 ids aren't in it."""
    keys = strings(frequent.pieces)
    lengths = cached_lengths(Encoder(path), keys) if keys else np.zeros(0, np.int64)
    return LengthTable([k for k, n in zip(keys, lengths) if n < 1 << 16], lengths[lengths < 1 << 16])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, room: int = COUNTERS) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens (no special tokens added), over_limit. ``path``: a vocabulary file (.json)."""
    table = docs.sparkSession.sparkContext.broadcast(length_table(frequent_pieces(docs, room), path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches):
        for b in slices(batches, "text"):
            texts = pc.fill_null(b["text"], "")
            keys, index, n_pieces = keyed_pieces(texts)
            used = np.flatnonzero(np.bincount(index, minlength=len(keys)))
            names, lengths = strings(keys.take(pa.array(used))), np.zeros(len(keys), np.int64)
            found = table.value.find(hashes(names))
            miss = np.flatnonzero(found < 0)
            if len(miss):
                found[miss] = cached_lengths(encoder(path), [names[k] for k in miss])
            lengths[used] = found
            n = sums(lengths[index], np.concatenate(([0], np.cumsum(n_pieces))))
            yield result(schema, b["doc_id"], pc.binary_length(texts).cast(pa.int64()), n, n > limit)

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
