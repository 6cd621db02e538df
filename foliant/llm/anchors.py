"""Content-defined anchors: what lets repeated windows be found from a small part of all positions.

Of the grams (k entries in a row) in a window, the one with the least hash is the window's anchor, the leftmost on a tie.
The choice depends on the window's content alone, so equal windows have equal anchors at equal places, and an anchor
stands for a stretch of neighbouring windows. The sketch counts anchors: a count-min sketch whose cells the tasks fill
and Spark merges; it never says less than the true count, so a window whose anchor is counted once is unique.

The sketch has about four cells for each anchor, up to 2**MAX_BITS a row (64 MB in all, on every executor). That is enough
for some 10 GB of text; on more it lets ever more unique anchors pass. Results stay the same, the tables grow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import U64, mix

#: Rows of the sketch, and the powers of two between which the cells of a row are.
DEPTH, MIN_BITS, MAX_BITS = 2, 20, 28
BLOCK_BITS = 16
#: The low bits of a key hold a place, so so many windows are looked at together.
PLACE = U64((1 << 24) - 1)
CHUNK = 1 << 22


@dataclass
class Anchors:
    """Over all texts of a batch: place and gram hash of each anchor, first and last window it stands for, its text."""

    at: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray

    def picked(self, which: np.ndarray) -> Anchors:
        return Anchors(*(x[which] for x in (self.at, self.gram, self.first, self.last, self.text)))


def least_in_windows(v: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost entry that is least (in its upper 40 bits) in each n entries in a row."""
    out = np.empty(max(0, len(v) - n + 1), np.int64)
    for c in range(0, len(out), CHUNK):
        stop = min(c + CHUNK, len(out))
        key = (v[c : stop + n - 1] & ~PLACE) | np.arange(stop + n - 1 - c, dtype=U64)
        have = 1
        while have < n:
            step = min(have, n - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        out[c:stop] = (key & PLACE).astype(np.int64) + c
    return out


def find_anchors(v: np.ndarray, starts: np.ndarray, window: int, gram: int) -> Anchors:
    """Anchors of texts; text t holds the entries starts[t] to starts[t + 1], and ``v`` has a hash for each gram of them all."""
    owner = least_in_windows(v, window - gram + 1)
    if not len(owner):
        none = np.zeros(0, np.int64)
        return Anchors(none, none.astype(U64), none, none, none)
    edge = np.zeros(len(owner) + 1, np.int32)  # windows that reach over the end of a text
    np.add.at(edge, np.minimum(np.maximum(starts[:-1], starts[1:] - window + 1), len(owner)), 1)
    np.add.at(edge, np.minimum(starts[1:], len(owner)), -1)
    over = np.cumsum(edge[:-1]) > 0
    cut = owner[1:] != owner[:-1]
    first, last = ~over, ~over
    first[1:] &= cut | over[:-1]
    last[:-1] &= cut | over[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return Anchors(owner[first], v[owner[first]], first, last, np.searchsorted(starts, first, side="right") - 1)


def names_of(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each stretch of ``raw``, as two columns; equal for equal stretches wherever they stand."""
    found = b"".join([xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(begin.tolist(), end.tolist())])
    both = np.frombuffer(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def cell_bits(n_anchors: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, (4 * n_anchors).bit_length()))


def cells_of(gram: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(gram, 101 + row) >> U64(64 - bits)).astype(np.int64)


SKETCH_SCHEMA = "block int, once binary, more binary"


def sketch_rows(grams: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """A task's own sketch: for each block of cells, the cells counted once and more often, as 16-bit offsets."""
    all_ = np.concatenate(grams) if grams else np.zeros(0, U64)
    blocks, once, more = [], [], []
    for row in range(DEPTH):
        cell, n = np.unique(cells_of(all_, row, bits), return_counts=True)
        block = (row << (bits - BLOCK_BITS)) + (cell >> BLOCK_BITS)
        for b, c, k in _by_block(block, (cell & ((1 << BLOCK_BITS) - 1)).astype("<u2"), n):
            blocks.append(b)
            once.append(c[k == 1].tobytes())
            more.append(c[k > 1].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "more"])


def _by_block(block, cell, n):
    cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else []
    for a, z in zip(cut, [*cut[1:], len(block)]):
        yield int(block[a]), cell[a:z], n[a:z]


def _merge(batches):
    """Sketch rows sorted by block -> bits of the cells counted twice or more; one block in memory at a time."""
    now, count, out = None, None, []
    flush = lambda: out.append((now, np.packbits(count > 1).tobytes())) if now is not None and (count > 1).any() else None
    for b in batches:
        for block, once, more in zip(b["block"].to_pylist(), b["once"].to_pylist(), b["more"].to_pylist()):
            if block != now:
                flush()
                now, count = block, np.zeros(1 << BLOCK_BITS, np.int8)
            at = np.frombuffer(once, "<u2")
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(more, "<u2")] = 2
        if len(out) > 256:
            yield _bits(out)
            out.clear()
    flush()
    yield _bits(out)


def _bits(out):
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["block", "bits"])


def merged_sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """The bits of all cells, from the tasks' sketch rows; DEPTH * 2**bits bits reach the driver at most."""
    cells = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary")
    whole = np.zeros((DEPTH << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for r in cells.toLocalIterator():
        whole[r.block] = np.frombuffer(r.bits, np.uint8)
    return whole.reshape(DEPTH, -1)


def maybe_repeated(sketch: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """False only for anchors that occur once."""
    yes = np.ones(len(gram), bool)
    for row in range(DEPTH):
        cell = cells_of(gram, row, sketch.shape[1].bit_length() + 2)
        yes &= (sketch[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return yes


def broadcast_sketch(docs: DataFrame, anchors, per_anchor: int):
    """The sketch of all texts of ``docs``, on every executor. ``anchors``: record batches -> grams of each; one anchor in about ``per_anchor`` bytes."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = cell_bits(size // per_anchor)

    def sketch(batches):
        yield sketch_rows(list(anchors(batches)), bits)

    return spark.sparkContext.broadcast(merged_sketch(docs.select("text").mapInArrow(sketch, SKETCH_SCHEMA), bits))
