"""Token files compressed by Re-Pair.

Documents are range-sorted by id, encoded, and cut into shards of about ``SHARD_IDS`` ids. In each shard the most
frequent pairs of neighbouring ids are replaced by nonterminals, again and again, never across the end of a document, until
no pair occurs twice or the symbols (16 bits with this vocabulary) are used up.
A shard is one row of a Parquet file (so the write is committed by Spark and works on any file system):

    shard          partition << 20 | number in it; rises with doc_id
    doc_ids        int64s, null ids as the smallest int64
    symbol_ends    int64s: where each document's symbols end
    rules          uint32 pairs: nonterminal terminals + k stands for pair k
    lengths        uint32s: number of ids each nonterminal expands to
    symbols        uint16s, or uint32s if ``wide``
    terminals, n_ids, first_id, last_id

All integers are little-endian. ``Shard.document`` decodes one document by its symbols alone; ``Shard.ids_at`` finds a stretch
of ids by the expansion lengths.

Defined results: null and empty texts hold the end id only; documents with the same id stand in order of their texts' hash;
an empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.arrow import flatten, result, slices
from foliant.llm.common import running_totals
from foliant.llm.tokens import encoder

SHARD_IDS, PART_BYTES = 1 << 20, 16 << 20
END = 2
TERMINALS = 49_408
#: Pairs replaced in one round, and how often a pair must occur.
PER_ROUND, LEAST = 4096, 2
NULL_ID = -(1 << 63)

SCHEMA = pa.schema([("shard", pa.int64()), ("doc_ids", pa.binary()), ("symbol_ends", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("wide", pa.bool_()), ("terminals", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])
SQL_SCHEMA = "shard long, doc_ids binary, symbol_ends binary, rules binary, lengths binary, symbols binary, wide boolean, terminals long, n_ids long, first_id long, last_id long"


def frequent_pairs(code: np.ndarray, none: int, room: int) -> np.ndarray:
    """The codes of the pairs to replace now, most frequent first, ties by code; ``none`` stands for no pair."""
    ordered = np.sort(code)
    ordered = ordered[: np.searchsorted(ordered, ordered.dtype.type(none))]
    if not len(ordered):
        return ordered
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    n = np.diff(np.concatenate((at, [len(ordered)])))
    often = n >= LEAST
    pairs, n = ordered[at[often]], n[often]
    return pairs[np.argsort(-n, kind="stable")][:room]


def compress(ids: np.ndarray, last: np.ndarray, terminals: int = TERMINALS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, which symbols end a document) for ids and the ids that end one.

    Symbols have 16 bits while the vocabulary allows it, a pair's code twice as many; the code of all ones is no
    pair, since the largest symbol is never given away.
    """
    bits, kind, wide = (16, np.uint16, np.uint32) if terminals < 1 << 16 else (32, np.uint32, np.uint64)
    limit = (1 << 16) - 1 - terminals if bits == 16 else 1 << 20
    none = (1 << 2 * bits) - 1
    factor, shift = (wide(0x9E3779B1), wide(12)) if bits == 16 else (wide(0x9E3779B97F4A7C15), wide(44))
    slot = lambda c: (c * factor >> shift).astype(np.int64)
    home = np.empty(1 << 20, np.int16)
    symbol, rules = ids.astype(kind), np.zeros((0, 2), np.uint64)
    while len(symbol) > 1 and len(rules) < limit:
        code = symbol[:-1].astype(wide) << wide(bits) | symbol[1:]
        code[last[:-1]] = none
        found = frequent_pairs(code, none, min(PER_ROUND, limit - len(rules)))
        # a hash table of the pairs; of two in one slot the more frequent stays
        home.fill(-1)
        home[slot(found)[::-1]] = np.arange(len(found), dtype=np.int16)[::-1]
        which = home[slot(code)]
        at = np.flatnonzero(which >= 0)
        at = at[found[which[at]] == code[at]]
        if not len(at):
            break
        # of overlapping pairs every second one is replaced, from the left
        start = np.concatenate(([True], at[1:] != at[:-1] + 1))
        run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        replaced = which[at]
        used = np.bincount(replaced, minlength=len(found)) > 0
        pair = found[used].astype(np.uint64)
        symbol[at] = (terminals + len(rules) - 1 + np.cumsum(used))[replaced]
        last[at] = last[at + 1]
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        symbol, last = symbol[stays], last[stays]
        rules = np.concatenate((rules, np.stack([pair >> np.uint64(bits), pair & np.uint64((1 << bits) - 1)], 1)))
    return symbol, rules, last


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that symbols stand for: pairs take the place of nonterminals until none is left."""
    s = symbols.astype(np.int64)
    while len(s) and (inner := s >= terminals).any():
        n = 1 + inner
        out = np.repeat(s, n)
        second = (np.cumsum(n) - 1)[inner]
        pair = rules[s[inner] - terminals]
        out[second - 1], out[second] = pair[:, 0], pair[:, 1]
        s = out
    return s.astype(np.uint32)


def expand_all(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """The same for a whole shard: each rule is expanded once, and every symbol's ids are copied from there."""
    flat = np.concatenate((np.arange(terminals, dtype=np.uint32), expand(np.arange(terminals, terminals + len(rules)), rules, terminals)))
    length = np.concatenate((np.ones(terminals, np.int64), lengths))
    return flat[flatten(symbols, np.cumsum(length) - length, length)]


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids each nonterminal expands to; a pair refers to earlier ones only."""
    out = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    while len(todo):
        parts = [np.where(rules[todo, k] < terminals, 1, out[np.maximum(rules[todo, k].astype(np.int64) - terminals, 0)]) for k in (0, 1)]
        ready = (parts[0] > 0) & (parts[1] > 0)
        out[todo[ready]] = (parts[0] + parts[1])[ready]
        todo = todo[~ready]
    return out


@dataclass
class Shard:
    """One row of a token file."""

    doc_ids: np.ndarray
    symbol_ends: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    terminals: int

    @classmethod
    def read(cls, row: dict) -> Shard:
        return cls(
            np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["symbol_ends"], "<i8"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64),
            np.frombuffer(row["lengths"], "<u4"), np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2"), row["terminals"])

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.symbol_ends[k - 1] if k else 0 : self.symbol_ends[k]], self.rules, self.terminals)

    def symbol_lengths(self) -> np.ndarray:
        return np.concatenate((np.ones(self.terminals, np.int64), self.lengths))[self.symbols]

    def ids_at(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, expanding only the symbols that hold them."""
        ends = np.cumsum(self.symbol_lengths())
        a, b = np.searchsorted(ends, [start, stop - 1], side="right") if stop > start else (0, -1)
        before = ends[a - 1] if a else 0
        return expand(self.symbols[a : b + 1], self.rules, self.terminals)[start - before : stop - before]


def shard_row(number: int, docs: list, parts: list[np.ndarray], terminals: int) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    last = np.zeros(len(ids), bool)
    last[np.cumsum([len(p) for p in parts]) - 1] = True
    symbols, rules, last = compress(ids, last, terminals)
    wide = bool(terminals + len(rules) > 1 << 16)
    ends = np.flatnonzero(last).astype("<i8") + 1
    known = np.array([NULL_ID if d is None else d for d in docs], "<i8")
    one = [number, known.tobytes(), ends.tobytes(), rules.astype("<u4").tobytes(), rule_lengths(rules, terminals).astype("<u4").tobytes(), symbols.astype("<u4" if wide else "<u2").tobytes(), wide, terminals, len(ids), int(known[0]), int(known[-1])]
    return result(SCHEMA, *[[x] for x in one])


def write(docs: DataFrame, path: str, vocabulary: str, end: int = END, terminals: int = TERMINALS, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` and write the token file at ``path`` in ascending doc_id order, in partitions of about PART_BYTES of text."""
    n = (docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // PART_BYTES + 1
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def shards(batches):
        first, k = TaskContext.get().partitionId() << 20, 0
        held, parts, size = [], [], 0
        for b in slices(batches, "text", 4 << 20):
            flat, n_ids = encoder(vocabulary).encode(b["text"])
            ends = np.cumsum(n_ids)
            for doc, a, z in zip(b["doc_id"].to_pylist(), ends - n_ids, ends):
                held.append(doc)
                parts.append(np.append(flat[a:z], np.uint32(end)))
                size += len(parts[-1])
                if size >= shard_ids:
                    yield shard_row(first + k, held, parts, terminals)
                    held, parts, size, k = [], [], 0, k + 1
        if held:
            yield shard_row(first + k, held, parts, terminals)

    ordered.mapInArrow(shards, SQL_SCHEMA).write.parquet(path)


def id_ranges(ids: np.ndarray, most: int = 64) -> list[tuple[int, int]]:
    """Sorted ids as at most so many ranges, cut at their widest gaps."""
    if not len(ids):
        return []
    gaps = (ids[1:].astype(np.float64) - ids[:-1].astype(np.float64)) if len(ids) > 1 else np.zeros(0)
    cut = np.sort(np.argsort(gaps)[::-1][: most - 1]) + 1
    return [(int(part[0]), int(part[-1])) for part in np.split(ids, cut)]


def read_documents(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids) of some documents, null ids too: shards that can't hold one are passed over by Parquet's statistics (see id_ranges), and only wanted documents' symbols are expanded."""
    wanted = np.unique(np.array([NULL_ID if d is None else d for d in doc_ids], np.int64))
    near = F.lit(False)
    for low, high in id_ranges(wanted):
        near = near | ((F.col("first_id") <= high) & (F.col("last_id") >= low))
    shared = spark.sparkContext.broadcast(wanted)

    def look_up(batches):
        for b in batches:
            for k in range(b.num_rows):
                low, high = (np.searchsorted(shared.value, b[c][k].as_py(), side) for c, side in (("first_id", "left"), ("last_id", "right")))
                if low == high:
                    continue
                s = Shard.read(b.slice(k, 1).to_pylist()[0])
                here = np.flatnonzero(np.isin(s.doc_ids, shared.value[low:high]))
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[here], mask=s.doc_ids[here] == NULL_ID), pa.array([s.document(k).astype(np.int32) for k in here], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spark.read.schema(SQL_SCHEMA).parquet(path).filter(near).mapInArrow(look_up, "doc_id long, ids array<int>")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a token file: doc_id, start, n_tokens, ids_crc32 (and its ids if asked for)."""
    fields = [("doc_id", pa.int64()), ("shard", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    sql = "doc_id long, shard long, inside long, n_tokens long, ids_crc32 long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        sql += ", ids array<int>"
    schema = pa.schema(fields)

    def decode(batches):
        for b in batches:
            for row in b.to_pylist():
                s = Shard.read(row)
                ids = expand_all(s.symbols, s.rules, s.lengths, s.terminals).astype("<u4")
                ends = np.cumsum(s.symbol_lengths())[s.symbol_ends - 1]
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                own = [ids[a:z] for a, z in zip(starts, ends)]
                known = pa.array(s.doc_ids, mask=s.doc_ids == NULL_ID)
                columns = [known, np.full(len(own), row["shard"]), starts, ends - starts, [zlib.crc32(x.tobytes()) for x in own]]
                yield result(schema, *columns, *([[x.astype(np.int32) for x in own]] if with_ids else []))

    files = spark.read.schema(SQL_SCHEMA).parquet(path)
    totals = files.select(F.lit(0).alias("all"), F.shiftright("shard", 20).alias("part"), "shard", "n_ids")
    bases = running_totals(totals, ["all"], "part", [F.col("shard")], "n_ids", "base").select("shard", "base")
    rows = files.mapInArrow(decode, sql).join(bases, "shard")
    return rows.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
