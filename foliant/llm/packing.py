"""Packing documents into sequences of a fixed number of tokens.

Sizes are integers up to the capacity, so an instance is the number of pieces of each size: at most ``capacity``
numbers, whatever the size of the corpus. Spark counts them; Martello and Toth's reduction fixes, for the largest
piece left, a set of at most three that dominates every other set with that piece; best fit places what no
dominance settles. The plan comes back as ranges: pieces number i to j of a size go to sequences from s on, at
one offset. Pieces are numbered inside their size by two-level counts, so no size meets in one task.

Defined results: a null or empty text is one piece of the end token alone; only documents longer than the capacity
are cut, their first piece being the shorter one; repeated rows are packed each; an empty table gives an
empty table; ties in numbering fall to doc_id, piece and checksum.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.arrow import result, slices
from foliant.llm.common import running_totals, stored
from foliant.llm.tokens import encoder

CAPACITY = 2048
END = 0
BLOCKS = 64
#: Beyond so many rows the broadcast of the plan would be refused; a plan has a few rows for each size, so it isn't reached.
MAX_PLAN = 2_000_000


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces of a document; the first may be shorter."""
    first = len(ids) % capacity or min(capacity, len(ids))
    yield 0, ids[:first]
    for start in range(first, len(ids), capacity):
        yield start, ids[start : start + capacity]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    sql = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        sql += ", ids array<int>"
    schema = pa.schema(fields)

    def tokenise(batches):
        for b in slices(batches, "text", 4 << 20):
            flat, n = encoder(vocabulary).encode(b["text"])
            ends = np.cumsum(n)
            rows = []
            for doc, start, stop in zip(b["doc_id"].to_pylist(), ends - n, ends):
                own = np.append(flat[start:stop], np.uint32(END)).astype("<u4")
                for k, (at, ids) in enumerate(cut(own, capacity)):
                    row = (doc, k, at, len(ids), zlib.crc32(ids.tobytes()))
                    rows.append((*row, ids.astype(np.int32)) if with_ids else row)
            yield result(schema, *zip(*rows)) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tokenise, sql)


class Sizes:
    """How many pieces of each size are left; the largest size that is at most a bound."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.left)

    def take(self, size: int, n: int = 1) -> None:
        self.left[size] -= n
        if self.left[size] == 0:
            del self.left[size]
            self.order.pop(bisect_left(self.order, size))

    def give_back(self, size: int) -> None:
        if size not in self.left:
            insort(self.order, size)
        self.left[size] = self.left.get(size, 0) + 1

    def at_most(self, bound: int) -> int | None:
        k = bisect_left(self.order, bound + 1)
        return self.order[k - 1] if k else None

    def smallest(self, n: int, above: int = 0) -> list[int]:
        """The ``n`` smallest pieces that are larger than ``above``."""
        out = []
        for s in self.order[bisect_left(self.order, above + 1) :]:
            out += [s] * min(n - len(out), self.left[s])
            if len(out) == n:
                break
        return out


def dominating(sizes: Sizes, room: int) -> tuple[int, ...] | None:
    """The sizes to put beside a piece that leaves ``room``, if one set of them dominates all others.

    Nothing fits: none. One fills the room, or no two fit together: the largest that fits. Two fit but not three:
    the largest single if it is at least as large as any two that fit together; else the largest and what best
    fits beside it, if of any two that fit together the smaller one is no larger than that.
    """
    largest = sizes.at_most(room)
    if largest is None:
        return ()
    low = sizes.smallest(3)
    if largest == room or len(low) < 2 or low[0] + low[1] > room:
        return (largest,)
    if len(low) == 3 and sum(low) <= room:
        return None
    if largest >= best_pair(sizes, room):
        return (largest,)
    sizes.take(largest)
    beside = sizes.at_most(room - largest)
    sizes.give_back(largest)
    if beside is not None:
        above = sizes.smallest(2, beside)
        if len(above) < 2 or sum(above) > room:
            return (largest, beside)
    return None


def best_pair(sizes: Sizes, room: int) -> int:
    """The largest sum of two pieces that is at most ``room``; 0 if there is none."""
    best = 0
    for a in sizes.order:
        if 2 * a > room:
            break
        b = sizes.at_most(room - a)
        if b is not None and (b > a or b == a and sizes.left[a] > 1):
            best = max(best, a + b)
        elif b == a:  # one piece only of this size, nothing larger fits
            k = bisect_left(sizes.order, a)
            best = max(best, a + sizes.order[k - 1] if k else 0)
    return best


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of one sequence, number of such sequences), for pieces given as size -> number.

    Passes over the sizes from the largest down go on while one of them fixes something. A dominance holds as long as
    its pieces last, because taking pieces away only shrinks the alternatives, so it is applied that many times.
    """
    sizes, plan, fixed = Sizes(counts), [], True
    while fixed:
        fixed = False
        for size in sorted(sizes.left, reverse=True):
            while size in sizes.left:
                here = sizes.left[size]
                sizes.take(size)
                beside = dominating(sizes, capacity - size)
                sizes.give_back(size)
                if beside is None:
                    break
                content = (size, *beside)
                times = min(sizes.left[b] // content.count(b) for b in content)
                plan.append((content, times))
                for b in dict.fromkeys(content):
                    sizes.take(b, times * content.count(b))
                fixed = True
    return plan + best_fit(sizes.left, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, on many equal pieces at a time."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(content: tuple[int, ...], n: int) -> None:
        room = capacity - sum(content)
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((content, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                if n >= each:
                    put((size,) * each, n // each)
                    n %= each
                else:
                    put((size,) * n, 1)
                    n = 0
                continue
            room = rooms[k]
            content, m = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(k)
            used = min(m, n)
            if m > used:
                put(content, m - used)
            put((*content, size), used)
            n -= used
    return [x for held in groups.values() for x in held]


def ranges(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first number, count, per sequence, first sequence, offset) of every stretch of equal pieces."""
    out, used, sequence = [], {}, 0
    for content, n in plan:
        offset = 0
        for size in dict.fromkeys(content):
            each = content.count(size)
            out.append((size, used.get(size, 0), each * n, each, sequence, offset))
            used[size] = used.get(size, 0) + each * n
            offset += each * size
        sequence += n
    return sorted(out)


def assign(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the rows of ``pieces``; other columns stay."""
    spark = parts.sparkSession
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per size
    plan = ranges(plan_packing(counts, capacity))
    if len(plan) > MAX_PLAN:
        raise ValueError(f"a plan of {len(plan)} stretches is too large to send to every task")
    shared = spark.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 6))
    tie = F.xxhash64("doc_id", "piece")
    numbered = running_totals(
        parts.withColumn("__one", F.lit(1)).withColumn("__block", F.pmod(tie, F.lit(BLOCKS))),
        ["length"], "__block", [F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")], "__one", "__number",
    ).drop("__one", "__block")
    schema = parts.schema

    def place(batches):
        plan = shared.value
        keys = plan[:, 0] << 44 | plan[:, 1]
        for b in batches:
            size, number = b["length"].to_numpy(), b["__number"].to_numpy()
            at = plan[np.searchsorted(keys, size << 44 | number, side="right") - 1] if len(plan) else np.zeros((0, 6), np.int64)
            k = number - at[:, 1]
            own = b.select(schema.names)
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(at[:, 4] + k // at[:, 3]), pa.array(at[:, 5] + k % at[:, 3] * size)],
                names=[*schema.names, "sequence_id", "offset"])

    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return numbered.mapInArrow(place, f"{sql}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document goes: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return assign(stored(pieces(docs, vocabulary, capacity)), capacity)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), a group being at most ``capacity`` pieces."""
    placed = assign(stored(pieces(docs, vocabulary, capacity, with_ids=True)), capacity)
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda x: x["ids"])).alias("ids"))
