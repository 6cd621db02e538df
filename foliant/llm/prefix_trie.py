"""The trie of conversations: which openings they share, and what is saved by keeping each opening once.

Every turn gets a 128-bit id from its role and text, and a conversation is the row of its turns' ids. Texts stay behind; only
ids and sizes go on.

1. Rows are dealt to shards by ranges of (ids, conv_id), so that equal openings, even of a third of all rows, fall into
   neighbouring shards and no shard outgrows the others.
2. In a shard the ids become small numbers and a matrix with a row for each conversation, padded by -1 behind its end, BAND columns at a
   time: those that go on beyond a band are taken to the next one. numpy.lexsort puts the rows in order; the masks of where a
   column differs from the row above, OR-accumulated from left to right, mark where the nodes of every depth start, and
   reduceat sums up each depth from the deepest to the root.
3. The nodes on the path of a shard's first or last row may go on in its neighbours. They leave the shard as open nodes, without
   what open nodes below them add, and recombine FAN_IN neighbouring shards at a time: equal ones are added up, and those that are
   no longer on the edge of the range are closed and added to the node above them.
4. The ids of the conversations that end at an open node leave in sorted pieces, and one stream a node hashes them.

Turns and paths are told apart by 128-bit hashes: two of 10**12 different ones share one with a probability below 10**-14.

Defined results: null roles and texts are empty; turns of one conversation with one number (or none) stand in order of their
ids; repeated rows are turns of their own; rows without conv_id belong to no conversation; an empty table has no nodes,
not even a root; other columns are not read. A conversation's ids (16 bytes a turn) meet in one row.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import stored

#: Bytes of ids in a shard, columns of a matrix, shards that recombine in one task, ids of a piece of an open node's ends.
SHARD_BYTES, BAND, FAN_IN, PIECE = 8 << 20, 64, 64, 100_000
ROOT = xxhash.xxh3_128(b"").digest()
NOTHING = hashlib.sha256(b"").hexdigest()
#: Of the rows that shards give: nodes that are whole, nodes on their edges, pieces of the ends of those.
WHOLE, OPEN, ENDS = 0, 1, 2
SCHEMA = pa.schema([
    ("kind", pa.int8()), ("shard", pa.int64()), ("depth", pa.int64()), ("path", pa.binary()), ("above", pa.binary()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends", pa.string()), ("first", pa.bool_()), ("last", pa.bool_())])
SQL_SCHEMA = ("kind byte, shard long, depth long, path binary, above binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, "
              "ends string, first boolean, last boolean")


def turns_of(conversations: DataFrame, by: list[str]) -> DataFrame:
    """(by, turns): the ids and sizes of the turns of each conversation, in order; ``by``: conv_id and what follows from it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("number"), turn_id.alias("id"), F.octet_length(text).alias("size"))
    return conversations.select(*by, turn.alias("t")).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def ids_and_sizes(turns: Column) -> list[Column]:
    return [F.unhex(F.array_join(turns["id"], "")).alias("ids"), turns["size"].cast("array<long>").alias("sizes")]


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, ids, sizes): the first h turns of the family's head (c - c % family), then a conversation's own behind its first h; h = crc32(c) % most."""
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    families = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", (c - c % family).alias("__head")).repartition("__head")
    own = turns_of(families, ["__head", "conv_id"]).withColumn("__h", h)  # the one exchange serves the groups and the window
    of_head = F.max(F.when(c == F.col("__head"), F.slice("turns", 1, most - 1))).over(Window.partitionBy("__head"))
    both = own.withColumn("__first", F.coalesce(F.slice(of_head, F.lit(1), F.col("__h")), F.array().cast("array<struct<id:string,size:int>>")))
    rest = F.when(F.size("turns") > F.col("__h"), F.slice("turns", F.col("__h") + 1, F.size("turns"))).otherwise(F.array().cast("array<struct<id:string,size:int>>"))
    return both.select("conv_id", F.concat("__first", rest).alias("turns")).select("conv_id", *ids_and_sizes(F.col("turns")))


def sha_of(conv_ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, conv_ids.tolist())).encode()).hexdigest()


def numbered(ids: bytes) -> np.ndarray:
    """The rank of each 16-byte id among the distinct ones."""
    halves = np.frombuffer(ids, ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.zeros(len(order), np.int64)
    new[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new)
    return out


class Shard:
    """The nodes of a range of conversations. ``ids`` and ``sizes`` have the turns of one row after the other's."""

    def __init__(self, conv_id: np.ndarray, length: np.ndarray, ids: bytes, sizes: np.ndarray, columns: int = BAND):
        begin, rank = np.cumsum(length) - length, numbered(ids)
        n, deepest = len(conv_id), int(length.max(initial=0))
        order, group, self.starts = np.lexsort((conv_id, length > 0)), np.zeros(n, np.int64), []
        alive = np.arange(n)
        for band in range(0, deepest, columns):
            # positions (in the order so far) of the rows that go on, and the opening that each has
            width = min(columns, deepest - band)
            at, rows = alive, order[alive]
            column = band + np.arange(width)
            inside = column < length[rows][:, None]
            matrix = np.where(inside, rank[np.minimum(begin[rows][:, None] + column, len(rank) - 1)], -1)
            sort = np.lexsort((conv_id[rows], length[rows] > band + width, *matrix.T[::-1], group))  # those that end with the band stand first
            order[at], matrix, inside = rows[sort], matrix[sort], inside[sort]
            change = np.ones(matrix.shape, bool)
            change[1:] = matrix[1:] != matrix[:-1]
            change[1:, 0] |= group[1:] != group[:-1]
            change = np.logical_or.accumulate(change, axis=1)
            for k in range(width):
                there = inside[:, k]
                self.starts.append((at[there], change[there, k]))
            more = length[order[at]] > band + width
            alive, group = at[more], np.cumsum(change[:, -1])[more]
        self.conv_id, self.length, self.begin, self.ids, self.size = conv_id[order], length[order], begin[order], ids, sizes

    def path_keys(self, row: int) -> list[bytes]:
        """Keys of the nodes on a row's path, the root's first."""
        h, out, b = xxhash.xxh3_128(), [ROOT], int(self.begin[row])
        for k in range(b, b + int(self.length[row])):
            h.update(self.ids[16 * k : 16 * k + 16])
            out.append(h.digest())
        return out

    def tables(self, number: int) -> list[pa.Table]:
        n = len(self.conv_id)
        keys = [self.path_keys(0), self.path_keys(n - 1)]
        depths, below, found = [(np.arange(n), np.arange(n) == 0), *self.starts], None, []
        leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)  # what whole nodes give the nodes above them, at the row where they start
        for d in range(len(depths) - 1, -1, -1):
            at, start = depths[d]
            first = np.flatnonzero(start)
            many = np.diff(np.append(first, len(at)))
            conv, end = np.minimum.reduceat(self.conv_id[at], first), at[first + many - 1]
            on_first, on_last = at[first] == 0, end == n - 1
            is_open = on_first | on_last
            children = np.zeros(n, np.int64)
            if below is not None:
                children[below] = 1
            n_children = np.add.reduceat(children[at], first)
            leaf = ~is_open & (self.length[end] == d)  # its last row ends here, so all do
            leaves[at[first[leaf]]] += 1
            size = self.size[self.begin[at[first]] + d - 1] if d else np.zeros(len(first), np.int64)
            saved[at[first]] += np.where(is_open, 0, (many - 1) * size)
            n_leaves, n_saved = np.add.reduceat(leaves[at], first), np.add.reduceat(saved[at], first)
            ending = np.add.reduceat((self.length[at] == d).astype(np.int64), first)  # they stand first in their node
            for a, z in zip(at[first[is_open]].tolist(), end[is_open].tolist()):  # what is below an open node goes up when that one is closed
                leaves[a : z + 1] = saved[a : z + 1] = 0
            found.append([d, at[first], conv, many, n_children, n_leaves, n_saved, size, ending, on_first, on_last])
            below = at[first[~is_open]]
        out, parent = [], None
        for d, at, conv, many, n_children, n_leaves, n_saved, size, ending, on_first, on_last in found[::-1]:
            is_open, ends, pieces = on_first | on_last, [NOTHING] * len(at), []
            path, above = [None] * len(at), [None] * len(at)
            for k in np.flatnonzero(ending).tolist():
                own = self.conv_id[at[k] : at[k] + ending[k]]
                if is_open[k]:
                    pieces += [(k, p, own[p : p + PIECE]) for p in range(0, len(own), PIECE)]
                else:
                    ends[k] = sha_of(own)
            for k in np.flatnonzero(is_open).tolist():
                path[k] = keys[0 if on_first[k] else 1][d]
            up = None
            if parent is not None:
                up = np.searchsorted(parent["at"], at, side="right") - 1
                for k in np.flatnonzero(parent["open"][up]).tolist():
                    above[k] = parent["path"][up[k]]
            null = np.ones(len(at), bool) if up is None else parent["open"][up]
            parent_conv = np.zeros(len(at), np.int64) if up is None else parent["conv"][up]
            columns = [np.where(is_open, OPEN, WHOLE).astype(np.int8), np.full(len(at), number), np.full(len(at), d), pa.array(path, pa.binary()), pa.array(above, pa.binary()), conv,
                       pa.array(parent_conv, mask=null), many, n_children, n_leaves, n_saved, size, pa.array(ends, pa.string()), on_first, on_last]
            out.append(pa.table([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA))
            for k, p, own in pieces:
                row = {"kind": ENDS, "shard": number, "depth": d, "path": path[k], "size": p, "ends": ",".join(map(str, own.tolist()))}
                out.append(pa.Table.from_pylist([row], schema=SCHEMA))
            parent = {"at": at, "open": is_open, "path": path, "conv": conv}
        return out


def shard_nodes(rows: DataFrame, shards: int, band: int = BAND) -> DataFrame:
    """The rows of all shards (see SCHEMA). ``rows``: a stored table of conv_id, ids, sizes."""

    def build(batches):
        conv, length, ids, sizes = [], [], [], []
        for b in batches:
            conv.append(b["conv_id"].to_numpy())
            length.append(b["sizes"].value_lengths().to_numpy())
            ids += b["ids"].to_pylist()
            sizes.append(b["sizes"].flatten().to_numpy())
        if conv and sum(map(len, conv)):
            shard = Shard(np.concatenate(conv), np.concatenate(length).astype(np.int64), b"".join(ids), np.concatenate(sizes), band)
            for t in shard.tables(TaskContext.get().partitionId()):
                yield from t.to_batches(max_chunksize=1 << 16)

    return rows.repartitionByRange(shards, "ids", "conv_id").mapInArrow(build, SQL_SCHEMA)


def recombined(rows: pa.Table, fan_in: int) -> pa.Table:
    """Open nodes of neighbouring shards: equal ones become one; those off the edges of the range are closed and added to the node above."""
    rows = rows.to_pylist()
    low, high, nodes = min(r["shard"] for r in rows), max(r["shard"] for r in rows), {}
    for r in rows:
        n = nodes.setdefault(r["path"], r | {"first": False, "last": False, "conv_id": r["conv_id"], "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0})
        n["conv_id"] = min(n["conv_id"], r["conv_id"])
        n["first"] |= r["first"] and r["shard"] == low
        n["last"] |= r["last"] and r["shard"] == high
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            n[c] += r[c]
    for n in sorted(nodes.values(), key=lambda n: -n["depth"]):
        n["shard"] = low // fan_in
        if not (n["first"] or n["last"]):
            close(n, nodes)
    return pa.Table.from_pylist(list(nodes.values()), schema=SCHEMA)


def close(node: dict, nodes: dict) -> None:
    """A node that nothing more is added to: its own leaf and saving count, for it and for the node above."""
    node["kind"] = WHOLE
    node["n_leaves"] += node["n_children"] == 0
    node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
    above = nodes.get(node["above"])
    if above:
        above["n_children"] += 1
        above["n_leaves"] += node["n_leaves"]
        above["saved_tokens"] += node["saved_tokens"]


def closed(rows: pa.Table) -> pa.Table:
    """The last open nodes: those on the edges of all there is."""
    if not rows.num_rows:
        return rows
    nodes = {n["path"]: n for n in recombined(rows, 1).to_pylist()}
    for n in sorted(nodes.values(), key=lambda n: -n["depth"]):
        if n["kind"] == OPEN:
            close(n, nodes)
    return pa.Table.from_pylist(list(nodes.values()), schema=SCHEMA)


def whole_from_open(opened: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The nodes that shards share, each once, from the open nodes of shards."""
    found, now = [], opened.select(*SCHEMA.names)
    while (now.agg(F.max("shard")).head()[0] or 0) >= fan_in:
        level = stored(now.groupBy(F.floor(F.col("shard") / fan_in).alias("__range")).applyInArrow(lambda rows: recombined(rows, fan_in), SQL_SCHEMA))
        found.append(level.filter(F.col("kind") == WHOLE))
        now = level.filter(F.col("kind") == OPEN)
    out = now.groupBy(F.lit(0).alias("__range")).applyInArrow(closed, SQL_SCHEMA)
    for x in found:
        out = out.unionByName(x)
    return out


def hashes_of_ends(pieces: DataFrame) -> DataFrame:
    """(path, sha): of the conversations that end at each open node, one stream of pieces a node."""

    def stream(batches):
        schema, now, h = pa.schema([("path", pa.binary()), ("sha", pa.string())]), None, None
        for b in batches:
            done = []
            for path, text in zip(b["path"].to_pylist(), b["ends"].to_pylist()):
                if path != now:
                    done += [(now, h.hexdigest())] if now is not None else []
                    now, h = path, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist([{"path": p, "sha": s} for p, s in done], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"path": now, "sha": h.hexdigest()}], schema=schema)

    return pieces.repartition("path").sortWithinPartitions("path", "shard", "size").select("path", "ends").mapInArrow(stream, "path binary, sha string")


def prefix_trie(rows: DataFrame, shard_bytes: int = SHARD_BYTES, band: int = BAND, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each distinct opening of the conversations (conv_id, ids, sizes), the empty one included; columns as in the module's query."""
    rows = stored(rows)
    shards = (rows.agg(F.sum(F.octet_length("ids") + 16)).head()[0] or 0) // shard_bytes + 1
    made = stored(shard_nodes(rows, shards, band))
    kind = F.col("kind")
    shared = stored(whole_from_open(made.filter(kind == OPEN), fan_in).select("depth", "path", "above", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
    facts, numbers = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], F.lit(NOTHING)
    parents = shared.select(F.col("path").alias("__path"), F.col("conv_id").alias("__conv"))
    ends = hashes_of_ends(made.filter(kind == ENDS)).select(F.col("path").alias("__end"), "sha")
    own = shared.join(parents, F.col("above") == F.col("__path"), "left").join(ends, F.col("path") == F.col("__end"), "left")
    own = own.withColumns({"parent_conv_id": F.col("__conv"), "ends_sha256": F.coalesce("sha", numbers)}).select("conv_id", *facts, "ends_sha256")
    # a shard's whole nodes below an open one: one fact for each of the shard's open nodes, so no key outgrows a shard
    opened = made.filter(kind == OPEN).select("shard", "path").join(parents, F.col("path") == F.col("__path")).select(F.col("shard").alias("__shard"), "path", "__conv")
    whole = made.filter(kind == WHOLE).drop("path")
    below = whole.filter("above IS NOT NULL").join(opened, (F.col("shard") == F.col("__shard")) & (F.col("above") == F.col("path")))
    below = below.withColumn("parent_conv_id", F.col("__conv"))
    inner = whole.filter("above IS NULL").unionByName(below.select(*whole.columns))
    return own.unionByName(inner.withColumnRenamed("ends", "ends_sha256").select("conv_id", *facts, "ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = 5, most: int = 9, **sizes: int) -> DataFrame:
    """The trie of the rebuilt conversations; ``sizes``: those of prefix_trie."""
    return prefix_trie(rebuilt(conversations, family, most), **sizes)
