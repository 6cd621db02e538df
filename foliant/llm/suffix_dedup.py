"""Suffix-array dedup by distributed prefix doubling over sampled positions.

The positions that are ranked are anchors (see anchors.py): one in about 39, and every 100 bytes hold one. A sketch of the
anchors' grams (24 bytes) drops positions that are unique from the start. A gram's hash is its first rank.

An anchor stands for the 100-byte windows that begin up to 76 bytes before it. What all windows of a stretch have in common is
its core, what they cover together its hull; at first the core is the gram. Rows with one rank and one hull settle each other:
in all but the first, every window is a repeat, and only the first goes on. Then, round by round, each stretch is cut into
parts, whose cores are longer by the bytes at growing offsets from the anchor: 24, 74, 92, 98, 100 bytes. Spark sorts the pairs (rank of
the old core, bytes added) and numbers those that occur more than once: the new ranks. A position whose pair is unique drops out;
the others are settled by their hulls again and go on until the cores have reached the threshold of 100 bytes, where a core is a window.

A verdict rests on a 128-bit hash of the hull: two different ones of 10**12 share it with a probability below 10**-14.

Defined results: null and empty texts have no bytes; texts shorter than a window keep all; rows with one doc_id stand
level, none before the other; a null doc_id stands before all others; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.anchors import Anchors, broadcast_sketch, find_anchors, maybe_repeated, names_of
from foliant.llm.arrow import result, slices
from foliant.llm.common import U64, discard, mix, stored
from foliant.llm.window_dedup import covered, earliest, is_later, keyed, matched, per_document, unsettled

WINDOW, GRAM = 100, 24
#: Parts that a stretch is cut into in each round.
PARTS = 3


def gram_codes(raw: bytes, gram: int) -> np.ndarray:
    """A hash for each ``gram`` bytes in a row, a multiple of 8."""
    n = len(raw) - gram + 1
    if n <= 0:
        return np.zeros(0, U64)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).astype(U64)
    out = np.zeros(n, U64)
    for k in range(0, gram, 8):
        out = (out ^ eight[k : k + n]) * U64(0x9FB21C651E98DF25)
        out ^= out >> U64(32)
    return mix(out, 7)


def batch_anchors(b: pa.RecordBatch, window: int, gram: int) -> tuple[bytes, np.ndarray, Anchors]:
    texts = [t.encode() if t else b"" for t in b["text"].to_pylist()]
    raw, starts = b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return raw, starts, find_anchors(gram_codes(raw, gram), starts, window, gram)


def parts_of(rows: DataFrame, window: int, width: int) -> DataFrame:
    """The parts of stretches of ``width`` windows, of a PARTS-th of it each.

    A row has its anchor's place ``at``, ``low`` (its stretch begins ``low`` to ``low`` + ``width`` - 1 bytes before the anchor), the windows
    of the stretch that there are (``near`` to ``far`` bytes before it) and their ``hull``. A part has ``more``, a hash of the
    bytes by which its core is longer, on the left and on the right.
    """
    step, found = width // PARTS, []
    for k in range(PARTS):
        low = F.col("low") + k * step
        near, far = F.greatest("near", low), F.least("far", low + step - 1)
        left = F.substring("hull", F.col("far") - low + 1, F.lit(k * step))
        right = F.substring("hull", F.col("far") - F.col("low") - width + window + 2, F.lit((PARTS - 1 - k) * step))
        own = F.substring("hull", F.col("far") - far + 1, far - near + window)
        found.append(F.when(near <= far, F.struct(low.alias("low"), near.alias("near"), far.alias("far"), F.xxhash64(left, right).alias("more"), own.alias("hull"))))
    return rows.select("id", "th", "at", "rank", F.explode(F.array_compact(F.array(*found))).alias("p")).select("id", "th", "at", "rank", "p.*")


def reranked(rows: DataFrame) -> DataFrame:
    """Those rows whose pair (rank, bytes added) occurs more than once, with its number in the order of pairs as the new rank; a stored table in place of ``rows``."""
    key = ["rank", "low", "more"]
    often = rows.groupBy(*key).agg(F.count("*").alias("__n")).filter("__n > 1")
    pairs = stored(often.orderBy(*key).withColumn("new", F.monotonically_increasing_id()))
    ranked = matched(rows, pairs, key, rows.count()).filter("new IS NOT NULL").drop("rank", "more").withColumnRenamed("new", "rank")
    out = stored(ranked.withColumns({"c1": F.xxhash64("hull"), "c2": F.xxhash64(F.lit(1), "hull"), "lo": F.col("at") - F.col("far")}))
    discard(rows, pairs)
    return out


def doubled(rows: DataFrame, window: int, gram: int) -> list[DataFrame]:
    """Tables of (id, th, lo, n), windows that start earlier too, from rows (id, th, at, rank, low, near, far, hull) that no equal hull settles."""
    found, width = [], 1
    while width < window - gram + 1:
        width *= PARTS
    while width > 1:
        ranked = reranked(stored(parts_of(rows, window, width)))
        if ranked.isEmpty():  # all are unique
            break
        ranked = earliest(ranked, ["rank", "near", "far", "c1", "c2"], "lo")
        found.append(ranked.filter(is_later("lo")).select("id", "th", "lo", (F.col("far") - F.col("near") + 1).alias("n")))
        rows, width = ranked.filter(~is_later("lo")), width // PARTS
    return found


def repeated_strings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, th, lo, n): stretches of windows that all start earlier somewhere."""
    texts = keyed(docs)
    shared = broadcast_sketch(docs, lambda batches: (batch_anchors(b, window, gram)[2].gram for b in slices(batches, "text")), (window - gram) // 2)

    def rows(batches):
        for b in slices(batches, "text"):
            raw, starts, a = batch_anchors(b, window, gram)
            a = a.picked(maybe_repeated(shared.value, a.gram))
            c1, c2 = names_of(raw, a.first, a.last + window)
            text, begin = pa.array(a.text), starts[a.text]
            yield pa.RecordBatch.from_arrays(
                [b["id"].take(text), b["th"].take(text), pa.array(a.gram.view(np.int64)), pa.array(c1), pa.array(c2),
                 pa.array((a.at - begin).astype(np.int32)), pa.array((a.first - begin).astype(np.int32)), pa.array((a.last - a.first + 1).astype(np.int32))],
                names=["id", "th", "gram", "c1", "c2", "at", "lo", "n"])

    found = stored(texts.select("id", "th", "text").mapInArrow(rows, "id long, th long, gram long, c1 long, c2 long, at int, lo int, n int"))
    found = earliest(found, ["gram", "c1", "c2"], "lo")
    later = found.filter(is_later("lo")).select("id", "th", "lo", "n")

    def hulls(batches):
        for b in slices(batches, "text"):
            flat, n = b["items"].flatten(), b["items"].value_lengths().to_numpy()
            lo, many = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
            raw, text = [t.encode() for t in b["text"].to_pylist()], np.repeat(np.arange(b.num_rows), n)
            hull = [raw[k][x : x + m - 1 + window] for k, x, m in zip(text.tolist(), lo.tolist(), many.tolist())]
            near, which = flat.field("at").to_numpy() - lo - many + 1, pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [b["id"].take(which), b["th"].take(which), flat.field("at"), flat.field("gram"), pa.array(np.zeros(len(lo), np.int32)), pa.array(near.astype(np.int32)), pa.array((near + many - 1).astype(np.int32)), pa.array(hull, pa.binary())],
                names=["id", "th", "at", "rank", "low", "near", "far", "hull"])

    open_rows = per_document(unsettled(found, ["c1", "c2"]), "gram", "at", "lo", "n")
    single = texts.select("id", "th", "text").join(open_rows, ["id", "th"])
    rest = single.mapInArrow(hulls, "id long, th long, at int, rank long, low int, near int, far int, hull binary")
    for more in doubled(rest, window, gram):
        later = later.unionByName(more)
    return later


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the bytes that are left, if asked for)."""
    runs = per_document(repeated_strings(docs, window, gram), "lo", "n")
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_bytes)

    def remove(batches):
        for b in slices(batches, "text"):
            out = []
            for text, items in zip(b["text"].to_pylist(), b["items"].to_pylist()):
                raw, spans, gone = (text.encode() if text else b""), 0, 0
                left = raw
                if items:
                    hit = covered(len(raw), items, window)
                    gone, spans = int(hit.sum()), int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                    left = np.frombuffer(raw, np.uint8)[~hit].tobytes()
                row = (len(raw), gone, spans, hashlib.sha256(left).hexdigest())
                out.append((*row, left) if with_bytes else row)
            yield result(schema, b["doc_id"], *zip(*out)) if out else pa.RecordBatch.from_pylist([], schema=schema)

    sql = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return keyed(docs).join(runs, ["id", "th"], "left").select("doc_id", "text", "items").mapInArrow(remove, sql)
